"""Merging, harvesting and query understanding by hand."""

from pyspark.sql import functions as F

from lexmill.operators import merge, relational, understanding
from lexmill.sources import harvest


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 102)], "a long, b long")
    got = {r.id: r.root for r in merge.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 102, 103: 102}


def test_veto(spark):
    rec = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, doi string")
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert sorted(map(tuple, merge.veto(links, rec, "id", "doi").collect())) == [(1, 3), (2, 3)]


def test_oai(spark):
    page = """<OAI-PMH><ListRecords><record><header status="deleted"><identifier>oai:1</identifier><datestamp>2024-02-01</datestamp></header></record>
    <record><header><identifier>oai:2</identifier><datestamp>2024-01-05</datestamp></header><metadata><oai_dc:dc xmlns:dc="x"><dc:title>A &amp; B</dc:title><dc:creator>One</dc:creator><dc:creator>Two</dc:creator></oai_dc:dc></metadata></record>
    <resumptionToken cursor="0">tok|2</resumptionToken></ListRecords></OAI-PMH>"""
    df = spark.createDataFrame([(page,)], "xml string")
    rows = {r.record_id: r for r in harvest.oai_records(df, "xml").collect()}
    assert rows["oai:1"].deleted and rows["oai:2"].title == ["A & B"] and rows["oai:2"].creator == ["One", "Two"]
    assert df.select(harvest.resumption_token(F.col("xml"))).first()[0] == "tok|2"
    old = spark.createDataFrame([("oai:1", "2024-01-01", False), ("oai:3", "2024-01-01", False)], "record_id string, datestamp string, deleted boolean")
    kept = harvest.merge_harvest(old, harvest.oai_records(df, "xml").select("record_id", "datestamp", "deleted"))
    assert sorted(r.record_id for r in kept.collect()) == ["oai:2", "oai:3"]


def test_hosts(spark):
    ok = lambda u: spark.range(1).select(harvest.allowed(F.lit(u), ["example.org"])).first()[0]
    assert [ok(u) for u in ("https://example.org/a", "http://A.example.org:80", "https://badexample.org", "ftp://example.org", "https://example.org@evil.com/")] == [True, True, False, False, False]


def test_expansion_keeps_other_words(spark):
    q = spark.createDataFrame([(1, "Time and being today")], "id long, query string")
    al = spark.createDataFrame([("c", "concept", "being"), ("c", "concept", "and being")], "entity string, kind string, alias string")
    found = understanding.detect(q, "id", "query", al)
    assert [r.alias for r in found.collect()] == ["and being"]
    out = understanding.expansions(q, found, spark.createDataFrame([("c", "Sein", 0.9)], "entity string, label string, weight double"))
    assert sorted((r.query, r.kind) for r in out.collect()) == [("time and being today", "original"), ("time sein today", "translation")]


def test_ids_run_on(spark):
    reg = spark.createDataFrame([("b", 7)], "k string, id long")
    new = spark.createDataFrame([(x,) for x in "abcde"], "k string")
    got = {r.k: r.id for r in relational.allocate_ids(new, reg, "k", "id").collect()}
    assert got["b"] == 7 and sorted(got.values()) == [7, 8, 9, 10, 11]
    assert got == {r.k: r.id for r in relational.allocate_ids(new.repartition(5), reg, "k", "id").collect()}


def test_aliases_of_any_length(spark):
    from lexmill.operators import understanding

    aliases = [("k", "work", "Critique of the Pure Reason"), ("k", "work", "critique"), ("z", "work", "a title of no fewer than nine words, folded"), ("e", "concept", " - ")]
    texts = [(1, "On the critique of the pure reason."), (2, "critique"), (3, "See A title of no fewer than nine words folded!"), (4, "pure reason"), (5, ""), (6, None)]
    got = understanding.detect(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame(aliases, "entity string, kind string, alias string"))
    assert sorted((r.id, r.entity, r.alias) for r in got.collect()) == [(1, "k", "critique of the pure reason"), (2, "k", "critique"), (3, "z", "a title of no fewer than nine words folded")]
    assert understanding.detect(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame([], "entity string, kind string, alias string")).count() == 0


def test_understood_from_tables_ranks_as_by_hand(spark):
    from pyspark.sql import functions as F

    from lexmill.functions import ranking
    from lexmill.operators import understanding

    make = spark.createDataFrame
    aliases = [("kant", "person", "Kant"), ("kant", "person", "Immanuel Kant"), ("duty", "concept", "duty"), ("duty", "concept", "Pflicht"), ("cpr", "work", "Critique of the Pure Reason"), ("eth", "area", "ethics"), ("eth", "area", "moral philosophy")]
    args = make(aliases, "entity string, kind string, alias string"), make([("kant", "E"), ("duty", "E"), ("eth", "E")], "entity string, area string"), make([("duty", "deber", 0.9), ("duty", "Pflicht", 0.9)], "entity string, label string, weight double")
    rows = understanding.understood(make([(1, "Kant on duty and the critique of the pure reason"), (2, "nothing"), (3, None)], "id long, query string"), *args, {"area": 1.0, "concept": 0.55, "person": 0.15})
    got = {r.id: understanding.as_understood(r) for r in rows.collect()}
    want = ranking.Understood(
        original="kant on duty and the critique of the pure reason", expansions=(("kant on deber and the critique of the pure reason", 0.9), ("kant on pflicht and the critique of the pure reason", 0.9)),
        persons=(("immanuel kant", "kant"),), concepts=(("duty", "pflicht"),), works=("critique of the pure reason",), areas=((("ethics", "moral philosophy"), 0.7),),
    )
    assert got[1] == want and got[2] == ranking.Understood(original="nothing") and got[3] == ranking.Understood(original="")
    titles = make([("kant on duty",), ("the critique of the pure reason",), ("soul",)], "t string").withColumn("w", F.split("t", " "))
    assert titles.select(ranking.query_match(F.col("t"), F.col("w"), got[1])).collect() == titles.select(ranking.query_match(F.col("t"), F.col("w"), want)).collect()
