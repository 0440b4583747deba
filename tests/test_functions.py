"""Golden cases of the column functions, written by hand."""

import datetime as dt

from pyspark.sql import functions as F

from lexmill.functions import hashing, ids, scoring, text
from lexmill.operators import evaluate, relational
from lexmill.streaming import events


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(x):
    return F.lit(x).cast("string")


def test_text(spark):
    assert one(spark, text.fold(lit("  Élan—Vital, Größe!  ")), text.fold(lit(None)), text.slug(lit("Ça va?"))) == ("elan vital gro e", "", "ca-va")
    assert one(spark, text.has_phrase(lit("the art of war"), lit("art of")), text.has_phrase(lit("the heart of war"), lit("art of"))) == (True, False)
    sim = lambda a, b: one(spark, text.title_similarity(lit(a), lit(b)))[0]
    assert sim("Being and Time", "being, and time!") == 1.0
    assert sim("History of thought vol II", "History of thought vol III") == 0.0
    assert sim("Ethics", "Ethics now") == 0.0
    assert sim("The critique of pure reason", "The critique of pure reason: a reader") == 0.97
    assert round(sim("one two three four", "two three four five"), 6) == round(0.7 * 3 / 5 + 0.3 * 3 / 4, 6)
    assert one(spark, text.initials_compatible(lit("J. Smith"), lit("Jane Smith")), text.initials_compatible(lit("J. Smith"), lit("Jane Ann Smith"))) == (True, False)
    assert one(spark, text.name_signature(lit("Smith, Jane"))) == ("jane smith",)
    assert one(spark, text.voted_language(text.language_votes(lit("le chat et la souris dans les bois")))) == ("fr",)
    assert one(spark, text.voted_language(text.language_votes(lit("xyz")))) == (None,)
    assert one(spark, text.strip_html(lit("<p>a&amp;b</p><script>x</script> <b>c</b>"))) == ("a&b c",)


def test_hashes(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    for s in ("", "a", "hello", "naïve café"):
        assert one(spark, hashing.fnv1a32(lit(s))) == (fnv(s),)
    assert one(spark, hashing.fnv1a32(lit(None))) == (None,)


def test_identifiers_and_dates(spark):
    assert one(spark, ids.doi(lit("https://doi.org/10.1000/ABC.1")), ids.doi(lit("doi: 10.1000/x")), ids.doi(lit("11.1/x"))) == ("10.1000/abc.1", "10.1000/x", None)
    assert one(spark, ids.orcid(lit("https://orcid.org/0000-0002-1825-009x")), ids.isbn(lit("978-0-306-40615-7")), ids.isbn(lit("12"))) == ("0000-0002-1825-009X", "9780306406157", None)
    works = ("https://openalex.org/W123", "w123", " https://api.openalex.org/works/w9 ", "https://explore.openalex.org/authors/A5", "openalex:S1", "W12x", "10.1/W1", None)
    assert one(spark, *[ids.openalex(lit(x).cast("string")) for x in works]) == ("W123", "W123", "W9", "A5", "S1", None, None, None)
    handles = ("http://repo.example.edu/handle/20.500.12059/123", "HDL:10486/7788", "20.500.12059/123/", "https://hdl.handle.net/10486/77?show=full", "https://repo.example/xmlui/handle/123456789/4", "https://example.org/about", None)
    assert one(spark, *[ids.handle(lit(x).cast("string")) for x in handles]) == ("20.500.12059/123", "10486/7788", "20.500.12059/123", "10486/77", "123456789/4", None, None)
    assert one(spark, ids.year(lit("c. 1987, repr.")), ids.year(lit("123456"))) == (1987, None)
    date = lambda x: tuple(one(spark, ids.partial_date(lit(x), 2025))[0])
    assert date("1999-05-07") == ("1999-05-07", "day", "valid")
    assert date("7/5/1999") == ("1999-05-07", "day", "valid")
    assert date("1999-00-00") == ("1999", "year", "valid")
    assert date("1999-05-31") == ("1999-05-31", "day", "valid")
    assert date("1999-02-30")[1] == "month"
    assert date("1969-12-31")[2] == "suspicious" and date("1700")[2] == "suspicious" and date("2031")[2] == "suspicious"
    assert date("") == (None, "none", "unknown") and date(None) == (None, "none", "unknown")


def test_scores(spark):
    assert [one(spark, scoring.level(F.lit(x)))[0] for x in (90, 85, 65, 40, 10)] == ["P1", "P1", "P2", "P3", "P4"]
    assert one(spark, scoring.impact(F.lit(9999)), scoring.impact(F.lit(-3))) == (1.0, 0.0)


def test_overlay_and_previous(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k int, x string")
    cure = spark.createDataFrame([(2, "b"), (9, "z")], "k int, x string")
    assert sorted(map(tuple, relational.overlay(base, cure, "k", ["x"]).collect())) == [(1, "a"), (2, "b")]
    new, old = (spark.createDataFrame(r, "s string, v int") for r in ([("a", 1)], [("a", 0), ("b", 5)]))
    assert sorted(map(tuple, relational.keep_previous(new, old, "s").collect())) == [("a", 1), ("b", 5)]


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("q", i, i) for i in range(1, 11)] + [("r", 1, 1)], "query_id string, id int, rank int")
    judged = spark.createDataFrame([("q", i, 1 if i in (2, 5) else 0) for i in range(1, 11)], "query_id string, id int, grade int")
    rows = {r.query_id: r for r in evaluate.ranking_metrics(run, judged).collect()}
    from math import log2

    assert rows["q"].precision == 0.2 and rows["q"].recall == 1.0 and rows["q"].mrr == 0.5
    assert abs(rows["q"].ndcg - (1 / log2(3) + 1 / log2(6)) / (1 + 1 / log2(3))) < 1e-12
    assert rows["r"].precision is None and rows["r"].mrr is None


def test_streaming_twins(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, 0, 10 * (i % 5), i), i % 2, "click", 1.0, "{}") for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.union(df).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("uniq", events.stream_unique(stream), "append"), ("sess", events.stream_sessions(stream), "complete"), ("tumb", events.stream_tumbling(stream, "10 minutes", ["event_type"]), "complete")):
        run = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination()
    assert spark.table("uniq").count() == 20
    assert spark.table("tumb").agg(F.sum("n")).first()[0] == 40
    assert spark.table("sess").agg(F.sum("n")).first()[0] == 40


def test_sources(spark, tmp_path):
    from lexmill.sources import snapshots as S

    df = spark.createDataFrame([(i, f"name {i}") for i in range(50)], "id long, name string")
    S.write_buckets(df, "name", str(tmp_path / "b"), 8)
    assert spark.read.json(str(tmp_path / "b")).count() == 50
    S.write_shards(df, "id", ["id"], str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 50
    S.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 50
    assert S.manifest(spark, str(tmp_path / "c")).filter("length(sha256) = 64 and bytes > 0").count() >= 1
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{oops\n')
    assert S.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id long", strict=False).collect()[1]["_corrupt"] == "{oops"
    (tmp_path / "snap.json").write_text('{"records": [{"id": 1}, {"id": 2}]}')
    assert S.read_snapshot(spark, str(tmp_path / "snap.json"), "id: long").count() == 2
    assert S.pick_evenly([str(i) for i in range(10)], 4) == ["0", "3", "6", "9"]


def test_totals_at_half_points(spark):
    """A total that decimals put just under a half, and a penalty that doubles put over .15."""
    found, cover, full = F.lit(1), F.lit(0.0), F.lit(13292)
    parts = {"title": cover, "consensus": scoring.consensus(found, found), "impact": scoring.impact(full)}
    total = scoring.total(parts, {"title": 0.5, "consensus": 0.3, "impact": 0.2}, scoring.dispersion_penalty(F.lit(14), cover))
    assert one(spark, total, scoring.dispersion_penalty(F.lit(20), cover).cast("double")) == (14, 0.15)
