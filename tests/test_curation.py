"""Rules and tables of curation, row by row."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import curation, relational


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_labels(spark):
    df = spark.createDataFrame([(1, "ring of economy", None), (2, "gear", ["mine"]), (3, "none", []), (4, None, None)], "id long, t string, given array<string>")
    got = {r.id: (r.labels, r.provenance) for r in curation.label_by_rules(df, F.col("t"), [("economy", "e"), ("ring", "r"), ("ring|gear", "e"), ("o", "o")], F.col("given"), most=2).collect()}
    assert got == {1: (["e", "r"], "derived"), 2: (["mine"], "editorial"), 3: (["o"], "derived"), 4: ([], "none")}


def test_contributions_and_variants(spark):
    facts = spark.createDataFrame([(1, "a", "author"), (1, "a", "author"), (1, "a", "supervisor"), (1, "b", "editor"), (1, "b", "author"), (2, None, "author")], "w long, n string, r string")
    assert rows(curation.contributions(facts, "w", F.col("n"), "r")) == [(1, "a", ["author", "supervisor"], True), (1, "b", ["author", "editor"], False), (2, None, ["author"], False)]
    df = spark.createDataFrame([(1, "vol x", "long text"), (2, "x", "y"), (3, None, "vol"), (4, None, None)], "id long, t string, b string")
    assert rows(curation.best_variant(df, "id", {"t": F.col("t"), "b": F.col("b")}, {"t": [("vol", 1)], "b": [("vol", 2), ("long", 1)]})) == [(1, "b", 1), (2, "first", 0), (3, "b", 2), (4, "first", 0)]


def test_admission(spark):
    candidates = spark.createDataFrame([(1, "t"), (2, "t"), (2, "t"), (3, " "), (4, "t"), (5, None), (5, "t")], "k long, title string")
    base = spark.createDataFrame([(1, "b"), (1, "b"), (9, "b")], "k long, title string")
    assert rows(curation.admission(candidates, base, "k", ["title"])) == [("admitted", 1), ("exists already", 1), ("incomplete", 2), ("repeated", 4)]
    assert dict(rows(curation.admission(candidates.limit(0), base, "k", ["title"]))) == {"admitted": 0, "exists already": 0, "incomplete": 0, "repeated": 0}


def test_hits_canon_and_small_tables(spark):
    records = spark.createDataFrame([("p", "small ring"), ("p", "ring"), ("q", "gear"), ("q", None)], "s string, t string")
    asked = spark.createDataFrame([("ring", 1.0), ("gear", 0.5)], "query string, weight double")
    assert rows(curation.source_hits(records, "s", F.col("t"), asked)) == [("gear", 0.5, "p", 0), ("gear", 0.5, "q", 1), ("ring", 1.0, "p", 2), ("ring", 1.0, "q", 0)]
    works = spark.createDataFrame([(1, "k", "c"), (2, "k", "d"), (3, "h", "c"), (4, None, None)], "id long, person string, concept string")
    make = lambda *x: spark.createDataFrame([(v,) for v in x], "v string")
    assert rows(curation.related_canon(works, "person", "concept", make("k", "k"), make("c", "c")).select("id", "concept_overlap")) == [(1, 1), (2, 0)]
    with pytest.raises(ValueError):
        relational.join_rows(records, spark.range(relational.SMALL_ROWS + 1))


def test_misplaced_rows_are_found(spark):
    df = spark.createDataFrame([(1, 1, 3), (2, 2, 0), (3, 2, 1), (4, None, 1)], "id long, b long, w long")
    assert rows(curation.index_state(df, "b", F.col("id"), "w", 0.5)) == [(1, 1, 0, 3, 1.0, True), (2, 2, 1, 1, 0.5, True), (None, 1, 1, 1, 1.0, True)]


def test_reasons_keep_their_order(spark):
    df = spark.createDataFrame([("kant on duty", ["Immanuel Kant"], True, 40, 10, 5, ["kant duty"], ["A", "B"], "10.1/x", 1785, True), ("soul", [], True, 0, 30, 0, ["a", "b"], ["A"], "", None, False), (None, None, None, None, None, None, [], [], None, None, None)], "t string, a array<string>, by boolean, topics int, journal int, outside int, q array<string>, p array<string>, doi string, y int, open boolean")
    builders = lambda: curation.result_reasons(F.col("t"), F.col("a"), F.col("by"), {"Kant": ["kant"]}, {"duty": ["duty", "pflicht"]}, ["kant on duty"], F.col("topics"), F.col("journal"), F.col("outside"), F.col("q"), F.col("p"), F.col("doi"), F.col("y"), F.col("open"))
    got = [r[0] for r in df.select(curation.reasons(builders())).collect()]
    assert got == [["by the person asked for: Immanuel Kant", "title names Kant", "title has the concept duty", "is the work kant on duty", "topics of the discipline", "signals of other disciplines"], ["journal of the discipline", "found by 2 variants of the query", "from A"], []]
    assert len(df.select(curation.reasons(builders(), 20)).first()[0]) == 11
    twice = df.limit(1).select(curation.reasons([F.array(F.lit("x"), F.lit(None)), F.lit(None).cast("array<string>"), F.array(F.lit("y"), F.lit("x"))])).first()[0]
    assert twice == ["x", "y"]
