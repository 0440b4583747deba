"""Ordered folds against loops, in any partitions, and the chains that an order keeps apart."""

import random

from pyspark.sql import functions as F

from lexmill.operators import folds

SCHEMA = "id long, person string, key string, title string, year int, curated boolean, doi boolean, abstract boolean"


def works_of(spark, rows, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return {r.id: r.work for r in folds.archive_fold(df, F.col("person"), "id", [F.col("id")]).collect()}


def test_a_record_between_two_works_joins_one(spark):
    """2 shares its key with 1 and its title and year with nothing yet; 3 has 2's title, which 1 keeps to itself."""
    rows = [(1, "p", "d1", "alpha", 2000, False, True, True), (2, "p", "d1", "beta", 2001, False, True, True), (3, "p", None, "beta", 2001, False, False, False), (4, "p", "d1", "beta", 2001, False, True, True), (5, "q", "d1", "alpha", 2000, False, True, True)]
    assert works_of(spark, rows) == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}


def test_leading_and_curated_records(spark):
    rows = [
        (1, "p", None, "alpha", 2000, False, False, False), (2, "p", "d1", "alpha", 2000, False, True, False),  # 2 leads by its DOI
        (3, "p", "d1", "gamma", 1999, False, True, True),  # leads by its abstract: title and year are now its own
        (4, "p", None, "gamma", 1999, False, False, False), (5, "p", None, "alpha", 1980, False, False, False),
        (6, "p", None, "alpha", 1970, True, False, False),  # curated: any earlier title will do, the latest entry first
        (7, "p", None, "alpha", 1960, False, False, False), (8, "p", None, None, None, True, True, True), (9, "p", None, "", None, False, False, False),
    ]
    got = works_of(spark, rows)
    assert got[1] == got[2] == got[3] == got[4] == 1 and got[5] == 5 and got[6] == got[7] == 5 and got[8] == 8 and got[9] == 9


def test_any_partitions_and_long_blocks(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["p", "q", None, "r"]) if i % 3 else "hot", rng.choice([None, "a", "b", "c", "d"]), rng.choice(["t1", "t2", "t3", "t4", "t5", "t6", None]), rng.randrange(3), rng.random() < 0.1, rng.random() < 0.3, rng.random() < 0.3) for i in range(3000)]
    want = {}
    for person in {r[1] for r in rows}:
        state = folds.Archive()
        for r in rows:
            if r[1] == person:
                want[r[0]] = state.take((r[0], *r[2:]))
    assert works_of(spark, rows, 1) == want == works_of(spark, rows, 9)


def test_fold_of_any_kind(spark):
    df = spark.createDataFrame([(i, i % 4, float(i * 7 % 11)) for i in range(200)], "id long, g long, x double").repartition(6)

    def take(state, row):
        state.append(row[0])
        return max(state)

    got = {r.id: r.most for r in folds.ordered_fold(df, F.col("g"), [-F.col("id")], list, take, ["x"], "id", "most", "double").collect()}
    assert got == {i: max(float(j * 7 % 11) for j in range(i, 200) if j % 4 == i % 4) for i in range(200)}
