"""Merged and ranked streams against the batch form: any order, split and repetition of pages, and a restart."""

import datetime as dt
import random

import pytest

from lexmill.streaming import merges

SCHEMA = "search long, run int, provider string, result string, score double, event_id long, ts timestamp"
START = dt.datetime(2024, 5, 1)


def pages_of(seed, n=240):
    rng = random.Random(seed)
    return [(rng.randrange(6), rng.choice([0, 0, 1, 2]) if i % 2 else 2, rng.choice("pqr"), f"r{rng.randrange(14)}", round(rng.random(), 3), i, START + dt.timedelta(seconds=i)) for i in range(n)]


def expected(spark, rows):
    return sorted(map(tuple, merges.ranks(spark.createDataFrame(rows, SCHEMA)).collect()))


def found(spark, table):
    df = merges.latest(spark, table).select("search", "run", "place", "result", "providers", "score", "first_id")
    return sorted(map(tuple, df.collect()))


def put(spark, folder, rows, at):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{at}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_split_gives_the_batch_result(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = pages_of(seed)
    shuffled = rows + rng.sample(rows, 60)  # some come twice
    rng.shuffle(shuffled)
    cuts = sorted(rng.sample(range(1, len(shuffled)), 3))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(shuffled)], strict=True)):
        put(spark, f"{tmp_path}/in", shuffled[a:b], i)
    merges.merge_stream(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    assert found(spark, f"{tmp_path}/out") == expected(spark, rows)


def test_a_restart_goes_on_and_a_replay_changes_nothing(spark, tmp_path):
    rows = pages_of(3)
    for i in range(2):
        put(spark, f"{tmp_path}/in", rows[i * 60 : i * 60 + 60], i)
    merges.merge_stream(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    assert found(spark, f"{tmp_path}/out") == expected(spark, rows[:120])
    put(spark, f"{tmp_path}/in", rows[100:], 2)  # with twenty rows again
    merges.merge_stream(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    assert found(spark, f"{tmp_path}/out") == expected(spark, rows)
    last = max((tmp_path / "out").glob("batch=*"), key=lambda p: int(p.name.removeprefix("batch=")))
    for name in (last.name.removeprefix("batch="), f".{last.name.removeprefix('batch=')}.crc"):
        (tmp_path / "at" / "commits" / name).unlink()  # as if it had been lost before its commit
    merges.merge_stream(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    assert found(spark, f"{tmp_path}/out") == expected(spark, rows)


def test_idle_searches_are_given_up(spark, tmp_path):
    rows = [(1, 0, "p", "a", 0.5, 1, START), (2, 0, "p", "b", 0.5, 2, START + dt.timedelta(days=3)), (2, 0, "q", "b", 0.5, 3, START + dt.timedelta(days=9)), (3, 0, "q", "c", 0.5, 4, START + dt.timedelta(days=9))]
    for i, r in enumerate(rows):
        put(spark, f"{tmp_path}/in", [r], i)
    query = merges.merge_stream(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/at")
    query.awaitTermination()
    assert found(spark, f"{tmp_path}/out") == expected(spark, rows)
