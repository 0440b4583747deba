"""Answers of several providers merged and ranked as their pages come in, in any order, split and repetition.

State is kept per search: for each result and provider its best score and first answer, of the latest run only. All of it
is a maximum, a minimum or a union, so that a page that comes late, twice, or again after a restart changes nothing that
the batch form would not give. Every search that a batch touches is ranked anew; the ranked lists are written under the
number of the batch, which a replay overwrites, and readers take each search's latest list. A search that has been idle
for a time gives up its state by a timer; what comes for it after that is later than the watermark.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Places of a ranked list.
PLACES = 10
IDLE_MS = 24 * 3600 * 1000
RANKED = "search long, run int, place int, result string, providers int, score double, first_id long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ranks(rows: DataFrame, places: int = PLACES) -> DataFrame:
    """The batch form. rows: search, run, provider, result, score, event_id. Of each search's latest run, results by the
    number of providers, the sum of their best scores in millionths, and name."""
    last = rows.groupBy("search").agg(F.max("run").alias("run"))
    best = rows.join(last, ["search", "run"]).groupBy("search", "run", "result", "provider").agg(F.max(F.round(F.col("score") * 1_000_000).cast("long")).alias("best"), F.min("event_id").alias("first_id"))
    merged = best.groupBy("search", "run", "result").agg(F.count("*").cast("int").alias("providers"), F.sum("best").alias("points"), F.min("first_id").alias("first_id"))
    by = W.partitionBy("search").orderBy(F.desc("providers"), F.desc("points"), "result")
    placed = merged.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= places)
    return placed.select("search", "run", "place", "result", "providers", (F.col("points") / 1_000_000).alias("score"), "first_id")


class Merge(StatefulProcessor):
    """State of one search, and its ranked list after each batch."""

    def __init__(self, places: int, idle_ms: int):
        self.places, self.idle_ms = places, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.found = handle.getMapState("found", "result string, provider string", "best long, first_id long")
        self.run = handle.getValueState("run", "run int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = self.run.get()[0] if self.run.exists() else None
        for part in rows:
            run = int(part["run"].max())
            if latest is None or run > latest:
                latest = run
                self.run.update((run,))
                self.found.clear()
            mine = part[part["run"] == latest]
            best = mine.assign(best=(mine["score"] * 1_000_000).round().astype("int64")).groupby(["result", "provider"]).agg(best=("best", "max"), first_id=("event_id", "min"))
            for (result, provider), (points, first) in zip(best.index, best.itertuples(index=False), strict=True):
                old = self.found.getValue((result, provider)) if self.found.containsKey((result, provider)) else None
                self.found.updateValue((result, provider), (int(max(points, old[0])), int(min(first, old[1]))) if old else (int(points), int(first)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), 0) + self.idle_ms)
        totals: dict[str, list[int]] = {}
        for (result, _), (points, first) in self.found.iterator():
            n, total, least = totals.get(result, (0, 0, first))
            totals[result] = [n + 1, total + points, min(least, first)]
        order = sorted(totals, key=lambda r: (-totals[r][0], -totals[r][1], r))[: self.places]
        yield pd.DataFrame(
            {
                "search": [key[0]] * len(order), "run": [latest] * len(order), "place": range(1, len(order) + 1), "result": order,
                "providers": [totals[r][0] for r in order], "score": [totals[r][1] / 1_000_000 for r in order], "first_id": [totals[r][2] for r in order],
            }
        ).astype({"search": "int64", "run": "int32", "place": "int32", "providers": "int32", "first_id": "int64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.found.clear()
        self.run.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs this store; the setting is read when a stream starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def merge_stream(stream: DataFrame, table: str, checkpoint: str, ts: str = "ts", late: str = "1 hour", places: int = PLACES, idle_ms: int = IDLE_MS):
    """Starts a run over what is there now; table and checkpoint are folders that all executors share.

    stream: search, run, provider, result, score, event_id and a time. Started again with the same checkpoint it goes on
    where it stopped; `latest` reads the table.
    """
    kept = stream.select("search", F.col("run").cast("int").alias("run"), "provider", "result", F.col("score").cast("double").alias("score"), F.col("event_id").cast("long").alias("event_id"), F.col(ts).alias("_ts"))
    ranked = kept.withWatermark("_ts", late).groupBy("search").transformWithStateInPandas(Merge(places, idle_ms), RANKED, outputMode="Update", timeMode="EventTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    with _rocks(stream.sparkSession):
        return ranked.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """Each search's list of the last batch that touched it."""
    rows = spark.read.schema(f"{RANKED}, batch long").parquet(table)
    last = rows.groupBy("search").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["search", "batch"]).drop("batch")
