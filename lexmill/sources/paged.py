"""Paged services as Spark data sources: sets as partitions of a batch, resumption tokens as offsets of a stream.

A service is a function fetch(set, token) -> (body, next token or None); token is "" for a set's first page. `register`
makes a data source of it, which `spark.read` reads set by set on the executors, and `spark.readStream` page by page: an
offset is the token of each set's next page, so a stream that stops, for whatever reason, asks next for the page that it
had not got. A batch that has to be repeated asks for its own pages again. A row is a page; pages are parsed where they
are used (`harvest.oai_records`), and a page is all that the driver or a worker holds at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from lexmill.sources.harvest import oai_records

Fetch = Callable[[str, str], tuple[str, str | None]]
PAGES = "set string, token string, body string"
#: The offset of a set without further pages.
DONE = "\x00done"


def _sets(options: dict) -> list[str]:
    found = [s.strip() for s in options.get("sets", "").split(",") if s.strip()]
    if not found:
        raise ValueError("the option sets must name the sets to read, separated by commas")
    return found


class _Batch(DataSourceReader):
    def __init__(self, fetch: Fetch, sets: list[str]):
        self.fetch, self.sets = fetch, sets

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.sets]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        token: str | None = ""
        seen: set[str] = set()
        while token is not None and token not in seen:  # a token that a service gives twice ends it
            seen.add(token)
            body, following = self.fetch(partition.value, token)
            yield partition.value, token, body
            token = following


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, fetch: Fetch, sets: list[str]):
        self.fetch, self.sets = fetch, sets

    def initialOffset(self) -> dict:  # noqa: N802
        return {s: "" for s in self.sets}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """The next page of every set that has one."""
        rows, end = [], dict(start)
        for s in self.sets:
            token = start.get(s, "")
            if token != DONE:
                body, following = self.fetch(s, token)
                rows.append((s, token, body))
                end[s] = DONE if following is None or following == token else following
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The pages of a batch again."""
        for s in self.sets:
            token = start.get(s, "")
            while token not in (DONE, end.get(s, "")):
                body, following = self.fetch(s, token)
                yield s, token, body
                token = DONE if following is None or following == token else following

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession, name: str, fetch: Fetch) -> None:
    """Makes a data source of a service; fetch goes to the executors and must only read."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGES

        def reader(self, schema) -> DataSourceReader:
            return _Batch(fetch, _sets(self.options))

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
            return _Stream(fetch, _sets(self.options))

    spark.dataSource.register(Paged)


def harvest(spark: SparkSession, name: str, sets: list[str], changes: str, checkpoint: str):
    """Starts a run over the pages that a service has left; its records, deletions among them, are appended to a log.

    changes and checkpoint are folders that all executors share. A batch is written under its number, which a repeated
    batch overwrites.
    """
    stream = spark.readStream.format(name).option("sets", ",".join(sets)).load()

    def write(pages: DataFrame, number: int) -> None:
        oai_records(pages, "body").write.mode("overwrite").parquet(f"{changes}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def snapshot(spark: SparkSession, changes: str) -> DataFrame:
    """The latest version of every harvested record, by datestamp, then batch; records whose latest version is a deletion are gone."""
    rows = spark.read.parquet(changes)
    by = W.partitionBy("record_id").orderBy(F.desc("datestamp"), F.desc("batch"))
    return rows.withColumn("_r", F.row_number().over(by)).filter((F.col("_r") == 1) & ~F.col("deleted")).drop("_r", "batch")
