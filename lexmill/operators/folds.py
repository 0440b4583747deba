"""Ordered folds: records of a block in their stated order, each seeing what those before it have become."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def ordered_fold(rows: DataFrame, block: Column, order: list[Column], start: Callable[[], Any], take: Callable[[Any, tuple], Any], columns: list[str], id_col: str, out: str, kind: str) -> DataFrame:
    """id, out: what take(state, row of `columns`) gives for every row, blocks apart, rows of a block in order.

    Spark deals rows by block and sorts them (spilling if they are many); a task streams over them and holds the state of
    the block that it is in. Null blocks are one block.
    """
    id_kind = dict(rows.dtypes)[id_col]
    dealt = rows.select(block.alias("_b"), F.col(id_col).alias("_id"), *[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    ordered = dealt.repartition("_b").sortWithinPartitions("_b", *[f"_o{i}" for i in range(len(order))], "_id")
    arrow_kind = to_arrow_type(T.DataType.fromDDL(kind))
    slim = ordered.select("_b", "_id", *[f"_c{i}" for i in range(len(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, inside = start(), object()
        for batch in batches:
            values = []
            for at, *row in zip(batch.column(0).to_pylist(), *[batch.column(i).to_pylist() for i in range(2, 2 + len(columns))], strict=True):
                if at != inside:
                    state, inside = start(), at
                values.append(take(state, tuple(row)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(values, arrow_kind)], names=["id", "out"])

    return slim.mapInArrow(run, f"id {id_kind}, out {kind}").select(F.col("id").alias(id_col), F.col("out").alias(out))


class Archive:
    """Works of one person while records of several archives pass."""

    def __init__(self) -> None:
        self.works: list[dict] = []
        self.by_key: dict[str, int] = {}
        self.by_title: dict[tuple, int] = {}
        self.by_name: dict[str, int] = {}
        self.by_curated: dict[str, int] = {}

    def place(self, key: str | None, title: str, year: int | None, curated: bool) -> int | None:
        """Where a record belongs: its key, else title and year, else the title if it or the work there is curated."""
        for index in (self.by_key.get(key) if key else None, self.by_title.get((title, year)), (self.by_name if curated else self.by_curated).get(title)):
            if index is not None:
                return index
        return None

    def enter(self, index: int) -> None:
        work = self.works[index]
        if work["key"]:
            self.by_key[work["key"]] = index
        self.by_title[work["title"], work["year"]] = index
        for name in work["names"]:
            self.by_name[name] = index
            if work["curated"]:
                self.by_curated[name] = index

    def take(self, row: tuple) -> Any:
        """The id of the first record of the work that a record becomes part of; one without a title stands alone."""
        own, key, title, year, curated, doi, abstract = row
        curated, doi, abstract = bool(curated), bool(doi), bool(abstract)
        if not title:
            return own
        index = self.place(key, title, year, curated)
        new = {"first": own, "key": key, "title": title, "year": year, "curated": curated, "doi": doi, "abstract": abstract, "names": {title}}
        if index is None:
            self.works.append(new)
            self.enter(len(self.works) - 1)
            return own
        old = self.works[index]
        leads = curated and not old["curated"] or doi and not old["doi"] or abstract and not old["abstract"]
        first, second = (new, old) if leads else (old, new)
        self.works[index] = {
            "first": old["first"], "key": first["key"] or second["key"], "title": first["title"], "year": first["year"], "names": old["names"] | new["names"],
            **{flag: old[flag] or new[flag] for flag in ("curated", "doi", "abstract")},
        }
        self.enter(index)
        for known in (old["key"], key):
            if known:
                self.by_key[known] = index
        return old["first"]


def archive_fold(rows: DataFrame, block: Column, id_col: str, order: list[Column]) -> DataFrame:
    """id, work: archives of each block's (a person's) works folded in order, so that a record between two works joins one.

    rows: id, key (an identifier, may be null), title (folded), year, curated, doi and abstract (booleans: has it). A
    record that brings what the work lacks (curation, DOI, abstract) leads: later records meet its title and year.
    """
    own = rows.withColumn("_own", F.col(id_col))
    return ordered_fold(own, block, order, Archive, Archive.take, ["_own", "key", "title", "year", "curated", "doi", "abstract"], id_col, "work", dict(rows.dtypes)[id_col])
