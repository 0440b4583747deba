"""Saved works most alike each other within a project: later ones pass in order of their ids until no better can come.

Scores end at 1, and of equal scores the earlier work counts, so a work that has met its number of partners of score 1 needs
no later one. A project's works are cut into blocks of ids; each block meets itself and the next one, and only works that
lack partners of score 1 after that meet all later works. A task holds the works that ask and a tile of those that pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.operators.merge import cut_lineage

# What a shared author and each shared tag add, the most that tags add, the least similarity, partners a work.
SHARED_AUTHOR, SHARED_TAG, MOST_TAGS, SAVED_LEAST, SAVED_PARTNERS = 0.34, 0.08, 0.24, 0.12, 4
#: Works of a block of ids, works that ask at once, works that pass at once, and numbers of a matrix of works and words.
BLOCK, ASKING, TILE, CELLS = 4096, 1024, 512, 2**23
_FIELDS = ("words", "authors", "tags")
#: Names compared one by one; works of more share authors by a matrix product.
_FEW = 4


def _listed(codes: np.ndarray, sizes: np.ndarray, wide: int) -> np.ndarray:
    """Rows of codes, filled up with -2."""
    out = np.full((len(sizes), wide), -2, np.int32)
    nth = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), nth] = codes
    return out


def _marks(codes: np.ndarray, sizes: np.ndarray, terms: int) -> np.ndarray:
    """A row of 0 and 1 for each list of codes; -1 is unknown."""
    out, row = np.zeros((len(sizes), terms), np.float32), np.repeat(np.arange(len(sizes)), sizes)
    out[row[codes >= 0], codes[codes >= 0]] = 1
    return out


class _Asking:
    """Works that ask, in the order of their ids, and the best partners of each so far."""

    def __init__(self, rows: pa.RecordBatch, partners: int, least: float):
        self.ids, self.order, self.partners, self.least = rows["id"], rows["nth"].to_numpy(), partners, least
        flat = {f: rows[f].flatten().dictionary_encode() for f in _FIELDS}
        self.terms = {f: x.dictionary for f, x in flat.items()}
        self.lists = {f: (flat[f].indices.to_numpy(), pc.list_value_length(rows[f]).to_numpy()) for f in _FIELDS}
        self.cells = len(rows) * max(len(t) for t in self.terms.values())
        self.top_order = np.zeros(0, np.int64)
        self.top = tuple(np.zeros(0, t) for t in (np.int64, float, np.int64))  # row, score, place in `found`
        self.found: list[pa.Array] = []
        self.worst = np.full(len(rows), -1.0)
        self.marks: dict[str, np.ndarray] | None = None

    def open(self) -> np.ndarray:
        return np.flatnonzero(self.worst < 1)

    def meet(self, ids: pa.Array, order: np.ndarray, lists: dict[str, tuple[pa.Array, np.ndarray]]) -> None:
        """Works that pass, in order, after those that passed before."""
        rows = self.open()
        rows = rows[self.order[rows] < order[-1]]
        if not len(rows):
            return
        if self.marks is None:
            self.marks = {f: _marks(*self.lists[f], len(self.terms[f])) for f in ("words", "tags")}
        codes = {f: pc.fill_null(pc.index_in(x, value_set=self.terms[f]), -1).to_numpy() for f, (x, _) in lists.items()}
        own = {f: self.lists[f][1][rows] for f in _FIELDS}
        sizes = {f: n for f, (_, n) in lists.items()}
        common = lambda f: self.marks[f][rows] @ _marks(codes[f], sizes[f], len(self.terms[f])).T
        words, tags = common("words"), common("tags")
        union = own["words"].astype(np.float32)[:, None] + sizes["words"].astype(np.float32) - words
        score = words / np.maximum(union, 1)
        author = self._authors(rows, codes["authors"], sizes["authors"])
        score += author * np.float32(SHARED_AUTHOR)
        score += np.minimum(tags * np.float32(SHARED_TAG), np.float32(MOST_TAGS))
        # about as good as the worst partner, or admitted; the exact score of these follows
        hit = score >= np.minimum(np.maximum(self.worst[rows], self.least), 1).astype(np.float32)[:, None] - np.float32(1e-5)
        if order[0] <= self.order[rows[-1]]:
            hit &= order > self.order[rows][:, None]
        i, j = np.nonzero(hit)
        both = words[i, j].astype(float)
        exact = both / np.maximum(own["words"][i] + sizes["words"][j] - both, 1) + np.where(author[i, j], SHARED_AUTHOR, 0.0) + np.minimum(MOST_TAGS, tags[i, j].astype(float) * SHARED_TAG)
        exact = np.floor(np.minimum(1.0, exact) * 1e6 + 0.5) / 1e6
        good = (exact >= self.least) & (exact > self.worst[rows[i]])
        if good.any():
            self._take(rows[i[good]], exact[good], j[good], ids, order)

    def _authors(self, rows: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        mine, own = self.lists["authors"]
        wide, other = int(own.max(initial=0)), int(sizes.max(initial=0))
        if wide > _FEW or other > _FEW:
            if "authors" not in self.marks:
                self.marks["authors"] = _marks(mine, own, len(self.terms["authors"]))
            return self.marks["authors"][rows] @ _marks(codes, sizes, len(self.terms["authors"])).T > 0
        found = np.zeros((len(rows), len(sizes)), bool)
        left, right = _listed(mine, own, wide)[rows], _listed(codes, sizes, other)
        for a in left.T:
            for b in np.where(right < 0, -1, right).T:  # what fills up equals nothing
                found |= a[:, None] == b
        return found

    def _take(self, row: np.ndarray, score: np.ndarray, at: np.ndarray, ids: pa.Array, order: np.ndarray) -> None:
        before = sum(map(len, self.found))
        self.found.append(ids)
        row, score, at = (np.concatenate(x) for x in zip(self.top, (row, score, before + at), strict=True))
        seen = np.concatenate([self.top_order, order[at[len(self.top_order):] - before]])
        best = np.lexsort((seen, -score, row))
        row, score, at, seen = row[best], score[best], at[best], seen[best]
        nth = np.arange(len(row)) - np.searchsorted(row, row, "left")
        kept = nth < self.partners
        row, score, at, seen, nth = row[kept], score[kept], at[kept], seen[kept], nth[kept]
        last = nth == self.partners - 1
        self.worst[row[last]] = score[last]
        # only the ids of partners stay
        whole = pa.chunked_array(self.found).take(pa.array(at)).combine_chunks()
        self.found, self.top, self.top_order = [whole], (row, score, np.arange(len(row))), seen

    def answers(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        row, score, at = self.top
        b = pa.chunked_array(self.found, self.ids.type).take(pa.array(at)).combine_chunks()
        return self.ids.take(pa.array(row)), b, pa.array(score)


def _groups(rows: pa.RecordBatch, partners: int, least: float) -> Iterator[_Asking]:
    """Works that ask in groups whose matrices stay under CELLS."""
    made = _Asking(rows, partners, least) if len(rows) <= ASKING else None
    if made is not None and (made.cells <= CELLS or len(rows) == 1):
        yield made
        return
    half = len(rows) // 2
    yield from _groups(rows.slice(0, half), partners, least)
    yield from _groups(rows.slice(half), partners, least)


def _best(dealt: DataFrame, least: float, partners: int) -> DataFrame:
    """project, a, b, similarity: of dealt(project, cell, passes, nth, id, ...) the best that pass in a cell for each that asks."""
    kinds = dict(dealt.dtypes)
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["project", "cell", "passes", "nth", "id", *_FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, held, groups = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            for g in groups or ():
                a, b, score = g.answers()
                yield pa.RecordBatch.from_arrays([pa.array([inside[0]] * len(a), project), a, b, score], names=["project", "a", "b", "similarity"])

        for whole in batches:
            project = whole["project"].type
            keys = list(zip(whole["project"].to_pylist(), whole["cell"].to_pylist(), whole["passes"].to_pylist(), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if keys[lo][:2] != inside:
                    yield from close()
                    inside, held, groups = keys[lo][:2], [], None
                batch = whole.slice(lo, hi - lo)
                if not keys[lo][2]:
                    held.append(batch)
                    continue
                if groups is None:
                    groups = list(_groups(pa.Table.from_batches(held).combine_chunks().to_batches()[0], partners, least)) if held else []
                    held = []
                for at in range(0, len(batch), TILE):
                    if not any(len(g.open()) for g in groups):
                        break
                    tile = batch.slice(at, TILE)
                    lists = {f: (tile[f].flatten(), pc.list_value_length(tile[f]).to_numpy()) for f in _FIELDS}
                    for g in groups:
                        g.meet(tile["id"], tile["nth"].to_numpy(), lists)
        yield from close()

    ordered = dealt.select(*columns).repartition(parts, "project", "cell").sortWithinPartitions("project", "cell", "passes", "nth")
    return ordered.mapInArrow(run, f"project {kinds['project']}, a {kinds['id']}, b {kinds['id']}, similarity double")


def saved_similarity(saved: DataFrame, project: str, id_col: str, least: float = SAVED_LEAST, partners: int = SAVED_PARTNERS, block: int = BLOCK) -> DataFrame:
    """project, a, b, similarity: of each saved work the most alike later ones of its project, by similarity, then id.

    saved: project, id, words, authors, tags (arrays, compared as sets). The Jaccard similarity of the words, more for a
    common author and for common tags, at most 1.
    """
    distinct = [F.coalesce(F.array_distinct(F.array_compact(c)), F.array().cast("array<string>")).alias(c) for c in _FIELDS]
    rows = saved.select(F.col(project).alias("project"), F.col(id_col).alias("id"), *distinct).filter("project is not null and id is not null")
    nth = F.rank().over(W.partitionBy("project").orderBy("id"))
    rows = cut_lineage(rows.withColumn("nth", nth.cast("long")).withColumn("block", F.floor((F.col("nth") - 1) / block)))
    side = lambda r, passes, cell: r.withColumn("passes", F.lit(passes)).withColumn("cell", cell)
    near = side(rows, True, F.explode(F.array_compact(F.array(F.col("block"), F.when(F.col("block") > 0, F.col("block") - 1)))))
    first = cut_lineage(_best(side(rows, False, F.col("block")).unionByName(near), least, partners))
    last = rows.groupBy("project").agg(F.max("block").alias("last"))
    full = first.filter("similarity >= 1").groupBy("project", "a").agg(F.count("*").alias("n")).filter(F.col("n") >= partners)
    rest = rows.join(last, "project").filter("block + 1 < last").join(full.select("project", F.col("a").alias("id")), ["project", "id"], "left_anti")
    rest = cut_lineage(rest.select(*rows.columns))
    chunks = cut_lineage(rest.groupBy("project").agg(F.ceil(F.count("*") / block).alias("chunks"), F.min("nth").alias("from")))
    asks = side(rest.join(chunks, "project"), False, F.pmod(F.xxhash64("id"), F.col("chunks")))
    later = rows.join(chunks, "project").filter(F.col("nth") > F.col("from"))
    more = _best(asks.unionByName(side(later, True, F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)))), least, partners)
    return first.join(rest.select("project", F.col("id").alias("a")), ["project", "a"], "left_anti").unionByName(more)
