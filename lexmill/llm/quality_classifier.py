"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic steps.

A text's statistics (`STATISTICS`: sizes, shares of kinds of bytes, repetition, entropy) are standardised by the training
rows' means and deviations. `FEATURES` random cosines of seeded frequencies approximate a Gaussian kernel whose width is
the root of the number of statistics. Each task sums the normal equations of its rows per fold, slabs of the sums are
added in groups of at most `TASKS` parts, and the driver solves systems of a fixed size: one for every fold without it,
and one for all. The penalty is the one of least squared error outside the folds, which the sums alone give. Scores of
training rows by the system without their fold are counted in bins; pooling adjacent violators over the bins gives a
rising calibration, read off linearly between the middles of its steps.

Labels are 0 or 1; other values and nulls do not train. Repeated labels of an id count as their mean, repeated rows of an
id each train. Null and empty texts have zero statistics and a score like any other. Null ids are scored and do not
train. Without training rows every score is 0.5. Empty table: no rows. Very long texts are measured whole. Ties score
alike. Other columns may have any names and are not read; id, language and source are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import map_batches, materialise, text_bytes
from lexmill.llm.quality_rules import measure_text

STATISTICS = (
    "log_words", "log_chars", "log_lines", "word_length", "word_length_spread", "distinct_words", "top_word", "entropy", "symbols", "marks", "stops", "digits", "capitals",
    "beyond_ascii", "bare_marks", "dup_lines", "repeated_words", "stutters", "line_words",
)
FEATURES, FOLDS, SEED = 256, 5, 11
PENALTIES = tuple(10.0**k for k in range(-6, 2))
#: Parts that a sum is made of at most; rows of a slab of the normal equations; bins of scores for the calibration.
TASKS, SLAB, BINS = 128, 65, 2000

_CLASS = np.zeros(256, np.int64)
for _i, _some in enumerate((b"#*$%&|<>@^~\\{}[]_=+/", b"!?", b".,;:", b"0123456789", bytes(range(65, 91)), bytes(range(128, 256))), 1):
    _CLASS[list(_some)] = _i


def statistics(text: str | None) -> np.ndarray:
    """STATISTICS of one text."""
    data = text_bytes(text)
    words = data.split()
    out = np.zeros(len(STATISTICS))
    if not words:
        return out
    n_words, n_chars, _, dup_lines, repeated, n_lines, stutters = measure_text(text)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / len(data)
    kinds = np.bincount(_CLASS, counts, 7)[1:] / n_chars
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    numbers = np.unique(np.fromiter(map(hash, words), np.int64, n_words), return_counts=True)[1]
    bare = sum(1 for w in words if len(w) == 1 and not w.isalnum())
    out[:] = (
        np.log1p(n_words), np.log1p(n_chars), np.log1p(n_lines), lengths.mean(), lengths.std(), len(numbers) / n_words, numbers.max() / n_words, -(share * np.log2(share)).sum(),
        *kinds, bare / n_words, dup_lines / n_lines, repeated / n_words, stutters / n_words, np.log1p(n_words / n_lines),
    )
    return out


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["id", "x"])

    return map_batches(docs.select(id_col, text_col), run, f"id {dict(docs.dtypes)[id_col]}, x array<double>")


def _rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(STATISTICS))


@dataclass(frozen=True)
class Features:
    """The random cosines, and the means and deviations by which statistics are standardised first."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray

    @classmethod
    def drawn(cls, mean: np.ndarray, scale: np.ndarray, n: int = FEATURES, seed: int = SEED) -> Features:
        rng = np.random.default_rng(seed)
        return cls(mean, scale, rng.normal(size=(len(mean), n)) / np.sqrt(len(mean)), rng.uniform(0, 2 * np.pi, n))

    def of(self, x: np.ndarray) -> np.ndarray:
        """Cosines whose products approximate the kernel, and a constant."""
        z = np.cos(((x - self.mean) / self.scale).clip(-8, 8) @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(x), 1))])


@dataclass(frozen=True)
class Model:
    features: Features
    weights: np.ndarray
    middles: np.ndarray  # of the calibration's steps, rising
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features.of(x) @ self.weights, self.middles, self.levels)


def _sums(rows: DataFrame, features: Features) -> np.ndarray:
    """Per fold, the sum over rows of v v' for v = (features, label): rows has fold, x, y."""
    size = FEATURES + 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size))
        for batch in batches:
            folds = batch.column(0).to_numpy()
            v = np.hstack([features.of(_rows_of(batch.column(1))), batch.column(2).to_numpy()[:, None]])
            for k in np.unique(folds):
                total[k] += v[folds == k].T @ v[folds == k]
        slabs = [(k, i, total[k, i : i + SLAB].ravel()) for k in range(FOLDS) for i in range(0, size, SLAB)]
        yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in slabs], pa.int32()), pa.array([s[1] for s in slabs], pa.int32()), pa.array([s[2] for s in slabs], pa.list_(pa.float64()))], names=["fold", "at", "cells"])

    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        total = sum(np.asarray(p) for p in parts["cells"].to_pylist())
        return pa.table({"fold": [key[0].as_py()], "at": [key[1].as_py()], "cells": [total]}, schema=pa.schema([("fold", pa.int32()), ("at", pa.int32()), ("cells", pa.list_(pa.float64()))]))

    parts = map_batches(rows.coalesce(TASKS), add, "fold int, at int, cells array<double>")
    out = np.zeros((FOLDS, size, size))
    for r in parts.groupBy("fold", "at").applyInArrow(merge, "fold int, at int, cells array<double>").collect():  # a fixed number of slabs
        out[r.fold, r.at : r.at + SLAB] = np.array(r.cells).reshape(-1, size)
    return out


def _solve(total: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights; the constant is not penalised."""
    gram, right = total[:-1, :-1], total[:-1, -1]
    ridge = np.full(len(gram), penalty * max(1.0, gram[-1, -1]))
    ridge[-1] = 1e-9
    return np.linalg.solve(gram + np.diag(ridge), right)


def fit_weights(sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The penalty of least error outside the folds, the weights without each fold, the weights of all."""
    total = sums.sum(0)
    best = None
    for penalty in PENALTIES:
        without = np.array([_solve(total - s, penalty) for s in sums])
        error = sum(s[-1, -1] - 2 * w @ s[:-1, -1] + w @ s[:-1, :-1] @ w for s, w in zip(sums, without, strict=True))
        if best is None or error < best[0]:
            best = error, penalty, without
    return best[1], best[2], _solve(total, best[1])


def pool(places: np.ndarray, n: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of bins in order: middles and levels of its steps."""
    steps: list[list[float]] = []  # rows, sum of labels, sum of places
    for p, k, m in zip(places, n, mean, strict=True):
        steps.append([k, k * m, k * p])
        while len(steps) > 1 and steps[-2][1] * steps[-1][0] >= steps[-1][1] * steps[-2][0]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last, strict=True)]
    return np.array([p / k for k, _, p in steps]), np.array([y / k for k, y, _ in steps])


def train(described: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Model:
    """described: id, x. labels: rows that may be learnt from."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("label_id")).agg(F.avg(label_col).alias("y"))
    fold = F.pmod(F.xxhash64(F.lit(SEED), F.col("id").cast("string")), F.lit(FOLDS)).cast("int").alias("fold")
    rows = materialise(described.join(known, F.col("id") == F.col("label_id")).select(fold, "x", "y"), "quality-training")
    each = [F.col("x")[i] for i in range(len(STATISTICS))]
    found = rows.agg(F.count("*").alias("n"), *[f(c) for c in each for f in (F.avg, F.stddev_pop)]).first()
    if not found[0]:
        nothing = Features.drawn(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
        return Model(nothing, np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    scale = np.array(found[2::2])
    features = Features.drawn(np.array(found[1::2]), np.where(scale > 1e-9, scale, 1.0))
    _, without, weights = fit_weights(_sums(rows, features))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = (features.of(_rows_of(batch.column(1))) * without[batch.column(0).to_numpy()]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array((score.clip(-1, 2) * BINS).round().astype(np.int32)), batch.column(2)], names=["bin", "y"])

    bins = map_batches(rows, place, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()  # at most 3 * BINS + 1
    middles, levels = pool(np.array([b.bin / BINS for b in bins]), np.array([b.n for b in bins]), np.array([b.y for b in bins]))
    return Model(features, weights, middles, levels)


def score(described: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id") -> DataFrame:
    """One row per row of described: id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(_rows_of(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    kind = dict(described.dtypes)["id"]
    return map_batches(described.select("id", held_out.alias("held_out"), "x"), run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def held_out_third(identity: Column) -> Column:
    """The ids whose labels are not learnt; a null id counts as an empty one."""
    return F.crc32(F.coalesce(identity.cast("string"), F.lit(""))) % 3 == 1


def classify(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column] = held_out_third, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Scores of all documents by a model of the labels that are not held out."""
    described = materialise(describe(docs, id_col, text_col), "statistics")
    model = train(described, labels.filter(~held_out(F.col(id_col))), label_col, id_col)
    return score(described, model, held_out(F.col("id")), id_col)
