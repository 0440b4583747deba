"""Languages by character n-grams: smoothed profiles learned from declared languages, whole texts scored by log probability.

A text is lower-cased; ASCII letters and the bytes of other letters keep their values, everything else is one separator,
of which runs count once. A gram is three such bytes in a row, in texts framed by separators. Tasks count grams per
language in arrays and hand on those that occur, Spark sums them, and the profile (grams that occur at all, by language)
goes back to the tasks: its size is bounded by the alphabet, not by the rows.

Null texts, and texts without letters, have no language. Rows without a declared language do not train. Ties go to the
smaller name. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added to every count of a gram.
SMOOTHING = 0.5
#: Letters are numbered by byte: a to z, then bytes of UTF-8 beyond ASCII; 0 is the separator.
_KIND = np.zeros(256, np.int64)
_KIND[97:123] = np.arange(1, 27)
_KIND[0x80:0xF5] = np.arange(27, 27 + 0xF5 - 0x80)
BASE = int(_KIND.max()) + 1


def grams(text: str | None) -> np.ndarray:
    """Codes of a text's grams, in order."""
    kinds = _KIND[np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    kept = kinds[np.append(True, (kinds[1:] != 0) | (kinds[:-1] != 0))]
    if len(kept) < 3:
        return np.zeros(0, np.int64)
    return (kept[:-2] * BASE + kept[1:-1]) * BASE + kept[2:]


def spelling(code: int) -> bytes:
    """The bytes of a gram, separators as spaces."""
    byte = np.zeros(BASE, np.int64)
    byte[_KIND[_KIND > 0]] = np.flatnonzero(_KIND)
    byte[0] = 32
    return bytes(int(byte[code // BASE**i % BASE]) for i in (2, 1, 0))


@dataclass(frozen=True)
class Profile:
    """Log probabilities: a row per gram that occurs, and one for those that do not; a column per language."""

    languages: list[str]
    codes: np.ndarray
    logs: np.ndarray

    def score(self, text: str | None) -> np.ndarray:
        found = grams(text)
        if not self.languages or not len(found):
            return np.zeros(len(self.languages))
        at = np.minimum(np.searchsorted(self.codes, found), max(0, len(self.codes) - 1))
        rows = np.where(self.codes[at] == found, at, len(self.codes))
        return np.bincount(rows, minlength=len(self.logs)) @ self.logs


def count(docs: DataFrame, text: Column, language: Column) -> DataFrame:
    """language, gram, n over all documents that declare a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for x, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name not in total:
                    total[name] = np.zeros(BASE**3, np.int32)
                codes, n = np.unique(grams(x), return_counts=True)
                total[name][codes] += n.astype(np.int32)
            if len(total) > 8:  # languages that a task holds at once
                yield from _rows(total)
                total = {}
        yield from _rows(total)

    parts = docs.select(text.alias("text"), language.alias("language")).filter("language is not null").mapInArrow(run, "language string, gram int, n long")
    return parts.groupBy("language", "gram").agg(F.sum("n").alias("n"))


def _rows(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, n in total.items():
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64())], names=["language", "gram", "n"])


def learn(docs: DataFrame, text: Column, language: Column, smoothing: float = SMOOTHING) -> Profile:
    """A profile of every declared language."""
    rows = count(docs, text, language).collect()  # languages by grams of the alphabet
    names = sorted({r.language for r in rows})
    codes = np.array(sorted({r.gram for r in rows}), np.int64)
    n = np.zeros((len(codes) + 1, len(names)))
    place = {c: i for i, c in enumerate(codes.tolist())}
    for r in rows:
        n[place[r.gram], names.index(r.language)] = r.n
    return Profile(names, codes, np.log((n + smoothing) / (n.sum(0) + smoothing * len(n)))) if names else Profile([], codes, np.zeros((1, 0)))


def tell(docs: DataFrame, id_col: str, text: Column, profile: Profile) -> DataFrame:
    """id, language, n_grams, margin (to the next language, natural log per gram; null with one language)."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                n = len(grams(x))
                scores = profile.score(x)
                order = sorted(range(len(scores)), key=lambda i: (-scores[i], profile.languages[i]))
                margin = (scores[order[0]] - scores[order[1]]) / n if n and len(order) > 1 else math.nan
                out.append((profile.languages[order[0]] if n and order else None, n, None if math.isnan(margin) else margin))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.float64()), strict=True)]], names=["id", "language", "n_grams", "margin"])

    return docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(run, f"id {kind}, language string, n_grams long, margin double").withColumnRenamed("id", id_col)
