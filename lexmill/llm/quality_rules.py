"""Quality rules whose thresholds follow the data: mergeable quantile sketches per language and source.

A document's measures are integers. A sketch is the count of each bin of a number, where a bin keeps its six leading
bits (relative error under 1/32): sketches merge by adding counts, whatever the order, so the thresholds of a group are
the same for any partitioning, and small groups fall back on their language's merged sketch, then on that of all rows.
A rate (parts per million) fails above
    middle + spread * (high - middle) + slack / median size
of its group's quantiles: what most of the group has, and as many events more as `slack` would be in the group's median
document, since a rate that is zero in most documents has no spread of its own. Floor and ceiling are rails for
degenerate groups; on usual data they lie far from the limits.

Null text: no words, so the document fails the base. Null language or source: a group of its own (null-safe joins).
Empty table: no rows. Ties and repeats are measured alike, each row counted. Very long texts are measured whole. Extra
columns pass through the filter untouched, whatever their names; judge reads the id, groups and text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lexmill.llm.common import join_lookup, map_batches, materialise, text_bytes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutters")
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """Fails above middle + spread * (high - middle) + slack / median whole of the group, held in floor..ceiling (ppm)."""

    name: str
    part: str
    whole: str
    slack: int
    middle: float = 0.5
    high: float = 0.8
    spread: float = 4.0
    floor: int = 500
    ceiling: int = 900_000


RULES = (
    Rule("symbol_rate", "n_symbols", "word_chars", slack=20, ceiling=250_000),
    Rule("dup_line_rate", "n_dup_lines", "n_lines", slack=5),
    Rule("repeat_rate", "n_repeat_words", "n_words", slack=6 * WINDOW),
    Rule("stutter_rate", "n_stutters", "n_words", slack=8, ceiling=300_000),
)
#: A group of fewer documents takes the thresholds of its language, or of all.
MIN_GROUP = 100


def measure_text(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text; n_stutters counts words equal to the word before. Windows are compared by 64-bit hashes."""
    data = text_bytes(text)
    words = data.split()  # bytes split at just space and \t-\r
    n = len(words)
    spaces = sum(data.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    if n > WINDOW:
        windows = np.zeros(n - WINDOW + 1, np.uint64)
        for i in range(WINDOW):
            windows = windows * _MULTIPLIER + hashes[i : n - WINDOW + 1 + i]
        ordered = np.sort(windows)
        if len(twice := ordered[1:][ordered[1:] == ordered[:-1]]):
            at = np.flatnonzero(np.isin(windows, twice))
            edges = np.zeros(n + 1, np.int64)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + WINDOW, -1)
            repeated = int((np.cumsum(edges)[:n] > 0).sum())
    return n, len(text or "") - spaces, sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))), len(lines) - len(set(lines)), repeated, len(lines), int((hashes[1:] == hashes[:-1]).sum())


_STRUCT = pa.struct([(m, pa.int64()) for m in MEASURES])


def measure(docs: DataFrame, text_col: str = "text", out: str = "measures") -> DataFrame:
    """docs with a struct of MEASURES, without changing the other columns."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure_text(t) for t in batch.column(place).to_pylist()]
            column = pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(len(MEASURES))], fields=list(_STRUCT))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    kind = T.StructType([T.StructField(m, T.LongType(), False) for m in MEASURES])
    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(out, kind, False)]))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def rate(m: Column, rule: Rule) -> Column:
    """A rule's measure in whole parts per million, 0 where there is nothing to divide by."""
    return F.when(m[rule.whole] > 0, F.floor(1_000_000 * m[rule.part] / m[rule.whole])).otherwise(0).cast("long")


def bin_of(x: Column) -> Column:
    """The number with all but its six leading bits cleared."""
    unit = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(x)) - 6, F.lit(0))).cast("long")
    return x - x % unit


def sketch(measured: DataFrame, groups: list[str], rules: tuple[Rule, ...] = RULES, m: str = "measures") -> DataFrame:
    """Counts per group, rule and bin, of documents that pass the base; partial counts are summed before any shuffle."""
    kept = measured.filter(~base_failed(F.col(m)))
    numbers = {r.name: rate(F.col(m), r) for r in rules} | {r.whole: F.col(m)[r.whole] for r in rules}
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), bin_of(x).alias("bin")) for name, x in numbers.items()])
    return kept.select(*groups, F.explode(pairs).alias("p")).groupBy(*groups, "p.rule", "p.bin").agg(F.count("*").alias("n"))


def thresholds(sketches: DataFrame, groups: list[str], rules: tuple[Rule, ...] = RULES, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per group with a limit per rule, from the narrowest merged sketch of at least min_group documents."""
    levels = [groups[:i] for i in range(len(groups), -1, -1)]
    limits = []
    for keys in levels:
        merged = sketches.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
        by = W.partitionBy(*keys, "rule")
        placed = merged.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("total", F.sum("n").over(by))
        columns = [F.max("total").alias("total")]
        for r in rules:
            at = lambda name, q: F.min(F.when((F.col("rule") == name) & (F.col("upto") >= F.ceil(F.col("total") * q)), F.col("bin")))
            limit = at(r.name, r.middle) + r.spread * (at(r.name, r.high) - at(r.name, r.middle)) + F.lit(r.slack * 1_000_000) / F.greatest(at(r.whole, 0.5), F.lit(1))
            columns.append(F.least(F.lit(r.ceiling), F.greatest(F.lit(r.floor), F.floor(limit))).cast("long").alias(r.name))
        limits.append(placed.groupBy(*keys).agg(*columns))
    out = limits[0]
    for keys, level in zip(levels[1:], limits[1:], strict=True):
        wider = level.select(*[F.col(k).alias(f"w_{k}") for k in keys], *[F.col(c).alias(f"w_{c}") for c in ("total", *[r.name for r in rules])])
        joined = out.join(wider, [out[k].eqNullSafe(wider[f"w_{k}"]) for k in keys] or F.lit(True), "left")
        small = F.col("total") < min_group
        out = joined.select(*groups, F.when(small, F.col("w_total")).otherwise(F.col("total")).alias("total"), *[F.when(small, F.col(f"w_{r.name}")).otherwise(F.col(r.name)).alias(r.name) for r in rules])
    return out.select(*groups, *[F.col(r.name).alias(f"max_{r.name}") for r in rules])


def passes(m: Column, rules: tuple[Rule, ...] = RULES, prefix: str = "max_") -> Column:
    """No rule over its group's limit; a group without limits (every document failed the base) has none to pass."""
    out = ~base_failed(m)
    for r in rules:
        out &= rate(m, r) <= F.coalesce(F.col(f"{prefix}{r.name}"), F.lit(r.ceiling))
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id, measures, base_failed, its group's limits, kept. Texts are read once."""
    measured = materialise(measure(docs.select(id_col, *groups, text_col), text_col).drop(text_col), "quality")
    limits = materialise(thresholds(materialise(sketch(measured, list(groups), rules), "sketch"), list(groups), rules), "limits")
    joined = join_lookup(measured, limits, list(groups))
    m = F.col("measures")
    return joined.select(id_col, *[m[x].alias(x) for x in MEASURES], base_failed(m).alias("base_failed"), passes(m, rules).alias("kept"), *[f"max_{r.name}" for r in rules])


def keep_good(docs: DataFrame, text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their columns. Texts are measured twice rather than shuffled or stored."""
    own = "__lexmill_measures"
    limits = materialise(thresholds(materialise(sketch(measure(docs.select(*groups, text_col), text_col, own), list(groups), rules, own), "sketch"), list(groups), rules), "limits")
    limits = limits.select(*groups, *[F.col(f"max_{r.name}").alias(f"{own}_{r.name}") for r in rules])
    return join_lookup(measure(docs, text_col, own), limits, list(groups)).filter(passes(F.col(own), rules, f"{own}_")).select(*docs.columns)
