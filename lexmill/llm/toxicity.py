"""Toxicity by a classifier chain: linear models in sequence, each fed the earlier categories' probabilities.

The labelled sample is bounded (`max_rows` label rows, those with the smallest seeded hashes); everything else covers
all documents. Features are character n-grams of the normalised text, words' edges included, chosen by a two-proportion
score per category from counts made in Spark, and found in a text by one Aho-Corasick pass. The models are logistic;
what a later model is trained on are out-of-fold probabilities of the earlier ones, so that it meets in training what
it will meet on unseen texts: a fold's n-grams are chosen, and its models fitted, without the fold. A category's cut-off
is the one of best F1 on its out-of-fold probabilities.

Null or empty text: no features, so the models' base rate. Texts of any length are read whole. Null labels are left out
of training, labels without a document too; with no labels or one class only, the probability is the smoothed share.
Repeated ids keep each of their rows when scored; in training a label row takes the smallest text of its id. Ties of
hashes go by labels, ties of scores by n-gram. Empty docs: no rows. Only id, text and label columns are read, so others
may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmill.llm.common import map_batches, materialise
from lexmill.llm.license_scan import normalise

#: Rows of the training sample, n-gram lengths, n-grams chosen per category, rows that must have one, folds.
MAX_ROWS, LENGTHS, PER_CATEGORY, MIN_ROWS, FOLDS = 6000, (4, 5, 6), 400, 5, 5
L2, ROUNDS = 1e-3, 250


@dataclass(frozen=True)
class Category:
    name: str
    column: str
    positive: int = 1


@dataclass
class Chain:
    """weights[i]: of the n-grams, then of the earlier categories' probabilities, then the intercept."""

    categories: list[str]
    grams: list[str]
    weights: list[np.ndarray] = field(default_factory=list)
    cuts: list[float] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.hstack([out, _sigmoid(np.hstack([x, out, np.ones((len(x), 1))]) @ w)[:, None]])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Accelerated gradient descent on the L2-penalised log loss; the last weight is the intercept, unpenalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    prior = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(x.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    if not 0 < y.sum() < len(y):
        return w
    penalty = np.full(len(w), L2)
    penalty[-1] = 0
    step = 1 / (0.25 * np.linalg.norm(x, 2) ** 2 / len(x) + L2) if min(x.shape) < 64 else 1 / (0.25 * _top_eigenvalue(x) / len(x) + L2)
    ahead, before = w.copy(), w.copy()
    for i in range(ROUNDS):
        gradient = x.T @ (_sigmoid(x @ ahead) - y) / len(y) + penalty * ahead
        w = ahead - step * gradient
        ahead = w + i / (i + 3) * (w - before)
        before = w
    return w


def _top_eigenvalue(x: np.ndarray) -> float:
    v = np.ones(x.shape[1])
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    return 1.05 * float(v @ (x.T @ (x @ v)))


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of best F1, midway to the next lower probability, within 0.1 to 0.9; 1 without positives."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    if not len(y) or hits[-1] == 0:
        return 1.0
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + hits[-1])
    ends = np.append(p[order][1:] < p[order][:-1], True)
    i = int(np.argmax(np.where(ends, f1, 0)))
    below = p[order][i + 1] if i + 1 < len(p) else 0.0
    return float(np.clip((p[order][i] + below) / 2, 0.1, 0.9))


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, names: list[str], grams: list[str], chosen: list[np.ndarray]) -> Chain:
    """labels: a column per category, in chain order; chosen: features for each fold, then those for all rows."""
    chain, held = Chain(names, [grams[i] for i in chosen[-1]]), np.zeros((len(x), 0))
    for j in range(len(names)):
        y = labels[:, j].astype(float)
        out = np.zeros(len(x))
        for f in range(FOLDS):
            test = folds == f
            if test.any():
                inputs = np.hstack([x[:, chosen[f]], held])
                out[test] = _sigmoid(np.hstack([inputs[test], np.ones((int(test.sum()), 1))]) @ fit_logistic(inputs[~test], y[~test]))
        chain.weights.append(fit_logistic(np.hstack([x[:, chosen[-1]], held]), y))
        chain.cuts.append(best_cut(out, y))
        held = np.hstack([held, out[:, None]])
    return chain


def _framed(text: str | None) -> str:
    return f" {normalise(text).decode('utf-8', 'surrogatepass')} "


def featurise(texts: list[str | None], grams: list[str]) -> np.ndarray:
    """log(1 + count) of each n-gram."""
    import ahocorasick

    found = np.zeros((len(texts), len(grams)))
    if not grams:
        return found
    automaton = ahocorasick.Automaton()
    for i, g in enumerate(grams):
        automaton.add_word(g, i)
    automaton.make_automaton()
    for row, text in enumerate(texts):
        for i, n in Counter(i for _, i in automaton.iter(_framed(text))).items():
            found[row, i] = n
    return np.log1p(found)


def train(docs: DataFrame, labels: DataFrame, categories: tuple[Category, ...], id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, seed: int = 7) -> Chain:
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    marks = [(F.col(c.column) == c.positive).cast("int").alias(f"y{i}") for i, c in enumerate(categories)]
    known = labels.dropna(subset=[id_col, *{c.column for c in categories}])
    # hashes far above what the sample needs are left out before the sort; the sample is bounded by max_rows
    n = known.count()
    if n > 4 * max_rows:
        known = known.filter(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") < int(2**33 * max_rows / n))
    sample = known.select(F.col(id_col).alias("sample_id"), key.alias("key"), *marks).orderBy("key", *[f"y{i}" for i in range(len(marks))]).limit(max_rows)
    fold = F.pmod(F.conv(F.substring("key", 1, 6), 16, 10).cast("int"), F.lit(FOLDS)).alias("fold")
    names = [f"y{i}" for i in range(len(marks))]
    numbered = sample.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy(*names)))
    found = docs.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("text")).join(F.broadcast(numbered), F.col("text_id") == F.col("sample_id"))
    rows = materialise(found.groupBy("key", "nth", *names).agg(F.min("text").alias("text")).select("text", fold, *names), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers: dict[str, int] = {}
            seen, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            cell = batch.column(1).to_numpy().astype(np.int64)
            for i in range(len(names)):
                cell = 2 * cell + batch.column(2 + i).to_numpy()
            for text, c in zip(batch.column(0).to_pylist(), cell, strict=True):
                framed = _framed(text)
                grams = {framed[i : i + n] for n in LENGTHS for i in range(len(framed) - n + 1)}
                seen.append(np.fromiter((numbers.setdefault(g, len(numbers)) for g in grams), np.int64, len(grams)))
                cells.append(np.full(len(grams), c))
            both, n = np.unique(np.concatenate(seen) * n_cells + np.concatenate(cells), return_counts=True)
            texts = pa.array(list(numbers), pa.string())
            yield pa.RecordBatch.from_arrays([texts.take(pa.array(both // n_cells)), pa.array((both % n_cells).astype(np.int32)), pa.array(n.astype(np.int64))], names=["gram", "cell", "n"])

    # a cell is a fold with one combination of labels
    per_fold = 2 ** len(names)
    n_cells = FOLDS * per_fold
    cell_of = F.col("fold")
    for c in names:
        cell_of = 2 * cell_of + F.col(c)
    sizes = np.zeros(n_cells, np.int64)
    for r in rows.groupBy(cell_of.alias("cell")).count().collect():
        sizes[r["cell"]] = r["count"]
    counted = map_batches(rows, count, "gram string, cell int, n bigint").groupBy("gram").agg(*[F.coalesce(F.sum(F.when(F.col("cell") == c, F.col("n"))), F.lit(0)).alias(f"c{c}") for c in range(n_cells)])
    sum_of = lambda cells: reduce(Column.__add__, [F.col(f"c{c}") for c in cells])
    picked: list[list[str]] = []
    if sizes.sum():
        scores = []
        for f in range(FOLDS + 1):
            inside = [c for c in range(n_cells) if c // per_fold != f]
            n = sum_of(inside)
            for j in range(len(names)):
                with_mark = [c for c in inside if (c >> (len(names) - 1 - j)) & 1]
                positive, all_rows = max(1, int(sizes[with_mark].sum())), max(1, int(sizes[inside].sum()))
                share = sum_of(with_mark) / positive - (n - sum_of(with_mark)) / max(1, all_rows - positive)
                scores.append(F.when(n >= MIN_ROWS, share / F.sqrt(n / all_rows / positive + 1e-9)).alias(f"z_{f}_{j}"))
        ranked = materialise(counted.filter(sum_of(range(n_cells)) >= MIN_ROWS).select("gram", *scores), "toxicity-grams")
        for f in range(FOLDS + 1):
            best = [ranked.filter(F.col(f"z_{f}_{j}").isNotNull()).orderBy(F.desc(f"z_{f}_{j}"), "gram").limit(PER_CATEGORY).select("gram") for j in range(len(names))]
            picked.append(sorted({r["gram"] for r in reduce(DataFrame.union, best).collect()}))  # at most PER_CATEGORY for each category
    grams = sorted({g for some in picked for g in some})
    place = {g: i for i, g in enumerate(grams)}
    chosen = [np.array([place[g] for g in some], np.int64) for some in picked] or [np.zeros(0, np.int64)] * (FOLDS + 1)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = featurise(batch.column(0).to_pylist(), grams)
            sparse = [[{"i": int(i), "x": float(v[i])} for i in np.flatnonzero(v)] for v in x]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(1, 2 + len(names))], pa.array(sparse, pa.list_(pa.struct([("i", pa.int32()), ("x", pa.float64())])))], names=["fold", *names, "v"])

    found = map_batches(rows, vectors, f"fold int, {', '.join(f'{c} int' for c in names)}, v array<struct<i: int, x: double>>").toArrow()
    x = np.zeros((len(found), len(grams)))
    for row, v in enumerate(found["v"].to_pylist()):
        for e in v:
            x[row, e["i"]] = e["x"]
    y = np.array([found[c].to_pylist() for c in names]).T.reshape(len(found), len(names))
    # rows in one order whatever the partitions, so that the fit is the same
    order = np.lexsort((*x.T[:50], *y.T, found["fold"].to_numpy())) if len(found) else np.zeros(0, int)
    return fit_chain(x[order], y[order], found["fold"].to_numpy()[order], [c.name for c in categories], grams, chosen)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, p_<category> and <category> for each category of the chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.probabilities(featurise(batch.column(1).to_pylist(), chain.grams))
            columns = [a for i, cut in enumerate(chain.cuts) for a in (pa.array(p[:, i], pa.float64()), pa.array(p[:, i] >= cut, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *[n for c in chain.categories for n in (f"p_{c}", c)]])

    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, " + ", ".join(f"p_{c} double, {c} boolean" for c in chain.categories))
