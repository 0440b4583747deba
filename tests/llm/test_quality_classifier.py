"""The quality classifier: held-out labels, sums and calibration against plain numpy, awkward rows."""

import zlib

import numpy as np
import pandas as pd

from lexmill.llm import quality_classifier as Q
from lexmill.llm import queries
from tests.llm.fixtures import DATA, awkward, awkward_rows, empty

LARGER = "/root/testdata/sf0.01"


def area(scores, truth):
    """Share of pairs in order, ties half."""
    ranks = pd.Series(scores).rank()
    n = sum(truth)
    return (sum(r for r, t in zip(ranks, truth, strict=True) if t) - n * (n + 1) / 2) / (n * (len(truth) - n))


def test_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op13_quality_classifier(spark, LARGER).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(held) > 80
    assert area([r.score for r, _ in held], [q for _, q in held]) >= 0.97
    assert sum(r.predicted == q for r, q in held) >= 0.95 * len(held)
    assert sum((r.score - q) ** 2 for r, q in held) <= 0.05 * len(held)


def test_labels_held_out_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS string)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = ({r.doc_id: r.score for r in Q.classify(docs, x).collect()} for x in (labels, other))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_sums_and_weights_against_numpy(spark):
    rng = np.random.default_rng(2)
    d = len(Q.STATISTICS)
    x, fold, y = rng.normal(size=(900, d)), rng.integers(0, Q.FOLDS, 900), rng.integers(0, 2, 900).astype(float)
    features = Q.Features.drawn(x.mean(0), x.std(0))
    rows = spark.createDataFrame([(int(f), v.tolist(), float(t)) for f, v, t in zip(fold, x, y, strict=True)], "fold int, x array<double>, y double").repartition(7)
    sums = Q._sums(rows, features)
    v = np.hstack([features.of(x), y[:, None]])
    for k in range(Q.FOLDS):
        assert np.allclose(sums[k], v[fold == k].T @ v[fold == k])
    penalty, without, weights = Q.fit_weights(sums)
    errors = {}
    for p in Q.PENALTIES:
        ridge = np.diag([*[p * len(x)] * Q.FEATURES, 0])
        fits = [np.linalg.solve(v[fold != k, :-1].T @ v[fold != k, :-1] + np.diag([*[p * (fold != k).sum()] * Q.FEATURES, 1e-9]), v[fold != k, :-1].T @ y[fold != k]) for k in range(Q.FOLDS)]
        errors[p] = sum(((v[fold == k, :-1] @ w - y[fold == k]) ** 2).sum() for k, w in enumerate(fits))
        if p == penalty:
            assert np.allclose(without, fits) and np.allclose(weights, np.linalg.solve(v[:, :-1].T @ v[:, :-1] + ridge, v[:, :-1].T @ y), atol=1e-5)
    assert penalty == min(errors, key=errors.get)


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    d = len(Q.STATISTICS)
    x = rng.normal(size=(40, d))
    z = Q.Features.drawn(np.zeros(d), np.ones(d), 20_000).of(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * d))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_pooling_is_isotonic_least_squares():
    """Against the largest of least means, which defines the isotonic fit."""
    rng = np.random.default_rng(4)
    n, mean = rng.integers(1, 9, 40).astype(float), rng.random(40)
    middles, levels = Q.pool(np.arange(40.0), n, mean)
    want = [max(min((n[a : b + 1] @ mean[a : b + 1]) / n[a : b + 1].sum() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(sorted(set(np.round(want, 9))), levels) and (np.diff(levels) > 0).all() and (np.diff(middles) > 0).all()


def test_awkward(spark):
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, None), (None, 1), (11, 0), (9, 1), (3, 5), (20, 1), (21, 0), (999, 1)], "doc_id long, quality int")
    got = Q.classify(awkward(spark), labels).collect()
    assert len(got) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for (i, text, *_), r in zip(awkward_rows(), sorted(got, key=lambda r: 0), strict=True):
        by_text.setdefault(text or "", set()).add(round(r.score, 12))
    assert all(len(s) == 1 for s in by_text.values())
    assert {r.score for r in Q.classify(awkward(spark), labels.limit(0)).collect()} == {0.5}
    assert Q.classify(empty(spark), labels).count() == 0
