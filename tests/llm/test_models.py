"""The classifier chain by held-out accuracy; the suffix tree against counts and walks by hand."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmill.llm import queries
from lexmill.llm import suffix_tree as S
from lexmill.llm import toxicity as T
from tests.llm.fixtures import DATA, awkward, awkward_rows, empty

LARGER = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    chain = T.train(docs, labels.filter("doc_id % 3 <> 0"), queries.CATEGORIES)
    truth = {r.doc_id: r.toxic for r in labels.filter("doc_id % 3 = 0").collect()}
    got = {r.doc_id: r.toxic for r in T.score(docs, chain).collect()}
    hits = sum(got[i] and t == 1 for i, t in truth.items())
    assert hits >= 0.8 * sum(truth.values())
    assert hits >= 0.9 * sum(got[i] for i in truth)


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (400, 3)).astype(float)
    y = np.stack([x[:, 0], x[:, 0]], 1).astype(int)
    chain = T.fit_chain(x, y, np.arange(400) % 5, ["a", "b"], ["p", "q", "r"], [np.arange(3)] * 6)
    assert chain.weights[1].shape == (5,) and chain.weights[1][3] > 0.5
    p = chain.probabilities(x)
    assert ((p >= chain.cuts) == (y == 1)).all()


def test_features_are_chosen_without_the_fold(spark, monkeypatch):
    """Features of every fold against a choice by hand; repeated ids give one row a label."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    monkeypatch.setattr(T, "PER_CATEGORY", 25)
    seen = {}
    fit = T.fit_chain
    monkeypatch.setattr(T, "fit_chain", lambda x, y, folds, names, grams, chosen: seen.update(n=len(x), chosen=[[grams[i] for i in c] for c in chosen]) or fit(x, y, folds, names, grams, chosen))
    T.train(docs.union(docs.limit(40)), labels, queries.CATEGORIES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [(int(hashlib.md5(f"7:{r.doc_id}".encode()).hexdigest()[:6], 16) % 5, (r.quality == 0, r.toxic == 1), texts[r.doc_id]) for r in labels.collect() if r.doc_id in texts and r.quality is not None and r.toxic is not None]
    grams = [{f[i : i + n] for f in [T._framed(t)] for n in T.LENGTHS for i in range(len(f) - n + 1)} for _, _, t in rows]
    assert seen["n"] == len(rows)
    for fold in range(6):
        inside = [(y, g) for (f, y, _), g in zip(rows, grams, strict=True) if f != fold]
        n, picked = Counter(x for _, g in inside for x in g), set()
        for j in range(2):
            marked = Counter(x for y, g in inside if y[j] for x in g)
            positive = max(1, sum(y[j] for y, _ in inside))
            score = {g: (marked[g] / positive - (k - marked[g]) / max(1, len(inside) - positive)) / math.sqrt(k / len(inside) / positive + 1e-9) for g, k in n.items() if k >= T.MIN_ROWS}
            picked |= set(sorted(score, key=lambda g: (-score[g], g))[:25])
        assert len(picked ^ set(seen["chosen"][fold])) <= 2  # ties within rounding


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(7, 1, 0), (8, None, 1), (None, 1, 1), (11, 0, 1), (9, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    chain = T.train(awkward(spark), labels, queries.CATEGORIES)
    assert T.score(awkward(spark), chain).count() == len(awkward_rows())
    none = T.train(empty(spark), labels.limit(0), queries.CATEGORIES)
    assert T.score(awkward(spark), none).filter("toxic").count() == 0
    assert T.score(empty(spark), none).count() == 0


def test_lm_base_by_counting(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = queries.op9_lm_score(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0


@pytest.fixture(scope="module")
def grown(spark):
    texts = ["abra cadabra abra", "abba", "cab cab cab dab", "", "bad cab"] * 6
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = S.corpus_counts(df)
    return texts, S.grow(counts.filter("kind = 1").select("code", "n"), 1.0)


def brute_tree(texts, least):
    """Counts of every context, the retained ones, and the smoothed probability of a symbol."""
    seen = [Counter() for _ in range(S.DEPTH + 1)]
    for t in texts:
        s = bytes([S.END]) * S.DEPTH + b" ".join(t.encode().split()) + bytes([S.END])
        for i in range(S.DEPTH, len(s)):
            for k in range(S.DEPTH + 1):
                seen[k][s[i - k : i], s[i]] += 1
    totals = [Counter() for _ in seen]
    for k, c in enumerate(seen):
        for (ctx, _), n in c.items():
            totals[k][ctx] += n
    kept = set()
    for k in range(1, S.DEPTH + 1):
        gain = Counter()
        for (ctx, sym), n in seen[k].items():
            gain[ctx] += n * math.log(n / totals[k][ctx] * totals[k - 1][ctx[1:]] / seen[k - 1][ctx[1:], sym])
        kept |= {ctx[j:] for ctx, g in gain.items() if g >= least for j in range(k)}

    def p(ctx, sym):
        k = len(ctx)
        if k == 0:
            return (seen[0][b"", sym] + 1) / (totals[0][b""] + 256)
        kinds = sum(1 for c, _ in seen[k] if c == ctx)
        return (seen[k][ctx, sym] + kinds * p(ctx[1:], sym)) / (totals[k][ctx] + kinds)

    return kept, p


def test_tree_equals_brute_force(grown):
    texts, tree = grown
    kept, p = brute_tree(texts, 1.0)
    mine = {int(k).to_bytes(length, "big") for length in range(1, S.DEPTH + 1) for k in tree.keys[length]}
    assert mine == kept
    for text in ("abra cab", "zzz", "", "dab dab bad abba cadabra"):
        s = bytes([S.END]) * S.DEPTH + b" ".join(text.encode().split()) + bytes([S.END])
        want = 0.0
        for i in range(S.DEPTH, len(s)):
            ctx = next(s[i - k : i] for k in range(S.DEPTH, -1, -1) if k == 0 or s[i - k : i] in kept)
            want += math.log10(p(ctx, s[i]))
        assert math.isclose(tree.score([S.read_words(text)], tree.prepare())[0], want, rel_tol=1e-5)


def test_distributions_sum_to_one(grown):
    tree = grown[1]
    used = len(np.unique(tree.column)) - 1
    sums = (10.0 ** tree.logs[:, :-1]).sum(1) + (256 - used) * 10.0 ** tree.logs[:, -1]
    assert np.allclose(sums, 1, atol=1e-4)
    assert isinstance(tree.prepare()[1], pd.Index)


def test_model_size_is_bounded(spark):
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("text")
    grams = S.corpus_counts(texts).filter("kind = 1").select("code", "n")
    small, large = S.grow(grams, cells=4000), S.grow(grams)
    assert len(small.logs) < len(large.logs) and small.logs.size <= 4000 * S.DEPTH


def test_scores_do_not_depend_on_what_travels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    whole = {r.doc_id: r.score for r in S.score(docs).collect()}
    for cells in (200, 20_000):
        part = {r.doc_id: r.score for r in S.score(docs, cells=cells).collect()}
        assert part.keys() == whole.keys() and all(math.isclose(part[i], whole[i], rel_tol=1e-5) for i in whole)


def test_lm_beats_the_baseline_on_held_out_texts(spark):
    # the baseline pools all unknown words as one; on much smaller corpora that outweighs what the tree knows
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = S.score(rows).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_lm_awkward(spark):
    assert S.score(awkward(spark)).count() == len(awkward_rows())
    assert S.score(empty(spark)).count() == 0
    nothing = S.score(awkward(spark), held_out=F.lit(True)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in nothing)
    repeated = [tuple(r)[1:] for r in S.score(awkward(spark)).filter("doc_id in (7, 8)").collect()]
    assert len(repeated) == 5 and len(set(repeated)) == 2  # four rows of equal texts, in training, and one of another


def test_planting_holds_no_copies_of_the_table(spark):
    """The driver makes the probabilities of the nodes that travel in one table, a part of it at a time."""
    import tracemalloc

    from lexmill.llm import suffix_tree

    grams = spark.range(400_000).selectExpr("(xxhash64(id % 60000) & 1099511627775L) << 8 | (65 + id % 60) as code", "id % 5 + 20 as n")
    tracemalloc.start()
    tree = suffix_tree.grow(grams, least_gain=0.0, cells=10**9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tree.logs.nbytes > 10_000_000 and peak < 2 * tree.logs.nbytes
    assert abs((10.0 ** tree.logs[1:, :-1].astype(float)).sum(1).max() - 1) < 0.01
