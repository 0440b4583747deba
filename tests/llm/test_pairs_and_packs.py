"""The Jaccard join against all pairs, packing by round trip, mixing against SQL and by hand."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import jaccard_join as J
from lexmill.llm import mixing as M
from lexmill.llm import packing as K
from lexmill.llm import queries
from tests.compare import connect, difference
from tests.llm.fixtures import DATA, awkward, awkward_rows, empty, plain_docs


def brute_sets(texts, size=3):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    return out


def brute_components(rows, percent=90, size=3):
    """rows: (doc_id, text) -> sorted (doc_id, n_shingles, component_id)."""
    sets = brute_sets((t for _, t in rows), size)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def joined(df, *how):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join(df, "doc_id", "text", *how).collect()), key=str)


def test_join_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.op5_jaccard_join(spark, DATA).collect()), key=str) == brute_components(rows)


def near_copies(seed, n_bases, n_copies, sizes):
    rng = random.Random(seed)
    rows = []
    for _ in range(n_bases):
        base = [f"w{rng.randrange(100_000)}" for _ in range(rng.choice(sizes))]
        for _ in range(n_copies):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 12))):
                i = rng.randrange(len(words))
                words[i : i + rng.randrange(2)] = [f"x{rng.randrange(100_000)}"] * rng.randrange(1, 2)
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "sizes", "block"), [(1, range(3, 30), 1024), (2, (60, 150, 300), 1024), (3, (18, 22, 25, 40), 8), (4, (80,), 4)])
def test_join_equals_all_pairs(spark, monkeypatch, seed, sizes, block):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "CELLS", 60 if block < 10 else J.CELLS)
    rows = near_copies(seed, 12 if block > 10 else 4, 14 if block > 10 else 45, list(sizes))
    assert joined(plain_docs(spark, rows)) == brute_components(rows)
    if seed < 4:
        assert joined(plain_docs(spark, rows), 80, 5) == brute_components(rows, 80, 5)


@pytest.mark.parametrize(("percent", "size"), [(90, 3), (80, 5)])
def test_join_of_large_sets_equals_all_pairs(spark, percent, size):
    """Sets of 1,500 to 5,000 shingles that share passages: the sketch must tell them apart, and no link is lost."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(300)]
    rows = []
    for _ in range(14):
        base = [f"w{rng.randrange(100_000)}" for _ in range(rng.choice((1500, 2600, 5000)))]
        for _ in range(3):
            words = list(base)
            for _ in range(rng.randrange(0, len(base) // 30)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(100_000)}"
            rows.append((len(rows), " ".join(words + passage)))
    assert joined(plain_docs(spark, rows), percent, size) == brute_components(rows, percent, size)
    unlike = [J.shingle_hashes(t, J._WordHashes(), size) for _, t in rows[::3]]
    n = np.array([len(s) for s in unlike])
    a, b = np.triu_indices(len(unlike), 1)
    allowed = n[a] + n[b] - 2 * -(-percent * (n[a] + n[b]) // (100 + percent))
    assert (J.Sketches([J.parity_sketch(s) for s in unlike], n).distances(a, b) > allowed).all()


def test_frequent_lists_are_counted_apart(spark, monkeypatch):
    """One list holds half of all rows, repeated and not."""
    monkeypatch.setattr(J, "LONG", 16)
    rows = [(7, sid) for sid in range(900)] * 2 + [(100 + i // 2, i) for i in range(900)] + [(5000 + i, i) for i in range(50)]
    got = sorted(map(tuple, J._lists(spark.createDataFrame(rows, "key long, sid long")).collect()))
    assert got == sorted([(7, sid, 900) for sid in range(900)] + [(100 + i // 2, i, 2) for i in range(900)])
    roots = spark.createDataFrame([(i, 0) for i in range(900) if i != 13], "sid long, root long")
    mixed = J._mixed(spark.createDataFrame(got, "key long, sid long, size long"), roots).collect()
    assert {r.key for r in mixed} == {7, 106} and len(mixed) == 902


def test_join_awkward(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    assert joined(awkward(spark)) == brute_components(rows)
    assert J.join(empty(spark)).count() == 0
    kept = J.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert J.keep_one(empty(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 80), st.integers(0, 80), st.integers(0, 2**32), st.sampled_from([90, 80]))
def test_sets_that_link_share_a_list(n, less, more, seed, percent):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**64, n + more, dtype=np.uint64))
    a, b = pool[:n], np.sort(np.concatenate([pool[min(less, n - 1) : n], pool[n:]]))
    shared = len(np.intersect1d(a, b))
    boundary = J.best_boundary(percent)
    if 100 * shared >= percent * (len(a) + len(b) - shared):
        assert np.intersect1d(J.signatures(a, boundary, percent), J.signatures(b, boundary, percent)).size
        sketches = J.Sketches([J.parity_sketch(a), J.parity_sketch(b)], np.array([len(a), len(b)]))
        assert sketches.distances(np.array([0]), np.array([1]))[0] <= len(a) + len(b) - 2 * shared
        assert shared >= J.needed(len(a), len(b), percent)


def check_packing(rows, docs, path):
    """docs: by id, or by (id, copy)."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[(r.doc_id, r.copy) if (r.doc_id, r.copy) in docs else r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, text in docs.items():
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
        total += at
    return padding / max(total, 1)


def test_packing_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert check_packing(queries.op4_packing(spark, DATA).collect(), docs, queries.tokenizer_path()) < 0.01


def test_packing_groups_and_awkward(spark):
    docs = {r[0]: r[1] for r in awkward_rows() if r[0] is not None and r[0] != 7}
    df = awkward(spark).filter("doc_id is not null and doc_id <> 7")
    rows = K.digest(K.pack(df, queries.tokenizer_path(), group_pieces=16)).collect()
    check_packing(rows, docs, queries.tokenizer_path())
    again = K.digest(K.pack(df.repartition(3), queries.tokenizer_path(), group_pieces=16)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert K.pack(empty(spark), queries.tokenizer_path()).count() == 0
    assert K.pack(awkward(spark), queries.tokenizer_path()).select("doc_id").distinct().count() == len({r[0] for r in awkward_rows()})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_first_fit_equals_a_scan(sizes):
    sizes = sorted(sizes, reverse=True)
    room, bins = [], []
    for i, n in enumerate(sizes):
        for j, free in enumerate(room):
            if free >= n:
                room[j] -= n
                bins[j].append((i, 0, n))
                break
        else:
            room.append(64 - n)
            bins.append([(i, 0, n)])
    assert K.first_fit_decreasing(sizes, 64) == bins
    filled = K.fill_gaps([list(b) for b in bins], 64, 4)
    pieces = defaultdict(list)
    for b in filled:
        assert 0 < sum(n for _, _, n in b) <= 64
        for i, start, n in b:
            pieces[i].append((start, n))
    for i, n in enumerate(sizes):
        at = 0
        for start, k in sorted(pieces[i]):
            assert start == at and k > 0
            at += k
        assert at == n


@pytest.mark.parametrize("plan", [queries.MIX, M.Plan(domains={"d0": 90, "d1": 1}, languages={"fr": 70}, budget_percent=160, max_epochs=2), M.Plan(budget_percent=7, seed=3), M.Plan(domains={"d1": 0}, languages={"fr": 0, "en": 3}, sources={"src0": 0}, budget_percent=90, max_epochs=1)])
def test_mixing_equals_sql(spark, plan):
    from lexmill.llm.oracles import mixing_sql

    got = M.plan_mix(spark.read.parquet(f"{DATA}/documents.parquet"), plan, queries.domain())
    assert difference(got, connect(DATA), mixing_sql(plan)) is None


def test_mixing_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 1000), ("b", "x", "1", 1000)], "mix_domain string, mix_lang string, mix_source string, tokens long")
    plan = M.Plan(domains={"a": 1, "b": 1}, other=1, budget_percent=40, max_epochs=1)
    shares = {tuple(r)[:3]: r.share for r in M.leaf_budgets(leaves, plan).collect()}
    # 1204 tokens: 602 a domain; in a 301 a language; source 1 has but 10, so source 2 gets its rest
    assert shares == {("a", "x", "1"): 10, ("a", "x", "2"): 291, ("a", "y", "1"): 301, ("b", "x", "1"): 602}
    short = M.Plan(domains={"a": 1, "b": 9}, other=1, budget_percent=90, max_epochs=1)
    shares = {tuple(r)[:3]: r.share for r in M.leaf_budgets(leaves, short).collect()}
    assert shares[("b", "x", "1")] == 1000 and abs(sum(shares.values()) - 2709) <= 2


def test_tokens_of_weight_zero_hold_nobody_down(spark):
    """a has 10 wanted tokens beside 100 unwanted ones: b takes what a cannot."""
    from pyspark.sql import functions as F

    rows = [(1, "w " * 10, "en", "x", "a"), *[(10 + i, "w " * 10, "fr", "x", "a") for i in range(10)], *[(30 + i, "w " * 10, "en", "x", "b") for i in range(10)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, d string")
    plan = M.Plan(domains={"a": 1, "b": 1}, languages={"fr": 0}, budget_percent=50, max_epochs=1)  # 105 of 210 tokens
    taken = [r for r in M.plan_mix(docs, plan, F.col("d")).collect() if r.copies]
    assert {r.lang for r in taken} == {"en"} and sum(r.n_tokens for r in taken if r.domain == "a") == 10 and sum(r.n_tokens for r in taken if r.domain == "b") == 90
    nothing = M.Plan(domains={"a": 0, "b": 0}, budget_percent=50)
    assert all(r.copies == 0 for r in M.plan_mix(docs, nothing, F.col("d")).collect()) and M.mix(docs, nothing, F.col("d")).count() == 0


def test_mixing_awkward(spark):
    planned = {r.doc_id: r.copies for r in M.plan_mix(awkward(spark), queries.MIX, queries.domain()).collect()}
    assert len(planned) == len({r[0] for r in awkward_rows()})
    mixed = M.mix(awkward(spark), queries.MIX, queries.domain())
    assert mixed.columns == awkward(spark).columns
    counts = {r.doc_id: r["count"] for r in mixed.filter("doc_id is not null and doc_id <> 7").groupBy("doc_id").count().collect()}
    assert counts == {k: n for k, n in planned.items() if n and k is not None and k != 7}
    clashing = awkward(spark).withColumnsRenamed({"score": "mix_key", "spans": "mix_domain", "n": "mix_copies", "id": "mix_copy", "key": "mix_last_key", "word": "mix_id", "sid": "own_1"})
    renamed = M.mix(clashing, queries.MIX, queries.domain())
    assert renamed.columns == clashing.columns and sorted(map(str, renamed.collect())) == sorted(map(str, M.mix(awkward(spark), queries.MIX, queries.domain()).toDF(*clashing.columns).collect()))
    assert M.plan_mix(empty(spark), queries.MIX, queries.domain()).count() == 0 and M.mix(empty(spark), queries.MIX, queries.domain()).count() == 0


def test_copies_are_packed_apart(spark):
    rows = [(i, f"text number {i} " * 40) for i in range(300) for _ in range(2)]
    packed = K.digest(K.pack(plain_docs(spark, rows).coalesce(1), queries.tokenizer_path(), group_pieces=16)).collect()
    check_packing(packed, {(i, c): rows[2 * i][1] for i in range(300) for c in (0, 1)}, queries.tokenizer_path())
    groups = defaultdict(set)
    for r in packed:
        groups[r.doc_id].add((r.copy, r.sequence_id >> 32))
    assert sum(len({g for _, g in found}) > 1 for found in groups.values()) > 250


def test_added_tokens_are_taken_whole(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    first = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b", "<|endoftext|>", " x <|endoftext|>  <|endoftext|>y\n", "<|endoftext|", "<<|endoftext|>>", "it's<|endoftext|>'s"]
    rows = K.pack(plain_docs(spark, list(enumerate(texts))), path).collect()
    for i, text in enumerate(texts):
        want = [*first.encode(text, add_special_tokens=False).ids, K.END_ID]
        pieces = sorted((r.start, r.ids, r.doc_tokens) for r in rows if r.doc_id == i)
        assert np.frombuffer(b"".join(x[1] for x in pieces), "<u4").tolist() == want and pieces[0][2] == len(want)
    assert first.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
