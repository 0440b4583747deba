"""Every query of the catalogue against DuckDB on the same tables."""

import itertools
import math
import random
from collections import Counter

import pytest

from lexmill.plans import catalog
from tests.compare import DATA, connect, difference


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(catalog.QUERIES[name](spark, DATA), con, catalog.ORACLE_SQL[name]) is None


def test_memory_of_edges_does_not_grow_with_the_table(spark):
    """Tasks of a co-membership follow its facts; a graph's edges reach Python in batches, never as one frame."""
    from pyspark.sql import functions as F

    from lexmill.operators import graph

    facts = spark.range(4_000_000).select((F.col("id") % 2_000_000).alias("g"), (F.col("id") % 2_000_000 % 700 + 1000 * F.floor(F.col("id") / 2_000_000)).alias("m"))
    found = graph.co_members(facts, "g", "m")
    assert found.rdd.getNumPartitions() == 20 and sorted(map(tuple, found.orderBy("a").limit(1).collect())) == [(0, 1000, 2858)] and found.count() == 700
    capped = graph.degree_capped(spark.createDataFrame([(1, 1, 2, 3.0)], "graph long, a long, b long, score double"), "graph", 2, 5)
    plan = capped._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_inverted_index_deals_whole_texts_once(spark):
    plan = catalog.QUERIES["inverted_index_rebuild"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


def test_degree_capped_edges_equal_a_loop(spark):
    from lexmill.operators.graph import degree_capped

    rows = [(g, a, b, float((a * 7 + b * 3 + g) % 11)) for g in range(3) for a in range(8) for b in range(a + 1, 8)]
    got = sorted(map(tuple, degree_capped(spark.createDataFrame(rows, "graph long, a long, b long, score double"), "graph", 2, 5).collect()))
    want = []
    for g in range(3):
        degree, taken = {}, 0
        for _, a, b, s in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1], r[2])):
            if taken < 5 and degree.get(a, 0) < 2 and degree.get(b, 0) < 2:
                degree[a], degree[b], taken = degree.get(a, 0) + 1, degree.get(b, 0) + 1, taken + 1
                want.append((g, a, b, s))
    assert got == sorted(want)


def test_result_sorts_give_each_work_four_places(spark):
    rows = catalog.QUERIES["result_sorts"](spark, DATA)
    assert sorted(rows.columns) == ["by_title", "cited", "id", "newest", "oldest"]
    found = rows.collect()
    for name in ("by_title", "cited", "newest", "oldest"):
        places = sorted(r[name] for r in found)
        assert places[:20] == list(range(1, 21)) and len(set(places)) == len(found) > 20


def test_inverted_file_recall(spark):
    rows = catalog.QUERIES["ivf_recall"](spark, DATA).collect()
    assert sum(r.hits for r in rows) >= 0.9 * sum(r.wanted for r in rows)


def test_clusters_hold_every_vector(spark):
    rows = catalog.QUERIES["cluster_lookup"](spark, DATA).collect()
    assert len({r.id for r in rows}) == len(rows) == spark.read.parquet(f"{DATA}/embeddings.parquet").count()


def titles_of(spark, tmp_path, least):
    """Documents of few words and all languages, and their title words of at least `least` letters."""
    rng = random.Random(3)
    words = [f"{w}{i}" for w in ("stone", "river", "of", "x") for i in range(12)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) + "\nbody text", ("de", "en", None)[i % 3]) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return {i: [w for w in t.split("\n")[0].split() if len(w) >= least] for i, t, _ in rows}


def test_title_lexical_edges_equal_all_pairs(spark, tmp_path):
    first = {}
    for i, words in titles_of(spark, tmp_path, 1).items():
        first.setdefault(frozenset(words), i)
    want = set()
    for x, y in itertools.combinations(first, 2):
        shared, total = len(x & y), len(x | y)
        if 100 * shared >= 12 * total and shared >= 2 or 100 * shared >= 34 * total:
            want.add((*sorted((first[x], first[y])), shared, total))
    got = list(map(tuple, catalog.QUERIES["title_lexical_edges"](spark, str(tmp_path)).collect()))
    assert len(got) == len(set(got)) and set(got) == want
    assert any(100 * s < 60 * n for *_, s, n in want)


def test_title_lexical_edges_join_copies_and_all_their_partners(spark, tmp_path):
    titles = ["stone river", "river stone", "stone river", "stone river bank", "other", "", ""]
    spark.createDataFrame([(i, f"{t}\nbody") for i, t in enumerate(titles)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.QUERIES["title_lexical_edges"](spark, str(tmp_path)).collect()))
    assert got == [(0, 1, 2, 2), (0, 2, 2, 2), (0, 3, 2, 3), (1, 2, 2, 2), (1, 3, 2, 3), (2, 3, 2, 3)]


def test_tfidf_edges_of_all_languages_equal_all_pairs(spark, tmp_path):
    docs = titles_of(spark, tmp_path, 4)
    df = Counter(w for words in docs.values() for w in set(words))
    vectors = {}
    for i, words in docs.items():
        raw = {w: (1 + math.log(c)) * (math.log((len(docs) + 1) / (df[w] + 1)) + 1) for w, c in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        vectors[i] = {w: x / norm for w, x in raw.items()}
    want = {}
    for a, b in itertools.combinations(sorted(vectors), 2):
        both = vectors[a].keys() & vectors[b].keys()
        score = sum(vectors[a][w] * vectors[b][w] for w in both)
        if score >= 0.08 and len(both) >= 2:
            want[a, b] = score, len(both)
    got = {(r.a, r.b): (r.score, r.shared) for r in catalog.QUERIES["tfidf_edges_all"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k][0], want[k][0], abs_tol=2e-6) and got[k][1] == want[k][1] for k in want)
    assert any(score < 0.3 for score, _ in want.values())
