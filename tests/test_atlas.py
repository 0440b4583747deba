"""Research graph operators and title functions by hand, with null, empty and repeated rows."""

import math
from collections import Counter

from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import atlas


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_catalogue_match_states(spark):
    long = [f"a rather long title {i}" for i in range(6)]
    records = spark.createDataFrame([(i, t, 2000) for i, t in enumerate(long)] + [(9, "short", 2000), (10, None, 2000)], "id long, key string, issue int")
    entries = [("main", 1, long[0], 2000, None), ("other", 2, long[0], 2000, "x"), ("main", 3, long[1], 2000, "x"), ("other", 4, long[1], 2000, "y"), ("main", 5, long[2], 2000, "x"), ("main", 5, long[2], 2000, "x")]
    entries += [("main", 6, long[3], 2000, "x"), ("main", 7, long[3], 2000, "x"), ("main", 8, long[4], 1999, "x"), ("other", 9, long[5], 2000, "x"), ("main", 10, "short", 2000, "x")]
    got = dict((r.id, (r.status, r.ref)) for r in atlas.catalogue_match(records, spark.createDataFrame(entries, "source string, ref long, key string, issue int, author string"), "id", "main").collect())
    none = ("no verified match", None)
    assert got == {0: ("verified", 1), 1: ("conflicting authors", None), 2: ("repeated identity", None), 3: ("ambiguous", None), 4: none, 5: ("verified", 9), 9: none, 10: none}


def test_archive_merge(spark):
    data = [(1, "a", 2000, "d1", False), (2, "b", 2001, "d1", False), (3, "b", 2001, None, False), (4, "b", 1990, None, False), (5, "c", 1, None, False), (6, "c", 2, None, True), (7, "c", 3, None, False), (8, None, None, None, True), (9, None, None, None, False)]
    df = spark.createDataFrame(data, "id long, t string, y int, doi string, curated boolean")
    got = rows(atlas.archive_merge(df, "id", [F.col("doi"), F.concat("t", F.lit(":"), F.col("y").cast("string"))], F.col("t"), F.col("curated")))
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 5), (8, 8), (9, 9)]
    assert atlas.archive_merge(df.limit(0), "id", [F.col("doi")], F.col("t"), F.col("curated")).collect() == []


def test_authority_merges(spark):
    people = [(1, "n", "x", 0), (2, "n", "y", 0), (3, "n", None, 0), (4, "n", None, 1), (5, "m", "x", 0), (6, "", None, 0), (7, "", None, 0), (8, None, None, 0), (9, "n", "x", 0)]
    got = rows(atlas.authority_merges(spark.createDataFrame(people, "id long, name string, anchor string, context int")))
    assert got == [("anchor", 1, 5, "confirmed"), ("anchor", 1, 9, "confirmed"), ("name", 1, 2, "rejected"), ("name", 1, 3, "probable"), ("name", 1, 4, "unresolved")]


def test_identity_graph(spark):
    seen = [("ann", "x", 1, "p"), ("ann", None, 2, "q"), ("bob", "y", 1, "p"), ("bob", "z", 3, "p"), ("bob", None, 4, "p"), ("cid", None, 5, "p"), ("cid", None, 5, "p"), ("Ann", "x", 6, "p")]
    got = rows(atlas.identity_graph(spark.createDataFrame(seen, "name string, anchor string, work long, provider string")))
    assert got == [("name:bob", "bob", 1, "p", True), ("name:cid", "cid", 1, "p", False), ("x", "Ann;ann", 3, "p,q", False), ("y", "bob", 1, "p", True), ("z", "bob", 1, "p", True)]


def test_contributions_need_one_authority(spark):
    mentions = spark.createDataFrame([("ann", 1, 1), ("ann", 1, 1), ("ann", 1, 2), ("bob", 1, 1), (None, 1, 1)], "name string, work long, ref long")
    people = spark.createDataFrame([(7, "ann"), (8, "bob"), (9, "bob"), (10, None)], "id long, name string")
    assert [(r.authority, r.work, r.evidence) for r in atlas.contributions(mentions, people).collect()] == [(7, 1, 2)]


def test_snapshot_does_not_depend_on_order(spark):
    works, hits = [("k1", "A"), ("k2", "B"), ("k1", "C")], [("q", "k1", 0.5, "p"), ("q", "k1", 0.7, "r"), ("q", "kx", 0.9, "p"), ("s", "k2", None, "p")]
    make = lambda w, h: atlas.snapshot(spark.createDataFrame(w, "key string, title string"), spark.createDataFrame(h, "query string, key string, score double, provider string"))
    nodes, edges, diagnostics = make(works, hits)
    assert rows(nodes.select("key", "title", "records")) == [("k1", "A", 2), ("k2", "B", 1)]
    assert rows(edges.select("query", "score", "evidence")) == [("q", 0.7, 2), ("s", None, 1)]
    assert rows(diagnostics) == rows(make(works[::-1], hits[::-1])[2]) and diagnostics.first()[:5] == (2, 3, 2, 3, 2)
    assert rows(make(works, hits[:0])[2])[0][2:5] == (0, None, 0)


def test_weighted_vectors_equal_a_loop(spark):
    docs = {1: (["a", "b", "a"], ["c"]), 2: (["b"], []), 3: ([], None), 4: (["a", ""], ["b", "d"])}
    fields = {"x": 4.2, "y": 1.0}
    weights = {i: Counter() for i in docs}
    for i, parts in docs.items():
        for words, w in zip(parts, fields.values(), strict=True):
            for t in words or []:
                if t:
                    weights[i][t] += w
    df = Counter(t for c in weights.values() for t in c)
    want = {}
    for i, c in weights.items():
        raw = {t: (1 + math.log(w)) * (math.log((len(docs) + 1) / (df[t] + 1)) + 1) for t, w in c.items()}
        want |= {(i, t): x / math.sqrt(sum(y * y for y in raw.values())) for t, x in raw.items()}
    table = spark.createDataFrame([(i, *p) for i, p in docs.items()], "id long, x array<string>, y array<string>")
    got = {(r.id, r.token): r.value for r in atlas.weighted_vectors(table, "id", fields).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_remapped_neighbours(spark):
    identity = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")], "id long, identity string")
    found = spark.createDataFrame([(2, 1, 0.9), (2, 4, 0.8), (2, 3, 0.7), (2, 5, 0.8)], "query_id long, id long, score double")
    assert rows(atlas.remapped(found, identity, 5)) == [(2, 3, 0.8, 1), (2, 5, 0.8, 2)]


def test_title_functions(spark):
    df = spark.createDataFrame([("Introducción!", ""), ("The Ring and the Bolt of Rings", "ring"), (None, "x"), ("", "")], "t string, a string")
    got = df.select(text.is_generic_title(F.col("t")), text.title_words(F.col("t")), text.stem_labels(F.lower("t"), F.col("a"), {"ring": "jewel", "bolt": "machine"})).collect()
    assert [tuple(r) for r in got] == [(True, ["introduccion"], []), (False, ["ring", "bolt", "rings"], ["machine"]), (False, [], []), (False, [], [])]


def test_split_people(spark):
    known = ["Hannah Arendt", "Plato", "Arendt Lijphart"]
    asked = ["Arendt y Arendt", "arendt and hannah arendt", "Plato, Aristotle, Hannah Arendt", "plato, kant", "Plato", None, "Plato Y Élan"]
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    got = [[tuple(x) for x in r[0]] for r in df.select(text.split_people(F.col("q"), known)).collect()]
    assert got == [[], [("arendt", "Hannah Arendt"), ("hannah arendt", None)], [("Plato", "Plato"), ("Aristotle", None), ("Hannah Arendt", "Hannah Arendt")], [], [], [], [("Plato", "Plato"), ("Élan", None)]]


def test_evidence_classes(spark):
    from lexmill.operators import resolve

    shape = "id long, name string, anchor string, affiliation string, family array<string>, coworkers array<string>, keys array<string>"
    mention = [(1, "Ana M. Soto", "x", "u", ["soto", "gil"], ["p", "q"], ["o:x", "n:soto"])]
    people = [
        (1, "ana m soto", "x", None, ["soto", "gil"], [], ["o:x", "n:soto"]),  # A, D; shares two keys, counted once
        (2, "Soto Ana M", None, "u", None, ["p"], ["n:soto"]),  # B, C, D
        (3, "Ana Maria Soto", None, None, ["soto", "diaz"], ["p", "q"], ["n:soto"]),  # B, D, family veto
        (4, "Eva Soto", "y", None, [], None, ["n:soto"]),  # anchor veto
        (5, "Ana Soto", None, None, [], [], ["n:soto"]),  # D only
        (6, None, None, None, None, None, ["n:soto"]),
        (7, "Ana M. Soto", None, None, [], [], [None]),  # no key, no pair
    ]
    pairs = resolve.blocked(spark.createDataFrame(mention, shape), spark.createDataFrame(people, shape), "keys")
    got = {r[0]: tuple(r)[1:] for r in pairs.select("c.id", *[v.alias(k) for k, v in resolve.evidence().items()]).collect()}
    assert got == {1: (1, 0, 0, 1, 0), 2: (0, 1, 1, 1, 0), 3: (0, 1, 0, 1, 1), 4: (0, 0, 0, 0, 1), 5: (0, 0, 0, 1, 0), 6: (0, 0, 0, 0, 0)}
    status = spark.createDataFrame(list(got.values()), "a int, b int, c int, d int, v int").select(resolve.evidence_status(*[F.col(x) for x in "abcdv"]))
    assert [r[0] for r in status.collect()] == ["confirmed", "probable", "rejected", "rejected", "unresolved", "unresolved"]


def test_languages(spark):
    asked = [("the work of time", "en"), ("¿qué hay?", "es"), ("die Größe und das Maß", "de"), ("razão", "pt"), ("tempus", "unknown"), (None, "unknown"), ("the les", "unknown"), ("the ñ", "es")]
    df = spark.createDataFrame(asked, "q string, want string")
    assert all(r[0] == r[1] for r in df.select(text.query_language(F.col("q")), "want").collect())
    rows = [("the ways of the world", "das ist und der Tag", "xx", "en"), ("Ética", "das ist und der Tag", "xx", "de"), ("Ética", None, "xx", "xx"), (None, None, None, None), ("the of", "", "xx", "xx")]
    df = spark.createDataFrame(rows, "t string, b string, d string, want string")
    assert [r[0] for r in df.select(text.effective_language(F.col("t"), F.col("b"), F.col("d"))).collect()] == [r[3] for r in rows]


def test_macro_means(spark):
    from lexmill.operators import evaluate

    run = spark.createDataFrame([("q", i, i) for i in range(1, 11)] + [("r", i, i) for i in range(1, 11)], "query_id string, id long, rank int")
    judged = spark.createDataFrame([("q", i, int(i in (1, 7))) for i in range(1, 11)] + [("r", 1, 1)], "query_id string, id long, grade int")
    r = evaluate.macro_means(evaluate.ranking_metrics(run, judged), F.lit("all"), ["precision5", "precision", "recall", "mrr", "coverage"]).first()
    assert (r.queries, r.complete) == (2, 1) and (r.precision5, r.precision, r.recall, r.mrr) == (0.2, 0.2, 1.0, 1.0) and abs(r.coverage - 0.55) < 1e-12


def test_blocked_folds_names_before_the_join(spark):
    from lexmill.operators import resolve

    rows = [(i, f"Ana  Soto {i % 3}", [f"n:{i % 2}", None, f"a:{i % 3}"]) for i in range(40)]
    side = spark.createDataFrame(rows, "id long, name string, keys array<string>")
    pairs = resolve.blocked(side, side, "keys", small=0)
    got = pairs.select("m.id", "c.id", "m._named.plain", "c._named.signature").collect()
    want = {(i, j) for i, _, x in rows for j, _, y in rows if set(x) & set(y) - {None}}
    assert len(got) == len(want) and {(r[0], r[1]) for r in got} == want
    assert all(r[2] == f"ana soto {r[0] % 3}" and r[3] == f"{r[1] % 3} ana soto" for r in got)
