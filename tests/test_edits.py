"""Joins by edit distance and by ratio against all pairs, at the bound and beside it."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.operators import edits


def levenshtein(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, e in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != e))
    return row[-1]


def edited(rng, x, n):
    x = list(x)
    for _ in range(n):
        at = rng.randrange(len(x) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            x.insert(at, rng.choice("abc "))
        elif at < len(x):
            x[at : at + 1] = [] if kind == 1 else [rng.choice("abc?")]
    return "".join(x)


def frames(spark, left, right):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(left)], "a long, x string, issue long"), spark.createDataFrame([(i, *r) for i, r in enumerate(right)], "b long, y string, issue long")


@pytest.mark.parametrize("share", [0.06, 0.15])
def test_joins_lose_no_pair(spark, share):
    rng = random.Random(8)
    bases = ["".join(rng.choice("abc ") for _ in range(n)) for n in (1, 2, 5, 9, 16, 17, 27, 33, 50, 51, 90) for _ in range(3)]
    right = [(b, i % 3) for i, b in enumerate(bases)] + [("", 1), ("aaaaaaaaaaaaaaaaaaaa", 1), ("aaaaaaaaaaaaaaaaaaaaa", 1)]
    left = [(edited(rng, b, rng.randrange(int(len(b) * share * 2) + 3)), i) for b, i in right for _ in range(4)] + right
    a, b = frames(spark, left, right)
    want = {}
    for i, (x, p) in enumerate(left):
        for j, (y, q) in enumerate(right):
            if p == q and x and y and (d := levenshtein(x, y)) <= int(round((len(x) + len(y)) * share, 6)):
                want[i, j] = d
    got = edits.edit_join(a, b, ["issue"], share).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.distance for r in got} == want
    assert any(d == int(round((len(left[i][0]) + len(right[j][0])) * share, 6)) for (i, j), d in want.items() if d)
    ratios = {(i, j): s for i, (x, p) in enumerate(left) for j, (y, q) in enumerate(right) if p == q and x and y and (s := SequenceMatcher(None, x, y).ratio()) >= 1 - share}
    assert {(r.a, r.b): r.ratio for r in edits.ratio_join(a, b, ["issue"], 1 - share).collect()} == ratios


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab", max_size=24), st.text("ab", max_size=24)), min_size=1, max_size=12), st.sampled_from([0.05, 0.1, 0.25]))
def test_joins_on_two_letters(spark, pairs, share):
    a, b = frames(spark, [(x, 0) for x, _ in pairs], [(y, 0) for _, y in pairs])
    want = {(i, j) for i, (x, _) in enumerate(pairs) for j, (_, y) in enumerate(pairs) if x and y and levenshtein(x, y) <= int(round((len(x) + len(y)) * share, 6))}
    assert {(r.a, r.b) for r in edits.edit_join(a, b, ["issue"], share).collect()} == want


def test_copies_are_compared_once(spark):
    texts = ["small ring of brass", "small rings of brass", "large gear in context"]
    rows = [(t, i % 5) for t in texts for i in range(40)]
    a, b = frames(spark, rows, rows)
    found = edits.text_pairs(a.select("x", "issue"), b.select("y", "issue"), ["issue"], 0.06).collect()
    assert len(found) == len(set(found)) <= 5
    got = edits.edit_join(a, b, ["issue"], 0.06).collect()
    want = {(i, j) for i, (x, p) in enumerate(rows) for j, (y, q) in enumerate(rows) if p == q and levenshtein(x, y) <= int(round((len(x) + len(y)) * 0.06, 6))}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


TITLE = "La recepción de la fenomenología en América Latina"
BROKEN = "La recepci�n de la fenomenolog�a en Am�rica Latina"


def test_damaged_titles(spark):
    records = [(1, BROKEN, 5), (2, BROKEN, 6), (3, TITLE, 5), (4, "Educaci�n breve", 5), (5, "�" * 8 + TITLE, 5), (6, BROKEN, 7), (7, BROKEN, 8), (8, BROKEN, 9), (9, None, 5), (10, BROKEN, 10)]
    catalogue = [("main", "m5", TITLE, 5, None), ("other", "o5", TITLE + "!", 5, "Ana"), ("other", "x5", "Educación breve", 5, "Ana"), ("other", "bad", BROKEN, 5, "Zoe")]
    catalogue += [("other", "o7", TITLE, 7, "Ana"), ("other", "p7", TITLE, 7, "Eva"), ("other", "o8", TITLE, 8, "Ana"), ("other", "o8", TITLE, 8, "Ana"), ("main", "m9", TITLE, 9, "Ana"), ("main", "n9", TITLE, 9, "Ana"), ("other", "o10", TITLE, 10, None), ("other", "p10", TITLE + " hoy", 10, "Ana")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(catalogue)], "entry long, source string, ref string, title string, issue long, author string")
    got = {r.id: (r.status, r.ref) for r in edits.damaged_match(spark.createDataFrame(records, "id long, title string, issue long"), df, "id", "main").collect()}
    assert got == {1: ("verified", "o5"), 2: ("no verified match", None), 4: ("no verified match", None), 5: ("no verified match", None), 6: ("conflicting authors", None), 7: ("repeated identity", None), 8: ("ambiguous", None), 10: ("verified", "o10") if SequenceMatcher(None, fold(BROKEN), fold(TITLE + " hoy")).ratio() < 0.94 else ("verified", "p10")}


def fold(x):
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.combining(c))
    return bare.replace("�", "?")


def test_fold_damaged(spark):
    row = spark.createDataFrame([(BROKEN + " — ¿Qué?",)], "t string").select(edits.fold_damaged(F.col("t"))).first()
    assert row[0] == "la recepci?n de la fenomenolog?a en am?rica latina que"
