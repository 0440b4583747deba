"""Saved works most alike, by blocks and in rests, against all pairs."""

import math
import random

import pytest

from lexmill.operators import saved_works


def _rows(n: int, seed: int):
    rng = random.Random(seed)
    pick = lambda letters, most: [rng.choice(letters) for _ in range(rng.randrange(most + 1))]
    return [(rng.randrange(3), i * 7 % 1000, pick("abcdefgh", 6), pick("uvwxyz", 6 if i % 50 == 0 else 2) or None, pick("klmn", 4)) for i in range(n)]


def _brute(rows):
    out = {}
    for p, a, w, x, t in rows:
        found = []
        for q, b, v, y, s in rows:
            if p == q and a < b:
                both = len(set(w) & set(v))
                lexical = both / len(set(w) | set(v)) if both else 0.0
                score = math.floor(min(1.0, lexical + (0.34 if set(x or ()) & set(y or ()) else 0.0) + min(0.24, len(set(t) & set(s)) * 0.08)) * 1e6 + 0.5) / 1e6
                if score >= 0.12:
                    found.append((-score, b))
        out[p, a] = [(b, -s) for s, b in sorted(found)[:4]]
    return {(p, a, b, s) for (p, a), near in out.items() for b, s in near}


@pytest.mark.parametrize("block", [16, 100, 4096])
def test_blocks_change_nothing(spark, block):
    rows = _rows(400, block)
    saved = spark.createDataFrame(rows, "project int, id long, words array<string>, authors array<string>, tags array<string>")
    found = saved_works.saved_similarity(saved, "project", "id", block=block)
    assert {tuple(r) for r in found.collect()} == _brute(rows)


def test_many_works_that_share_words_make_no_pairs(spark):
    # 40,000 works of one project share three words and a tag: 800 million pairs, several rows each
    saved = spark.range(40_000).selectExpr("1 AS project", "id", "array('of', 'in', 'context', concat('w', id % 5)) AS words", "array(concat('a', id % 3)) AS authors", "array('read') AS tags")
    found = saved_works.saved_similarity(saved, "project", "id")
    assert found.filter("similarity = 1 and b <= a + 60").count() == 4 * (40_000 - 60) + found.filter("similarity = 1 and a >= 39940").count()
