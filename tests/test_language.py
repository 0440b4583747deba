"""Language profiles against plain counts, and on held-out rows against the vote of function words."""

import math
from collections import Counter

from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import language as L
from tests.compare import DATA


def plain(x):
    kept = []
    for b in f" {(x or '').lower()} ".encode():
        c = b if 97 <= b <= 122 or 0x80 <= b < 0xF5 else 32
        if c != 32 or not kept or kept[-1] != 32:
            kept.append(c)
    return [bytes(kept[i : i + 3]) for i in range(len(kept) - 2)]


ROWS = [(1, "Der Fuß, die Füße!", "de"), (2, "the foot -- the FEET 22", "en"), (3, "das Haus", "de"), (4, None, "en"), (5, "漢字 x", None), (6, "", "de"), (7, "??", "en"), (8, "le pied 漢字", "fr"), (9, "a" * 100_000, "en")]


def test_profile_and_scores_equal_plain_counts(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(4)
    profile = L.learn(df, F.col("text"), F.col("lang"))
    counts = {}
    for _, x, lang in ROWS:
        if lang:
            counts.setdefault(lang, Counter()).update(plain(x))
    seen = sorted({g for c in counts.values() for g in c})
    assert profile.languages == ["de", "en", "fr"] and sorted(L.spelling(int(c)) for c in profile.codes) == seen
    log = lambda lang, g: math.log((counts[lang][g] + L.SMOOTHING) / (counts[lang].total() + L.SMOOTHING * (len(seen) + 1)))
    got = {r.doc_id: r for r in L.tell(df, "doc_id", F.col("text"), profile).collect()}
    for i, x, _ in ROWS:
        mine = plain(x)
        scores = sorted((-sum(log(lang, g) for g in mine), lang) for lang in counts)
        assert got[i].n_grams == len(mine)
        if mine:
            assert got[i].language == scores[0][1] and math.isclose(got[i].margin, (scores[1][0] - scores[0][0]) / len(mine), abs_tol=1e-9)
        else:
            assert got[i].language is None and got[i].margin is None
    none = L.learn(df.limit(0), F.col("text"), F.col("lang"))
    assert {r.language for r in L.tell(df, "doc_id", F.col("text"), none).collect()} == {None}


def test_held_out_rows_by_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    profile = L.learn(docs.filter(~held), F.col("text"), F.col("lang"))
    found = L.tell(docs.filter(held), "doc_id", F.col("text"), profile)
    voted = docs.filter(held).select("doc_id", "lang", text.voted_language(text.language_votes(F.col("text"))).alias("vote"))
    rows = voted.join(found, "doc_id").filter("lang is not null and text is not null" if "text" in voted.columns else "lang is not null").collect()
    for lang in {r.lang for r in rows}:
        mine = [r for r in rows if r.lang == lang]
        right, by_vote = (sum(getattr(r, c) == lang for r in mine) for c in ("language", "vote"))
        assert right >= by_vote and right >= 0.97 * len(mine), (lang, right, by_vote, len(mine))
