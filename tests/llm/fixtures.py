"""A small table with every awkward case: nulls in any column, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, n long, id string, key string, word string, measures int, max_symbol_rate string, epochs int, copies string, sid string, component_id string, bucket int, fingerprint string"


def awkward_rows() -> list[tuple]:
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "thêta", "iota", "Kappa", "漢字", "mu"]
    prose = " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(400))
    secret = 'api_key = "abcdefgh12345678" and AKIA' + "A1" * 10 + " é " + "0123456789abcdef" * 3 + " token: short"
    notice = "Licensed under the Apache\nLicense, and the GNU Generel Public License; MIT License (CC BY)."
    texts = [None, "", " \n\t ", "one", "two words", "x" * 200_000, "long " * 20_000, prose, prose, prose + " tail", prose.replace("alpha", "ALPHA"), secret, notice, "# head\n\npara one. Para two!\npara one. Para two!\n", "a\r\nb\x0bc\x0cd", "ß x y \x00 z", "Sentence. " * 50]
    texts += [" ".join(rng.choice(words) + str(rng.randrange(900)) for _ in range(rng.randrange(15, 60))) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src7", None, "other"]), None if t is None or i % 9 == 0 else len(t)) for i, t in enumerate(texts)]
    rows += [(None, prose, None, None, None), (None, None, None, None, None), (7, prose, "en", "src0", 3), (7, prose, "en", "src0", 3), (7, "other text under the same id", "en", "src0", 3)]
    return [(*r, 0.5, "s", 1, "i", "k", "w", 3, "m", 2, "c", "d", "e", 5, "f") for r in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")
