"""Tier arms, the ranking profile and names, row by row; foldings by property."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.functions import ids, ranking, text, tiers
from lexmill.operators import relational

C = F.col


def test_every_arm_of_the_first_tiers(spark):
    rows = [
        (True, 0.6, 0.1, 0.9, 3, "EXCLUDE", "phenomenology-hard-science-noise"), (False, None, 0.5, 0.0, 0, "CORE", "strong-philosophy-keyword"), (False, None, 0.3, 0.0, 2, "CORE", "keyword-plus-multiple-concepts"),
        (True, 0.54, 0.3, 0.5, 1, "CORE", "keyword-plus-concept-score"), (False, None, 0.3, 0.1, 1, "PROBABLE", "moderate-philosophy-keyword"), (False, None, None, 0.4, 2, "PROBABLE", "multiple-philosophy-concepts"), (True, None, None, 0.9, 1, "BORDERLINE", "insufficient-corroboration"),
    ]
    df = spark.createDataFrame(rows, "ph boolean, noise double, family double, concept double, n int, tier string, reason string")
    got = df.withColumn("t", tiers.tier_v1(C("ph"), C("noise"), C("family"), C("concept"), C("n")))
    assert got.filter("t.tier <> tier or t.reason <> reason").collect() == []


def test_every_arm_of_the_second_tiers(spark):
    rows = [
        (True, False, 0.6, 0.1, None, None, 0.9, 3, "EXCLUDE", "phenomenology-hard-science-noise"), (False, False, None, 0.5, None, None, 0.4, 0, "CORE", "strong-nonduplicate-corroboration"), (False, False, None, 0.0, 0.35, 0.35, 0.0, 0, "CORE", "generic-plus-secondary-philosophy"),
        (False, False, None, 0.45, None, None, 0.0, 2, "CORE", "corroboration-plus-multiple-concepts"), (False, False, None, 0.25, None, 0.9, 0.0, 1, "PROBABLE", "moderate-nonduplicate-corroboration"), (False, True, None, 0.0, None, None, 0.45, 2, "PROBABLE", "multiple-philosophy-concepts"),
        (False, False, None, 0.0, None, None, 0.65, 1, "PROBABLE", "strong-anchor-only"), (False, True, None, 0.0, None, None, 0.65, 1, "BORDERLINE", "insufficient-corroboration"),
    ]
    df = spark.createDataFrame(rows, "ph boolean, amb boolean, noise double, own double, kw double, sec double, concept double, n int, tier string, reason string")
    got = df.withColumn("t", tiers.tier_v2(C("ph"), C("amb"), C("noise"), C("own"), C("kw"), C("sec"), C("concept"), C("n")))
    assert got.filter("t.tier <> tier or t.reason <> reason").collect() == []


def test_every_arm_of_the_third_tiers(spark):
    base = ("PROBABLE", "SCHOLARLY", 0, False, False, 0.9, None, None, None, False)
    cases = [
        ({0: "EXCLUDE", 1: "PARATEXT"}, "EXCLUDE"), ({3: True, 5: 0.1, 6: 0.35}, "EXCLUDE"), ({3: True, 5: 0.1, 7: "physics", 8: 0.45}, "EXCLUDE"), ({3: True, 5: 0.1, 7: "ethics", 8: 0.9}, "BORDERLINE"), ({3: True, 5: 0.1, 6: 0.9, 9: True}, "BORDERLINE"),
        ({1: "LOW_QUALITY", 2: 9}, "BORDERLINE"), ({1: "PARATEXT", 2: 6}, "PROBABLE"), ({1: "PARATEXT", 2: 5}, "BORDERLINE"), ({1: "EMPIRICAL_ADJACENT", 2: 6}, "PROBABLE"), ({1: "EMPIRICAL_ADJACENT"}, "BORDERLINE"), ({0: "CORE"}, "CORE"), ({0: "CORE", 4: True}, "BORDERLINE"), ({2: 6}, "CORE"), ({2: 3}, "PROBABLE"), ({}, "BORDERLINE"),
    ]
    rows = [(*[change.get(i, x) for i, x in enumerate(base)], want) for change, want in cases]
    df = spark.createDataFrame(rows, "v2 string, role string, e int, ph boolean, amb boolean, own double, noise double, dom string, ds double, hits boolean, want string")
    got = df.withColumn("t", tiers.tier_v3_1(*[C(c) for c in ("v2", "role", "e", "ph", "amb", "own", "noise", "dom", "ds", "hits")]))
    assert got.filter("t.tier <> want").collect() == []


def test_profile_by_hand(spark):
    q = ranking.Understood(original="mind body", expansions=(("body mind problem", 0.9), ("soul", 1.0)), persons=(("descartes",),), concepts=(("mind body problem",),), works=("meditations",), areas=((("mind",), 0.5),), area_terms=(("ethics",),), domain_terms=(("medicine",),))
    df = spark.createDataFrame([("descartes on the mind body problem", "philosophy of mind"), ("soul", "law"), ("", "x")], "t string, topic string").withColumn("w", F.array_distinct(F.split("t", " ")))
    got = [tuple(round(x, 6) for x in r) for r in df.select(ranking.query_match(C("t"), C("w"), q), ranking.domain_match(C("t"), C("w"), C("topic"), q)).collect()]
    assert got == [(0.995, 0.59), (0.55, 0.0), (0.0, 0.0)]
    d = spark.range(1).select(ranking.discipline(F.lit(0.55), *[F.lit(0.0)] * 4, F.lit(0.5), F.lit(0.0)), ranking.discipline(F.lit(0.0), F.lit(0.0), F.lit(0.1), *[F.lit(0.0)] * 2, F.lit(0.65), F.lit(0.35))).first()
    assert [round(x, 6) for x in d] == [0.55, 0.0]
    texts = spark.createDataFrame([("ethics of medicine",), ("ethics",), ("medicine",), ("x",)], "t string")
    assert [tuple(r[0]) for r in texts.select(ranking.conjunction(C("t"), F.lit(True), q)).collect()] == [("both", 2), ("area-only", -2), ("domain-only", 0), ("neither", -1)]
    assert spark.range(1).select(ranking.prefix_match("kant", F.array(F.lit("kantiano"))), ranking.prefix_match("kan", F.array(F.lit("kantiano")))).first() == (True, False)


def test_rules_in_blocks(spark, monkeypatch):
    rules = spark.createDataFrame([(i, i % 7, i % 10, f"r{i}") for i in range(40)], "rule_id int, priority int, k int, label string")
    df = spark.range(12).withColumn("v", (C("id") % 11).cast("int"))
    one = sorted(map(tuple, relational.rule_join(df, rules, C("v") == C("k"), "id", "priority", "rule_id", ["label"]).collect()))
    monkeypatch.setattr(relational, "RULE_BLOCK", 7)
    assert sorted(map(tuple, relational.rule_join(df, rules, C("v") == C("k"), "id", "priority", "rule_id", ["label"]).collect())) == one
    assert len(one) == 12 and (10, None, None) in one


def test_foldings(spark):
    letters = "".join(chr(x) for x in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.decomposition(chr(x)) and not unicodedata.decomposition(chr(x)).startswith("<"))
    bare = "".join(c for c in unicodedata.normalize("NFD", letters) if not unicodedata.combining(c))
    row = spark.createDataFrame([(letters, "Dr. María-José  Pérez, <b>Ñandú</b> 漢字 (Coord.)", "Dra. Ana López; Luis Gil and Ana López / Prof. X", "ética; Ética. , a|lógica\n")], "a string, b string, c string, d string")
    x = row.select(text.strip_accents(C("a")), text.fold_search(C("b")), text.fold_corpus(C("b")), text.fold_plain(C("b")), text.fold_ascii(C("b")), text.person_key(C("b")), text.person_names(C("c")), text.keywords(C("d"))).first()
    assert x[0] == bare
    assert list(x)[1:] == ["dr maria-jose perez b nandu b 漢字 coord", "dr maria-jose perez b nandu b coord", "dr maria jose perez b nandu b coord", "dr. maria-jose perez, nandu (coord.)", "maria jose perez b nandu b 漢字", ["ana lopez", "luis gil", "x"], ["ética", "Ética", "lógica"]]


@pytest.mark.parametrize(("date", "year", "month", "want"), [("1999-05-02", None, None, (1999, 5, "month")), ("1999-05", 2001, 3, (2001, 3, "month")), ("n.d.", 2001, None, (2001, None, "year")), (None, None, 4, (None, 4, "unknown")), ("1999-13", 1999, None, (1999, None, "year"))])
def test_work_dates(spark, date, year, month, want):
    df = spark.createDataFrame([(date, year, month)], "d string, y int, m int")
    assert tuple(df.select(ids.work_date(C("d"), C("y"), C("m"))).first()[0]) == want
