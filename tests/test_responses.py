"""Answers of services as records: odd payloads, lists or single values, references, CSV, paging with backoff."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexmill.sources import responses as R


def answers(spark, *bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "source long, body string")


def rows(df):
    return [r.asDict() for r in df.orderBy("source", "rank").collect()]


def test_references_are_decoded_once_and_odd_ones_stay(spark):
    cases = {"a &amp;lt; b": "a &lt; b", "caf&eacute; &#233;&#x1F600;": "café é😀", "&nope; &#0; &#xD800; &#1114112; & &;": "&nope; &#0; &#xD800; &#1114112; & &;", "": "", "plain": "plain", "&amp;": "&", "&lt;&gt;": "<>"}
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", R.decode_references(F.col("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == cases
    assert spark.range(1).select(R.decode_references(F.lit(None).cast("string")).alias("y")).first().y is None


def test_markup_goes_coded_or_not(spark):
    cases = {"<i>A</i> b .": "A b.", "&lt;jats:p&gt;T &amp;amp; u&lt;/jats:p&gt;": "T &amp; u", "<![CDATA[x <b>y</b>]]> ;": "x y;", " <br/> ": None, "a b\n\tc": "a b c", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", R.clean(F.col("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == cases


def test_works(spark):
    full = {"id": "W1", "display_name": "T", "title": "other", "authorships": [{"author": {"id": 1, "display_name": "A"}}, {"author": None}, {"author": {"display_name": "B"}}], "publication_year": 1999, "type": "article", "language": "en", "doi": "https://doi.org/10.1234/AbC",
            "primary_location": {"source": {"display_name": "J", "host_organization_name": "P"}}, "cited_by_count": 0, "topics": [{"display_name": "X"}, {"id": 3}], "open_access": {"is_oa": True}, "best_oa_location": {"pdf_url": "u"}}
    found = rows(R.works_records(answers(spark, json.dumps({"results": [full, {"title": "only"}, {}]}), None, "oops", json.dumps({"results": []})), "body", ["source"]))
    assert [r["rank"] for r in found] == [1, 2, 3] and [r["title"] for r in found] == ["T", "only", ""]
    first = found[0]
    assert (first["authors"], first["year"], first["doi"], first["journal"], first["publisher"], first["topics"], first["cited_by"], first["open"], first["url"]) == (["A", "B"], 1999, "10.1234/abc", "J", "P", ["X"], 0, True, "u")
    assert found[2]["authors"] == [] and found[2]["record_id"] is None
    bad = R.unreadable(answers(spark, None, "oops", '{"results": 3}', '{"results": []}', '{"message": {}}'), "body", "works")
    assert sorted(r.source for r in bad.collect()) == [0, 1, 2, 4]


def test_registry_leaves_containers_and_untitled(spark):
    items = [
        {"DOI": "10.1234/X", "title": ["<i>Title</i> one"], "author": [{"given": "A", "family": "B"}, {"family": "C"}, {}], "issued": {"date-parts": [[2001, 2]]}, "published-print": {"date-parts": [[2000]]}, "ISBN": ["978-1 2", "97812"], "container-title": ["J"], "type": "chapter"},
        {"DOI": "10.1234/J", "title": ["Journal"], "type": " Journal "}, {"DOI": "10.1234/U", "title": ["<b></b>"]}, {"title": "plain text title", "URL": "http://x", "published": {"date-parts": [[None]]}, "created": {"date-parts": [[1980, 1, 1]]}},
    ]
    a, b = rows(R.registry_records(answers(spark, json.dumps({"message": {"items": items}})), "body", ["source"]))
    assert (a["record_id"], a["title"], a["authors"], a["year"], a["isbn"], a["journal"], a["url"]) == ("registry:10.1234/x", "Title one", ["A B", "C"], 2000, ["97812"], "J", "https://doi.org/10.1234/x")
    assert (b["record_id"], b["title"], b["year"], b["rank"], b["authors"]) == ("registry:http://x", "plain text title", 1980, 4, [])


def test_archive_fields_are_values_or_lists(spark):
    docs = [
        {"identifier": "a b", "title": ["[One]", "two"], "creator": "Me &amp; you", "year": "1987", "date": "1999-01-01", "language": ["Spanish"], "isbn": "978-1, 2;3", "subject": [f"s{i}" for i in range(25)]},
        {"identifier": ["c"], "title": "[Untitled]", "creator": ["X", "", "Y"], "year": 99, "date": "about 1850?", "language": "xx", "subject": "one"}, {"title": None, "language": "Klingon"},
    ]
    a, b, c = rows(R.archive_records(answers(spark, json.dumps({"response": {"docs": docs}})), "body", ["source"]))
    assert (a["record_id"], a["title"], a["authors"], a["year"], a["language"], a["isbn"], len(a["topics"]), a["url"]) == ("archive:a b", "[One]", ["Me & you"], 1987, "es", ["9781", "2", "3"], 20, "https://archive.org/details/a%20b")
    assert (b["record_id"], b["title"], b["authors"], b["year"], b["language"], b["topics"]) == ("archive:c", "[Untitled]", ["X", "Y"], 1850, "xx", ["one"])
    assert (c["record_id"], c["title"], c["language"], c["year"], c["isbn"]) == (None, "", None, None, [])


def test_person_takes_the_fullest_public_summary(spark):
    doi = lambda x, rel="self": {"external-id-type": "doi", "external-id-value": x, "external-id-relationship": rel}
    groups = [
        {"work-summary": [{"put-code": 7, "title": {"title": {"value": "short"}}}, {"put-code": 8, "title": {"title": {"value": "full"}}, "publication-date": {"year": {"value": "2010"}}, "type": "book", "external-ids": {"external-id": [doi("10.1234/whole", "part-of"), doi("10.1234/A")]}}]},
        {"work-summary": [{"put-code": 9, "visibility": "private", "title": {"title": {"value": "hidden"}}}]}, {"work-summary": []}, {},
        {"work-summary": [{"journal-title": {"value": "J"}, "url": {"value": "https://site/x"}}]},
    ]
    table = answers(spark, json.dumps({"group": groups})).withColumn("who", F.lit("0000-0001-0002-0003"))
    a, b = rows(R.person_records(table, "body", "who", ["source"]))
    assert (a["record_id"], a["title"], a["year"], a["type"], a["doi"], a["url"], a["rank"]) == ("orcid:0000-0001-0002-0003:7", "full", 2010, "book", "10.1234/a", "https://doi.org/10.1234/a", 1)
    assert (b["record_id"], b["title"], b["url"], b["rank"]) == ("orcid:0000-0001-0002-0003:j:", "J", "https://site/x", 5)


def test_csv_profiles(spark):
    body = '﻿ORCID,given-names,family-name,credit-name,other-name,institution-name\r\n0000-0001-0002-0003,Ann,"Lee, ""Jr""\nII",,A; B|A,Uni\r\n,,,,,\r\nnone,x,y,z,,\r\n0000-0001-0002-000x,,,"Cred",,\r\n0000-0001-0002-0004'
    found = rows(R.profile_records(answers(spark, body, "", None), "body", ["source"]))
    assert [(r["orcid"], r["name"], r["other_names"], r["institutions"]) for r in found] == [("0000-0001-0002-0003", 'Ann Lee, "Jr"\nII', ["A", "B"], ["Uni"]), ("0000-0001-0002-000X", "Cred", [], []), ("0000-0001-0002-0004", "0000-0001-0002-0004", [], [])]


def test_paging_waits_and_gives_up(spark):
    def fetch(url):
        calls.setdefault(url, 0)
        calls[url] += 1
        if url == "a/2" and calls[url] < 3:
            return 429, "", 0.5 if calls[url] == 1 else None
        return (503, "down", None) if url == "b/1" else (404, "no", None) if url == "c/1" else (200, url, None)

    calls, naps = {}, []
    step = lambda url, body: {"a/1": "a/2", "a/2": "a/3", "a/3": "a/1"}.get(url)
    sources = spark.createDataFrame([("a", "a/1"), ("b", "b/1"), ("c", "c/1"), ("d", None)], "key string, url string")
    found = R.fetch_pages(sources, "url", "key", fetch, step, attempts=3, delay=0.0, sleep=naps.append).orderBy("key", "page").collect()
    assert [(r.key, r.page, r.status, r.tries) for r in found] == [("a", 1, 200, 1), ("a", 2, 200, 3), ("a", 3, 200, 1), ("b", 1, 503, 3), ("c", 1, 404, 1)]


def test_empty_tables(spark):
    none = answers(spark, "x").filter("false").withColumn("who", F.lit("w"))
    for found in (R.works_records(none, "body", ["source"]), R.registry_records(none, "body", ["source"]), R.archive_records(none, "body", ["source"]), R.person_records(none, "body", "who", ["source"]), R.profile_records(none, "body", ["source"])):
        assert found.count() == 0
    with pytest.raises(KeyError):
        R.unreadable(none, "body", "other")


def test_lines_of_a_long_csv_answer_do_not_carry_the_answer(spark):
    """One page of 200,000 lines, of 14 MB: a copy of it beside each line would be terabytes."""
    many = spark.range(1).select(F.concat(F.lit("orcid,credit-name\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.concat(F.lit("0000-0000-0000-"), F.lpad(i % 10_000, 4, "0"), F.lit(',"A long name, of number '), i, F.lit('"'))), "\n")).alias("body"), F.lit("s").alias("source"))
    found = R.profile_records(many, "body", ["source"])
    assert found.agg(F.count("*"), F.max("rank"), F.max(F.length("name"))).first()[:] == (200_000, 200_000, len("A long name, of number 200000"))
