"""Answers of scholarly services as rows: paged fetching with backoff, and one record shape for four kinds of payload.

A table of answers has a text column with the payload of a page. Payloads are read as variants on the JVM side, so a field
may be one value or a list. An answer that is null, malformed or without its list gives no records; `unreadable` finds it,
so that a blocked source is not taken for an empty one.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import ids

# Types of registry entries that hold works and are none.
CONTAINERS = ("journal", "journal-issue", "journal-volume", "book-series", "book-set", "proceedings-series", "report-series", "standard-series")
# Names of languages and their codes.
LANGUAGES = {
    "en": ("eng", "english"), "es": ("spa", "spanish", "español", "espanol"), "fr": ("fre", "fra", "french"), "de": ("ger", "deu", "german"),
    "it": ("ita", "italian"), "pt": ("por", "portuguese"), "la": ("lat", "latin"),
}
# Where each payload keeps its list.
LISTS = {"works": "$.results", "registry": "$.message.items", "archive": "$.response.docs", "person": "$.group"}



def _named() -> Column:
    return F.from_json(F.lit(json.dumps({f"&{n};": chr(p) for n, p in name2codepoint.items()})), "map<string,string>")


def decode_references(x: Column) -> Column:
    """Named and numeric character references decoded once; unknown ones and those of no character stay as written."""
    number = lambda m: F.when(m.rlike("^&#[xX]"), F.conv(F.regexp_extract(m, "^&#[xX]([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(m, "^&#([0-9]*)", 1)).try_cast("long")
    valid = lambda n: (n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF))
    point = lambda m: F.when(valid(number(m)), F.decode(F.unhex(F.lpad(F.hex(F.when(valid(number(m)), number(m)).otherwise(F.lit(32))), 8, "0")), "UTF-32"))
    names = _named()
    # parts between references are joined with what each reference stands for, so no result is decoded twice
    reference = r"&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});"
    found = F.regexp_extract_all(x, F.lit(reference), F.lit(0))
    meant = F.transform(found, lambda m: F.coalesce(names[m], point(m), m))
    between = F.split(x, reference, -1)
    joined = F.array_join(F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.get(meant, i), F.lit("")))), "")
    return F.when(x.contains("&"), joined).otherwise(x)


def clean(x: Column) -> Column:
    """Markup out, coded markup too; references decoded, space collapsed, none before punctuation; null if nothing is left."""
    bare = F.regexp_replace(decode_references(F.regexp_replace(x, r"(?is)<!\[CDATA\[(.*?)\]\]>", "$1")), "<[^>]*>", " ")
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(bare, r"[\s ]+", " "), r" ([,.;:!?])", "$1")), F.lit(""))


def language_code(x: Column) -> Column:
    """Two letters of a named or coded language; null for what is neither."""
    name = F.lower(clean(x))
    known = F.lit(None).cast("string")
    for code, names in LANGUAGES.items():
        known = F.when(name.isin(*names), code).otherwise(known)
    return F.coalesce(known, F.when(name.rlike("^[a-z]{2}$"), name))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _many(v: Column, path: str) -> Column:
    """A list of texts, or one text as a list; nothing is an empty list."""
    one = _get(v, path)
    return F.array_compact(F.coalesce(_get(v, path, "array<string>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>")))


def _first(v: Column, path: str) -> Column:
    return F.get(_many(v, path), F.lit(0))


def _texts(values: Column) -> Column:
    return F.array_compact(F.transform(values, clean))


def _isbn(values: Column) -> Column:
    parts = F.flatten(F.transform(values, lambda x: F.split(x, "[,;|]")))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"[-\s]", "")), lambda x: x != ""))


def _items(answers: DataFrame, body: str, path: str, keep: list[str]) -> DataFrame:
    """keep, rank from 1, and the variant of each item of an answer."""
    found = _get(F.try_parse_json(F.col(body)), path, "array<variant>")
    return answers.select(*keep, F.posexplode(found).alias("_at", "v")).withColumn("rank", F.col("_at") + 1).drop("_at")


def _record(items: DataFrame, keep: list[str], **fields: Column) -> DataFrame:
    shape = ("record_id", "string"), ("title", "string"), ("authors", "array<string>"), ("year", "int"), ("type", "string"), ("language", "string"), ("doi", "string"), ("isbn", "array<string>"), ("journal", "string"), ("publisher", "string"), ("topics", "array<string>"), ("cited_by", "long"), ("open", "boolean"), ("url", "string")
    return items.select(*keep, "rank", *[fields.get(name, F.array() if kind.startswith("array") else F.lit(None)).cast(kind).alias(name) for name, kind in shape])


def unreadable(answers: DataFrame, body: str, kind: str) -> DataFrame:
    """The answers that do not hold the list of their kind."""
    return answers.filter(_get(F.try_parse_json(F.col(body)), LISTS[kind], "array<variant>").isNull())


def works_records(answers: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """Records of `results` of works, with the place of each as its rank."""
    v = F.col("v")
    names = lambda path, inner: F.array_compact(F.transform(F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>")), lambda x: F.nullif(_get(x, inner), F.lit(""))))
    return _record(
        _items(answers, body, LISTS["works"], keep), keep, record_id=_get(v, "$.id"), title=F.coalesce(_get(v, "$.display_name"), _get(v, "$.title"), F.lit("")), authors=names("$.authorships", "$.author.display_name"),
        year=_get(v, "$.publication_year", "int"), type=_get(v, "$.type"), language=_get(v, "$.language"), doi=ids.doi(_get(v, "$.doi")), journal=_get(v, "$.primary_location.source.display_name"),
        publisher=_get(v, "$.primary_location.source.host_organization_name"), topics=names("$.topics", "$.display_name"), cited_by=_get(v, "$.cited_by_count", "long"), open=_get(v, "$.open_access.is_oa", "boolean"),
        url=F.coalesce(_get(v, "$.best_oa_location.landing_page_url"), _get(v, "$.best_oa_location.pdf_url"), _get(v, "$.id")),
    )


def registry_records(answers: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """Records of `message.items` that have a title and are no containers; the first dated statement gives the year."""
    v = F.col("v")
    people = F.transform(F.coalesce(_get(v, "$.author", "array<variant>"), F.array().cast("array<variant>")), lambda a: F.nullif(F.trim(F.concat_ws(" ", _get(a, "$.given"), _get(a, "$.family"))), F.lit("")))
    year = F.coalesce(*[_get(v, f"$['{k}']['date-parts'][0][0]", "int") for k in ("published", "published-print", "published-online", "issued", "created")])
    doi = ids.doi(_get(v, "$.DOI"))
    url = F.coalesce(_get(v, "$.URL"), F.concat(F.lit("https://doi.org/"), doi))
    found = _record(
        _items(answers, body, LISTS["registry"], keep), keep, record_id=F.concat(F.lit("registry:"), F.coalesce(doi, _get(v, "$.URL"))), title=clean(_first(v, "$.title")), authors=F.array_compact(people), year=year, type=_get(v, "$.type"),
        language=_get(v, "$.language"), doi=doi, isbn=_isbn(_many(v, "$.ISBN")), journal=_first(v, "$['container-title']"), publisher=_get(v, "$.publisher"), topics=_many(v, "$.subject"), cited_by=_get(v, "$['is-referenced-by-count']", "long"), url=url,
    )
    return found.filter(F.col("title").isNotNull() & ~F.coalesce(F.lower(F.trim("type")).isin(*CONTAINERS), F.lit(False)))


def archive_records(answers: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """Records of `response.docs`, whose fields are single values or lists; a declared year leads, then that of the date."""
    v = F.col("v")
    declared = _first(v, "$.year").try_cast("int")
    dated = F.nullif(F.regexp_extract(F.coalesce(_first(v, "$.date"), F.lit("")), r"\b(1[0-9]{3}|20[0-9]{2}|21[0-9]{2})\b", 1), F.lit("")).cast("int")
    key = clean(_first(v, "$.identifier"))
    return _record(
        _items(answers, body, LISTS["archive"], keep), keep, record_id=F.concat(F.lit("archive:"), key), title=F.coalesce(clean(_first(v, "$.title")), F.lit("")), authors=_texts(_many(v, "$.creator")),
        year=F.coalesce(F.when(declared.between(1000, 2200), declared), dated), type=F.lit("archive-text"), language=language_code(_first(v, "$.language")), isbn=_isbn(_many(v, "$.isbn")), publisher=clean(_first(v, "$.publisher")),
        topics=F.slice(_texts(_many(v, "$.subject")), 1, 20), url=F.concat(F.lit("https://archive.org/details/"), F.replace(F.url_encode(key), F.lit("+"), F.lit("%20"))),
    )


def person_records(answers: DataFrame, body: str, person: str, keep: list[str]) -> DataFrame:
    """A record per group of a person's public work summaries; person names the column of the person's ORCID.

    The fullest summary leads (title, DOI, year, address; the first among equals); year and month come from one summary.
    Identifiers of a whole that the work is part of are not its own. A group without title or public summary gives none.
    """
    value = lambda s, path: F.nullif(F.trim(F.coalesce(_get(s, f"{path}.value"), _get(s, path))), F.lit(""))
    external = lambda s: F.coalesce(_get(s, "$['external-ids']['external-id']", "array<variant>"), F.array().cast("array<variant>"))
    own = lambda i: (F.lower(_get(i, "$['external-id-type']")) == "doi") & (F.lower(F.coalesce(_get(i, "$['external-id-relationship']"), F.lit("self"))) != "part-of")
    doi = lambda s: F.get(F.array_compact(F.transform(F.filter(external(s), own), lambda i: ids.doi(_get(i, "$['external-id-value']")))), F.lit(0))
    isbn = lambda s: F.transform(F.filter(external(s), lambda i: F.lower(_get(i, "$['external-id-type']")).isin("isbn", "isbn-10", "isbn-13")), lambda i: _get(i, "$['external-id-value']"))
    part = lambda s, name, lo, hi: F.when(value(s, f"$['publication-date'].{name}").try_cast("int").between(lo, hi), value(s, f"$['publication-date'].{name}").try_cast("int"))
    url = lambda s: F.when(value(s, "$.url").rlike("^(?i:https?)://[^/]"), value(s, "$.url"))
    read = lambda s: F.struct(value(s, "$.title.title").alias("title"), doi(s).alias("doi"), part(s, "year", 1, 3000).alias("year"), url(s).alias("url"), _get(s, "$.type").alias("type"), value(s, "$['journal-title']").alias("journal"), _get(s, "$['put-code']", "long").alias("code"), isbn(s).alias("isbn"))
    open_to_all = lambda s: ~F.coalesce(_get(s, "$.visibility").isin("limited", "private"), F.lit(False))
    summaries = F.transform(F.filter(_get(F.col("v"), "$['work-summary']", "array<variant>"), open_to_all), read)
    # read once per group; fields of the fullest summary and the first of each across the group are then plain columns
    named = list(dict.fromkeys([*keep, person]))
    groups = _items(answers, body, LISTS["person"], named).select(*named, "rank", F.explode(F.array(summaries)).alias("m")).filter(F.size("m") > 0)
    full = lambda s: sum(((F.coalesce(s["title"], s["journal"]) if c == "title" else s[c]).isNotNull().cast("int") for c in ("title", "doi", "year", "url")), F.lit(0))
    best = F.array_max(F.transform("m", lambda s, i: F.struct(full(s).alias("n"), (-i).alias("at"))))["at"]
    first = lambda c: F.get(F.array_compact(F.transform("m", lambda s: s[c])), F.lit(0))
    lead = F.get("m", -best)
    titled = groups.withColumn("title", F.coalesce(lead["title"], lead["journal"], F.get(F.array_compact(F.transform("m", lambda s: F.coalesce(s["title"], s["journal"]))), F.lit(0)))).filter("title is not null")
    who = F.col(person)
    tail = F.coalesce(first("code").cast("string"), F.concat(F.lower("title"), F.lit(":"), F.coalesce(first("year").cast("string"), F.lit(""))))
    page = F.concat(F.lit("https://orcid.org/"), who)
    return _record(
        titled, keep, record_id=F.concat(F.lit("orcid:"), who, F.lit(":"), tail), title=F.col("title"), authors=F.array(who), year=first("year"), type=lead["type"], doi=first("doi"),
        isbn=F.array_distinct(F.flatten(F.transform("m", lambda s: s["isbn"]))), journal=lead["journal"], url=F.coalesce(first("url"), F.concat(F.lit("https://doi.org/"), first("doi")), page),
    )


def csv_records(answers: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """keep, rank, and a map from the header's names (lower case) to the trimmed cells of each row of a CSV answer.

    Quoted cells may hold commas, doubled quotes and line ends; rows without any text go.
    """
    text = F.regexp_replace(F.coalesce(F.col(body), F.lit("")), "^﻿", "")
    lines = F.regexp_extract_all(text, F.lit(r'(?:[^"\r\n]|"(?:[^"]|"")*+")+'), F.lit(0))
    bare = lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, r'^"|"\s*$', ""), F.lit('""'), F.lit('"'))).otherwise(c)
    # a comma before the line gives each cell one, so that empty cells count
    cells = lambda line: F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*+"\s*|[^,]*)'), F.lit(1)), lambda c: F.trim(bare(c)))
    kept = F.filter(lines, lambda line: F.exists(cells(line), lambda c: c != ""))
    whole = answers.select(*keep, F.explode(F.array(kept)).alias("lines"))
    # header and lines are columns before lines become rows: what is read from the list after that is copied to each row
    parts = whole.select(*keep, F.transform(cells(F.get("lines", F.lit(0))), F.lower).alias("head"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))).alias("tail"))
    split = parts.select(*keep, "head", F.posexplode("tail").alias("_at", "line")).select(*keep, "head", "_at", F.explode(F.array(cells(F.col("line")))).alias("cells"))
    # a name that stands twice in a header keeps its last cell, as a record would
    pairs = F.array_sort(F.transform(F.array_distinct("head"), lambda h: F.struct(h.alias("key"), F.coalesce(F.get("cells", F.size("head") - F.array_position(F.reverse("head"), h).cast("int")), F.lit("")).alias("value"))))
    return split.select(*keep, (F.col("_at") + 1).alias("rank"), F.map_from_entries(pairs).alias("cell"))


def profile_records(answers: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """People found by a CSV search: orcid, name (credited, else given and family, else the ORCID), other names, institutions."""
    cell = lambda *names: F.coalesce(*[F.nullif(F.try_element_at("cell", F.lit(n)), F.lit("")) for n in names])
    listed = lambda x: F.array_distinct(F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "[;|]"), lambda n: F.trim(n)), lambda n: n != ""))
    who = ids.orcid(cell("orcid", "orcid-id", "orcid-identifier"))
    name = F.coalesce(cell("credit-name"), F.nullif(F.concat_ws(" ", cell("given-names", "given-name"), cell("family-name", "family-names")), F.lit("")), who)
    at = F.array_distinct(F.array_compact(F.array(cell("current-institution-affiliation-name"), cell("past-institution-affiliation-name"), cell("institution-name"))))
    return csv_records(answers, body, keep).filter(who.isNotNull()).select(*keep, "rank", who.alias("orcid"), name.alias("name"), listed(cell("other-name")).alias("other_names"), at.alias("institutions"))


def fetch_pages(
    requests: DataFrame, url: str, key: str, fetch: Callable[[str], tuple[int, str, float | None]], following: Callable[[str, str], str | None],
    attempts: int = 4, delay: float = 75.0, sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """key, page, url, status, body, tries of every page of each request; key is a text that names the source.

    fetch(url) answers status, body and how long to wait if told; following(url, body) the next address, or None. A status
    of 429 or from 500 on is tried again after what was told, else after `delay`, at most `attempts` times; other statuses
    and the last try end the source with the status in its last row, so `keep_previous` can fall back on the last snapshot.
    Pages stream out one by one, a worker holds one. A lost task asks again from the first page: fetch must only read.
    An address that a source gives twice ends it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, start in zip(frame["key"], frame["url"], strict=True):
                page, at, seen = 1, start, set()
                while at is not None and at not in seen:
                    seen.add(at)
                    for tries in range(1, attempts + 1):
                        status, body, told = fetch(at)
                        if tries == attempts or not (status == 429 or status >= 500):
                            break
                        sleep(delay if told is None else told)
                    yield pd.DataFrame({"key": [source], "page": [page], "url": [at], "status": [status], "body": [body], "tries": [tries]})
                    at, page = (following(at, body), page + 1) if 200 <= status < 300 else (None, page)

    asked = requests.select(F.col(key).cast("string").alias("key"), F.col(url).alias("url"))
    return asked.mapInPandas(run, "key string, page long, url string, status int, body string, tries int").withColumnRenamed("key", key)
