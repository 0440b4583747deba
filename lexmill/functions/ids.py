"""Identifiers and partial dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doi(x: Column) -> Column:
    """Lower-case DOI without resolver or label; null if it has no 10.prefix/suffix."""
    found = F.regexp_extract(F.lower(F.trim(x)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)?(10\.[0-9]{4,9}/\S+)$", 1)
    return F.nullif(found, F.lit(""))


def orcid(x: Column) -> Column:
    """Four dashed groups of an ORCID in upper case; null if there are none."""
    return F.nullif(F.upper(F.regexp_extract(F.coalesce(x, F.lit("")), r"([0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9Xx])", 1)), F.lit(""))


def openalex(x: Column) -> Column:
    """Letter and number of a work, author, source, institution, concept, publisher, funder or topic id, with or without its address; null otherwise."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(F.coalesce(x, F.lit("")))), r"^(?:HTTPS?://(?:API\.|EXPLORE\.)?OPENALEX\.ORG/(?:[A-Z]+/)?|OPENALEX:)?([WASICPFT][0-9]+)$", 1), F.lit(""))


def handle(x: Column) -> Column:
    """Prefix and suffix of a repository handle, from its address or bare, in lower case without a trailing slash; null otherwise."""
    bare = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return F.nullif(F.regexp_extract(bare, r"^(?:https?://[^/]+/(?:[a-z0-9_-]+/)*?(?:handle/)?|hdl:|handle:)?([0-9]+(?:\.[0-9a-z.]+)?/[^\s/?#]+)/?(?:[?#].*)?$", 1), F.lit(""))


def isbn(x: Column) -> Column:
    """Ten or thirteen digits; null otherwise."""
    bare = F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9Xx]", ""))
    return F.when(bare.rlike("^([0-9]{9}[0-9X]|97[89][0-9]{10})$"), bare)


def year(x: Column) -> Column:
    """The first year from 1000 to 2999 in a text; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), r"(?:^|[^0-9])([12][0-9]{3})(?:$|[^0-9])", 1), F.lit("")).cast("int")


def work_date(date: Column, declared: Column, month: Column) -> Column:
    """Struct (year, month, precision): the declared year first; a date gives its month only if its year agrees."""
    found = r"^([0-9]{4})-([0-9]{2})(?:-[0-9]{2})?$"
    valid = lambda y: F.when(y.between(1000, 2999), y)
    of = lambda i: F.nullif(F.regexp_extract(F.trim(F.coalesce(date, F.lit(""))), found, i), F.lit("")).cast("int")
    own = valid(of(1))
    y = F.coalesce(valid(declared), own)
    m = F.when(own == y, of(2)).otherwise(month)
    m = F.when(m.between(1, 12), m)
    return F.struct(y.alias("year"), m.alias("month"), F.when(y.isNull(), "unknown").when(m.isNull(), "year").otherwise("month").alias("precision"))


def decade(y: Column) -> Column:
    return (F.floor(y / 10) * 10).cast("int")


def partial_date(x: Column, reference_year: int) -> Column:
    """Struct (value, precision, quality) of an ISO or day-first date; zero months and days lower the precision.

    suspicious: 1969-12-31, before 1800, or later than the year after the reference year. unknown: no date at all.
    """
    text = F.trim(F.coalesce(x, F.lit("")))
    iso, dmy = r"^([0-9]{4})(?:-([0-9]{1,2})(?:-([0-9]{1,2}))?)?$", r"^([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})$"
    is_iso, is_dmy = text.rlike(iso), text.rlike(dmy)
    part = lambda i, d: F.when(is_iso, F.nullif(F.regexp_extract(text, iso, i), F.lit(""))).when(is_dmy, F.regexp_extract(text, dmy, d)).cast("int")
    y, m, d = part(1, 3), part(2, 2), part(3, 1)
    month, day = F.when(m.between(1, 12), m), F.when(d.between(1, 31), d)
    full = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    real = F.try_to_timestamp(full, F.lit("yyyy-MM-dd")).isNotNull()
    value = F.when(y.isNull(), None).when(month.isNotNull() & day.isNotNull() & real, full).when(month.isNotNull(), F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"))).otherwise(F.lpad(y.cast("string"), 4, "0"))
    precision = F.when(y.isNull(), "none").when(F.length(value) == 10, "day").when(F.length(value) == 7, "month").otherwise("year")
    quality = F.when(y.isNull(), "unknown").when((value == "1969-12-31") | (y < 1800) | (y > reference_year + 1), "suspicious").otherwise("valid")
    return F.struct(value.alias("value"), precision.alias("precision"), quality.alias("quality"))


def identity_key(doi_col: Column, provider: Column, source_id: Column, title: Column, y: Column, author: Column) -> Column:
    """doi, else the provider's own id, else folded title with year and author."""
    from lexmill.functions.text import fold

    own = F.when(source_id.isNotNull(), F.concat(provider, F.lit(":"), source_id))
    return F.coalesce(F.concat(F.lit("doi:"), doi(doi_col)), own, F.concat(F.lit("title:"), F.concat_ws("|", fold(title), y.cast("string"), fold(author))))
