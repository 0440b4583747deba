"""Harvested records: OAI-PMH pages as texts, incremental merges with deletions, host allow-lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.text import strip_html


def _all(xml: Column, tag: str) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>"), 1), strip_html)


def oai_records(pages: DataFrame, xml_col: str, fields: tuple[str, ...] = ("title", "creator", "date", "identifier", "subject", "language")) -> DataFrame:
    """One row per record of a ListRecords page: record_id, datestamp, deleted, and an array per Dublin Core field."""
    record = F.explode(F.regexp_extract_all(xml_col, F.lit(r"(?s)<(?:\w+:)?record(?:\s[^>]*)?>(.*?)</(?:\w+:)?record>"), 1)).alias("r")
    rows = pages.select(record)
    header = F.regexp_extract("r", r"(?s)<(?:\w+:)?header.*?</(?:\w+:)?header>", 0)
    body = F.regexp_replace("r", r"(?s)<(?:\w+:)?header.*?</(?:\w+:)?header>", "")
    one = lambda tag: F.get(_all(header, tag), F.lit(0))
    return rows.select(one("identifier").alias("record_id"), one("datestamp").alias("datestamp"), header.rlike(r'status\s*=\s*"deleted"').alias("deleted"), *[_all(body, f).alias(f) for f in fields])


def resumption_token(xml: Column) -> Column:
    """The token of the next page; null on the last."""
    return F.nullif(F.regexp_extract(xml, r"<(?:\w+:)?resumptionToken[^>]*>([^<]+)<", 1), F.lit(""))


def merge_harvest(previous: DataFrame, new: DataFrame, key: str = "record_id", stamp: str = "datestamp") -> DataFrame:
    """The latest version of each record, deleted ones gone; new rows win ties."""
    both = previous.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    by = W.partitionBy(key).orderBy(F.desc(stamp), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(by)).filter((F.col("_r") == 1) & ~F.coalesce("deleted", F.lit(False))).drop("_r", "_new")


def allowed(url: Column, hosts: list[str]) -> Column:
    """Whether a URL is http(s) and its host is on the list, or under a host on it."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    under = F.lit(False)
    for h in hosts:
        under |= (host == h) | host.endswith(f".{h}")
    return under
