"""Query registration, and input relations that both engines derive from the star schema by the same plain SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.session import table


def registry() -> tuple[dict, dict[str, str], Callable]:
    """Queries, their DuckDB SQL, and the decorator that adds to both."""
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(fn):
            queries[fn.__name__] = fn
            if sql is not None:
                oracle[fn.__name__] = sql
            return fn

        return add

    return queries, oracle, query


def relation(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """The rows of a SELECT over test tables, which it names after FROM or JOIN."""
    names = set(re.findall(r"\b(?:FROM|JOIN) ([a-z]+)", sql))
    return spark.sql(re.sub(r"\b(FROM|JOIN) ([a-z]+)", r"\1 {\2}", sql), **{n: table(spark, d, n) for n in names})


def dealt(rows: DataFrame) -> DataFrame:
    """The rows over as many tasks as the session shuffles into: of a small file they would all be one task's."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Signals of a work, as the tier rules read them: scores may be null.
SIGNALS = """
SELECT p_partkey AS id, p_name AS title, p_partkey % 4 = 0 AS is_phenomenology, p_partkey % 3 = 0 AS is_ambiguous,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey * 7 % 101 AS DOUBLE) / 100 END AS hard_noise, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_partkey * 31 % 67 AS DOUBLE) / 100 END AS family,
  CAST(p_partkey * 17 % 83 AS DOUBLE) / 100 AS concept, p_partkey % 4 AS n_concepts, CAST(p_partkey * 5 % 61 AS DOUBLE) / 100 AS own, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey * 3 % 59 AS DOUBLE) / 100 END AS keyword,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey * 13 % 71 AS DOUBLE) / 100 END AS secondary, CASE WHEN p_size % 3 = 0 THEN 'physics' WHEN p_size % 3 = 1 THEN 'ethics' END AS top_domain, CAST(p_partkey % 90 AS DOUBLE) / 100 AS top_domain_score,
  p_size % 9 AS evidence, p_size % 4 = 0 AS has_text_hits, CASE p_size % 7 WHEN 0 THEN 'LOW_QUALITY' WHEN 1 THEN 'PARATEXT' WHEN 2 THEN 'EMPIRICAL_ADJACENT' WHEN 3 THEN 'REVIEW' ELSE 'SCHOLARLY' END AS role
FROM part"""

#: Works with titles that repeat, DOIs on some, authors, years, providers, citations.
WORKS = """
SELECT p_partkey AS id, concat(p_name, ' of ', lower(p_type), CASE WHEN p_partkey % 3 = 0 THEN ' and its other studies' ELSE ' in context' END, CASE WHEN p_partkey % 17 = 0 THEN ' vol 2' WHEN p_partkey % 19 = 0 THEN ' vol 3' ELSE '' END) AS title,
  concat('Author ', p_brand, ' ', CAST(p_size % 4 AS STRING)) AS author, CAST(1990 + p_size % 30 AS INT) AS year, CASE WHEN p_partkey % 5 = 0 THEN concat('10.1234/', CAST(p_partkey % 50 AS STRING)) END AS doi,
  CASE p_partkey % 3 WHEN 0 THEN 'journals' WHEN 1 THEN 'archive' ELSE 'registry' END AS provider, p_partkey * 7 % 500 AS citations, concat('On ', p_brand, ' and ', lower(p_type)) AS abstract, lower(p_type) AS topic
FROM part"""
