"""A corpus pipeline of the training-data operators; each stage is written as Parquet and read again.

Every stage works on all that its predecessor kept, and all but the last return the columns of documents: quality rules
drop documents, the n-gram Jaccard join keeps one of each group, secret scans blot secrets out, mixing takes documents
by target weights (some twice), and packing returns pieces of token sequences.

Stages take documents as they come: nulls in any column, empty and very long texts, ties and repeated rows, empty tables
and further columns of any name, with the results that their operators state. Rows without an id stay in the join, and
rows without a language, source or domain are mixed as the empty name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import jaccard_join, mixing, packing, quality_rules, secret_scan
from lexmill.llm.common import materialise, table
from lexmill.llm.queries import MIX, domain, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: the documents that pass."""
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the document of the least id of each group of copies and near copies."""
    return jaccard_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every document stays, with its secrets blotted out and its length counted anew."""
    return secret_scan.redact_secrets(docs, chars_col="n_chars")


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents by the target weights of domains and languages, each as often as it is taken."""
    return mixing.mix(docs, MIX, domain())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of sequences of 1024 tokens."""
    return packing.digest(packing.pack(docs, tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("jaccard_join", near_copies),
    ("secret_scan", secrets),
    ("mixing", target_mix),
    ("packing", pack),
]

#: The join and the packing are beyond SQL on whole texts: the pipeline is tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
