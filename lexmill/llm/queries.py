"""The registered queries of this package: each applies its operator to its whole table and derives its columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import conversation_repair, fingerprint, html_extract, jaccard_join, license_scan, mixing, packing, quality_classifier, quality_rules, secret_scan, suffix_tree, token_alignment, toxicity
from lexmill.llm.common import table
from lexmill.llm.oracles import REPAIR_SQL, mixing_sql


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(table(spark, sf_dir, "documents")))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stutters", *[c for c in judged.columns if c.startswith("max_")])


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


#: The chain: faults of quality first, then toxicity with the fault's probability as an input.
CATEGORIES = (toxicity.Category("low_quality", "quality", 0), toxicity.Category("toxic", "toxic", 1))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES))


def domain() -> Column:
    """Domains are fives of numbered sources: src0 to src4 are d0."""
    return F.concat(F.lit("d"), F.floor(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int") / 5).cast("string"))


MIX = mixing.Plan(domains={"d0": 40, "d1": 25, "d2": 20, "d3": 15}, languages={"en": 60, "de": 15, "fr": 15, "es": 10}, budget_percent=80)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"), MIX, domain())


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"), damaged=True)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_fingerprint": op2_fingerprint,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_html_extract": op6_html_extract,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_lm_score": op9_lm_score,
    "op10_secret_scan": op10_secret_scan,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_alignment": op12_token_alignment,
    "op13_quality_classifier": op13_quality_classifier,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op8_mixing": mixing_sql(MIX), "op11_conversation_repair": REPAIR_SQL}
