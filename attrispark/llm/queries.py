"""The opN_<name> queries over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .divergence import quality_rules
from .interactions import audit_filters
from .language import identify_language
from .lattice import dedup_embeddings
from .licenses import scan_licenses, scan_sql
from .mixing import mix_sources
from .packing import pack_documents
from .pages import extract_pages
from .perplexity import classify_quality
from .simhash import simhash_groups
from .source_audit import audit_sources
from .substrings import dedup_substrings
from .suffixes import dedup_suffixes


#: The public vocabulary file that op9 packs with; a parameter of the operator.
PACK_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = PACK_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_suffixes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return found.withColumnRenamed("id", "doc_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).withColumnRenamed("id", "doc_id")


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_source_mixing": op8_source_mixing,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_license_scan": op10_license_scan,
    "op11_source_divergence": op11_source_divergence,
    "op12_language_id": op12_language_id,
    "op13_filter_interaction": op13_filter_interaction,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": oracle.EMBEDDINGS.replace("WITH v AS", "WITH RECURSIVE v AS", 1),
    "op3_substring_dedup": oracle.SUBSTRINGS,
    "op4_suffix_dedup": oracle.SUFFIXES,
    "op5_quality_rules": oracle.quality_rules(),
    "op10_license_scan": scan_sql(),
    "op8_source_mixing": oracle.source_mixing(),
    "op11_source_divergence": oracle.source_divergence(),
    "op13_filter_interaction": oracle.filter_interaction(),
}
