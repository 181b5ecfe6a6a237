"""Queries opN_<name> over the driver's tables: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, lm_score, minhash, pieces, quality, sharding, suffix_dedup, url_filter, warc
from .common import table


def op1_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(table(spark, sf_dir, "documents", "doc_id", "text"), lm_score.labelled_good(spark, sf_dir))
    return scored.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages", "page_id", "html"))


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


def op7_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality.apply_rules(table(spark, sf_dir, "documents", "doc_id", "text", "source"), texts=False)
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.find_items(docs, items)
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items")


ALL = (
    op1_cross_entropy, op2_url_filter, op3_warc, op4_jump_sharding, op5_sampled_pieces, op6_lsh_forest,
    op7_suffix_arrays, op8_host_rules, op9_page_difference, op10_cgk_decontamination,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
