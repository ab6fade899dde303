"""The registered queries of the corpus operators, and the oracle SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tallyward.llm import (
    bpe, context_tree, decontaminate, divergence, hard_negatives, hilbert, html_text, language, licences, line_quality, simhash, suffix_dedup,
    window_dedup,
)

Query = Callable[[SparkSession, str], DataFrame]


ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole. Python workers are told where this package is, should the session not say so."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_text_to_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.report(table(spark, sf_dir, "pages"))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored, learned outside the held-out fold."""
    return context_tree.report(table(spark, sf_dir, "documents"))


def op4_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the held-out fold."""
    return language.report(table(spark, sf_dir, "documents"))


def op5_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is removed of it as repeated."""
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all windows of the benchmark."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by its counts and by the lines its source repeats."""
    return line_quality.quality(table(spark, sf_dir, "documents"))


def op8_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    return simhash.report(table(spark, sf_dir, "documents"))


def op9_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences named in every document."""
    return licences.report(table(spark, sf_dir, "documents"))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its place along the curve."""
    return hilbert.document_shards(table(spark, sf_dir, "documents"))


def op11_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, and by which terms."""
    return divergence.report(table(spark, sf_dir, "documents"))


def op12_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row, against all rows."""
    return hard_negatives.report(table(spark, sf_dir, "embeddings"))


def op13_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words removed as repeated from an earlier one."""
    return window_dedup.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    """Query by name."""
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_text_to_tag": op2_text_to_tag,
        "op3_context_tree": op3_context_tree,
        "op4_word_backoff": op4_word_backoff,
        "op5_suffix_arrays": op5_suffix_arrays,
        "op6_decontaminate": op6_decontaminate,
        "op7_line_frequency": op7_line_frequency,
        "op8_simhash_anchors": op8_simhash_anchors,
        "op9_licence_sentences": op9_licence_sentences,
        "op10_hilbert_shards": op10_hilbert_shards,
        "op11_run_lengths": op11_run_lengths,
        "op12_residue_negatives": op12_residue_negatives,
        "op13_count_min": op13_count_min,
    }


def oracle_sql() -> dict[str, str]:
    """Oracle SQL by query."""
    return {
        "op6_decontaminate": decontaminate.ORACLE,
        "op7_line_frequency": line_quality.ORACLE,
        "op9_licence_sentences": licences.ORACLE,
        "op11_run_lengths": divergence.ORACLE,
        "op12_residue_negatives": hard_negatives.ORACLE,
        "op13_count_min": window_dedup.ORACLE,
    }
