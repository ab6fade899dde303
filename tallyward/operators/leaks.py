"""Leak tests on free text: answers, prompts, documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions import pii_patterns as pii
from tallyward.functions.numbers import ratio


def flag_suspects(df: DataFrame, text_col: str) -> DataFrame:
    """Adds `may_hold_pii`, the cheap test."""
    return df.withColumn("may_hold_pii", pii.prefilter_hit(F.col(text_col)))


def flag_leaks(df: DataFrame, text_col: str) -> DataFrame:
    """Adds `leaks`: the text holds an e-mail address, phone number or street address."""
    return df.withColumn("leaks", pii.leak_hit(F.col(text_col)))


def leak_rows(df: DataFrame, key_cols: Sequence[str], text_col: str) -> DataFrame:
    """One row per match: the key columns, `position` from 0, `kind` and `match`."""
    found = df.select(*key_cols, F.posexplode(pii.leak_matches(F.col(text_col))).alias("position", "found"))
    kind = F.substring_index("found", ":", 1)
    return found.select(
        *key_cols, "position", kind.alias("kind"), F.expr("substring(found, length(substring_index(found, ':', 1)) + 2)").alias("match")
    )


def leak_rate(df: DataFrame, source_col: str, text_col: str) -> DataFrame:
    """(source, n, leaks, leak_rate) per source; counted in the map tasks, so a large source is no hot spot."""
    counts = df.groupBy(F.col(source_col).alias("source")).agg(
        F.count("*").alias("n"), F.count_if(pii.leak_hit(F.col(text_col))).alias("leaks")
    )
    return counts.withColumn("leak_rate", ratio(F.col("leaks"), F.col("n")))
