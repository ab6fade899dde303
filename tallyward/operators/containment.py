"""Which texts contain which known values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A value list up to this size is broadcast whole; beyond it, texts and values meet on character runs.
SMALL_VALUES = 300
SMALL_VALUE_CHARS = 1_000_000
RUN = 8
# Words of 64 bits in the map of run digests that texts are held against: 1 MB, whatever the list. A full map lets more
# through to the join and loses none.
MAP_WORDS = 1 << 17


def known_values(values: DataFrame, value_col: str) -> DataFrame:
    """Distinct lower-case values; null and empty ones can not leak."""
    value = F.lower(F.col(value_col).cast("string"))
    return values.select(value.alias("value")).where(F.length("value") > 0).distinct()


def texts_containing(
    texts: DataFrame, key: str, text_col: str, values: DataFrame, value_col: str, small: int = SMALL_VALUES
) -> DataFrame:
    """The rows of `texts` whose text contains any value, ignoring case. `key` must be unique.

    Probes the size of the value list first (a bounded job). A short list is broadcast and each text stops at
    its first hit. A long list meets the texts through `matching_pairs`.
    """
    wanted = known_values(values, value_col)
    size = wanted.limit(small + 1).agg(F.count("*"), F.coalesce(F.sum(F.length("value")), F.lit(0))).first()
    if size[0] <= small and size[1] <= SMALL_VALUE_CHARS:
        # Lowered before the join, else it would be lowered again for every value.
        folded = texts.withColumn("_text", F.lower(F.col(text_col)))
        return folded.join(F.broadcast(wanted), F.col("_text").contains(F.col("value")), "left_semi").drop("_text")
    hits = matching_pairs(texts, key, text_col, wanted).select(key).distinct()
    return texts.join(hits, key, "left_semi")


def matching_pairs(texts: DataFrame, key: str, text_col: str, values: DataFrame) -> DataFrame:
    """(key, value) for every text that contains a value of `known_values`; an equi-join, then a check.

    A value is looked up under its rarest run of RUN characters, which any text containing it must have too;
    a shorter value is its own run. Only run digests and keys take part in the first join, and of them only those
    that the anchors' map has, so texts are shuffled once, for the check, and only those with a candidate are compared.
    """
    anchors = _anchors(values)
    folded = texts.select(F.col(key), F.lower(F.col(text_col)).alias("_text"))
    candidates = mapped_runs(folded, key, anchors).join(anchors.select("run", "value"), "run").select(key, "value").distinct()
    return candidates.join(folded, key).where(F.col("_text").contains(F.col("value"))).select(key, "value")


def mapped_runs(folded: DataFrame, key: str, anchors: DataFrame) -> DataFrame:
    """(key, run): digests of the runs of each `_text` that may be an anchor; the others end in the task that made them."""
    lengths = [r[0] for r in anchors.select("length").distinct().collect()]  # at most RUN distinct lengths
    every = F.concat(*[_runs(F.col("_text"), n) for n in lengths]) if lengths else F.array().cast("array<string>")
    runs = folded.select(key, F.explode(F.array_distinct(every)).alias("run")).select(key, F.xxhash64("run").alias("run"))
    bits = F.get(_digest_map(anchors).scalar(), F.expr(f"CAST(shiftright(run, 6) & {MAP_WORDS - 1} AS INT)"))
    return runs.where(F.getbit(bits, F.expr("CAST(run & 63 AS INT)")) == 1)


def _digest_map(anchors: DataFrame) -> DataFrame:
    """One row: MAP_WORDS words, with a bit set for each anchor's digest."""
    word, bit = f"CAST(shiftright(run, 6) & {MAP_WORDS - 1} AS INT) AS word", "shiftleft(1L, CAST(run & 63 AS INT)) AS bits"
    none = anchors.sparkSession.range(0, MAP_WORDS, 1, 1).selectExpr("CAST(id AS INT) AS word", "0L AS bits")
    words = anchors.selectExpr(word, bit).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    whole = words.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return whole.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words")).select("words.bits")


def _runs(text: Column, length: int) -> Column:
    """All runs of `length` characters, overlapping; one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def _anchors(values: DataFrame) -> DataFrame:
    """(value, length, run): the digest of the run each value is looked up under."""
    sized = values.withColumn("length", F.least(F.length("value"), F.lit(RUN)))
    by_length = F.lit(None).cast("array<string>")
    for n in range(1, RUN + 1):
        by_length = F.when(F.col("length") == n, _runs(F.col("value"), n)).otherwise(by_length)
    runs = sized.select("value", "length", F.explode(F.array_distinct(by_length)).alias("run"))
    runs = runs.withColumn("run", F.xxhash64("run"))
    common = runs.groupBy("run").agg(F.count("*").alias("_shared"))
    return runs.join(common, "run").groupBy("value", "length").agg(F.min_by("run", F.struct("_shared", "run")).alias("run"))
