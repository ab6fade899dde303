"""Quality rules: counts on each text, and lines that too many documents of a host share.

A line is normalised (letters lower-cased, runs of digits one 0, everything but letters and digits one space) and hashed. A
line is boilerplate if more documents of its host hold it than both limits allow: a number, and a share of the host's
documents. Exact copies are one document. Boilerplate lines are removed; a document that loses too many of its words with
them is depleted and rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import documents, text_bytes

#: A line is removed if more documents of its host hold it than this number ...
MAX_DOCUMENTS = 20
#: ... and more than this share of them.
MAX_SHARE = 0.05
#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.3
SYMBOLS = "#*$%&|<>"
SPAN = 5

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], size: int = SPAN) -> int:
    """Words inside a window of `size` words that the text holds twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, total = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + size - max(covered, at)
            covered = at + size
    return total


def counts_of(text: bytes) -> tuple[int, int, int, int, int]:
    """The five counts of one text."""
    words = text.split()
    chars = sum(map(_code_points, words))
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    symbols = sum(text.count(s.encode()) for s in SYMBOLS)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def _code_points(word: bytes) -> int:
    return len(word) if word.isascii() else sum(b & 0xC0 != 0x80 for b in word)


def text_counts(frame: DataFrame, keys: list[str], text_column: str = "text") -> DataFrame:
    """The key columns and the five counts of each whole text; a null text has none of anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = list(zip(*map(counts_of, text_bytes(batch.column(len(keys)))))) or [()] * len(_COUNTS)
            columns = [*batch.columns[: len(keys)], *(pa.array(c, pa.int64()) for c in counts)]
            yield pa.record_batch(columns, [*keys, *_COUNTS])

    source = documents(frame, *keys, text_column)
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keys)]] + [f"{c} long" for c in _COUNTS])
    return source.mapInArrow(run, shape)


def normalised(line: Column) -> Column:
    """What makes two lines the same."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[^\p{L}\p{N}]+", " "))


def host_lines(frame: DataFrame, host_column: str, text_column: str) -> DataFrame:
    """(host, text_key, line_hash, words, line): a row per line with a letter or digit."""
    source = documents(frame, host_column, text_column).select(
        F.col(f"`{host_column}`").alias("host"), F.md5(F.coalesce(f"`{text_column}`", F.lit(""))).alias("text_key"),
        F.explode(F.split(F.col(f"`{text_column}`"), "\n")).alias("line"),
    )
    shape = normalised(F.col("line"))
    return source.withColumn("shape", shape).where("shape != ''").select(
        "host", "text_key", F.xxhash64("shape").alias("line_hash"), F.size(F.split("shape", " ")).alias("words"), "line"
    )


def boilerplate(lines: DataFrame, max_documents: int = MAX_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line_hash) of the lines above both limits. A null host is a host of its own."""
    held = lines.select("host", "line_hash", "text_key").distinct().groupBy("host", "line_hash").agg(F.count("*").alias("holders"))
    sizes = lines.select("host", "text_key").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    joined = held.where(F.col("holders") > max_documents).alias("l").join(sizes.alias("s"), F.expr("l.host <=> s.host"))
    return joined.where(F.col("holders") > max_share * F.col("documents")).select("l.host", "l.line_hash", "holders", "documents")


def depleted(lines: DataFrame, bad: DataFrame, min_left: float = MIN_LEFT) -> DataFrame:
    """(host, text_key, left) of the texts left with too small a share of their words.

    Copies of a text add the same to both sums, so that the share is that of one copy. Only texts with a removed line can
    be depleted; the others are filtered by the join before their words are summed up.
    """
    marked = lines.alias("l").join(bad.alias("b"), F.expr("l.host <=> b.host AND l.line_hash = b.line_hash"), "left")
    sums = marked.groupBy("l.host", "text_key").agg(
        F.sum(F.when(F.col("holders").isNull(), F.col("words")).otherwise(0)).alias("kept_words"), F.sum("words").alias("words")
    )
    return sums.where(F.col("kept_words") < min_left * F.col("words")).select(
        "host", "text_key", (F.col("kept_words") / F.col("words")).alias("left")
    )


def clean(frame: DataFrame, bad: DataFrame, host_column: str = "source", text_column: str = "text") -> DataFrame:
    """Texts without their boilerplate lines: (host, text_key, text), a row per host and distinct text that loses a line."""
    source = documents(frame, host_column, text_column).select(
        F.col(f"`{host_column}`").alias("host"), F.col(f"`{text_column}`").alias("whole"),
        F.md5(F.coalesce(f"`{text_column}`", F.lit(""))).alias("text_key"),
    )
    once = source.groupBy("host", "text_key").agg(F.any_value("whole").alias("whole"))
    lines = once.select("host", "text_key", F.posexplode(F.split("whole", "\n")).alias("at", "line"))
    hashed = lines.withColumn("line_hash", F.xxhash64(normalised(F.col("line")))).alias("l")
    marked = hashed.join(bad.alias("b"), F.expr("l.host <=> b.host AND l.line_hash = b.line_hash"), "left")
    rows = marked.groupBy("l.host", "text_key").agg(
        F.sort_array(F.collect_list(F.when(F.col("holders").isNull(), F.struct("at", "line")))).alias("kept"),
        F.count("holders").alias("removed"),
    )
    return rows.where("removed > 0").select("host", "text_key", F.array_join(F.col("kept.line"), "\n").alias("text"))


def base_failed() -> Column:
    """The rules on the text alone: too few words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality(frame: DataFrame, id_column: str = "doc_id", host_column: str = "source", text_column: str = "text",
            max_documents: int = MAX_DOCUMENTS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """Per row the id, the five counts, `base_failed`, `kept` and `words_left`, the share of words that are no boilerplate
    where that is too small, else null.

    A null or empty text has no words and fails the base rules. Null hosts are one host. Repeated rows and rows with the
    same id are judged each by its own text. Other columns are ignored. An empty table gives an empty result.
    """
    lines = host_lines(frame, host_column, text_column)
    lost = depleted(lines, boilerplate(lines, max_documents, max_share), min_left)
    keyed = documents(frame, id_column, host_column, text_column).select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{host_column}`").alias("host"),
        F.md5(F.coalesce(f"`{text_column}`", F.lit(""))).alias("text_key"), F.col(f"`{text_column}`").alias("text"),
    )
    counted = text_counts(keyed, ["id", "host", "text_key"]).withColumn("base_failed", base_failed()).alias("c")
    judged = counted.join(lost.alias("d"), F.expr("c.host <=> d.host AND c.text_key = d.text_key"), "left")
    return judged.select(
        F.col("id").alias(id_column), *_COUNTS, "base_failed", (~F.col("base_failed") & F.col("left").isNull()).alias("kept"),
        F.col("left").alias("words_left"),
    )


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, text, md5(coalesce(text, '')) AS k, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents
), base AS (
  SELECT doc_id, source, k, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines
  FROM d
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i) WHERE len(w) >= 5
), twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
again AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM twice, LATERAL (SELECT unnest(range(i, i + 5)) AS p) GROUP BY doc_id
), lines AS (
  SELECT source, k, trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS h
  FROM d, LATERAL (SELECT unnest(ls) AS l)
), shaped AS (SELECT *, len(string_split(h, ' ')) AS words FROM lines WHERE h <> ''),
sizes AS (SELECT source, count(DISTINCT k) AS documents FROM shaped GROUP BY source),
bad AS (
  SELECT s.source, s.h FROM (SELECT source, h, count(DISTINCT k) AS holders FROM shaped GROUP BY source, h) s
  JOIN sizes z ON s.source IS NOT DISTINCT FROM z.source
  WHERE holders > {MAX_DOCUMENTS} AND holders > {MAX_SHARE} * documents
), lost AS (
  SELECT s.source, s.k, sum(CASE WHEN b.h IS NULL THEN words ELSE 0 END) / sum(words) AS share
  FROM shaped s LEFT JOIN bad b ON s.source IS NOT DISTINCT FROM b.source AND s.h = b.h GROUP BY s.source, s.k
), joined AS (
  SELECT base.*, coalesce(again.n, 0)::BIGINT AS n_repeat_words, lost.share FROM base LEFT JOIN again USING (doc_id)
  LEFT JOIN lost ON base.source IS NOT DISTINCT FROM lost.source AND base.k = lost.k AND lost.share < {MIN_LEFT}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND share IS NULL AS kept, share AS words_left
FROM joined
"""
