"""The corpus pipeline: five stages over documents, each calling one of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents. `run` writes each
stage's rows below spark.checkpoint.dir and reads them back, so that a stage sees what the one before kept, and a lost executor
costs no more than the stage it was on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import bpe, decontaminate, language, simhash, suffix_dedup
from tallyward.llm.common import held
from tallyward.llm.queries import table

#: The share of probability a document's language must have.
MIN_LANGUAGE_SCORE = 0.5
#: So many words in a row that are repeated are a passage, as are strings of suffix_dedup.LENGTH bytes.
PASSAGE_WORDS = 50
#: What a worker of the last stage remembers: pieces of text and states of the transducer.
MAX_PIECES = 100_000
MAX_STATES = 200_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: those with letters, and one language more likely than all others together.

    The model is learned from the documents outside the held-out fold, all documents are judged. Null and empty texts go.
    """
    told = language.predict(_packed(docs), language.trained(docs), "doc")
    kept = told.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, of equal ids the one with the smallest hash of
    its text. Rows equal in id and text are one document, of which any row stays; documents without an id come last.

    Rows are named by hashes of id and text, which stay the same whenever they are read.
    """
    name = [F.xxhash64(F.lit(seed), "doc_id", "text") for seed in (0, 1)]
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text", name[0].alias("h1"), name[1].alias("h2"))
    place = F.struct(F.col("doc.doc_id").isNull().alias("null"), F.col("doc.doc_id").alias("id"), "h1", "h2")
    classes = simhash.near_duplicates(named.select(place.alias("place"), "text"), "place")
    first = classes.where(F.col("place") == F.col("component")).select("place.h1", "place.h2")
    kept = named.select("doc", "h1", "h2").join(first, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    return kept.select("doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that are repeated anywhere; n_chars is that of the text left, which may be empty.

    A passage is a string of 400 bytes or 50 words in a row: most passages of so many words have fewer bytes.
    """
    left = suffix_dedup.dedup(_packed(docs, "text"), ("doc",), with_text=True, words=PASSAGE_WORDS)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated by the benchmark."""
    found = decontaminate.scan(_packed(docs), table(spark, sf_dir, "benchmark"), id_column="doc")
    return found.where(~decontaminate.contaminated()).select("doc.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the token ids' number and digest, and the digest of the text they decode to.

    Executors have grown in the stages before, so less is remembered here than `bpe` does by itself.
    """
    return bpe.round_trip(docs, max_pieces=MAX_PIECES, max_states=MAX_STATES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminated),
    ("byte_bpe", byte_bpe),
]

#: Language scores and fingerprints are beyond SQL; the stages are tested against plain versions instead.
ORACLE_SQL: str | None = None


def _packed(docs: DataFrame, *without: str) -> DataFrame:
    """The documents as one column, so that none of theirs can clash with an operator's, and the text."""
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in without]
    return docs.select(F.struct(*columns).alias("doc"), "text")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = held(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The pipeline as a query."""
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    """Its oracle, if there is one."""
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
