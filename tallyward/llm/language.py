"""Language identification: known words first, then ever shorter character n-grams.

A word that the training texts hold is scored by its frequency in each language. Any other word is scored by those of its
four-character pieces that are known, if there are none by the three-character ones, and so on. The scores of all words add
up; the language with the highest sum is the answer, its share of the total probability the score.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import documents, resident, slices, text_bytes
from tallyward.operators.topn import first_per_key

#: Training texts per language: those with the smallest hash. They bound the fit; predictions cover all rows. All their words and
#: n-grams are kept, with their counts in every language.
MAX_TEXTS = 2_000
LONGEST = 4
#: Words with their scores remembered by a Python worker.
MAX_REMEMBERED = 200_000
UNDETERMINED = "und"

_WORDS = regex.compile(r"\p{L}+").findall


@dataclass(frozen=True)
class Model:
    """The languages in order, and for words and n-grams their 64-bit hashes, sorted, and a row of log frequencies for each, one in
    each language. Hashes in an array take a fraction of the memory of a table of strings."""

    languages: tuple[str, ...]
    words: np.ndarray
    word_logs: np.ndarray
    grams: np.ndarray
    gram_logs: np.ndarray


def _hashes(items: Iterable[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(item.encode()) for item in items], np.uint64)


def _logs(counts: pa.Table, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the items and their log frequencies, from all counts by item and language, with half a count added everywhere."""
    items = counts.column("item").combine_chunks().dictionary_encode()
    table = np.zeros((len(items.dictionary), len(languages)))
    table[items.indices.to_numpy(), pc.index_in(counts.column("lang"), pa.array(languages, pa.string())).to_numpy()] = counts.column("n").to_numpy()
    return _hashes(items.dictionary.to_pylist()), np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * (len(table) + 1)))


def _sorted(hashes: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    return hashes[order], logs[order]


def _rows(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the hashes are in a sorted table, the rows of those)."""
    if not len(table):
        return np.zeros(len(wanted), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    known = table[at] == wanted
    return known, at[known]


def fit(frame: DataFrame, text_column: str = "text", lang_column: str = "lang", max_texts: int = MAX_TEXTS) -> Model:
    """A model of the languages of the rows with a text and a language. Copies of a text count once.

    Runs jobs. What comes to the driver is every distinct word and n-gram, with its counts by language, of at most `max_texts`
    whole texts of each.
    """
    rows = documents(frame, text_column, lang_column).toDF("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    # Only hashes are ranked; each language's last one then picks the texts. Copies of a text are one.
    first = first_per_key(hashed.select("lang", "hash").distinct(), ["lang"], [F.col("hash")], max_texts)
    last = {r["lang"]: r["last"] for r in first.groupBy("lang").agg(F.max("hash").alias("last")).collect()}
    bounds = F.create_map(*[F.lit(x) for pair in last.items() for x in pair]) if last else F.create_map().cast("map<string,long>")
    sample = hashed.where(F.col("hash") <= F.try_element_at(bounds, F.col("lang"))).groupBy("lang", "text").agg(F.count("*").alias("copies"))
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))
    words = sample.select("lang", F.explode(found).alias("item")).groupBy("lang", "item").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), "item", F.lit(" "))
    starts = F.sequence(F.lit(1), F.length("item") + 2)
    pieces = words.select("lang", "n", padded.alias("word"), F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("size"), starts.alias("starts"))
    pieces = pieces.select("lang", "n", "word", "size", F.explode("starts").alias("at")).where(F.expr("at + size <= length(word) + 1"))
    grams = pieces.select("lang", "size", F.expr("substring(word, at, size)").alias("item"), "n").where("trim(item) != ''")
    grams = grams.groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    found = words.select(F.lit(0).alias("size"), "lang", "item", "n").unionByName(grams).toArrow()
    languages = pc.unique(found.column("lang")).to_pylist()
    languages.sort()
    sizes = [found.filter(pc.equal(found.column("size"), size)) for size in range(LONGEST + 1)]
    # An n-gram's length is in its text, so that all lengths share a table.
    grams, gram_logs = zip(*[_logs(counts, languages) for counts in sizes[1:]])
    return Model(tuple(languages), *_sorted(*_logs(sizes[0], languages)), *_sorted(np.concatenate(grams), np.concatenate(gram_logs)))


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """The score of each word in each language; zeros if not even a character of it is known."""
    out = np.zeros((len(words), len(model.languages)))
    known, rows = _rows(model.words, _hashes(words))
    out[known] = model.word_logs[rows]
    for i in np.flatnonzero(~known):
        padded = f" {words[i]} "
        for size in range(LONGEST, 0, -1):
            rows = _rows(model.grams, _hashes(padded[i : i + size] for i in range(len(padded) - size + 1)))[1]
            if len(rows):
                out[i] = model.gram_logs[rows].sum(axis=0) / len(rows)
                break
    return out


class Scorer:
    """Predictions with the scores of words met lately remembered as rows of a matrix."""

    def __init__(self, model: Model, limit: int = MAX_REMEMBERED) -> None:
        self.model, self.limit = model, limit
        self.places: dict[str, int] = {}
        self.scores = np.zeros((limit, len(model.languages)))

    def predict(self, text: str) -> tuple[str, float]:
        """(language, probability); undetermined with 0 for a text without letters."""
        counts = Counter(_WORDS(text.lower()))
        if not counts or not self.model.languages:
            return UNDETERMINED, 0.0
        total = np.zeros(len(self.model.languages))
        words = iter(counts.items())
        while chunk := [pair for pair, _ in zip(words, range(self.limit))]:
            if len(self.places) + len(chunk) > self.limit:
                self.places.clear()
            known = len(self.places)
            at = np.array([self.places.setdefault(word, len(self.places)) for word, _ in chunk])
            if len(self.places) > known:
                self.scores[known : len(self.places)] = word_scores(self.model, list(islice(reversed(self.places), len(self.places) - known))[::-1])
            total += np.array([n for _, n in chunk], float) @ self.scores[at]
        best = int(total.argmax())
        return self.model.languages[best], float(1.0 / np.exp(np.maximum(total - total[best], -700.0)).sum())


def predict(frame: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column, `lang_pred` and `score` of each whole text.

    A null or empty text, one without letters, or a model without languages gives `und` with score 0. Ties go to the first
    language by name. Repeated rows and null ids are kept as they are. Other columns are ignored.
    """
    key, sent = uuid.uuid4().hex, frame.sparkSession.sparkContext.broadcast(model)  # bounded by the training texts of fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What another operator has left goes before the model is loaded.
        scorer = resident(key, "scorer", lambda: Scorer(sent.value))
        for batch in slices(batches, 2048, 1):
            found = [scorer.predict(t.decode(errors="replace")) for t in text_bytes(batch.column(1))]
            columns = [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
            yield pa.record_batch(columns, ["id", "lang_pred", "score"])

    source = documents(frame, id_column, text_column)
    shape = f"id {source.schema[0].dataType.simpleString()}, lang_pred string, score double"
    return source.mapInArrow(run, shape).withColumnRenamed("id", id_column)


def fold(id_column: str, folds: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo the number of folds. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))), F.lit(folds))


def trained(frame: DataFrame) -> Model:
    """A model of the documents outside the held-out fold."""
    return fit(frame.where(fold("doc_id", 4) != 2))


def report(frame: DataFrame) -> DataFrame:
    """Every document with its fold and prediction."""
    found = predict(frame, trained(frame))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
