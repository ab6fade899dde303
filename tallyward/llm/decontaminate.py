"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all benchmark items.

Texts are lower-cased (A-Z) and cut into words of digits, ASCII letters and non-ASCII bytes. Each distinct word of the
benchmark is a letter of the automaton's alphabet, every other word of a document is letter 0, so a document is read once,
word by word, whatever the number of items. Word positions are mapped back to byte offsets of the original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import documents, held, resident, slices, text_bytes

WINDOW = 13
#: Words in the windows of one automaton, some 50 bytes each in a task. More windows make further automata, used in turn.
BLOCK_WORDS = 2_000_000

#: Bytes that are no part of a word become spaces, A-Z becomes a-z.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

Windows = dict[tuple[bytes, ...], set[str]]


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of a text."""
    return text.translate(_NORMAL).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    """Each run of `size` words; fewer words are one window, none give none."""
    if words:
        for at in range(max(1, len(words) - size + 1)):
            yield tuple(words[at : at + size])


def blocks(benchmark: DataFrame, id_column: str, text_column: str, size: int, block_words: int) -> Iterator[Windows]:
    """The windows of all items with the ids of their items, in blocks of bounded size, read item by item.

    The items are the stated query set, which every document meets in blocks. An item without id has the empty id.
    """
    found: Windows = {}
    held = 0
    rows = benchmark.select(F.col(f"`{id_column}`").cast("string"), F.col(f"`{text_column}`").cast("binary"))
    for item, text in rows.toLocalIterator():
        for window in windows_of(words_of(bytes(text or b"")), size):
            if window not in found:
                held += len(window)
            found.setdefault(window, set()).add(item or "")
            if held >= block_words:
                yield found
                found, held = {}, 0
    yield found


class Matcher:
    """The automaton of a block of windows."""

    def __init__(self, windows: Windows) -> None:
        self.letters: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in windows.items():
            key = tuple(self.letters.setdefault(word, len(self.letters) + 1) for word in window)
            self.automaton.add_word(key, (len(key), tuple(items)))
        if windows:
            self.automaton.make_automaton()

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(first word, word after the last, items) of each occurrence of a window."""
        if not self.letters or not words:
            return
        letter = self.letters.get
        for last, (length, items) in self.automaton.iter(tuple([letter(w, 0) for w in words])):
            yield last + 1 - length, last + 1, items


def _matcher(key: str, block: Broadcast) -> Matcher:
    """The automaton of a block, kept between the tasks of a Python worker."""
    return resident(key, "matcher", lambda: Matcher(block.value))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching runs made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def byte_spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words as byte offsets of the original text."""
    if not runs:
        return []
    in_word = np.frombuffer(text.translate(_NORMAL), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], in_word, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in runs]


RUNS = "array<struct<first:int,after:int>>"
_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def scan(frame: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS, id_column: str = "doc_id",
         text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document the id column, `n_words`, `n_hit`, the sorted `items` found and the byte `spans` of the words hit.

    A null or empty text, or one without words, has no hits; so has every text if the benchmark has no words. Items are
    told apart by their id as a string. Repeated rows are scanned each. Other columns are ignored.
    """
    source = documents(frame, id_column, text_column)
    kind = source.schema[0].dataType.simpleString()
    context = source.sparkSession.sparkContext
    found = source.withColumns({"runs": F.array().cast(RUNS), "items": F.array().cast("array<string>")})
    shape = f"id {kind}, text string, runs {RUNS}, items array<string>"
    pending = None
    for windows in blocks(benchmark, item_column, item_text, size, block_words):
        if pending is not None:  # the automata of all blocks would be in memory at once if they were one stage
            found = held(found.mapInArrow(_step(*pending), shape), "hits")
        pending = uuid.uuid4().hex, context.broadcast(windows)
    last = f"id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
    return found.mapInArrow(_step(*pending, True), last).withColumnRenamed("id", id_column)


def _step(key: str, block: Broadcast, last: bool = False):
    """A pass over the documents with one automaton, adding to the runs and items of the passes before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, block)
        for batch in slices(batches, 1024, 1):
            runs, items, counts, hits, spans = [], [], [], [], []
            before = zip(batch.column(2), batch.column(3))
            for text, (old_runs, old_items) in zip(text_bytes(batch.column(1)), before):
                words = words_of(text)
                own = [(r["first"], r["after"]) for r in old_runs.as_py()]
                ids = set(old_items.as_py())
                for first, after, found in matcher.matches(words):
                    own.append((first, after))
                    ids.update(found)
                own = merged(own)
                runs.append([{"first": a, "after": b} for a, b in own])
                items.append(sorted(ids))
                if last:
                    counts.append(len(words))
                    hits.append(sum(b - a for a, b in own))
                    spans.append(byte_spans(text, own))
            strings = pa.array(items, pa.list_(pa.string()))
            if last:
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), strings, pa.array(spans, _SPANS)]
                yield pa.record_batch(columns, ["id", "n_words", "n_hit", "items", "spans"])
            else:
                columns = [batch.column(0), batch.column(1), pa.array(runs, _RUNS), strings]
                yield pa.record_batch(columns, ["id", "text", "runs", "items"])

    return run


def contaminated():
    """The rule: some word is hit, and the words hit are at least a twentieth of all."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(frame: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The scan with the items as one digest and the verdict."""
    return scan(frame, benchmark).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


#: The same as SQL, for one window length per item length.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS x
  FROM b, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win),
own AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT * FROM d, sizes WHERE len(w) >= n), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
), hits AS (SELECT doc_id, i, own.n, item_id FROM own JOIN win USING (n, x)),
words AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM hits, LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items,
         sha256(array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',')) AS items_sha256 FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
