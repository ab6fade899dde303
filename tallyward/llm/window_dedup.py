"""Removal of repeated word windows: every word inside a window of `length` words that also starts in a document of smaller id.

A count-min sketch goes first, exact grouping second:

* A window's mark is the smallest hash of the word grams in it, the last one of equals; equal windows have equal marks. Windows in
  a row with the same mark gram are a run, which is counted once, in the cells of its mark. A window is in one run only, so that
  the cells of its mark hold at least its own count: the sketch overestimates, as it should, with a fraction of the additions.
* Each task sketches its rows; the sketches are merged by segments of cells, in two rounds. A counter only tells none, once and
  more, so the merged sketch is one bit a cell. Its size is fixed, which bounds the broadcast; a corpus too large for it fills
  the cells, and more windows than need be go on to the second pass. None is lost.
* The second pass takes the runs whose mark is estimated to be there more than once. Runs of the same words are one class, whose
  smallest id is known by plain aggregation; all windows of its other documents repeat. Only if a mark has several classes are
  their windows grouped one by one, each class once, however many copies it has.

Words, runs and windows are told apart by 128-bit hashes, rows by their id and a 64-bit hash of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import documents, held, resident, slices, sliding_min, text_bytes

LENGTH = 50
#: Words of a gram.
GRAM = 8
#: The sketch has two rows of 2 to so many cells, and so one bit for each: 32 MB are sent to the tasks.
BITS = 27
#: Cells of a row are merged by segments of 2 to so many.
SEGMENT_BITS = 22
#: Tasks whose sketches are merged in the first round: those of equal number modulo this.
FAN = 16
#: Marks that a task gathers before it sends their cells on.
GATHERED = 1 << 20
#: Windows worked on at once; a longer text is cut into pieces that overlap, so that no window is lost.
PIECE = 1 << 18
#: Hashes of words remembered by a Python worker, and the bytes of the longest word remembered.
MAX_WORDS = 200_000
LONGEST_WORD = 64

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def mixed(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Two arrays of 64-bit hashes made one; the order matters."""
    out = (a ^ (a >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    out = (out + b) * np.uint64(0xA0761D6478BD642F)
    return out ^ (out >> np.uint64(32))


def joined_hashes(words: np.ndarray, count: int) -> np.ndarray:
    """A hash of the `count` words from each position, put together from powers of two."""
    n = len(words) - count + 1
    if n <= 0:
        return words[:0]
    out, at, power, size = None, 0, words, 1
    while True:
        if count & size:
            out = power[at : at + n] if out is None else mixed(out, power[at : at + n])
            at += size
        if at == count:
            return out
        power, size = mixed(power[:-size], power[size:]), 2 * size


class WordHashes(dict):
    """128-bit hashes of the words met lately."""

    def __missing__(self, word: bytes) -> bytes:
        found = xxhash.xxh3_128_digest(word)
        if len(self) >= MAX_WORDS:
            self.clear()
        if len(word) <= LONGEST_WORD:
            self[word] = found
        return found

    def of(self, text: bytes, size: int = 1 << 20) -> np.ndarray:
        """Two 64-bit hashes for each word of a text, which is split in parts of bounded size."""
        found, start = [], 0
        while start < len(text):
            cut = _SPACE.search(text, start + size)
            stop = cut.end() if cut else len(text)
            found += [self[word] for word in text[start:stop].split()] if cut else map(self.__getitem__, text[start:].split())
            start = stop
        return np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)


def buffers(texts: Iterable[np.ndarray], length: int, size: int = PIECE) -> Iterator[tuple]:
    """The words of texts strung together in buffers of bounded size: (hashes, where windows start, and for each part its text's
    number, its place in the text and its place in the buffer)."""
    parts: list[tuple[int, int, np.ndarray]] = []
    total = 0

    def buffer() -> tuple:
        ends = np.cumsum([0, *(len(p) for _, _, p in parts)])
        valid = np.zeros(ends[-1], bool)
        for start, end in zip(ends, ends[1:]):
            valid[start : end - length + 1] = True
        return np.concatenate([p for _, _, p in parts]), valid, np.array([n for n, _, _ in parts]), np.array([o for _, o, _ in parts]), ends

    for number, words in enumerate(texts):
        for start in range(0, len(words) - length + 1, size):
            part = words[start : start + size + length - 1]
            if parts and total + len(part) > size + length:
                yield buffer()
                parts, total = [], 0
            parts.append((number, start, part))
            total += len(part)
    if parts:
        yield buffer()


def runs_of(words: np.ndarray, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mark, start, windows) of the runs. Grams are compared by 40 bits of their hash and then by place, in one number."""
    low = np.uint64((1 << 24) - 1)
    hashes = joined_hashes(words[:, 0], gram)
    least = sliding_min((hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64)), length - gram + 1)
    at = np.flatnonzero(valid[: len(least)])
    own = least[at]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (np.diff(at) != 1)))
    return hashes[(low - (own[first] & low)).astype(np.int64)], at[first], np.diff(first, append=len(at))


def _cells(marks: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mixed(marks, np.uint64(row + 1)) >> np.uint64(64 - bits)


def _sketched(marks: np.ndarray, bits: int, fan: int) -> pa.RecordBatch:
    """The cells of a task's marks by segment: those met, and those met more than once."""
    rows: list[tuple] = []
    low = np.uint64((1 << SEGMENT_BITS) - 1)
    for row in (0, 1):
        cells, counts = np.unique(_cells(marks, row, bits), return_counts=True)
        segments = (cells >> np.uint64(SEGMENT_BITS)).astype(np.int64)
        places = (cells & low).astype(np.uint32)
        cuts = np.flatnonzero(np.diff(segments)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(cells)]):
            own = places[start:stop]
            rows.append((row, int(segments[start]), fan, own.tobytes(), own[counts[start:stop] > 1].tobytes()))
    return _cell_batch(rows)


_CELLS = "row int, segment int, fan int, once binary, twice binary"


def _cell_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["row", "segment", "fan", "once", "twice"])


def _sketch_step(length: int, gram: int, bits: int):
    """Texts to the cells of their runs' marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = resident("window words", "hashes", WordHashes)
        fan, found, n = TaskContext.get().partitionId() % FAN, [], 0
        for batch in slices(batches, 1024, 0):
            for words, valid, *_ in buffers((hashes.of(t) for t in text_bytes(batch.column(0))), length):
                marks = runs_of(words, valid, length, gram)[0]
                found.append(marks)
                n += len(marks)
                if n >= GATHERED:
                    yield _sketched(np.concatenate(found), bits, fan)
                    found, n = [], 0
        if found:
            yield _sketched(np.concatenate(found), bits, fan)

    return run


def _merge_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches that come sorted by (row, segment, fan) merged to one of each. Takes one segment's counters of memory."""
    once = twice = key = None

    def merged() -> pa.RecordBatch:
        return _cell_batch([(*key, np.flatnonzero(once).astype(np.uint32).tobytes(), np.flatnonzero(twice).astype(np.uint32).tobytes())])

    for batch in slices(batches, 64):
        for row, segment, fan, met, again in zip(*[c.to_pylist() for c in batch.columns]):
            if (row, segment, fan) != key:
                if key is not None:
                    yield merged()
                key, once, twice = (row, segment, fan), np.zeros(1 << SEGMENT_BITS, bool), np.zeros(1 << SEGMENT_BITS, bool)
            met, again = np.frombuffer(met, np.uint32), np.frombuffer(again, np.uint32)
            twice[met[once[met]]] = True
            twice[again] = True
            once[met] = True
    if key is not None:
        yield merged()


def _pack_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged sketches as bits: the cells met more than once."""
    for batch in batches:
        for row, segment, again in zip(*[batch.column(i).to_pylist() for i in (0, 1, 4)]):
            bits = np.zeros(1 << SEGMENT_BITS, bool)
            bits[np.frombuffer(again, np.uint32)] = True
            names = ["row", "segment", "bits"]
            yield pa.record_batch([pa.array([row], pa.int32()), pa.array([segment], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names)


def sketch(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, bits: int = BITS) -> list[bytearray]:
    """The merged sketch of all windows of a text column: for each of its two rows one bit a cell, set if met more than once.

    Runs a job. Two times 2 ** bits bits come to the driver, whatever the corpus.
    """
    bits = max(bits, SEGMENT_BITS)
    cells = texts.mapInArrow(_sketch_step(length, gram, bits), _CELLS)
    keys = ["row", "segment", "fan"]
    for _ in range(2):
        cells = cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge_step, _CELLS)
        keys = ["row", "segment"]
        cells = cells.withColumn("fan", F.lit(0))
    size = 1 << SEGMENT_BITS - 3
    rows = [bytearray(1 << bits - 3) for _ in range(2)]
    for found in cells.mapInArrow(_pack_step, "row int, segment int, bits binary").toLocalIterator():
        rows[found["row"]][found["segment"] * size : (found["segment"] + 1) * size] = found["bits"]
    return rows


def _estimated(sent: Broadcast) -> list[np.ndarray]:
    return [np.frombuffer(row, np.uint8) for row in sent.value]


def repeated_marks(rows: list[np.ndarray], marks: np.ndarray) -> np.ndarray:
    """Which marks the sketch estimates to be there more than once: all cells say so."""
    bits = int(len(rows[0]) * 8).bit_length() - 1
    out = np.ones(len(marks), bool)
    for number, row in enumerate(rows):
        cells = _cells(marks, number, bits)
        out &= (row[(cells >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
    return out


def _runs_step(sent: Broadcast, length: int, gram: int):
    """Rows (id, k, text) to their runs estimated to be there more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = resident("window words", "hashes", WordHashes)
        rows, digest = _estimated(sent), xxhash.xxh3_128_digest
        for batch in slices(batches, 1024, 2):
            for words, valid, numbers, offsets, ends in buffers((hashes.of(t) for t in text_bytes(batch.column(2))), length):
                marks, starts, windows = runs_of(words, valid, length, gram)
                again = repeated_marks(rows, marks)
                marks, starts, windows = marks[again], starts[again], windows[again]
                part = np.searchsorted(ends, starts, side="right") - 1
                raw = memoryview(np.ascontiguousarray(words)).cast("B")
                contents = b"".join([digest(raw[16 * a : 16 * b]) for a, b in zip(starts.tolist(), (starts + windows + length - 1).tolist())])
                both = np.frombuffer(contents, np.int64).reshape(-1, 2)
                owner = pa.array(numbers[part])
                found = [both[:, 0], both[:, 1], marks.view(np.int64), starts - ends[part] + offsets[part], windows]
                columns = [batch.column(0).take(owner), batch.column(1).take(owner), *(pa.array(np.ascontiguousarray(c, dtype=np.int64)) for c in found)]
                yield pa.record_batch(columns, ["id", "k", "c1", "c2", "mark", "start", "windows"])

    return run


def _windows_step(length: int):
    """Rows (text, runs) to the windows of the runs, each with the class it belongs to, its place there and the class's first id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = resident("window words", "hashes", WordHashes)
        for batch in slices(batches, 256, 1):
            for owner, (text, runs) in enumerate(zip(text_bytes(batch.column(1)), batch.column(2))):
                words = hashes.of(text)
                own = runs.as_py()
                for at in range(0, len(own), 4096):
                    part = own[at : at + 4096]
                    lanes = [np.concatenate([joined_hashes(words[r["start"] : r["start"] + r["windows"] + length - 1, n], length) for r in part]) for n in (0, 1)]
                    counts = [r["windows"] for r in part]
                    classes = np.repeat(np.array([(r["c1"], r["c2"]) for r in part], np.int64), counts, axis=0)
                    offsets = np.concatenate([np.arange(n, dtype=np.int64) for n in counts])
                    found = [lanes[0].view(np.int64), lanes[1].view(np.int64), classes[:, 0], classes[:, 1], offsets]
                    columns = [batch.column(0).take(pa.array(np.full(len(offsets), owner))), *(pa.array(np.ascontiguousarray(c)) for c in found)]
                    yield pa.record_batch(columns, ["first", "w1", "w2", "c1", "c2", "offset"])

    return run


def _joined(texts: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Rows by id and text hash; null ids meet."""
    return texts.join(other, texts["id"].eqNullSafe(other["other_id"]) & (texts["k"] == other["other_k"]), how).drop("other_id", "other_k")


def repeated_runs(texts: DataFrame, length: int, gram: int, bits: int) -> DataFrame:
    """(id, k, start, windows, offsets) of the runs of rows (id, k, text) that hold windows which start in a smaller id too: all of
    the run's windows if offsets is null, else those at the offsets."""
    kind = texts.schema["id"].dataType.simpleString()
    long = texts.where(F.octet_length("text") >= 2 * length - 1)
    sent = texts.sparkSession.sparkContext.broadcast(sketch(long.select("text"), length, gram, bits))  # of fixed size
    every = held(long.mapInArrow(_runs_step(sent, length, gram), f"id {kind}, k long, c1 long, c2 long, mark long, start long, windows long"), "runs")

    place = F.struct(F.col("id").isNull().alias("null"), "id", "k", "start")
    classes = every.groupBy("c1", "c2").agg(F.min(place).alias("place"), F.any_value("mark").alias("mark"), F.any_value("windows").alias("windows"), F.count("*").alias("n"))
    classes = held(classes.select("c1", "c2", "mark", "windows", "n", "place.id", "place.k", "place.start"), "classes")

    # A mark of one class only is done; of the others, each class's windows are looked at in one of its rows.
    several = classes.groupBy("mark").agg(F.count("*").alias("classes")).where("classes > 1")
    wanted = classes.join(several, "mark", "left_semi")
    by_row = wanted.groupBy(F.col("id").alias("other_id"), F.col("k").alias("other_k")).agg(F.collect_list(F.struct("c1", "c2", "start", "windows")).alias("runs"))
    shape = f"first {kind}, w1 long, w2 long, c1 long, c2 long, offset long"
    windows = _joined(texts, by_row, "inner").select(F.col("id").alias("first"), "text", "runs").mapInArrow(_windows_step(length), shape)
    windows = held(windows, "windows")
    least = windows.groupBy("w1", "w2").agg(F.min("first").alias("least"), F.max("first").alias("most"), F.count_if(F.col("first").isNull()).alias("without"))
    least = least.where("least < most OR (without > 0 AND least IS NOT NULL)").select("w1", "w2", "least")
    later = windows.join(least, ["w1", "w2"]).where("first > least OR first IS NULL")
    # A run has fewer windows than a window has words.
    inside = later.groupBy("c1", "c2").agg(F.collect_set("offset").alias("offsets"))

    known = classes.select("c1", "c2", F.col("id").alias("first"), "n").join(inside, ["c1", "c2"], "left").where("n > 1 OR offsets IS NOT NULL")
    known = held(known, "known")  # so that the join is of two plain tables, and Spark can split a class of many copies
    whole = F.when(F.col("id").isNull(), F.col("first").isNotNull()).otherwise(F.col("id") > F.col("first"))
    placed = every.join(known, ["c1", "c2"]).withColumn("whole", whole).where("whole OR offsets IS NOT NULL")
    return placed.select("id", "k", "start", "windows", F.when(~F.col("whole"), F.col("offsets")).alias("offsets"))


def removed_words(n: int, runs: list[dict], length: int) -> np.ndarray:
    """Which of a text's words are in a repeated window."""
    steps = np.zeros(n + 1, np.int64)
    for run in runs:
        offsets = run["offsets"]
        if offsets is None:
            steps[run["start"]] += 1
            steps[run["start"] + run["windows"] + length - 1] -= 1
        else:
            for offset in offsets:
                steps[run["start"] + offset] += 1
                steps[run["start"] + offset + length] -= 1
    return np.cumsum(steps[:-1]) > 0


def word_edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end, given which bytes are inside words; the last byte is not."""
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.append(0, edges)
    return edges[::2], edges[1::2]


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) in bytes of a text's words."""
    return word_edges(~_SPACES[np.frombuffer(text + b" ", np.uint8)])


def kept_text(text: bytes, runs: list[dict], length: int) -> tuple[int, list[dict], bytes]:
    """(words, spans removed as first word and word after the last, the other words joined by one space)."""
    data = np.frombuffer(text + b" ", np.uint8)
    inside = ~_SPACES[data]
    starts, ends = word_edges(inside)
    gone = removed_words(len(starts), runs, length)
    left = inside.copy()
    if runs:
        left[inside] = np.repeat(~gone, ends - starts)
    left[ends[~gone]] = True
    cuts = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    spans = [{"start": int(a), "end": int(b)} for a, b in zip(cuts[::2], cuts[1::2])]
    return len(starts), spans, np.where(inside, data, 0x20).astype(np.uint8)[left].tobytes()[:-1]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _remove_step(length: int, with_text: bool):
    """Rows (id, text, runs) to what is removed and left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, 1):
            counts, gone, digests, lists, left = [], [], [], [], []
            for text, runs in zip(text_bytes(batch.column(1)), batch.column(2)):
                n, spans, kept = kept_text(text, runs.as_py() or [], length)
                counts.append(n)
                gone.append(sum(s["end"] - s["start"] for s in spans))
                digests.append(sha256(kept).hexdigest())
                lists.append(spans)
                left.append(kept if with_text else None)
            columns = [
                batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(lists, _SPANS),
                pa.array(left, pa.binary()).cast(pa.string()),
            ]
            yield pa.record_batch(columns, ["id", "n_words", "n_removed", "kept_sha256", "spans", "kept"])

    return run


def dedup(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM,
          bits: int = BITS, with_text: bool = False) -> DataFrame:
    """Per row the id column, `n_words`, `n_removed`, `kept_sha256` (of the kept words joined by one space), the `spans` of words
    removed and, if asked for, `kept`, the text left.

    Windows are judged on the input. Ids may be of any type that has an order; a null id is larger than all others, and rows
    without an id do not repeat each other. Rows of the same id do not repeat each other either, so repeated rows come out alike.
    A null or empty text, or one of white space, has no words; a text of fewer words than a window keeps all. Other columns are
    ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    source = documents(frame, *dict.fromkeys((id_column, text_column)))
    texts = source.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(text).alias("k"), text.alias("text"))
    runs = repeated_runs(texts, length, gram, bits)
    # A row's runs are fewer than its words.
    listed = runs.groupBy(F.col("id").alias("other_id"), F.col("k").alias("other_k")).agg(F.collect_set(F.struct("start", "windows", "offsets")).alias("runs"))
    kind = texts.schema["id"].dataType.simpleString()
    shape = f"id {kind}, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept string"
    found = _joined(texts, listed, "left").select("id", "text", "runs").mapInArrow(_remove_step(length, with_text), shape)
    found = found if with_text else found.drop("kept")
    return found.withColumnRenamed("id", id_column)


def report(frame: DataFrame) -> DataFrame:
    """Every document with what is removed of it."""
    return dedup(frame).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The same as SQL.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS x
  FROM (SELECT * FROM d WHERE len(w) >= 50), LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)
), again AS (
  SELECT r, i FROM win JOIN (SELECT x, min(doc_id) AS least FROM win GROUP BY x HAVING count(*) > 1) USING (x)
  WHERE doc_id > least OR (doc_id IS NULL AND least IS NOT NULL)
), gone AS (SELECT DISTINCT r, p FROM again, LATERAL (SELECT unnest(range(i, i + 50)) AS p)),
listed AS (SELECT r, count(*)::BIGINT AS n_removed, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE
         list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN listed USING (r)
"""
