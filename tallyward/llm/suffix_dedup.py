"""Removal of repeated passages: every byte inside a string of `length` bytes that also starts anywhere else.

Suffix arrays find the repeated strings, shard by shard. What is compared in a shard is chosen so that equal strings meet in
the same one, without moving every suffix of a corpus:

* A window is a string of `length` bytes. Its mark is the smallest hash of the grams in it, the last one of equals; equal
  windows have equal marks. Windows in a row with the same mark gram are a run: it starts somewhere, has a number of windows,
  and its bytes are those of all its windows. A run of mark h can only repeat windows of other runs of mark h.
* Runs whose mark no other run has are done. So are runs with the same bytes as another run: all their windows repeat. Of the
  rest, one run of each content is cut out of its text and sent to the shard of its mark.
* In a shard, contents are first narrowed to the windows whose 64-bit hash another one has; then a suffix array over them and the
  common prefixes of neighbours tell which windows start elsewhere too. A mark with many contents is cut into blocks, and each
  pair of blocks is a group of its own: two suffix arrays, merged by looking up the strings of one in the other by bisection.
* The pairs grow with the square of the contents, so a mark of more than PAIRED blocks is dealt otherwise. Equal windows have the
  mark's gram at the same place, so its contents are cut into pieces by that place, a sixth of the window at a time, and a piece
  goes to the shard of its core: the bytes that all windows of such places have. Pieces with the same bytes repeat each other;
  of a core with more of them than a shard holds, windows are looked up one by one by 128-bit hashes.
* If asked for, so many words in a row are a window too, whatever white space is between them. Their marks are hashes of word
  grams, told from the others by the lowest bit; in a shard such windows are compared by 128-bit hashes of their words.

Texts are told apart by two 64-bit hashes, contents by a 128-bit one. Copies of a text are worked on once, but count as
often as they are there.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyward.llm import window_dedup
from tallyward.llm.common import documents, held, resident, slices, sliding_min, text_bytes
from tallyward.llm.suffix_arrays import Shard, merge, repeated

LENGTH = 400
#: Bytes of a gram: 8, 16 or 32.
GRAM = 32
#: A longer text is cut into pieces of this many windows to find its runs; no window is lost.
PIECE = 512 << 10
#: Bytes of the contents in one suffix array; a mark with more is cut into blocks of half of it.
SHARD = 1 << 20
#: A mark with more blocks is not compared in pairs of them, but by the cores of its pieces.
PAIRED = 4

_KEY = ["k1", "k2"]
#: The block of pieces.
_PIECE = -1


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes from each position."""
    hashes, size = data.astype(np.uint64), 1
    while size < gram:
        hashes = (hashes[:-size] << np.uint64(8 * size) | hashes[size:]) if size < 8 else _mixed(hashes[:-size], hashes[size:])
        size *= 2
    return _mixed(hashes, hashes)


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the `length` bytes from each position, put together from two grams that overlap."""
    gram = 1 << (length.bit_length() - 1)
    hashes = gram_hashes(data, gram)
    return _mixed(hashes[: max(0, len(data) - length + 1)], hashes[length - gram :])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = a * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed += b
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed


def runs_of(data: np.ndarray, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mark, start, windows) of the runs of a text; `valid` tells the starts of windows that lie within one document.

    Windows are compared by 40 bits of the gram's hash and then by place, the last first, in one number.
    """
    hashes = gram_hashes(data, gram)
    place = np.uint64((1 << 24) - 1) - np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min(hashes >> np.uint64(24) << np.uint64(24) | place, length - gram + 1)
    at = np.flatnonzero(valid[: len(least)])
    if not len(at):
        return np.zeros(0, np.int64), at, at
    own = least[at]
    fresh = np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(fresh)
    marks = hashes[(np.uint64((1 << 24) - 1) - (own[first] & np.uint64((1 << 24) - 1))).astype(np.int64)]
    return marks.view(np.int64), at[first], np.diff(first, append=len(at))


def pieces(texts: list[bytes], length: int, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts strung together in buffers of bounded size: (bytes, valid starts, text number and offset of each part's start)."""
    parts: list[tuple[int, int, bytes]] = []
    held_bytes = 0

    def buffer():
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        valid = np.zeros(len(data), bool)
        at = 0
        for _, _, part in parts:
            valid[at : at + len(part) - length + 1] = True
            at += len(part)
        return data, valid, np.array([n for n, _, _ in parts]), np.array([o for _, o, _ in parts]), np.cumsum([0, *(len(p) for _, _, p in parts)])

    for number, text in enumerate(texts):
        for start in range(0, len(text) - length + 1, size):
            part = text[start : start + size + length - 1]
            if held_bytes + len(part) > size + length and parts:
                yield buffer()
                parts, held_bytes = [], 0
            parts.append((number, start, part))
            held_bytes += len(part)
    if parts:
        yield buffer()


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that tell texts apart."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _of_words(marks: np.ndarray, words: bool) -> np.ndarray:
    """Marks whose lowest bit tells windows of words from those of bytes."""
    return marks & np.int64(-2) | np.int64(words)


def _run_batch(keys: list[np.ndarray], texts: list[bytes], owner: np.ndarray, marks: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """Runs by the place of their bytes in their texts, with the hash of these bytes."""
    digest, views = xxhash.xxh3_128_digest, [memoryview(t) for t in texts]
    places = zip(owner.tolist(), starts.tolist(), (starts + sizes).tolist())
    both = np.frombuffer(b"".join([digest(views[n][a:b]) for n, a, b in places]), np.int64).reshape(-1, 2)
    columns = [keys[0][owner], keys[1][owner], marks, both[:, 0], both[:, 1], starts, sizes]
    return pa.record_batch([pa.array(np.ascontiguousarray(c, dtype=np.int64)) for c in columns], [*_KEY, "mark", "c1", "c2", "start", "size"])


def _word_runs(texts: list[bytes], hashes: window_dedup.WordHashes, words: int) -> Iterator[tuple]:
    """(text number, mark, start, size) of the runs of word windows, in bytes."""
    starts, ends = zip(*map(window_dedup.word_places, texts))
    base = np.cumsum([0, *map(len, starts)])
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    for found, valid, numbers, offsets, edges in window_dedup.buffers(map(hashes.of, texts), words):
        marks, at, windows = window_dedup.runs_of(found, valid, words, min(window_dedup.GRAM, words))
        part = np.searchsorted(edges, at, side="right") - 1
        owner = numbers[part]
        first = base[owner] + at - edges[part] + offsets[part]
        yield owner, marks.view(np.int64), starts[first], ends[first + windows + words - 2] - starts[first]


def runs(keyed: DataFrame, length: int, gram: int, words: int | None = None) -> DataFrame:
    """(k1, k2, mark, c1, c2, start, size) of every run of every row; start and size are those of its bytes, c1 and c2 their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _word_hashes(words)
        for batch in slices(batches, 1024, 2):
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            texts = list(text_bytes(batch.column(2)))
            for data, valid, numbers, offsets, ends in pieces(texts, length):
                marks, starts, windows = runs_of(data, valid, length, gram)
                part = np.searchsorted(ends, starts, side="right") - 1
                yield _run_batch(keys, texts, numbers[part], _of_words(marks, False), starts - ends[part] + offsets[part], windows + length - 1)
            for owner, marks, starts, sizes in _word_runs(texts, hashes, words) if words else ():
                yield _run_batch(keys, texts, owner, _of_words(marks, True), starts, sizes)

    shape = "k1 long, k2 long, mark long, c1 long, c2 long, start long, size long"
    least = min(length, 2 * words - 1) if words else length
    return keyed.where(F.octet_length("text") >= least).mapInArrow(run, shape)


def _word_hashes(words: int | None) -> window_dedup.WordHashes | None:
    """What a worker remembers of words, if there are windows of words."""
    return resident("window words", "hashes", window_dedup.WordHashes) if words else resident(None)


def _split_step(length: int, gram: int, words: int | None):
    """Contents of marks with more than PAIRED blocks to their pieces, which have no blocks; all others as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _word_hashes(words)
        for batch in slices(batches, 4096, 5, 1 << 20):
            crowded = pc.greater(batch.column(1), PAIRED)
            yield batch.filter(pc.invert(crowded))
            found = batch.filter(crowded)
            of_words = pc.equal(pc.bit_wise_and(found.column(0), 1), 1)
            if (of_bytes := found.filter(pc.invert(of_words))).num_rows:
                yield _pieces(of_bytes, _Windows(of_bytes.column(5).to_pylist(), length), gram)
            if (rest := found.filter(of_words)).num_rows:
                yield _pieces(rest, _Windows(rest.column(5).to_pylist(), words, hashes), min(window_dedup.GRAM, words))

    return run


class _Windows:
    """The windows of contents strung together: of `length` bytes, or of so many words if their hashes are given.

    A place is a byte or a word. `edges` has the first place of each content, `starts` and `stops` the bytes of each place, `offsets`
    the first byte of each content, `at` and `owner` the first place and the content of each window.
    """

    def __init__(self, contents: list[bytes], length: int, hashes: window_dedup.WordHashes | None = None) -> None:
        self.length, self.of_words = length, hashes is not None
        self.text = (b" " if self.of_words else b"").join(contents)
        self.offsets = np.cumsum([0, *(len(c) + self.of_words for c in contents)])
        if self.of_words:
            self.values = hashes.of(self.text)
            self.starts, self.stops = window_dedup.word_places(self.text)
            self.edges = np.searchsorted(self.starts, self.offsets)
        else:
            self.values = np.frombuffer(self.text, np.uint8)
            self.starts = np.arange(len(self.text))
            self.stops, self.edges = self.starts + 1, self.offsets
        counts = np.maximum(np.diff(self.edges) - length + 1, 0)
        self.owner = np.repeat(np.arange(len(contents)), counts)
        self.at = np.arange(len(self.owner)) + np.repeat(self.edges[:-1] - np.cumsum(counts) + counts, counts)

    def hashes(self, length: int, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of so many places from each one."""
        if self.of_words:
            return window_dedup.joined_hashes(np.ascontiguousarray(self.values[:, lane]), length)
        return string_hashes(self.values, length)

    def grams(self, gram: int) -> np.ndarray:
        """The hashes that marks are made of."""
        return self.hashes(gram) if self.of_words else gram_hashes(self.values, gram)

    def spans(self, first: np.ndarray, last: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the bytes from window to window start and end in their content."""
        return self.starts[first] - self.offsets[owner], self.stops[last + self.length - 1] - self.offsets[owner]

    def digests(self) -> np.ndarray:
        """A 128-bit hash of each window."""
        if self.of_words:
            return np.stack([self.hashes(self.length, lane)[self.at].view(np.int64) for lane in (0, 1)], axis=1)
        digest, view, length = xxhash.xxh3_128_digest, memoryview(self.text), self.length
        return np.frombuffer(b"".join([digest(view[a : a + length]) for a in self.at.tolist()]), np.int64).reshape(-1, 2)


def _pieces(batch: pa.RecordBatch, found: _Windows, gram: int) -> pa.RecordBatch:
    """Contents (mark, blocks, c1, c2, first, content) of one kind to their pieces: runs of windows that have the mark's gram at places
    of the same sixth. A piece's mark is the hash of its contents' mark, of the sixth and of what all windows of such places have in common."""
    marks = batch.column(0).to_numpy().astype(np.int64)
    # The mark's gram is the last of equal ones in the first window of a content, and in all others.
    grams = found.grams(gram).view(np.int64) & np.int64(-2)
    place = np.zeros(len(marks), np.int64)
    within = (found.edges[:-1, None] + np.arange(found.length - gram + 1)).ravel()
    own = np.repeat(np.arange(len(marks)), found.length - gram + 1)
    same = grams[within] == marks[own] & np.int64(-2)
    place[own[same]] = within[same]

    width = max(1, found.length // 6)
    part = (place[found.owner] - found.at) // width
    first = np.flatnonzero(np.append(True, (found.owner[1:] != found.owner[:-1]) | (part[1:] != part[:-1])))
    last = np.append(first[1:], len(part)) - 1
    own, part = found.owner[first], part[first]
    cores = found.hashes(found.length - width + 1)[place[own] - part * width]
    named = _mixed(_mixed(cores, part.astype(np.uint64)), marks[own].view(np.uint64)).view(np.int64)
    starts, ends = found.spans(found.at[first], found.at[last], own)
    contents = batch.column(5).to_pylist()
    cut = [contents[n][a:b] for n, a, b in zip(own.tolist(), starts.tolist(), ends.tolist())]
    ids = [batch.column(i).take(pa.array(own)) for i in (2, 3)]
    columns = [pa.array(_of_words(named, found.of_words)), pa.array(np.zeros(len(own), np.int32)), *ids, pa.array(starts), pa.array(cut, pa.binary())]
    return pa.record_batch(columns, schema=batch.schema)


_SPANS = "c1 long, c2 long, first long, end long, w1 long, w2 long"


def _shard_step(length: int, shard: int, words: int | None):
    """Contents that come sorted by (mark, block, other), pieces also by content, to (c1, c2, first, end, w1, w2): spans of the windows
    that start elsewhere too, and with the hash (w1, w2) those that are still to be looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _word_hashes(words)
        pending: list[tuple] = []  # of groups that are whole
        group: list[tuple] = []
        twins: list[tuple] = []
        size, own_size, last, spread, twin = 0, 0, None, False, False

        def found() -> Iterator[pa.RecordBatch]:
            if of_bytes := [r for r in pending if not r[6]]:
                yield from _found(of_bytes, length)
            if of_words := [r for r in pending if r[6]]:
                yield from _found_words(of_words, words, hashes)

        def single() -> Iterator[pa.RecordBatch]:
            if group:
                windows = _Windows([r[5] for r in group], *((words, hashes) if group[0][6] else (length,)))
                yield _span_batch(group, windows.owner, *windows.spans(windows.at, windows.at, windows.owner), windows.digests())

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for mark, block, other, own, c1, c2, first, content in zip(*columns):
                key, row = (mark, block, other), (block, other, own, c1, c2, content, mark & 1, first)
                # A group is never cut, unless its windows are looked up; groups are gathered until they fill a shard.
                if key != last:
                    if spread:
                        yield from single()
                    else:
                        pending += group
                        size += own_size
                    group, own_size, spread, twin = [], 0, False, False
                    if pending and (size >= shard or block != other or last[1] != last[2]):
                        yield from found()
                        pending, size = [], 0
                elif block == _PIECE and before[5] == content:
                    twins += [row] if twin else [before, row]
                    twin = True
                    if len(twins) >= 4096:
                        yield _whole(twins)
                        twins = []
                    continue
                last, before, twin = key, row, False
                group.append(row)
                own_size += len(content)
                if block == _PIECE and own_size > shard:
                    yield from single()
                    group, own_size, spread = [], 0, True
        if spread:
            yield from single()
        else:
            pending += group
        if pending:
            yield from found()
        if twins:
            yield _whole(twins)

    return run


def _whole(rows: list[tuple]) -> pa.RecordBatch:
    """The spans of whole rows."""
    return _span_batch(rows, np.arange(len(rows)), np.zeros(len(rows), np.int64), np.array([len(r[5]) for r in rows]))


def _joined(rows: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    ends = np.cumsum([0, *(len(r[5]) for r in rows)])
    valid = np.zeros(len(data), bool)
    for start, end in zip(ends, ends[1:]):
        valid[start : end - length + 1] = True
    return data, valid, ends


def _stretches(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of hits start and where they are over."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], found, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def _span_batch(rows: list[tuple], owner: np.ndarray, first: np.ndarray, end: np.ndarray, digests: np.ndarray | None = None) -> pa.RecordBatch:
    c = np.array([(r[3], r[4], r[7]) for r in rows], np.int64)[owner]
    columns = [c[:, 0], c[:, 1], c[:, 2] + first, c[:, 2] + end, *(() if digests is None else digests.T)]
    arrays = [pa.array(np.ascontiguousarray(x, dtype=np.int64)) for x in columns]
    return pa.record_batch(arrays + [pa.nulls(len(owner), pa.int64())] * (6 - len(arrays)), ["c1", "c2", "first", "end", "w1", "w2"])


def _again(kinds: np.ndarray, rows: list[tuple], owner: np.ndarray) -> np.ndarray:
    """Which windows are of a kind that is there more than once, or in both blocks if there are two."""
    if rows[0][0] == rows[0][1]:
        return (np.bincount(kinds) > 1)[kinds]
    side = np.array([r[2] for r in rows])[owner]
    return np.logical_and(*(np.bincount(kinds[side == n], minlength=kinds.max() + 1) > 0 for n in rows[0][:2]))[kinds]


def _narrowed(rows: list[tuple], length: int) -> list[tuple]:
    """The rows cut to where their windows may repeat: no window starts again whose hash no other one has."""
    found = _Windows([r[5] for r in rows], length)
    kinds = np.unique(found.hashes(length)[found.at], return_inverse=True)[1]
    again = _again(kinds, rows, found.owner)
    at, owner = found.at[again], found.owner[again]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    owner, last = owner[first], np.append(first[1:], len(at))[: len(first)] - 1
    out = []
    for n, a, b in zip(owner.tolist(), *(x.tolist() for x in found.spans(at[first], at[last], owner))):
        row = rows[n]
        out.append((*row[:5], row[5][a:b], row[6], row[7] + a))
    return out


def _found(rows: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    if not (rows := _narrowed(rows, length)):
        return
    if rows[0][0] == rows[0][1]:
        data, valid, ends = _joined(rows, length)
        marked = [(rows, repeated(data, valid, length), ends)]
    else:
        sides = [[r for r in rows if r[2] == n] for n in rows[0][:2]]
        texts = [_joined(side, length) for side in sides]
        if not (sides[0] and sides[1]):
            return
        marked = [(side, found, text[2]) for side, found, text in zip(sides, merge(*(Shard(d, v, length) for d, v, _ in texts)), texts)]
    for side, found, ends in marked:
        starts, stops = _stretches(found)
        if len(starts):
            owner = np.searchsorted(ends, starts, side="right") - 1
            yield _span_batch(side, owner, starts - ends[owner], stops - ends[owner] + length - 1)


def _found_words(rows: list[tuple], words: int, hashes: window_dedup.WordHashes) -> Iterator[pa.RecordBatch]:
    text = b" ".join(r[5] for r in rows)
    offsets = np.cumsum([0, *(len(r[5]) + 1 for r in rows)])
    places = window_dedup.word_places(text)
    first = np.searchsorted(places[0], offsets)
    valid = np.zeros(len(places[0]), bool)
    for start, end in zip(first, first[1:]):
        valid[start : end - words + 1] = True
    at = np.flatnonzero(valid)
    own = hashes.of(text)
    lanes = [window_dedup.joined_hashes(np.ascontiguousarray(own[:, n]), words)[at] for n in (0, 1)]
    order = np.lexsort(lanes)
    fresh = np.append(True, (lanes[0][order[1:]] != lanes[0][order[:-1]]) | (lanes[1][order[1:]] != lanes[1][order[:-1]]))
    kinds = np.empty(len(at), np.int64)
    kinds[order] = np.cumsum(fresh) - 1
    owner = np.searchsorted(first, at, side="right") - 1
    found = np.zeros(len(valid), bool)
    found[at] = _again(kinds, rows, owner)
    starts, stops = _stretches(found)
    if len(starts):
        owner = np.searchsorted(first, starts, side="right") - 1
        yield _span_batch(rows, owner, places[0][starts] - offsets[owner], places[1][stops + words - 2] - offsets[owner])


def crowds(contents: DataFrame, length: int, shard: int) -> DataFrame:
    """(mark, blocks) of the marks whose contents (mark, c1, c2, size) do not fit into one shard."""
    # No content of byte windows is longer than twice the length, so that a bound on their number bounds their bytes; words may be
    # longer than others.
    most = max(1, shard // (4 * length))
    return contents.groupBy("mark").agg(
        F.greatest(F.ceil(F.count("*") / most), F.ceil(2 * F.sum("size") / shard)).cast("int").alias("blocks")
    ).where("blocks > 1")


def dealt(cut: DataFrame, crowded: DataFrame, hot: bool, length: int, gram: int, words: int | None) -> DataFrame:
    """(mark, block, other, own, c1, c2, first, content): the contents (mark, c1, c2, content) once for each group they are compared in, whole
    or in pieces. `hot` tells whether any mark has more than PAIRED blocks."""
    one = cut.join(crowded, "mark", "left").select(
        "mark", F.coalesce("blocks", F.lit(1)).alias("blocks"), "c1", "c2", F.lit(0).cast("long").alias("first"), "content"
    )
    if hot:
        one = one.mapInArrow(_split_step(length, gram, words), one.schema)
    piece = F.col("blocks") == 0
    own = one.withColumn("own", F.when(piece, _PIECE).otherwise(F.pmod(F.xxhash64("c1", "c2"), F.col("blocks"))).cast("int"))
    numbers = F.when(piece, F.array(F.lit(_PIECE))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    return own.withColumn("with", F.explode(numbers)).select(
        "mark", F.least("own", "with").alias("block"), F.greatest("own", "with").alias("other"), "own", "c1", "c2", "first", "content"
    )


def repeated_spans(keyed: DataFrame, texts: DataFrame, length: int, gram: int, shard: int, words: int | None = None) -> DataFrame:
    """(k1, k2, start, end): bytes, per distinct text, of windows in a row that also start somewhere else."""
    every = held(runs(keyed, length, gram, words), "runs")
    # Written first, so that the join is of two plain tables, whose hot marks Spark can split.
    shared = held(every.groupBy("mark").agg(
        F.count("*").alias("n"), (F.min("c1") != F.max("c1")).alias("differ"), (F.min("c2") != F.max("c2")).alias("differ2")
    ).where("n > 1").select("mark", (F.col("differ") | F.col("differ2")).alias("mixed")), "marks")
    candidates = held(every.join(shared, "mark"), "candidates")

    place = F.struct("k1", "k2", "start", "size")
    classes = candidates.groupBy("mark", "mixed", "c1", "c2").agg(F.count("*").alias("n"), F.min(place).alias("place"))
    whole = classes.where("n > 1").select("c1", "c2", F.lit(0).cast("long").alias("first"), F.col("place.size").alias("end"))

    wanted = classes.where("mixed").select("mark", "c1", "c2", "place.k1", "place.k2", "place.start", "place.size")
    content = F.expr("substring(CAST(text AS BINARY), CAST(start + 1 AS INT), CAST(size AS INT))")
    cut = wanted.join(texts, _KEY).select("mark", "c1", "c2", content.alias("content"))
    crowded = held(crowds(candidates.where("mixed").select("mark", "c1", "c2", "size").distinct(), length, shard), "crowded")
    hot = not crowded.where(F.col("blocks") > PAIRED).isEmpty()
    grouped = dealt(cut, crowded, hot, length, gram, words).repartition("mark", "block", "other")
    grouped = grouped.sortWithinPartitions("mark", "block", "other", *["content"] * hot)
    parts = grouped.mapInArrow(_shard_step(length, shard, words), _SPANS)
    if hot:
        # Windows that are looked up have a hash; spans that are found come with them to keep all this one pass over the contents.
        alike = Window.partitionBy(F.coalesce("w1", "c1"), F.coalesce("w2", "c2"))
        parts = parts.withColumn("n", F.count("w1").over(alike)).where("w1 IS NULL OR n > 1")
    parts = parts.select("c1", "c2", "first", "end")

    found = whole.union(parts)
    places = candidates.select(*_KEY, "c1", "c2", "start").distinct()
    return places.join(found, ["c1", "c2"]).select(
        *_KEY, (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("end")).alias("end")
    ).distinct()


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of bytes without overlaps; touching spans are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _remove_step(with_text: bool):
    """Texts with their repeated spans to what is removed and left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, 2):
            counts, numbers, digests, lists, left = [], [], [], [], []
            for text, found in zip(text_bytes(batch.column(2)), batch.column(3)):
                spans = merged_spans([(s["start"], s["end"]) for s in found.as_py() or ()])
                kept, at = [], 0
                for start, end in spans:
                    kept.append(text[at:start])
                    at = end
                kept.append(text[at:])
                rest = b"".join(kept)
                counts.append(len(text) - len(rest))
                numbers.append(len(spans))
                digests.append(sha256(rest).hexdigest())
                lists.append([{"start": a, "end": b} for a, b in spans])
                left.append(rest.decode(errors="ignore") if with_text else None)
            columns = [
                batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(numbers, pa.int64()), pa.array(digests, pa.string()),
                pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(left, pa.string()),
            ]
            yield pa.record_batch(columns, [*batch.schema.names[:2], "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return run


_REMOVED = "n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept string"


def dedup(frame: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text", length: int = LENGTH, gram: int = GRAM,
          shard: int = SHARD, with_text: bool = False, words: int | None = None) -> DataFrame:
    """The kept columns and, per row, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`, the `spans` removed (byte offsets, touching
    ones made one) and, if asked for, `kept`, the text left; a character that loses a byte is lost whole there.

    Strings of `length` bytes are judged on the input, all occurrences are removed. With `words`, so are that many words
    `[^\x20\x09-\x0D]+` in a row that also start anywhere else, with what is between them there. A null text is empty and stays; texts of no such
    string stay whole. Copies of a row repeat each other. Rows are told apart by their text only, so null or repeated ids do not matter.
    Other columns are ignored; kept columns may not have the names of the results. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    keyed = frame.select(*text_key(text), text.alias("text"))
    # One row per distinct text: copies are brought together within the map tasks, so a text of many copies is no hot key.
    texts = keyed.groupBy(*_KEY).agg(F.any_value("text").alias("text"))
    found = repeated_spans(keyed, texts, length, gram, shard, words)
    # A distinct text's spans are fewer than its bytes, times two with words.
    listed = found.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "end")).alias("found"))
    marked = texts.join(listed, _KEY, "left")
    slim = documents(frame, *keep, *([] if text_column in keep else [text_column])).select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *[k.alias(f"_{name}") for k, name in zip(text_key(text), _KEY)],
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    same = (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2"))
    if with_text:
        # The rows come to the texts before what is left is made, so that texts are not shuffled a second time.
        rows = slim.join(marked, same).select("row", "n_bytes", "text", "found")
        found = rows.mapInArrow(_remove_step(True), _shape(rows.select("row", "n_bytes")))
        return found.select("row.*", *[c for c in found.columns if c != "row"])
    keyed_rows = marked.select(*_KEY, "text", "found")
    removed = keyed_rows.mapInArrow(_remove_step(False), _shape(keyed_rows.select(*_KEY))).drop("kept")
    joined = slim.join(removed, same)
    return joined.select("row.*", "n_bytes", *[c for c in removed.columns if c not in _KEY])


def _shape(first: DataFrame) -> StructType:
    """The columns of a removal: those of the frame, then its results."""
    return StructType([*first.schema.fields, *StructType.fromDDL(_REMOVED).fields])


def report(frame: DataFrame) -> DataFrame:
    """Every document with what is removed of it."""
    return dedup(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
