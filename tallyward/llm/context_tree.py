"""Language-model scores by context-tree weighting over bytes, and the unigram score they are compared with.

A text is its words, lower-cased (A-Z), with a space after each but the last and a line feed at the end; before it stand line
feeds. A byte is eight binary decisions from the highest bit, so each context of 0 to DEPTH bytes has a tree of 255 decisions.
The Krichevsky-Trofimov estimate of a decision comes from how often it went either way in the training texts. A node is worth
half its own estimate of all it has seen and half the product of what its longer contexts are worth; this gives the weight with
which it stops, and a decision's probability mixes the estimates of all depths by these weights. Where a longer context has
never been met, the mixture ends at the longest that has, so that each decision's probabilities add up to one.

The counts are those of grams, DEPTH bytes and the byte after them. A task counts the grams of its texts and deals them to
buckets, as sorted packed tables rather than rows; the tables of a bucket are added up after a shuffle. Contexts that share their
last INNER bytes are in one bucket, where their trees are weighed; the decisions of shorter contexts, at most 255 for each of
65,536, are finished on the driver. A document's score adds up the logarithms of its grams: those of frequent grams are sent to all
tasks, at most FREQUENT_GRAMS of them, the others are looked up by a join. So it is done for the words' counts as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import documents, held, resident, slices, text_bytes
from tallyward.llm.language import fold

DEPTH = 6
INNER = 3
#: Grams and words sent to all tasks.
FREQUENT_GRAMS = 1 << 21
FREQUENT_WORDS = 1 << 18
#: Buckets the count tables are dealt to.
BUCKETS = 2048
#: Entries of the count tables a task holds before it adds them up or passes them on.
HELD_ENTRIES = 1 << 21
#: Text positions worked on at once, and rows of the model.
CHUNK = 1 << 18
END = b"\n"

_LN_HALF = float(np.log(0.5))


def stream(words: list[bytes]) -> bytes:
    """What a text is to the model, after the bytes that stand before it."""
    return END * DEPTH + b" ".join(words) + END


def grams(data: np.ndarray) -> np.ndarray:
    """The gram that ends at each position from DEPTH on: the bytes before, the nearest in the highest place, then the byte."""
    wide = data.astype(np.uint64)
    n = len(wide) - DEPTH
    found = wide[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        found |= wide[DEPTH - back : DEPTH - back + n] << np.uint64(8 * (DEPTH - back + 1))
    return found.view(np.int64)


def chunks(streams: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, document) of strung-together streams, some positions at a time."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    ends = np.cumsum([0, *map(len, streams)])
    for at in range(0, len(data) - DEPTH, CHUNK):
        part = data[at : at + CHUNK + DEPTH]
        place = np.arange(at + DEPTH, at + len(part))
        owner = np.searchsorted(ends, place, side="right") - 1
        own = place - ends[owner] >= DEPTH  # not what stands before a text
        yield grams(part)[own], owner[own]


# ---- counting ----


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted count table as bytes: the differences of the keys and the counts, by place of the byte, compressed."""
    steps = np.stack([np.diff(keys, prepend=0), counts])
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A count table back from its bytes."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    steps, counts = np.ascontiguousarray(planes.T).view(np.int64).reshape(2, -1)
    return np.cumsum(steps), counts


def bucket_of(names: np.ndarray) -> np.ndarray:
    """The bucket of a context or word, from a number for it."""
    return (names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40) & np.uint64(BUCKETS - 1)).astype(np.int16)


def _count_step():
    """Texts to (gram, bucket, data): count tables of words' hashes and of grams, 0 for grams only held-out texts have."""

    def emit(gram: bool, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        buckets = bucket_of(keys >> 8 * (DEPTH - INNER + 1) if gram else keys)
        order = np.argsort(buckets, kind="stable")
        keys, counts, buckets = keys[order], counts[order], buckets[order]
        cuts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
        tables = [pack(keys[a:b], counts[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(keys)))]
        names = ["gram", "bucket", "data"]
        return pa.record_batch([pa.array(np.full(len(cuts), gram)), pa.array(buckets[cuts].astype(np.int32)), pa.array(tables, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(None)
        held_tables: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}
        size = {False: 0, True: 0}
        for batch in slices(batches, 512, 1):
            for held_out in (False, True):
                part = batch.filter(pc.equal(batch.column(0), held_out))
                texts = [t.lower().split() for t in text_bytes(part.column(1))]
                found = [(True, keys) for keys, _ in chunks([stream(words) for words in texts])]
                if not held_out:
                    found.append((False, word_hashes(texts)))
                for gram, keys in found:
                    keys, counts = np.unique(keys, return_counts=True)
                    held_tables[gram].append((keys, np.zeros_like(counts) if held_out else counts))
                    size[gram] += len(keys)
                del texts, found
            for gram, tables in held_tables.items():
                if size[gram] >= HELD_ENTRIES:
                    tables[:] = [added(tables)]
                    size[gram] = len(tables[0][0])
                    if size[gram] >= HELD_ENTRIES // 2:
                        yield emit(gram, *tables[0])
                        tables.clear()
                        size[gram] = 0
        for gram, tables in held_tables.items():
            if size[gram]:
                yield emit(gram, *added(tables))

    return run


def word_hashes(texts: list[list[bytes]]) -> np.ndarray:
    """The hashes of all words of some texts, one text after the other."""
    return np.array(list(map(xxhash.xxh64_intdigest, chain.from_iterable(texts))), np.uint64).view(np.int64)


def added(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Count tables made one, sorted by key."""
    keys = np.concatenate([k for k, _ in tables])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.concatenate([c for _, c in tables])[order]
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The count table of each bucket, from rows (bucket, data) that come sorted by bucket."""
    last, tables, size = None, [], 0
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if bucket != last and tables:
                yield added(tables)
                tables, size = [], 0
            tables.append(unpack(data.as_py()))
            last = bucket
            size += len(tables[-1][0])
            if size > 2 * len(tables[0][0]) + CHUNK:  # a bucket of many tables is added up on the way
                tables = [added(tables)]
                size = len(tables[0][0])
    if tables:
        yield added(tables)


def _words_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, counts in buckets(batches):
        yield pa.record_batch([pa.array(keys), pa.array(counts)], ["key", "n"])


# ---- the model ----


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for x of at least a half, by Stirling's series eight places up."""
    up = x + 8.0
    series = 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5)
    rest = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (up - 0.5) * np.log(up) - up + 0.5 * np.log(2 * np.pi) + series - rest


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov probability of so many decisions either way."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """The decisions of the contexts of one length: `entries` are the distinct (context, byte), in order."""

    def __init__(self, entries: np.ndarray, counts: np.ndarray) -> None:
        self.entries = entries
        symbols = entries & 255
        self.nodes, self.zeros, self.ones, self.names, self.firsts = [], [], [], [], []
        for bit in range(8):
            # A decision is named by its context and the bits before it, with a leading one.
            names = (entries >> 8 << 8) | (symbols >> (8 - bit)) | (1 << bit)
            fresh = np.append(True, names[1:] != names[:-1])
            first = np.flatnonzero(fresh)
            went = symbols >> (7 - bit) & 1
            total = np.add.reduceat(counts, first)
            ones = np.add.reduceat(counts * went, first)
            self.nodes.append(np.cumsum(fresh) - 1)
            self.names.append(names[first])
            self.firsts.append(first)
            self.zeros.append((total - ones).astype(float))
            self.ones.append(ones.astype(float))

    def weigh(self, below: list[np.ndarray] | None) -> None:
        """Sets what each decision is worth and the weight with which it stops, from the sums of the longer contexts' worth."""
        self.worth, self.stop = [], []
        for bit in range(8):
            own = log_kt(self.zeros[bit], self.ones[bit])
            worth = own if below is None else np.logaddexp(_LN_HALF + own, _LN_HALF + below[bit])
            self.worth.append(worth)
            self.stop.append(np.ones(len(own)) if below is None else np.exp(_LN_HALF + own - worth))

    def sums_for(self, shorter: Level) -> list[np.ndarray]:
        """The worth of these decisions, added up by the decision of the next shorter context."""
        sums = []
        for bit in range(8):
            first = self.entries[self.firsts[bit]]
            parent = shorter.nodes[bit][np.searchsorted(shorter.entries, _shorter(first))]
            sums.append(np.bincount(parent, self.worth[bit], len(shorter.zeros[bit])))
        return sums

    def mix(self, bit: int, at: np.ndarray, went: np.ndarray, longer: np.ndarray) -> np.ndarray:
        """The probability of a decision at entries `at`; `longer` is that of the next longer context, negative if never met."""
        node = self.nodes[bit][at]
        return mixed(self.zeros[bit][node], self.ones[bit][node], self.stop[bit][node], went, longer)


def mixed(zeros: np.ndarray, ones: np.ndarray, stop: np.ndarray, went: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """A node's estimate and the longer context's probability by the node's weight; -1 where the node has seen nothing."""
    own = (np.where(went, ones, zeros) + 0.5) / (zeros + ones + 1.0)
    return np.where(zeros + ones > 0, np.where(longer < 0, own, stop * own + (1 - stop) * longer), -1.0)


def _shorter(entries: np.ndarray) -> np.ndarray:
    """(context, byte) with the farthest byte of the context left out; the same for names of decisions."""
    return entries >> 16 << 8 | entries & 255


def inner_levels(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, Level]:
    """For sorted distinct grams, whole in their contexts of INNER bytes: the probabilities of their eight decisions from the
    contexts of INNER bytes and more, -1 where those have seen nothing; and the level of INNER bytes."""
    levels = [Level(keys, counts)]
    levels[0].weigh(None)
    places = [np.arange(len(keys))]
    while len(levels) <= DEPTH - INNER:
        longer = levels[-1]
        short = _shorter(longer.entries)
        entries, at = np.unique(short, return_inverse=True)
        own = np.bincount(at[places[-1]], counts, len(entries)).astype(np.int64)
        level = Level(entries, own)
        level.weigh(longer.sums_for(level))
        levels.append(level)
        places.append(at[places[-1]])
    found = np.empty((len(keys), 8))
    symbols = keys & 255
    for bit in range(8):
        p, went = np.full(len(keys), -1.0), (symbols >> (7 - bit) & 1).astype(bool)
        for level, at in zip(levels, places):
            p = level.mix(bit, at, went, p)
        found[:, bit] = p
    return found, levels[-1]


_INNER = "keys binary, counts binary, p binary, node long, zeros double, ones double, worth double"


def _inner_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets to their grams and decisions' probabilities and, as rows of their own, the sums for the next shorter contexts."""
    resident(None)
    names = ["keys", "counts", "p", "node", "zeros", "ones", "worth"]
    for keys, counts in buckets(batches):
        found, level = inner_levels(keys, counts)
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (keys, counts, found.astype(np.float32))]
        yield pa.record_batch([*blobs, pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.float64())] * 3], names)
        short = [_shorter(level.names[bit]) for bit in range(8)]
        nodes, at = np.unique(np.concatenate(short), return_inverse=True)
        sums = [np.bincount(at, np.concatenate(x), len(nodes)) for x in (level.zeros, level.ones, level.worth)]
        yield pa.record_batch([*[pa.nulls(len(nodes), pa.binary())] * 3, pa.array(nodes), *map(pa.array, sums)], names)


class Outer:
    """The decisions of contexts shorter than INNER bytes: per length sorted names, counts and stop weights."""

    def __init__(self, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> None:
        order = np.argsort(nodes)
        nodes, zeros, ones, below = nodes[order], zeros[order], ones[order], below[order]
        self.tables = []
        for _ in range(INNER):
            own = log_kt(zeros, ones)
            worth = np.logaddexp(_LN_HALF + own, _LN_HALF + below)
            self.tables.append((nodes, zeros, ones, np.exp(_LN_HALF + own - worth)))
            nodes, at = np.unique(_shorter(nodes), return_inverse=True)
            zeros, ones, below = (np.bincount(at, x, len(nodes)) for x in (zeros, ones, worth))

    def log10(self, keys: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """The logarithm of each gram's last byte's probability, from the probabilities by the longer contexts."""
        total = np.zeros(len(keys))
        symbols = keys & 255
        for bit in range(8):
            went = (symbols >> (7 - bit) & 1).astype(bool)
            p = inner[:, bit]
            for length, (nodes, zeros, ones, stop) in zip(range(INNER - 1, -1, -1), self.tables):
                context = keys >> 8 * (DEPTH + 1 - length)
                names = context << 8 | symbols >> (8 - bit) | 1 << bit
                at = np.minimum(np.searchsorted(nodes, names), max(0, len(nodes) - 1))
                if len(nodes):
                    met = nodes[at] == names
                    p = np.where(met, mixed(zeros[at], ones[at], stop[at], went, p), -1.0)
            total += np.log10(np.where(p < 0, 0.5, p))  # nothing seen at all: an even chance
        return total


class GramTable:
    """Every gram of the texts with its training count and the log10 of its probability, as packed rows of a written table."""

    def __init__(self, packed: DataFrame) -> None:
        inner = held(packed.mapInArrow(_inner_step, _INNER), "contexts")
        shorter = inner.where("node IS NOT NULL").groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("worth"))
        # At most 255 decisions of 65,536 contexts of two bytes; those that texts hold are far fewer.
        columns = [c.to_numpy() for c in shorter.toArrow().columns]
        sent = packed.sparkSession.sparkContext.broadcast(Outer(*columns))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, counts, p in zip(*batch.columns):
                    grams_here = np.frombuffer(keys.as_py(), np.int64)
                    logs = sent.value.log10(grams_here, np.frombuffer(p.as_py(), np.float32).reshape(-1, 8).astype(float))
                    blobs = [keys.as_py(), counts.as_py(), logs.tobytes()]
                    yield pa.record_batch([pa.array([x], pa.binary()) for x in blobs], ["keys", "counts", "logs"])

        grams_only = inner.where("keys IS NOT NULL").select("keys", "counts", "p")
        self.rows = held(grams_only.mapInArrow(run, "keys binary, counts binary, logs binary"), "grams")

    def levels(self) -> DataFrame:
        """(level, count): how many grams have a count of so many binary digits."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for counts in batch.column(0):
                    levels, sizes = np.unique(_level(np.frombuffer(counts.as_py(), np.int64)), return_counts=True)
                    yield pa.record_batch([pa.array(levels.astype(np.int32)), pa.array(sizes)], ["level", "count"])

        return self.rows.select("counts").mapInArrow(run, "level int, count long").groupBy("level").agg(F.sum("count").alias("count"))

    def frequent(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The grams from level `least` on and their logarithms, on the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, logs in _parted(batches, least, True):
                blobs = [keys.tobytes(), logs.astype(np.float32).tobytes()]
                yield pa.record_batch([pa.array([x], pa.binary()) for x in blobs], ["keys", "logs"])

        found = self.rows.mapInArrow(run, "keys binary, logs binary").toArrow().to_pydict()
        return np.frombuffer(b"".join(found["keys"]), np.int64), np.frombuffer(b"".join(found["logs"]), np.float32)

    def rare(self, least: int) -> DataFrame:
        """(key, log10) of the other grams."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, logs in _parted(batches, least, False):
                yield pa.record_batch([pa.array(keys), pa.array(logs)], ["key", "log10"])

        return self.rows.mapInArrow(run, "key long, log10 double")


def _parted(batches: Iterator[pa.RecordBatch], least: int, above: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, logs) of the grams of packed rows whose level is at least, or is under, `least`."""
    resident(None)
    for batch in batches:
        for keys, counts, logs in zip(*batch.columns):
            chosen = (_level(np.frombuffer(counts.as_py(), np.int64)) >= least) == above
            yield np.frombuffer(keys.as_py(), np.int64)[chosen], np.frombuffer(logs.as_py(), np.float64)[chosen]


def _level(counts: np.ndarray) -> np.ndarray:
    """Binary digits of counts, 0 for 0."""
    return np.frexp(counts.astype(float))[1]


def least_level(sizes: DataFrame, limit: int) -> int:
    """The lowest level from which on the rows of a table (level, count) number at most `limit`."""
    least, total = 65, 0
    for level, size in sorted(((r["level"], r["count"]) for r in sizes.collect()), reverse=True):
        if (total := total + size) > limit:
            break
        least = level
    return least


# ---- scoring ----


class Lookup:
    """Values by key, in an open table of numpy arrays. -1 marks a free place and can be no key: it is counted as rare."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, (4 * len(keys) // 3 + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.float32)
        for at in range(0, len(keys), CHUNK // 4):
            self._put(keys[at : at + CHUNK // 4], values[at : at + CHUNK // 4])

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        keys, values = keys[keys != -1], values[keys != -1]
        slot = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            taken, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[taken], self.values[taken] = keys[placed], values[placed]
            left = np.ones(len(keys), bool)
            left[placed] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 for those that are not there; which are there)."""
        slot = self._slots(keys)
        met = self.keys[slot]
        found = met == keys
        values = np.where(found, self.values[slot], 0.0).astype(float)
        found &= met != -1
        left = np.flatnonzero(~found & (met != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            met = self.keys[slot[left]]
            hit = met == keys[left]
            values[left[hit]] = self.values[slot[left[hit]]]
            found[left[hit]] = True
            left = left[~hit & (met != -1)]
        return values, found


_SCORED = "n_tokens long, n_known long, base double, score double, rare_words array<long>, rare_grams array<long>"


def _score_step(words_sent, grams_sent):
    """Texts to the parts of their scores that frequent words and grams give, with the others by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_table, gram_table = _lookups(words_sent), _lookups(grams_sent)
        for batch in slices(batches, 512, 2):
            texts = [t.lower().split() for t in text_bytes(batch.column(2))]
            n = len(texts)
            sizes = np.array([len(w) for w in texts], np.int64)
            hashes, owner = word_hashes(texts), np.repeat(np.arange(n), sizes)
            logs, known = word_table.get(hashes)
            base = np.bincount(owner, logs, n)
            rare_words = _lists(owner[~known], hashes[~known], n)
            scores, missing = np.zeros(n), []
            for keys, owner in chunks([stream(words) for words in texts]):
                values, found = gram_table.get(keys)
                scores += np.bincount(owner, values, n)
                missing.append((owner[~found], keys[~found]))
            rare_grams = _lists(*(np.concatenate(x) for x in zip(*missing)), n)
            counts = sizes - np.diff(rare_words.offsets.to_numpy())
            columns = [batch.column(0), batch.column(1), *(pa.array(x) for x in (sizes + 1, counts, base, scores)), rare_words, rare_grams]
            yield pa.record_batch(columns, ["id", "held_out", "n_tokens", "n_known", "base", "score", "rare_words", "rare_grams"])

    return run


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """The values of each of n owners, which come in order."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _lookups(sent) -> Lookup:
    """The table of a broadcast, made once per Python worker."""
    name, model, keys, values = sent.value
    return resident(model, name, lambda: Lookup(keys, values))


def score(frame: DataFrame, held_out: str, id_column: str = "doc_id", text_column: str = "text", frequent_words: int = FREQUENT_WORDS,
          frequent_grams: int = FREQUENT_GRAMS) -> DataFrame:
    """Per row the id, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score`, the log10 of
    the model's probability of the whole text (its code length in bits is that times -log2(10)).

    Learns from the rows where the SQL condition `held_out` is false, and scores all. A null or empty text is the end alone. With
    nothing to learn from, every byte costs eight bits. Repeated rows and ids are scored each. Other columns are ignored.
    """
    context = frame.sparkSession.sparkContext
    rows = frame.select(F.col(f"`{id_column}`").alias("id"), F.expr(held_out).alias("held_out"), F.col(f"`{text_column}`").alias("text"))
    counted = rows.select("held_out", "text").mapInArrow(_count_step(), "gram boolean, bucket int, data binary")
    tables = held(counted, "counts")
    sorted_tables = lambda gram: tables.where(F.col("gram") == gram).select("bucket", "data").repartition("bucket").sortWithinPartitions("bucket")
    words = held(sorted_tables(False).mapInArrow(_words_step, "key long, n long"), "words")
    texts = rows.where("NOT held_out").count()
    sums = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    train_tokens, distinct = sums[1] + texts, sums[0] + (texts > 0)
    scale = float(np.log10(train_tokens + 0.5 * (distinct + 1)))

    scored = GramTable(sorted_tables(True))
    level = F.length(F.bin("n"))
    least_word = least_level(words.groupBy(level.alias("level")).count(), frequent_words)
    least_gram = least_level(scored.levels(), frequent_grams)
    word_logs = words.select("key", F.log10(F.col("n") + 0.5).alias("log10"), level.alias("level"))
    few_words = [c.to_numpy() for c in word_logs.where(F.col("level") >= least_word).select("key", "log10").toArrow().columns]
    name = uuid.uuid4().hex
    sent = [context.broadcast((str(kind), name, keys, values.astype(np.float32))) for kind, (keys, values) in enumerate((few_words, scored.frequent(least_gram)))]
    step = _score_step(*sent)
    kind = rows.schema["id"].dataType.simpleString()
    first = rows.mapInArrow(step, f"id {kind}, held_out boolean, {_SCORED}").withColumn("row", F.monotonically_increasing_id())
    first = held(first, "scores")

    gram_logs = scored.rare(least_gram).select(F.lit(True).alias("gram"), "key", F.lit(0).alias("known"), F.lit(0.0).alias("base"), F.col("log10").alias("score"))
    rare_words = word_logs.where(F.col("level") < least_word)
    rare_words = rare_words.select(F.lit(False).alias("gram"), "key", F.lit(1).alias("known"), F.col("log10").alias("base"), F.lit(0.0).alias("score"))
    asked = first.select("row", F.lit(False).alias("gram"), F.explode("rare_words").alias("key")).union(
        first.select("row", F.lit(True).alias("gram"), F.explode("rare_grams").alias("key"))
    )
    unknown = F.lit(float(np.log10(0.5)))
    rare = asked.join(rare_words.union(gram_logs), ["gram", "key"], "left").groupBy("row").agg(
        F.sum(F.coalesce("known", F.lit(0))).alias("more_known"), F.sum(F.coalesce("base", unknown)).alias("more_base"),
        F.sum(F.coalesce("score", F.lit(0.0))).alias("more_score"),
    )
    end = float(np.log10(texts + 0.5))
    whole = first.join(rare, "row", "left").fillna({"more_known": 0, "more_base": 0.0, "more_score": 0.0})
    return whole.select(
        F.col("id").alias(id_column), "held_out", "n_tokens",
        (F.col("n_known") + F.col("more_known") + int(texts > 0)).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base") + end - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("score") + F.col("more_score")).alias("score"),
    )


def report(frame: DataFrame) -> DataFrame:
    """Every document, learned from those outside the held-out fold."""
    rows = documents(frame, "doc_id", "text").withColumn("_held", fold("doc_id", 5) == 1)
    return score(rows, "_held")
