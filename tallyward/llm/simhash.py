"""Near-duplicates by SimHash fingerprints, compared around the points of a covering code.

A fingerprint has 64 bits; two documents are linked if theirs differ in at most `distance` of them. The bits are cut into
three parts of 21, 21 and 22 bits. If at most 4 bits differ, some part has at most one of them, so each part is covered on its
own with threshold 1. The anchors of a part are the words whose first 15 bits are a word of the Hamming code [15,11]: a code of
covering radius 1. The home of a fingerprint is the anchor it has in reach of the radius when only those 15 bits are changed.
A fingerprint that differs from it in one bit of the part is within the radius plus one of that home. So each fingerprint is
sent to every anchor within distance 2, about 15 a part, and at each anchor those at home are compared with all.

Equal fingerprints are one from the start. Around an anchor only as many links are kept as connect what all of them connect. An
anchor that is home to many is cut into blocks of homes, each a group of its own that all fingerprints at the anchor are sent
to. A group holds its homes in memory and reads the others past them, so no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import documents, held, resident, slices, text_bytes
from tallyward.llm.components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: (first bit, bits) of each part; the code's word is a part's first bits.
PARTS = ((0, 21), (21, 21), (42, 22))
CODE_BITS = 15
#: Home fingerprints of a group.
HOMES = 4096
#: Pairs compared in one step.
STEP = 2_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if it is in over half of the hashes of the shingles; no words give 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    count = max(1, len(words) - shingle + 1)
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:count], stops[last:])], dtype=np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, count, 4096):
        set_bits += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > count, bitorder="little").view(np.uint64)[0])


def fingerprints(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The id column and `bits`, the whole text's fingerprint as a signed long. A null or empty text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(None)
        for batch in slices(batches, 2048, 1):
            bits = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(bits.view(np.int64))], ["id", "bits"])

    source = documents(frame, id_column, text_column)
    return source.mapInArrow(run, f"id {source.schema[0].dataType.simpleString()}, bits long").withColumnRenamed("id", id_column)


def _syndrome(words: np.ndarray) -> np.ndarray:
    """The syndrome of the first 15 bits: the exclusive or of the numbers, from 1, of the bits that are set; 0 for code words."""
    found = np.zeros(len(words), np.uint32)
    for bit in range(CODE_BITS):
        found ^= ((words >> np.uint32(bit)) & np.uint32(1)) * np.uint32(bit + 1)
    return found


@cache
def changes(bits: int) -> list[np.ndarray]:
    """By syndrome, all changes of at most two of a part's bits that lead to an anchor; the first leads home."""
    masks = [0, *(1 << a for a in range(bits)), *((1 << a) | (1 << b) for a in range(bits) for b in range(a))]
    masks.sort(key=lambda m: (m >> CODE_BITS != 0, m.bit_count(), m))
    every = np.array(masks, np.uint32)
    kinds = _syndrome(every)
    return [every[kinds == s] for s in range(CODE_BITS + 1)]


def anchors(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of each fingerprint and each anchor within the radius plus one; `home` marks its own."""
    rows, names, homes = [], [], []
    for number, (start, width) in enumerate(PARTS):
        part = ((bits >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.uint32)
        syndromes = _syndrome(part)
        for syndrome, masks in enumerate(changes(width)):
            own = np.flatnonzero(syndromes == syndrome)
            found = (part[own, None] ^ masks[None, :]) | np.uint32(number << 22)
            first = np.zeros(found.shape, bool)
            first[:, 0] = True
            rows.append(np.repeat(own, len(masks)))
            names.append(found.ravel().astype(np.int32))
            homes.append(first.ravel())
    return np.concatenate(rows), np.concatenate(names), np.concatenate(homes)


def replicas(distinct: DataFrame) -> DataFrame:
    """(anchor, bits, home) of distinct fingerprints `bits`: about 45 rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            bits = batch.column(0).to_numpy(zero_copy_only=False)
            rows, names, homes = anchors(bits.view(np.uint64))
            yield pa.record_batch([pa.array(names), pa.array(bits[rows]), pa.array(homes)], ["anchor", "bits", "home"])

    return distinct.select("bits").mapInArrow(run, "anchor int, bits long, home boolean")


class Group:
    """The home fingerprints of an anchor, or a block of them, and which of them are connected so far."""

    def __init__(self, distance: int) -> None:
        self.distance = distance
        self.parts: list[np.ndarray] = []
        self.homes: np.ndarray | None = None

    def add(self, homes: np.ndarray) -> None:
        self.parts.append(homes)

    def close(self, out: list[np.ndarray]) -> None:
        """All homes are there; they are compared with each other."""
        if self.homes is None:
            self.homes = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)
            self.label = np.arange(len(self.homes))
            if len(self.homes) > 1:
                self.meet(self.homes, out)

    def meet(self, others: np.ndarray, out: list[np.ndarray]) -> None:
        """Adds links (n, 2) that connect what the pairs of a home and one of the others within the distance connect."""
        homes, label = self.homes, self.label
        step = max(1, STEP // max(1, len(homes)))
        for at in range(0, len(others) if len(homes) else 0, step):
            some = others[at : at + step]
            near = np.bitwise_count(some[:, None] ^ homes[None, :]) <= self.distance
            linked = near.any(axis=1)
            if not linked.any():
                continue
            some, near = some[linked], near[linked]
            first = near.argmax(axis=1)
            out.append(np.stack([some, homes[first]], axis=1))
            for row in np.flatnonzero(near.sum(axis=1) > 1):
                mine = np.flatnonzero(near[row])
                labels, where = np.unique(label[mine], return_index=True)
                if len(labels) > 1:
                    out.append(np.stack([np.repeat(some[row], len(labels)), homes[mine[where]]], axis=1))
                    label[np.isin(label, labels)] = labels[0]


def _compare(distance: int):
    """Links of groups that come sorted by (anchor, block), homes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, Group(distance)
        for batch in batches:
            out: list[np.ndarray] = []
            anchor, block, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            bits = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            names = anchor.astype(np.int64) << 32 | block.astype(np.int64)
            cuts = np.flatnonzero(np.diff(names, prepend=names[:1] - 1)).tolist()
            for start, end in zip(cuts, [*cuts[1:], len(names)]):
                if names[start] != key:
                    group.close(out)
                    key, group = names[start], Group(distance)
                homes = int(home[start:end].sum())
                if homes:
                    group.add(bits[start : start + homes])
                if start + homes < end:
                    group.close(out)
                    group.meet(bits[start + homes : end], out)
            if out:
                yield _links(out)
        out = []
        group.close(out)
        if out:
            yield _links(out)

    return run


def _links(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.concatenate(found).view(np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pa.record_batch([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], ["a", "b"])


def links(distinct: DataFrame, distance: int = DISTANCE, homes: int = HOMES) -> DataFrame:
    """(a, b) with a > b: fingerprints that differ in at most `distance` bits, enough of them to connect all such pairs."""
    if distance > DISTANCE:
        raise ValueError(f"three parts cover distances up to {DISTANCE}")
    sent = replicas(distinct)
    crowded = sent.where("home").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > homes)
    crowded = crowded.select("anchor", F.ceil(F.col("n") / homes).cast("int").alias("blocks"))
    cut = sent.join(crowded, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int")
    # Every fingerprint goes to each block of its anchors, but is at home in one of them.
    grouped = cut.select("anchor", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "bits",
                         F.col("home").alias("_home"), own.alias("_own"))
    dealt = grouped.select("anchor", "block", "bits", (F.col("_home") & (F.col("block") == F.col("_own"))).alias("home"))
    dealt = dealt.repartition("anchor", "block").sortWithinPartitions("anchor", "block", F.desc("home"))
    return dealt.mapInArrow(_compare(distance), "a long, b long")


def near_duplicates(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE, homes: int = HOMES) -> DataFrame:
    """Per row the id, the fingerprint `bits`, and `component`, the smallest id of those that links lead to, its own included.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with a null id take part and get the
    component's smallest id, null if there is none. Repeated rows are each returned. Other columns are ignored. An empty
    table gives an empty result.
    """
    found = held(fingerprints(frame, id_column, text_column, shingle), "fingerprints")
    own = found.groupBy("bits").agg(F.min(id_column).alias("least"))
    linked = components(links(own, distance, homes))
    rooted = own.join(linked, own["bits"] == linked["node"], "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = rooted.join(smallest, "root").select("bits", "component")
    return found.join(classes, "bits").select(id_column, "bits", "component")


def report(frame: DataFrame) -> DataFrame:
    """Every document with its fingerprint in hexadecimal and its component."""
    return near_duplicates(frame).select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
