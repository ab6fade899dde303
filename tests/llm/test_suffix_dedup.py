"""Removed bytes against a search for every string of the length, with small and full parameters."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyward.llm import suffix_dedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, length, gram, shard):
    rows = [(i // 2, t, 1) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").repartition(4)
    got = suffix_dedup.dedup(frame, length=length, gram=gram, shard=shard)
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == sorted((i // 2, *x) for i, x in enumerate(brute(texts, length)))


def texts_with_repeats(seed, n, alphabet):
    random.seed(seed)
    pick = lambda k: "".join(random.choices(alphabet, k=k))
    shared = [pick(random.randrange(20, 120)) for _ in range(6)]
    made = [None, "", "é" * 30, "a" * 200, "ab" * 70, pick(30)]
    for _ in range(n):
        made.append("".join(random.choice([pick(random.randrange(30)), random.choice(shared)[random.randrange(9) :]]) for _ in range(6)))
    made += [made[-1], made[-2], made[-2][:-1], "x" + made[-3], made[5]]
    near = list(pick(150))
    for _ in range(30):
        copy = near[:]
        copy[random.randrange(150)] = "#"
        made.append("".join(copy))
    return made


@pytest.mark.parametrize("shard", [600, 1 << 20])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnopé日"])
def test_small_strings(spark, alphabet, shard):
    check(spark, texts_with_repeats(len(alphabet), 60, alphabet), 24, 8, shard)


def test_full_length(spark):
    random.seed(9)
    pick = lambda k: " ".join(random.choice(["one", "two", "three", "four", "fünf", "six"]) + str(random.randrange(50)) for _ in range(k))
    passage = pick(150)
    made = [pick(300), pick(100) + passage + pick(90), passage + pick(40), pick(50) + passage, pick(20) + passage[:395], "q " * 2000, "q " * 100]
    made += [made[0], made[1][:700], passage[: len(passage) // 2] + "!" + passage[len(passage) // 2 :]]
    check(spark, made, suffix_dedup.LENGTH, suffix_dedup.GRAM, suffix_dedup.SHARD)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup.pieces, "__defaults__", (64,))
    texts = texts_with_repeats(5, 20, "abc")
    data = [(t or "").encode() for t in texts]
    starts = []
    for buffer, valid, numbers, offsets, ends in suffix_dedup.pieces(data, 24):
        assert len(buffer) <= 2 * (64 + 24)
        for a, n, o in zip(ends, numbers, offsets):
            starts += [(int(n), int(o + i)) for i in range(len(valid) - a) if i + a < ends[list(ends).index(a) + 1] and valid[a + i]]
    assert sorted(starts) == [(n, i) for n, d in enumerate(data) for i in range(len(d) - 23)]


def test_text_left(spark):
    passage = "é" * 210
    frame = spark.createDataFrame([(1, "ab" + passage + "c"), (2, passage + "d"), (3, None)], "doc_id long, text string")
    rows = suffix_dedup.dedup(frame, with_text=True).collect()
    assert sorted((r["doc_id"], r["kept"], r["n_removed"]) for r in rows) == [(1, "abc", 420), (2, "d", 420), (3, "", 0)]
    assert suffix_dedup.dedup(frame.limit(0)).count() == 0


def brute_with_words(texts, length, words):
    """(bytes, removed, spans, digest of the rest) by both rules."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)] for d in data]
    window = lambda d, p, i: tuple(d[a:b] for a, b in p[i : i + words])
    again = Counter(window(d, p, i) for d, p in zip(data, places) for i in range(len(p) - words + 1))
    out = []
    for d, p in zip(data, places):
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        for i in range(len(p) - words + 1):
            if again[window(d, p, i)] > 1:
                a, b = p[i][0], p[i + words - 1][1]
                gone[a:b] = [True] * (b - a)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [300, 1 << 20])
@pytest.mark.parametrize("words, length", [(3, 40), (10, 24), (12, 400)])
def test_windows_of_words(spark, words, length, shard):
    random.seed(words)
    pick = lambda k: "".join(random.choice(["a", "be", "é", "seven77"]) + random.choice(["", "", str(random.randrange(30))]) + random.choice([" ", " ", "\n", "\t "]) for _ in range(k))
    shared = [pick(random.randrange(words, 3 * words)) for _ in range(5)]
    made = [None, "", " ", "x" * 60, "x " * 40, " \x1f" * 30, pick(2)]
    for _ in range(40):
        made.append("".join(random.choice([pick(random.randrange(8)), random.choice(shared)[random.randrange(9) :]]) for _ in range(5)))
    made += [made[-1], " ".join(made[-2].split()), made[-3] + "é" * 100, "y" * 900 + " " + shared[0], shared[0] + "y" * 900, made[-4][:-1]]
    frame = spark.createDataFrame([(i // 2, t) for i, t in enumerate(made)], "doc_id long, text string").repartition(4)
    got = suffix_dedup.dedup(frame, length=length, gram=8, shard=shard, words=words)
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    expected = brute_with_words(made, length, words)
    assert sorted(tuple(r) for r in got) == sorted((i // 2, *x) for i, x in enumerate(expected))
    assert sum(x[1] > 0 for x in expected) > 20
    assert suffix_dedup.dedup(frame.limit(0), words=words).count() == 0


def crowd(n, seed, pool=0):
    """Texts that all have the one gram that is the mark of the windows around it, between random bytes or such out of a pool."""
    random.seed(seed)
    pick = lambda alphabet, k: "".join(random.choices(alphabet, k=k))
    grams = [pick("abcdefgh", 8) for _ in range(5000)]
    gram = grams[int(suffix_dedup.gram_hashes(np.frombuffer("".join(grams).encode(), np.uint8), 8)[::8].argmin())]
    sides = [pick("ijklmnopq", 40) for _ in range(pool)] or None
    side = lambda: random.choice(sides) if sides and random.random() < 0.8 else pick("ijklmnopq", 40)
    return [side()[random.randrange(25) :] + gram + side()[: random.randrange(40)] for _ in range(n)]


def runs_in(texts, length, gram):
    """The contents of runs, as rows (mark, c1, c2, size, content), each once."""
    out = {}
    for text in map(str.encode, texts):
        data = np.frombuffer(text, np.uint8)
        marks, starts, sizes = suffix_dedup.runs_of(data, np.arange(len(data)) + length <= len(data), length, gram)
        for mark, start, size in zip(suffix_dedup._of_words(marks, False).tolist(), starts.tolist(), sizes.tolist()):
            content = text[start : start + size + length - 1]
            c1, c2 = np.frombuffer(suffix_dedup.xxhash.xxh3_128_digest(content), np.int64).tolist()
            out[content] = (mark, c1, c2, len(content), content)
    return list(out.values())


def test_a_crowded_mark_is_not_compared_in_all_pairs(spark):
    def dealt(n):
        rows = runs_in(crowd(n, 3), 24, 8)
        frame = spark.createDataFrame(rows, "mark long, c1 long, c2 long, size long, content binary")
        crowded = suffix_dedup.crowds(frame.drop("content"), 24, 600)
        assert crowded.agg(F.max("blocks")).first()[0] > suffix_dedup.PAIRED
        return suffix_dedup.dealt(frame.drop("size"), crowded, True, 24, 8, None).count() / len(rows)

    # In pairs of blocks, a content would be dealt once for each block, which are eight times as many.
    assert dealt(2400) < 1.5 * dealt(300)


@pytest.mark.parametrize("pool", [0, 3, 12])
def test_crowded_marks(spark, pool):
    check(spark, crowd(300, pool, pool) + crowd(20, pool, pool), 24, 8, 100)


@pytest.mark.parametrize("pool", [0, 3, 12])
def test_pieces_of_a_crowded_mark(pool):
    rows = runs_in(crowd(300, pool, pool), 24, 8)
    text = {r[1:3]: r[4] for r in rows}
    counts = Counter(t[i : i + 24] for t in text.values() for i in range(len(t) - 23))
    columns = [[r[0] for r in rows], [9] * len(rows), [r[1] for r in rows], [r[2] for r in rows], [0] * len(rows), [r[4] for r in rows]]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    contents = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["mark", "blocks", "c1", "c2", "first", "content"])
    pieces = pa.Table.from_batches(suffix_dedup._split_step(24, 8, None)(iter([contents]))).sort_by([("mark", "ascending"), ("content", "ascending")])
    whole = [(text[r["c1"], r["c2"]][r["first"] : r["first"] + len(r["content"])], r["content"]) for r in pieces.to_pylist()]
    assert all(a == b for a, b in whole)
    assert sum(len(b) - 23 for _, b in whole) == sum(len(t) - 23 for t in text.values())
    block = pa.array([suffix_dedup._PIECE] * len(pieces), pa.int32())
    sent = pa.table([pieces["mark"], block, block, block, *(pieces[c] for c in ("c1", "c2", "first", "content"))], ["mark", "block", "other", "own", "c1", "c2", "first", "content"])
    found = [r for batch in suffix_dedup._shard_step(24, 60, None)(iter(sent.to_batches(50))) for r in batch.to_pylist()]
    looked_up = Counter((r["w1"], r["w2"]) for r in found if r["w1"] is not None)
    assert not pool or max(looked_up.values()) > 1
    starts = {
        (r["c1"], r["c2"], i) for r in found if r["w1"] is None or looked_up[r["w1"], r["w2"]] > 1 for i in range(r["first"], r["end"] - 23)
    }
    assert starts == {(*c, i) for c, t in text.items() for i in range(len(t) - 23) if counts[t[i : i + 24]] > 1}


def test_string_hashes():
    data = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=300)), np.uint8)
    for length in (1, 2, 3, 8, 13, 40, 300, 301):
        strings = [data[i : i + length].tobytes() for i in range(len(data) - length + 1)]
        hashes = suffix_dedup.string_hashes(data, length).tolist()
        assert len(hashes) == len(strings) and len(set(hashes)) == len(set(strings)) == len(set(zip(hashes, strings)))
