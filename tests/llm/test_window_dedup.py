"""Removed words against a search for every window, with small and full parameters, and a sketch too small for the table."""

import hashlib
import random
import re

import numpy as np
import pytest

from tallyward.llm import window_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    known = [(i, w) for i, w in split if i is not None]
    for i, w in known:
        for at in range(len(w) - length + 1):
            key = tuple(w[at : at + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for at in range(len(w) - length + 1):
            least = first.get(tuple(w[at : at + length]))
            if least is not None and (i is None or least < i):
                gone[at : at + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n, alphabet):
    random.seed(seed)
    pick = lambda k: " ".join(random.choices(alphabet, k=k))
    shared = [pick(random.randrange(5, 40)) for _ in range(6)]
    texts = [None, "", " \t\n\x0b\x0c\r ", "é " * 60, "a\x1cb " * 30, "  x " * 20, pick(9)]
    for _ in range(n):
        texts.append(random.choice([" ", "\n", "  \t"]).join(random.choice([pick(random.randrange(9)), random.choice(shared)]) for _ in range(5)))
    texts += [texts[-1], texts[-2], "x " + texts[-3] + " y", texts[4]]
    near = pick(90).split()
    for _ in range(25):
        copy = near[:]
        copy[random.randrange(90)] = "#"
        texts.append(" ".join(copy))
    ids = list(range(len(texts)))
    random.shuffle(ids)
    rows = [(i // 2, t) for i, t in zip(ids, texts)]  # two rows of an id
    return rows + [rows[9], rows[9], (None, texts[12]), (None, texts[12]), (None, texts[0]), (-5, near[0] and " ".join(near))]


def check(spark, rows, length, **how):
    frame = spark.createDataFrame([(*r, 7, "clash") for r in rows], "doc_id long, text string, n_words int, id string").repartition(5)
    got = window_dedup.dedup(frame, length=length, bits=22, **how)
    got = got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


@pytest.mark.parametrize("alphabet", [["a", "b"], ["one", "two", "Drei", "日本", "5", "é"]])
def test_small_windows(spark, alphabet):
    check(spark, made(len(alphabet), 40, alphabet), 7, gram=2)


def test_full_length(spark):
    check(spark, made(3, 30, [f"w{n}" for n in range(400)]), window_dedup.LENGTH)


def test_sketch_that_says_always(spark, monkeypatch):
    monkeypatch.setattr(window_dedup, "repeated_marks", lambda rows, marks: np.ones(len(marks), bool))
    check(spark, made(4, 30, ["a", "b", "c"]), 6, gram=3)


def test_sketch_never_underestimates(spark):
    rows = made(5, 40, ["a", "b", "c"])
    rows_of_sketch = [np.frombuffer(r, np.uint8) for r in window_dedup.sketch(spark.createDataFrame([(t or "",) for _, t in rows], "text string").repartition(6), 8, 4, 22)]
    hashes, counts = window_dedup.WordHashes(), {}
    for _, text in rows:
        words = hashes.of((text or "").encode())
        for buffer, valid, *_ in window_dedup.buffers([words], 8):
            marks, starts, windows = window_dedup.runs_of(buffer, valid, 8, 4)
            assert windows.sum() == valid.sum() == len(words) - 7
            for mark, start, n in zip(marks, starts, windows):
                for at in range(start, start + n):
                    counts.setdefault(buffer[at : at + 8].tobytes(), []).append(mark)
    for marks in counts.values():
        assert len(set(marks)) == 1
        if len(marks) > 1:
            assert window_dedup.repeated_marks(rows_of_sketch, np.array(marks[:1])).all()


def test_long_texts_in_pieces(monkeypatch):
    hashes = window_dedup.WordHashes()
    text = " ".join(str(n % 97) for n in range(5000)).encode()
    assert (hashes.of(text, 50) == hashes.of(text)).all() and len(hashes.of(text)) == 5000
    assert len(hashes.of(b"x" * 1000 + b" \n\t", 10)) == 1 and len(hashes.of(b"  ", 1)) == 0
    starts = []
    for words, valid, numbers, offsets, ends in window_dedup.buffers([hashes.of(text), hashes.of(text[:400])], 50, 64):
        assert len(words) <= 2 * (64 + 50)
        for a, b, n, o in zip(ends, ends[1:], numbers, offsets):
            starts += [(int(n), int(o + i)) for i in np.flatnonzero(valid[a:b])]
    sizes = [5000, len(text[:400].split())]
    assert sorted(starts) == [(n, i) for n, size in enumerate(sizes) for i in range(size - 49)]


def test_hashes_of_windows():
    words = np.arange(200, dtype=np.uint64)
    for count in (1, 2, 7, 50, 64):
        found = window_dedup.joined_hashes(words % np.uint64(90), count)
        assert len(found) == 201 - count and len(set(found.tolist())) == min(90, 201 - count)
        assert found[0] == found[90]
    assert len(window_dedup.joined_hashes(words[:3], 4)) == 0


def test_text_left_and_empty(spark):
    passage = " ".join(f"p{n}" for n in range(60))
    frame = spark.createDataFrame([("b", f"x\n{passage}  y"), ("a", passage), ("c", None)], "name string, body string")
    rows = window_dedup.dedup(frame, "name", "body", with_text=True).collect()
    assert sorted((r["name"], r["kept"], r["n_removed"]) for r in rows) == [("a", passage, 0), ("b", "x y", 60), ("c", "", 0)]
    assert [tuple(s) for r in rows for s in r["spans"]] == [(1, 61)]
    assert window_dedup.dedup(frame.limit(0), "name", "body").count() == 0
