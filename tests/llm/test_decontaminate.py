"""Hits against a plain search for every window, blocks against one automaton, and offsets."""

import hashlib
import random
import re

from tallyward.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))


def brute(text, items, size=13):
    own, hit, found = words(text), set(), set()
    for item, other in items:
        theirs = words(other)
        for at in range(max(1, len(theirs) - size + 1) if theirs else 0):
            window = theirs[at : at + size]
            for i in range(len(own) - len(window) + 1):
                if own[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add("" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)


def cases():
    random.seed(3)
    pick = lambda n: " ".join(random.choices(["Éa", "b", "c1", "D", "e-f"], k=n))
    items = [(10, pick(30)), (9, pick(13)), (2, "Only four words, here."), (7, None), (None, "b b c1"), (8, "!!"), (2, pick(20)), (5, "")]
    texts = [None, "", "...", pick(3), "x only FOUR words; here y", items[0][1] * 3, "q " * 500 + items[1][1], pick(4000)]
    texts += [f"{pick(5)} {' '.join(items[0][1].split()[n : n + 14])} {pick(5)}" for n in range(10)]
    return [(i % 7, t) for i, t in enumerate(texts + texts[3:5])], items


def test_against_plain_search(spark):
    rows, items = cases()
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted((i, *brute(t, items)) for i, t in rows)
    assert sorted(tuple(r) for r in decontaminate.report(frame, bench).collect()) == expected
    whole = sorted(map(str, decontaminate.scan(frame, bench).collect()))
    assert whole == sorted(map(str, decontaminate.scan(frame, bench, block_words=60).collect()))


def test_spans_are_offsets_of_the_original(spark):
    frame = spark.createDataFrame([(1, "é, ONE  two-three four. one two")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    (row,) = decontaminate.scan(frame, bench).collect()
    data = "é, ONE  two-three four. one two".encode()
    assert [data[s["start"] : s["end"]] for s in row["spans"]] == [b"ONE  two-three"]


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in decontaminate.report(frame, bench).collect()] == [0]
    assert decontaminate.report(frame.limit(0), bench).count() == 0
