"""Counts against plain Python, and the verdict on boilerplate."""

import re
from collections import Counter

from tallyward.llm import line_quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    again = {p for i, w in enumerate(windows) if counts[w] > 1 for p in range(i, i + 5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again)


def test_counts(spark):
    texts = [None, "", " \n\t", "a b c d e a b c d e a b c d e", "é\xa0x y\nz\n\nz\nz ", "# $ <b> & é|ü", "a a a a a a a", "w " * 30000, "\x0b\x0c\x85 x"]
    frame = spark.createDataFrame([(i // 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = sorted(tuple(r) for r in line_quality.text_counts(frame, ["doc_id"]).collect())
    assert got == sorted((i // 2, *brute(t)) for i, t in enumerate(texts))


def verdicts(spark, rows, **limits):
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, kept string")
    return {r["doc_id"]: (r["base_failed"], r["kept"]) for r in line_quality.quality(frame, **limits).collect()}


def own(n, k):
    return " ".join(f"word{chr(97 + (n + i) % 26)}{'x' * (n + i)}" for i in range(k))


def test_boilerplate_depletes(spark):
    menu = "Home About us Contact 12 of 40 pages here"
    rows = [(i, "a", f"{menu}\n{own(i, 4 if i < 5 else 40)}", "") for i in range(40)]
    rows += [(100 + i, "b", f"{menu}\n{own(i, 4)}", "") for i in range(10)]  # too few in this host
    rows += [(200, "a", None, ""), (201, None, menu, ""), (202, "a", "", "")]
    found = verdicts(spark, rows, min_left=0.5)
    assert all(found[i] == (False, i >= 5) for i in range(40))
    assert all(found[100 + i] == (False, True) for i in range(10))
    assert found[200] == found[202] == (True, False) and found[201] == (True, False)


def test_exact_copies_are_one_document(spark):
    text = own(3, 30)
    found = verdicts(spark, [(i, "a", text, "") for i in range(100)])
    assert all(v == (False, True) for v in found.values())


def test_clean_removes_the_lines(spark):
    rows = [(i, "a", f"top {i} line\n{own(i, 4)}\nlast", "") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, kept string")
    lines = line_quality.host_lines(frame, "source", "text")
    texts = {r["text"] for r in line_quality.clean(frame, line_quality.boilerplate(lines)).collect()}
    assert texts == {own(i, 4) for i in range(30)}


def test_empty_table(spark):
    assert verdicts(spark, [(1, "a", "x", "")][:0]) == {}
