"""The audit against a plain computation, with one block and many, one tile and many."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyward.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least, limit=50):
    counts, holders, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, text in rows:
        found = terms(text)
        counts[lang or "", source or ""].update(found)
        holders[lang or ""].update(set(found))
    for lang in holders:
        kept = [t for t, n in holders[lang].items() if n >= least]
        groups = {s: c for (l, s), c in counts.items() if l == lang}

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own, all_of = {s: shares(c) for s, c in groups.items()}, shares(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            above = [(all_of[t] - own[s][t], t.encode(), t) for t in kept if groups[s][t] and own[s][t] > all_of[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(above)[:limit])):
                out += [(lang, s, part, item, -v, n + 1) for n, (v, _, item) in enumerate(found)]
    return sorted(out)


def made(seed):
    random.seed(seed)
    vocabulary = ["The", "the", "of", "Äa", "äa", "日本", "x1y", "don't", "É", "z-z", " q"] + [f"w{'abcdefgh'[n % 8]}{'ijklmnop'[n // 8]}" for n in range(64)]
    rows = [(None, None, None), ("en", "", ""), ("en", None, "1 2 3 --"), ("xx", "a", "the"), ("xx", "b", None), ("", "s0", "the of")]
    for _ in range(260):
        lang = random.choice(["en", "de", None])
        k = min(len(vocabulary), 8 + int(random.expovariate(0.05)))
        rows.append((lang, random.choice(["s0", "s0", "s1", "s2", "Z", "é", None]), " ".join(random.choices(vocabulary[:k], k=random.randrange(60)))))
    return rows + rows[20:25] * 3


@pytest.mark.parametrize("sizes", [{}, {"block": 5, "tile": 2}, {"block": 1, "tile": 1}])
def test_against_plain_computation(spark, sizes):
    rows = made(1)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, rank int, term string").repartition(5)
    found = sorted(map(tuple, divergence.audit(frame, least=12, **sizes).collect()))
    assert found == brute(rows, 12) and len(found) > 200


def test_small_limit_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GATHERED", 10)
    rows = made(2)
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(2)
    assert sorted(map(tuple, divergence.audit(frame, least=3, limit=4).collect())) == brute(rows, 3, 4)


def test_shares_do_not_overflow():
    counts = [0, 5, 7, 10**14, 3 * 10**14, 10**15]
    assert divergence.shares(np.array(counts), 10**15).tolist() == [1 + 10**9 * c // 10**15 for c in counts]
    assert divergence.shares(np.array([1, 2, 3]), 3).tolist() == [1 + 10**9 * c // 3 for c in (1, 2, 3)]


def test_runs_and_parts():
    column = np.array([3, 3, 0, 0, 0, 7])
    values, starts = divergence.run_lengths(column, np.array([0, 2, 3, 4, 9, 10]))
    assert values.tolist() == [3, 0, 7] and starts.tolist() == [0, 3, 10]
    other = (np.array([1, 5]), np.array([0, 4]))
    assert divergence.run_distance((values, starts), other, 12) == 3 * 2 + 1 * 1 + 5 * 6 + 2 * 2
    text = "Aé b  c" * 50
    assert [w for part in divergence.words(text.encode(), 7) for w in part] == [t.encode() for t in terms(text)]
    matrix = np.random.default_rng(1).integers(0, 2, (40, 3))
    assert sum((np.diff(matrix[divergence.clustered(matrix), i]) != 0).sum() for i in range(3)) <= 7 + 3 + 1


def test_empty(spark):
    frame = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(frame).count() == 0
