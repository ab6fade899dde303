"""Fingerprints bit by bit, links and components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyward.llm import simhash
from tallyward.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys, linked):
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


TEXTS = [None, "", " \n", "One two", "one TWO", "a b c d", "É\xa0x y\x0bz w É", "a b c d e f " * 3000, "same words here now again"]


def test_fingerprints(spark):
    frame = spark.createDataFrame([(i // 2, t, 9) for i, t in enumerate(TEXTS)], "doc_id long, text string, bits int")
    got = sorted((r["doc_id"], r["bits"] % 2**64) for r in simhash.fingerprints(frame).collect())
    assert got == sorted((i // 2, plain_fingerprint(t)) for i, t in enumerate(TEXTS))


def test_same_hash_as_the_session(spark):
    (row,) = spark.range(1).select(F.xxhash64(F.lit("ab cd é f")).alias("h")).collect()
    assert row["h"] % 2**64 == xxhash.xxh64_intdigest("ab cd é f".encode(), 42)


def clustered(n, seed):
    random.seed(seed)
    made = []
    while len(made) < n:
        centre = random.getrandbits(64)
        for _ in range(random.choice([1, 1, 2, 30])):
            made.append(centre)
            for bit in random.sample(range(64), random.randrange(0, 7)):
                made[-1] ^= 1 << bit
            centre = random.choice([centre, made[-1]])
    return sorted(set(made))


def test_every_close_pair_meets_at_a_home():
    random.seed(2)
    for _ in range(300):
        x = random.getrandbits(64)
        y = x
        for bit in random.sample(range(64), 4):
            y ^= 1 << bit
        rows, names, homes = simhash.anchors(np.array([x, y], np.uint64))
        assert homes.sum() == 6
        assert any(h and a in names[rows == 1] for r, a, h in zip(rows, names, homes) if r == 0)


@pytest.mark.parametrize("homes", [2, 4096])
def test_components_of_links(spark, homes):
    keys = clustered(700, 4)
    frame = spark.createDataFrame([(k - 2**64 if k >= 2**63 else k,) for k in keys], "bits long")
    got = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(frame, homes=homes).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    close = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if (a ^ b).bit_count() <= 4]
    assert classes(keys, got) == classes(keys, close)


def test_documents(spark):
    random.seed(7)
    base = [" ".join(random.choices("abcdefghijklmnop", k=200)) for _ in range(6)]
    rows = [(100 - i, b[: len(b) - 2 * (i % 3)]) for i, b in enumerate(base * 5)]
    rows += [(3, None), (500, ""), (None, base[0]), (100, base[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    close = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a][1] ^ prints[b][1]).bit_count() <= 4]
    roots = classes(range(len(rows)), close)
    least = {}
    for at, (i, _) in enumerate(rows):
        least.setdefault(roots[at], []).extend([] if i is None else [i])
    expected = sorted((i or 0, f"{p:016x}", min(least[roots[at]])) for at, (i, p) in enumerate(prints))
    assert sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.report(frame).collect()) == expected
    assert simhash.report(frame.limit(0)).count() == 0


def test_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 400)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(links).collect()} == {**{i: 0 for i in range(1, 201)}, 500: 400}
