"""Exact scores against whole numbers of any size, and selections against a plain search."""

import math
import random

import numpy as np
import pytest

from tallyward.llm import hard_negatives as hn


def brute(rows, every, positives=5, negatives=5):
    def usable(r):
        return None not in r[:3] and all(x is not None and math.isfinite(x) for x in r[2])

    rows = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in filter(usable, rows)]
    out = []
    for a, label, v in {(i, l, tuple(v)) for i, l, v in rows if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, l) for i, l, w in rows)
        chosen = [(i, -s) for s, i, l in scored if l == label and i != a][:positives]
        for i, p in chosen:
            fits = [(j, -s) for s, j, l in scored if l != label and 80 * p <= -100 * s <= 100 * p][:negatives]
            out += [(a, i, n + 1, j, p, s) for n, (j, s) in enumerate(fits)]
    return sorted(out)


def made(seed, n, dims, size):
    random.seed(seed)
    centres = [[random.uniform(-size, size) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = random.choice(centres)
        rows.append((i, random.randrange(3), [float(np.float32(x + random.uniform(-size, size) / 2)) for x in c]))
    rows += [(n + k, k % 3, rows[0][2]) for k in range(30)]  # ties
    rows += [(n + 30, None, rows[1][2]), (n + 31, 1, None), (n + 32, 1, [1.0, None, 2.0]), (n + 33, 0, [float("nan")] * dims), (n + 34, 0, [float("-inf")])]
    rows += [(None, 1, rows[2][2]), (n + 40, 2, []), (n + 41, 2, rows[3][2][: dims // 2]), rows[5], rows[10], rows[10], (20, 2, rows[4][2])]
    return rows


def run(spark, rows, every):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, score string").repartition(4)
    return sorted(map(tuple, hn.mine(frame, f"vec_id % {every} = 0").collect()))


@pytest.mark.parametrize("size", [0.3, 40.0, 1e4])
def test_against_plain_search(spark, size):
    rows = made(int(size) + 1, 300, 12, size)
    found = run(spark, rows, 10)
    # Two rows of one id and positive give the same keys twice, so that rows are compared as lists.
    assert found == brute(rows, 10) and len(found) > 50


def test_many_cells_and_small_tiles(spark, monkeypatch):
    rows = made(7, 1500, 7, 0.5)
    monkeypatch.setattr(hn, "MAX_ANCHORS", 50)
    monkeypatch.setattr(hn, "MAX_ROWS", 200)
    monkeypatch.setattr(hn, "TILE", (16, 32))
    assert run(spark, rows, 5) == brute(rows, 5)


@pytest.mark.parametrize("dims", [1, 5, 64, 200])
@pytest.mark.parametrize("bits", [2, 9, 24])
def test_scores_are_exact(dims, bits):
    random.seed(dims * bits)
    a = [[random.randrange(-(1 << bits), 1 << bits) for _ in range(dims)] for _ in range(9)]
    b = [[random.choice([-(1 << bits), (1 << bits) - 1]) for _ in range(dims)] for _ in range(11)] + [[0] * dims]
    bound = max(sum(x * x for x in v) for v in a + b)
    moduli = hn.primes(bound)
    assert math.prod(moduli) > 2 * bound and all(64 * ((p - 1) // 2) ** 2 < 1 << 24 for p in moduli)
    left, right = (hn.residues(np.array(m, float), moduli) for m in (a, b))
    assert hn.scores(left, right, moduli).tolist() == [[sum(x * y for x, y in zip(v, w)) for w in b] for v in a]


def test_too_large_scores_raise(spark):
    frame = spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    with pytest.raises(ValueError):
        hn.mine(frame, "vec_id = 0")


def test_empty(spark):
    frame = spark.createDataFrame([(1, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hn.mine(frame, "vec_id = 0").count() == hn.report(frame.limit(0)).count() == 0
