"""Suffix arrays, common prefixes and merging against plain sorting and searching."""

import numpy as np
import pytest

from tallyward.llm import suffix_arrays as sa


def random_text(rng, n, kinds):
    parts = [rng.integers(0, kinds, rng.integers(1, 40)).astype(np.uint8) for _ in range(5)]
    out = np.concatenate([parts[rng.integers(0, 5)] for _ in range(n)] or [np.zeros(0, np.uint8)])
    return out


@pytest.mark.parametrize("kinds", [1, 2, 3, 255])
def test_order_and_prefixes(kinds):
    rng = np.random.default_rng(kinds)
    for n in (0, 1, 2, 10, 60):
        data = random_text(rng, n, kinds)
        text, depth = data.tobytes(), 24
        keys = sa.packed(data)
        order = sa.suffix_array(keys)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        cut = [text[i : i + depth] for i in order]
        shared = sa.common_prefixes(keys, order, depth)
        for at in range(1, len(order)):
            a, b = cut[at - 1], cut[at]
            own = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[at] == own


@pytest.mark.parametrize("length", [8, 13, 24])
def test_repeated_and_merged(length):
    rng = np.random.default_rng(length)
    for _ in range(15):
        a, b = random_text(rng, 25, 3), random_text(rng, 25, 3)
        b = np.concatenate([b, a[5:60], b[:7]])
        strings, valid = [], []
        for data in (a, b):
            ok = (np.arange(len(data)) + length <= len(data)) & (rng.random(len(data)) < 0.9)
            valid.append(ok)
            strings.append([data[i : i + length].tobytes() if ok[i] else None for i in range(len(data))])
        for data, ok, own in zip((a, b), valid, strings):
            expected = [s is not None and own.count(s) > 1 for s in own]
            assert sa.repeated(data, ok, length).tolist() == expected
        found = sa.merge(*(sa.Shard(d, ok, length) for d, ok in zip((a, b), valid)))
        for own, other, marks in ((strings[0], strings[1], found[0]), (strings[1], strings[0], found[1])):
            assert marks.tolist() == [s is not None and s in other for s in own]
