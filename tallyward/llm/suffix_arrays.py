"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, merging by binary search."""

from __future__ import annotations

import numpy as np

#: Positions that one lane of the common-prefix computation goes through.
LANE = 512


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number that sorts as they do; zeros stand beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    keys = np.zeros(len(data) + 1, np.uint64)
    for byte in range(8):
        keys |= padded[byte : byte + len(data) + 1].astype(np.uint64) << np.uint64(56 - 8 * byte)
    return keys


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """The positions sorted by what follows them.

    Starts from groups equal in eight bytes. A round sorts each group that is still open by the group of the position h
    bytes on, which doubles h. Groups of one are never touched again.
    """
    n = len(keys) - 1
    order = n - 1 - np.argsort(keys[:n][::-1], kind="stable")  # of equal words, the shorter suffix comes first
    rank = np.full(n + 1, -1, np.int64)
    fresh = np.empty(n, bool)
    if n:
        fresh[0] = True
        # A suffix of under eight bytes is no other's equal, though zeros may stand where the other has zeros.
        fresh[1:] = (keys[order[1:]] != keys[order[:-1]]) | (order[1:] > n - 8) | (order[:-1] > n - 8)
        starts = np.flatnonzero(fresh)
        rank[order] = np.repeat(starts, np.diff(starts, append=n))
    places = _open(np.arange(n), fresh)
    h = 8
    while len(places):
        at = order[places]
        key = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        resort = np.argsort(key, kind="stable")
        at, key = at[resort], key[resort]
        order[places] = at
        fresh = np.empty(len(places), bool)
        fresh[0] = True
        fresh[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(fresh)
        rank[at] = np.repeat(places[starts], np.diff(starts, append=len(places)))
        places = _open(places, fresh)
        h *= 2
    return order


def _open(places: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The places in groups of more than one; `fresh` marks the first of each group."""
    last = np.append(fresh[1:], True)
    return places[~(fresh & last)]


def equal_bytes(differ: np.ndarray) -> np.ndarray:
    """How many of the first bytes of two packed words are equal, from their exclusive or."""
    found = np.zeros(len(differ), np.int64)
    for byte in range(1, 8):
        found += differ < np.uint64(1 << (64 - 8 * byte))
    return found + (differ == 0)


def common_prefixes(keys: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place of a suffix array, the bytes its suffix shares with the one before, at most `depth`; the first has 0.

    Kasai's algorithm: in text order, the next position shares at least one byte less than this one did. The text is cut into
    lanes that go on side by side, eight bytes a step.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    at = np.arange(0, n, LANE)
    stop = np.minimum(at + LANE, n)
    have = np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        # A suffix without one before it, or one that has all bytes already, is done at once.
        left = np.minimum(depth, n - np.maximum(at, other))
        same = equal_bytes(keys[np.minimum(at + have, n)] ^ keys[np.minimum(other + have, n)])
        same = np.where(other < 0, 0, same)
        have = np.minimum(have + same, np.where(other < 0, 0, left))
        done = (same < 8) | (have >= left)
        shared[at[done]] = have[done]
        have = np.where(done, np.maximum(have - 1, 0), have)
        at = at + done
        going = at < stop
        if not going.all():
            at, stop, have = at[going], stop[going], have[going]
    return shared[order]


def repeated(data: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Which valid positions start a string of `length` bytes that starts at another valid position too."""
    if not valid.any():
        return np.zeros(len(data), bool)
    keys = packed(data)
    order = suffix_array(keys)
    kinds = np.cumsum(common_prefixes(keys, order, length) < length) - 1
    own = valid[order]
    counts = np.bincount(kinds[own], minlength=int(kinds[-1]) + 1)
    found = np.zeros(len(data), bool)
    found[order] = own & (counts[kinds] > 1)
    return found


def _order_of(keys_a: np.ndarray, a: np.ndarray, keys_b: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(a's string is smaller, both are equal) for strings of `length` bytes at positions a and b, all of them inside."""
    smaller, equal = np.zeros(len(a), bool), np.ones(len(a), bool)
    going = np.arange(len(a))
    for step in range(0, length, 8):
        x, y = keys_a[a[going] + step], keys_b[b[going] + step]
        if length - step < 8:
            cut = np.uint64(8 * (8 - (length - step)))
            x, y = x >> cut, y >> cut
        differ = x != y
        smaller[going[differ]] = x[differ] < y[differ]
        equal[going[differ]] = False
        going = going[~differ]
        if not len(going):
            break
    return smaller, equal


class Shard:
    """A piece of text with the sorted strings of `length` bytes that start at its valid positions, one of each kind."""

    def __init__(self, data: np.ndarray, valid: np.ndarray, length: int) -> None:
        self.length = length
        self.keys = packed(data)
        order = suffix_array(self.keys)
        kinds = np.cumsum(common_prefixes(self.keys, order, length) < length) - 1 if len(order) else order
        self.order, self.kinds = order[valid[order]], kinds[valid[order]]
        self.first = np.flatnonzero(np.diff(self.kinds, prepend=-1))
        self.heads = self.order[self.first]
        self.size = len(data)

    def mark(self, heads: np.ndarray) -> np.ndarray:
        """The positions whose string is one of the heads named by number."""
        found = np.zeros(self.size, bool)
        chosen = np.zeros(len(self.heads), bool)
        chosen[heads] = True
        found[self.order[np.repeat(chosen, np.diff(self.first, append=len(self.order)))]] = True
        return found


def merge(a: Shard, b: Shard) -> tuple[np.ndarray, np.ndarray]:
    """The positions of each shard whose string starts in the other one too: each head of b is looked up in a by bisection."""
    low, high = np.zeros(len(b.heads), np.int64), np.full(len(b.heads), len(a.heads))
    while (open_ := low < high).any():
        at = np.flatnonzero(open_)
        middle = (low[at] + high[at]) // 2
        smaller, _ = _order_of(a.keys, a.heads[middle], b.keys, b.heads[at], a.length)
        low[at] = np.where(smaller, middle + 1, low[at])
        high[at] = np.where(smaller, high[at], middle)
    at = np.flatnonzero(low < len(a.heads))
    _, equal = _order_of(a.keys, a.heads[low[at]], b.keys, b.heads[at], a.length)
    return a.mark(low[at[equal]]), b.mark(at[equal])
