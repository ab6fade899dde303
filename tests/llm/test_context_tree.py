"""Scores against a tree of dictionaries, proper probabilities, and exact unigram counts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyward.llm import context_tree as ct


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


class Tree:
    """Context-tree weighting with a dictionary per node."""

    def __init__(self, streams):
        self.counts = defaultdict(lambda: [0, 0])
        self.kids = defaultdict(set)
        for data in streams:
            for at in range(ct.DEPTH, len(data)):
                for length in range(ct.DEPTH + 1):
                    context = data[at - length : at]
                    for bit in range(8):
                        before = data[at] >> (8 - bit) | 1 << bit
                        self.counts[context, before][data[at] >> (7 - bit) & 1] += 1
                        if length:
                            self.kids[context[1:], before].add(context)
        self.memo = {}

    def kt(self, node):
        a, b = self.counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def worth(self, context, before):
        key = (context, before)
        if key not in self.memo:
            own = self.kt(key)
            if len(context) < ct.DEPTH:
                below = sum(self.worth(kid, before) for kid in self.kids[key])
                own = math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))
            self.memo[key] = own
        return self.memo[key]

    def probability(self, context, before, went, length=0):
        node = (context[len(context) - length :], before)
        if node not in self.counts:
            return None
        counts = self.counts[node]
        own = (counts[went] + 0.5) / (sum(counts) + 1)
        longer = self.probability(context, before, went, length + 1) if length < ct.DEPTH else None
        if longer is None:
            return own
        stop = math.exp(math.log(0.5) + self.kt(node) - self.worth(*node))
        return stop * own + (1 - stop) * longer

    def score(self, data):
        total = 0.0
        for at in range(ct.DEPTH, len(data)):
            for bit in range(8):
                p = self.probability(data[at - ct.DEPTH : at], data[at] >> (8 - bit) | 1 << bit, data[at] >> (7 - bit) & 1)
                total += math.log10(0.5 if p is None else p)
        return total


def expected(rows):
    words = [(i, (t or "").encode().lower().split()) for i, t in rows]
    training = [w for i, w in words if not held_out(i)]
    counts = Counter(x for w in training for x in w)
    n, v = sum(counts.values()) + len(training), len(counts) + bool(training)
    tree = Tree([ct.stream(w) for w in training])
    for i, w in words:
        own = [*(counts[x] for x in w), len(training)]
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in own)
        yield i, held_out(i), len(own), sum(c > 0 for c in own), n, base, tree.score(ct.stream(w))


def rows():
    random.seed(11)
    vocabulary = ["the", "cat", "sat", "mat", "Überall", "x", "running", "日本", "\x00", "dog's"]
    made = [(i, " ".join(random.choices(vocabulary[: 3 + i % 8], k=random.randrange(40)))) for i in range(30)]
    return made + [(100, None), (101, ""), (None, "the THE\tcat\n"), (3, "the cat"), (3, "the cat"), (4, "unseenword only here zzz")]


@pytest.mark.parametrize("limit", [1 << 18, 3])
def test_against_dictionaries(spark, limit):
    frame = spark.createDataFrame([(*r, "x") for r in rows()], "doc_id long, text string, score string").repartition(3)
    frame = frame.withColumn("_held", ct.fold("doc_id", 5) == 1)
    got = ct.score(frame, "_held", frequent_words=limit, frequent_grams=limit).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for mine, theirs in zip(sorted(map(tuple, got), key=order), sorted(expected(rows()), key=order), strict=True):
        assert mine[:5] == theirs[:5]
        assert mine[5:] == pytest.approx(theirs[5:], rel=1e-6, abs=1e-6)


def test_probabilities_add_up_to_one():
    tree = Tree([ct.stream((t or "").encode().lower().split()) for _, t in rows()])
    for context in (b"\n\n\nth", b"e cat", b"zzzzz"):
        def walk(before, p):
            if before >= 256:
                return p
            return sum(walk(before << 1 | w, p * (0.5 if (q := tree.probability(context, before, w)) is None else q)) for w in (0, 1))
        assert walk(1, 1.0) == pytest.approx(1)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.5, 100.5, 1e6, 1e12])
    assert ct.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-9)


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.append(np.unique(rng.integers(0, 1 << 48, 5000)), -7)
    values, found = ct.Lookup(keys, keys % 1000 * 0.5).get(np.concatenate([keys, keys + (1 << 50)]))
    assert found.tolist() == [True] * len(keys) + [False] * len(keys) and (values[: len(keys)] == keys % 1000 * 0.5).all()
    assert not ct.Lookup(keys[:0], keys[:0] * 0.5).get(keys)[1].any()
    assert ct.Lookup(np.array([-1, 5]), np.array([1.0, 2.0])).get(np.array([-1, 5]))[1].tolist() == [False, True]


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(i, "ab") for i in range(50) if held_out(i)], "doc_id long, text string")
    assert {(r["train_tokens"], round(r["score"], 4), r["n_known"]) for r in ct.report(frame).collect()} == {(0, round(-24 * math.log10(2), 4), 0)}
    assert ct.report(frame.limit(0)).count() == 0


def test_better_than_words_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    score, base = ct.report(docs).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert score > base
