"""The curve, the law of equal row counts, and what pruning skips."""

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyward.llm import hilbert


def test_neighbours_on_the_curve_are_neighbours_in_space():
    for dimensions, bits in ((2, 4), (3, 4), (3, 2), (4, 2)):
        points = sorted(itertools.product(range(1 << bits), repeat=dimensions), key=lambda p: hilbert.curve_index(p, bits))
        assert sorted(hilbert.curve_index(p, bits) for p in points) == list(range(len(points)))
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(points, points[1:]))


def rows_of(n, seed=5):
    random.seed(seed)
    made = []
    for i in range(n):
        text = random.choice([None, "", "same", "é" * random.randrange(900)])
        made.append((random.choice([None, i, i, 7]), text, random.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 40}", 1))
    return made + made[:20]


def test_law(spark):
    for n in (0, 3, 500):
        rows = rows_of(n) if n > 3 else rows_of(5)[:n]
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
        got = hilbert.document_shards(frame).collect()
        assert len(got) == len(rows)
        assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted(
            (-1 if i is None else i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
        slots = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(16)}
        assert all(v == list(range(len(v))) for v in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
        assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in got)


def test_cell_is_the_tables(spark):
    table = hilbert.curve_table(3)
    frame = spark.createDataFrame(rows_of(60), "doc_id long, text string, lang string, source string, shard int")
    for r in hilbert.document_shards(frame).collect():
        assert r["curve"] == table[r["lang_level"] * 256 + r["source_level"] * 16 + r["size_level"]]


def test_pruning_and_files(spark, folder):
    rows = spark.range(4000).select("id", *[F.pmod(F.xxhash64("id", F.lit(d)), F.lit(16)).cast("int").alias(d) for d in "abc"])
    placed = hilbert.place(rows.select("id", *[F.col(d).alias(f"_{d}") for d in "abc"]), {d: F.col(f"_{d}") for d in "abc"}, ["id"])
    shards = hilbert.manifest(placed, ["a", "b", "c"])
    found = [r["shard"] for r in hilbert.shards_matching(shards, {"a": 3, "b": 9, "c": 14}).collect()]
    assert 1 <= len(found) <= 4
    hilbert.write_shards(placed, f"{folder}/out")
    back = spark.read.parquet(f"{folder}/out")
    assert back.where("a = 3 AND b = 9 AND c = 14").select("shard").distinct().where(~F.col("shard").isin(found)).count() == 0
    assert back.count() == 4000


def test_place_with_clashing_columns(spark):
    rows = spark.range(300).select("id", (F.col("id") % 16).alias("a"), (F.col("id") % 5).alias("curve"), F.lit("x").alias("a.b"), *[F.lit(9).alias(c) for c in hilbert.PLACED[1:]])
    levels = {"a": F.col("a").cast("int"), "b": F.col("curve").cast("int")}
    placed = hilbert.place(rows, levels, ["id"])
    assert placed.columns == ["id", "a.b", "a", "b", "curve", "shard", "slot"]
    got = {r["id"]: r for r in placed.collect()}
    table = hilbert.curve_table(2)
    assert len(got) == 300 and all(r["curve"] == table[i % 16 * 16 + i % 5] and (r["a"], r["b"], r["a.b"]) == (i % 16, i % 5, "x") for i, r in got.items())
    assert sorted(r["shard"] for r in got.values()) == sorted(i * 16 // 300 for i in range(300))
    assert hilbert.place(rows.limit(0), levels, ["id"]).count() == 0
    with pytest.raises(ValueError):
        hilbert.place(rows, levels, ["id", "slot"])
