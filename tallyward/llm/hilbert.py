"""Sharding along a Hilbert curve, with DataFrame operations only.

Each metadata dimension is quantised to a few bits, rows are ordered by the curve index of their cell, and the order is cut
into runs of equal row counts. A run then covers a compact box of the dimensions, so a filter on several of them skips most
files. No row count or group has to fit anywhere: cells are counted first, a cell above its share of the rows is dealt to
several parts by a hash, and a row's place is the rows of the parts before its own plus its number within the part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.llm.common import documents

SHARDS = 16
BITS = 4
#: A part holds about this share of all rows at most. Cells and parts together are 2 ** (BITS * dimensions) + PARTS rows at most.
PARTS = 4096
#: Columns that `place` makes, the last seven for itself.
PLACED = ("curve", "shard", "slot", "_n", "_all", "_parts", "_part", "_start", "_number", "_rank")


def curve_index(point: Sequence[int], bits: int) -> int:
    """The position of a cell on the Hilbert curve of as many dimensions as the point has (the transposed-bits method)."""
    x, n = list(point), len(point)
    bit = 1 << (bits - 1)
    while bit > 1:
        for i in range(n):
            if x[i] & bit:
                x[0] ^= bit - 1
            else:
                swap = (x[0] ^ x[i]) & (bit - 1)
                x[0] ^= swap
                x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = 0
    for b in range(bits - 1, 0, -1):
        if x[-1] >> b & 1:
            flip ^= (1 << b) - 1
    x = [v ^ flip for v in x]
    index = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | v >> b & 1
    return index


def curve_table(dimensions: int, bits: int = BITS) -> list[int]:
    """The curve index of each cell; a cell's number has the first dimension in its highest bits."""
    cells = range(1 << bits * dimensions)
    mask = (1 << bits) - 1
    return [curve_index([cell >> bits * (dimensions - 1 - d) & mask for d in range(dimensions)], bits) for cell in cells]


def level_of_name(name: Column, bits: int = BITS) -> Column:
    """A level for a value that is only compared for equality; a reader computes the same level for the value it looks for."""
    return F.pmod(F.crc32(F.coalesce(name.cast("string"), F.lit(""))), F.lit(1 << bits)).cast("int")


def level_of_size(size: Column, bits: int = BITS, least: int = 4) -> Column:
    """The size's power of two, in order; sizes below 2 ** least share the first level, very large ones the last."""
    power = F.floor(F.log2(F.greatest(F.coalesce(size, F.lit(0)), F.lit(1)).cast("double"))) - least
    return F.least(F.greatest(power, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def place(frame: DataFrame, dimensions: dict[str, Column], key: Sequence[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """The frame with a level column per dimension, `curve`, `shard` and `slot`.

    `dimensions` gives the level of each row in each dimension, 0 to 2 ** bits - 1. Shards are runs along the curve whose row
    counts are at most one apart, slots number a shard's rows without gaps from 0. Rows of a cell are ordered by part, then by
    the key columns, nulls first; rows equal in all of them are interchangeable. An empty frame gives no rows. Columns of the frame
    that are named as a result (`curve`, `shard`, `slot`) or as a column in between (`PLACED`) give way and are not returned; one
    named as a dimension is replaced by its level. ValueError if such a column is a key.
    """
    taken = [k for k in key if k in PLACED]
    if taken:
        raise ValueError(f"keys are named as results: {taken}")
    table = F.expr(f"array({','.join(map(str, curve_table(len(dimensions), bits)))})")
    cell = F.lit(0)
    for name in dimensions:
        cell = cell * (1 << bits) + F.col(name)
    levelled = frame.withColumns(dimensions).drop(*PLACED)
    own = [f"`{c}`" for c in levelled.columns if c not in dimensions]
    rows = levelled.withColumn("curve", F.element_at(table, (cell + 1).cast("int")))

    whole = Window.partitionBy()
    cells = rows.groupBy("curve").agg(F.count("*").alias("_n")).withColumn("_all", F.sum("_n").over(whole))
    parts = cells.select("curve", "_all", (F.lit(1) + F.expr(f"_n * {PARTS} div _all")).alias("_parts"))
    # Both sides of a broadcast have a bound that does not depend on the rows: the number of cells, and cells plus PARTS.
    dealt = rows.join(F.broadcast(parts), "curve").withColumn("_part", F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.col("_parts")))
    counts = dealt.groupBy("curve", "_part", "_all").agg(F.count("*").alias("_n"))
    before = Window.orderBy("curve", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("curve", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))

    within = Window.partitionBy("curve", "_part").orderBy(*[F.col(k).asc_nulls_first() for k in key])
    numbered = dealt.withColumn("_number", F.row_number().over(within)).join(F.broadcast(starts), ["curve", "_part"])
    ranked = numbered.withColumn("_rank", F.col("_start") + F.col("_number") - 1)
    cut = ranked.withColumn("shard", F.expr(f"CAST((_rank * {shards}) div _all AS INT)"))
    first = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return cut.withColumn("slot", (F.col("_rank") - first).cast("long")).select(*own, *dimensions, "curve", "shard", "slot")


def manifest(placed: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Per shard its rows and the lowest and highest level of each dimension, from which a reader picks the shards to open."""
    bounds = [f(d).alias(f"{label}_{d}") for d in dimensions for f, label in ((F.min, "min"), (F.max, "max"))]
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), *bounds)


def shards_matching(shards: DataFrame, levels: dict[str, int]) -> DataFrame:
    """The shards of a manifest that can hold rows with the given levels."""
    found = shards
    for name, level in levels.items():
        found = found.where((F.col(f"min_{name}") <= level) & (F.col(f"max_{name}") >= level))
    return found.select("shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """The rows as Parquet below shard=N, in curve order within each file; a large shard is several files, each a run of it."""
    ordered = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def document_shards(frame: DataFrame) -> DataFrame:
    """Every document placed by language, source and size. A null text has size 1 and the checksum of the empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(frame, "doc_id", "text", "lang", "source").select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.col("lang").alias("_lang"), F.col("source").alias("_source"),
    )
    dimensions = {
        "lang_level": level_of_name(F.col("_lang")), "source_level": level_of_name(F.col("_source")), "size_level": level_of_size(F.col("size")),
    }
    placed = place(rows, dimensions, ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "curve", *dimensions,
    )
