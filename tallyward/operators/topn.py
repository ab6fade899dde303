"""First rows per key, without ever sorting a whole hot key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

GROUP_LIMIT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"
SALT_BUCKETS = 64


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, position: str = "position"
) -> DataFrame:
    """The first `n` rows of each key under `order`, numbered from 1 in column `position`.

    For small `n` Spark limits each key inside every map task before it shuffles (WindowGroupLimit), so a hot
    key sends at most n rows per task. Above the optimiser's threshold that rule is off; then the rows are
    first ranked within salted parts of a key, and only n rows per part reach the final ranking. Give `order`
    a unique last column when the result must be the same on every run.
    """
    threshold = int(df.sparkSession.conf.get(GROUP_LIMIT_SETTING, "1000"))
    if n >= threshold:
        hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if not _holds_map(f.dataType)]
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(SALT_BUCKETS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= n).drop("_rank", "_salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(whole)).where(F.col(position) <= n)


def _holds_map(kind: T.DataType) -> bool:
    """Whether a type has a part that can not be hashed."""
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, (T.MapType, T.VariantType))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first under `order`."""
    return first_per_key(df, keys, order, 1, "_position").drop("_position")


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert or replace by key: an incoming row replaces the current row of its key.

    Rows of the same key within one side are not expected; if there are, one is kept. As a key has a row or two, rows are shuffled
    before anything is sorted: limiting keys in the map tasks would sort all of an input split and drop next to nothing.
    """
    both = current.withColumn("_age", F.lit(1)).unionByName(
        incoming.withColumn("_age", F.lit(0)), allowMissingColumns=True
    )
    return latest_per_key(both.repartition(*keys), keys, [F.col("_age")]).drop("_age")


def newest_page(df: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a newest-first listing."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, order: Sequence[tuple[str, bool]], after: Sequence[object] | None, limit: int = 50) -> DataFrame:
    """The page of a listing that follows a place in it, by a filter instead of an offset: what comes before is never sorted.

    `order` is (column, descending) with a unique last column, `after` the values of the last row seen, None for the first page; a
    value may also be a Column without rows of its own, such as a scalar subquery. Nulls come last.
    """
    rows = df
    if after is not None:
        later, same = F.lit(False), F.lit(True)
        for (name, descending), value in zip(order, after, strict=True):
            column = F.col(name)
            if value is None:
                same = same & column.isNull()
                continue
            beyond = column < value if descending else column > value
            later = later | (same & (F.coalesce(beyond, F.lit(True)) if df.schema[name].nullable else beyond))
            same = same & (column == value)
        # The first column alone bounds what is read.
        name, descending = order[0]
        if after[0] is not None:
            first = F.col(name) <= after[0] if descending else F.col(name) >= after[0]
            rows = rows.where(first | F.col(name).isNull() if df.schema[name].nullable else first)
        rows = rows.where(F.coalesce(later, F.lit(False)))
    return rows.orderBy(*[F.desc_nulls_last(n) if descending else F.asc_nulls_last(n) for n, descending in order]).limit(limit)
