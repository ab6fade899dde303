"""Tables fed by micro-batches: published batch by batch, merged on reading, compacted as they grow.

A batch is a folder of rows and a commit that publishes it; a replay of a published batch changes nothing, and a reader never sees
one half-way. Rows of the same key are merged by aggregates that give the same whichever way batches are put together: sums,
extremes, unions of sketches, or the value of the newest batch. Every so many batches the merged rows so far are written as a
snapshot, which is published the same way, so that a reader needs the last snapshot and the batches since.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyward.sources.commits import CommitLog, discard

#: Batches from one snapshot to the next.
COMPACT_EVERY = 16

Merge = Callable[[str], Column]


def newest(column: str) -> Column:
    """The value of the newest batch that has the key."""
    return F.max_by(column, "batch")


class BatchTable:
    """Batches of keyed rows below a path. `merges` tells how a column's values are merged, the newest wins where it does not."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] | None = None, merges: Mapping[str, Merge] | None = None) -> None:
        self.spark, self.path, self.keys, self.merges = spark, path.rstrip("/"), list(keys or ()), dict(merges or {})
        # Names that begin with an underscore are hidden from a plain read of the path.
        self.batches = CommitLog(spark, f"{self.path}/_batches")
        self.snapshots = CommitLog(spark, f"{self.path}/_snapshots/_published")

    def write(self, rows: DataFrame, number: int, compact_every: int = COMPACT_EVERY, keep: int | None = None) -> None:
        """Publish a batch, unless it is published already; without keys there are no snapshots. `keep` is the number of snapshots
        that stay, with the batches since the first of them; all stay unless it is given."""
        if self.batches.read(number) is None:
            rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
            self.batches.put(number, {"schema": rows.schema.jsonValue()})
        if self.keys and compact_every and (number + 1) % compact_every == 0:
            self.compact(rows.schema, number)
            if keep:
                self.forget(keep)

    def compact(self, schema: StructType, upto: int) -> None:
        """Publish the merged rows of all batches up to a number as a snapshot."""
        if self.snapshots.read(upto) is None:
            self.read(schema, upto).write.mode("overwrite").parquet(f"{self.path}/_snapshots/upto={upto}")
            self.snapshots.put(upto, {"upto": upto})

    def forget(self, keep: int) -> None:
        """Remove what only readers of older snapshots than the last `keep` would need."""
        kept = self.snapshots.numbers()[-keep:]
        for number in self.batches.numbers():
            if number <= kept[0]:
                discard(self.spark, f"{self.path}/batch={number}")
        for number in self.snapshots.numbers():
            if number < kept[0]:
                discard(self.spark, f"{self.path}/_snapshots/upto={number}")

    def _snapshot_before(self, upto: int | None) -> int:
        last = self.snapshots.last(upto)
        return -1 if last is None else last

    def rows(self, schema: StructType, upto: int | None = None) -> DataFrame:
        """The rows to be merged, with `batch`: the last published snapshot, if there is one, and the published batches since.

        `upto` leaves out what comes after that batch; a snapshot counts if it is older.
        """
        last = self._snapshot_before(upto)
        numbers = [n for n in self.batches.numbers() if n > last and (upto is None or n <= upto)]
        whole = StructType([*schema.fields, StructField("batch", LongType())])
        parts = [self.spark.read.schema(whole).option("basePath", self.path).parquet(*[f"{self.path}/batch={n}" for n in numbers])] if numbers else []
        if last >= 0:
            parts.append(self.spark.read.schema(schema).parquet(f"{self.path}/_snapshots/upto={last}").withColumn("batch", F.lit(last).cast("long")))
        if not parts:
            return self.spark.createDataFrame([], whole)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read(self, schema: StructType | None = None, upto: int | None = None) -> DataFrame:
        """One row a key, merged. Without a schema it is that of the newest batch, of which there must be one."""
        if schema is None:
            schema = StructType.fromJson(self.batches.read(self.batches.last())["schema"])
        return merged(self.rows(schema, upto), self.keys, self.merges).select(*schema.fieldNames())


def merged(rows: DataFrame, keys: Sequence[str], merges: Mapping[str, Merge] | None = None) -> DataFrame:
    """Rows with `batch` as one row a key."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[(merges or {}).get(c, newest)(c).alias(c) for c in others])
