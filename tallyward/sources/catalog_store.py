"""The versioned catalog: every save is a new immutable version of a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.frames import struct_fields
from tallyward.operators.guards import require_tenant
from tallyward.plans import catalog as plans
from tallyward.plans.catalog import METRIC_SCHEMA
from tallyward.sources.commits import CommitLog, discard

JOIN_SCHEMA = (
    "name string, left_table string, right_table string, left_key string, right_key string, join_type string, "
    "description string, status string, version int, created_by string, created_at timestamp, approved_by string, "
    "approved_at timestamp, source string"
)
PROPOSAL_SCHEMA = (
    "proposal_id string, metric struct<{fields}>, question string, reason string, proposed_by string, "
    "proposed_at timestamp, status string, review_note string"
)
VERSION_SCHEMA = "version int, timestamp timestamp, count bigint, note string"


METRIC_PROPOSALS = PROPOSAL_SCHEMA.format(fields=struct_fields(METRIC_SCHEMA))
JOIN_PROPOSALS = PROPOSAL_SCHEMA.format(fields=struct_fields(JOIN_SCHEMA)).replace("metric struct", "join struct")

KINDS = {
    "metrics": METRIC_SCHEMA, "joins": JOIN_SCHEMA, "metric_proposals": METRIC_PROPOSALS, "join_proposals": JOIN_PROPOSALS,
}


class CatalogStore:
    """Catalog tables of one tenant under a shared root.

    A version is a folder of rows and a commit that names it. The commit comes last and can be made once for each number, so a
    save that dies half-way is never seen, and of two writers at the same time each gets a version of its own: the one that comes
    second makes its change again, on top of the first one's.
    """

    def __init__(self, spark: SparkSession, root: str, tenant_id: str = "default") -> None:
        self.spark = spark
        self.root = f"{root.rstrip('/')}/{require_tenant(tenant_id)}"

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _log(self, kind: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.root}/{kind}_versions")

    def versions(self, kind: str = "metrics") -> DataFrame:
        """(version, timestamp, count, note, label), newest first; the label is the version as v001."""
        log = self._log(kind)
        rows = self.spark.read.schema(VERSION_SCHEMA).json(log.folder) if log.last() else self._empty(VERSION_SCHEMA)
        return rows.withColumn("label", F.format_string("v%03d", "version")).orderBy(F.desc("version"))

    def latest_version(self, kind: str = "metrics") -> int:
        """Number of the newest version, 0 when there is none."""
        return self._log(kind).last() or 0

    def load(self, kind: str = "metrics", version: int | None = None) -> DataFrame:
        """A version of a table, the newest unless told otherwise; empty when there is none."""
        wanted = self.latest_version(kind) if version is None else version
        if wanted == 0:
            return self._empty(KINDS[kind])
        found = self._log(kind).read(wanted)
        if found is None:
            raise ValueError(f"no version {wanted} of {kind}")
        return self.spark.read.schema(KINDS[kind]).parquet(f"{self.root}/{kind}/{found['folder']}")

    def save(self, rows: DataFrame, kind: str = "metrics", note: str | None = None, now: Column | None = None) -> int:
        """Write the next version, whatever the one before holds, and return its number. Earlier versions stay as they are."""
        content = self._written(rows, kind, note, now)
        while True:
            version = self.latest_version(kind) + 1
            if self._log(kind).put(version, {"version": version, **content}):
                return version

    def update(
        self, change: Callable[[DataFrame], DataFrame], kind: str = "metrics", note: str | None = None, now: Column | None = None
    ) -> int:
        """Write the next version as a change of the one before and return its number.

        If another writer takes the number meanwhile, the change is made again on what that one wrote, so that neither is lost.
        """
        while True:
            version = self.latest_version(kind) + 1
            content = self._written(change(self.load(kind, version - 1)), kind, note, now)
            if self._log(kind).put(version, {"version": version, **content}):
                return version
            discard(self.spark, f"{self.root}/{kind}/{content['folder']}")

    def _written(self, rows: DataFrame, kind: str, note: str | None, now: Column | None) -> dict:
        folder = uuid.uuid4().hex
        path = f"{self.root}/{kind}/{folder}"
        rows.write.parquet(path)
        written = self.spark.read.schema(KINDS[kind]).parquet(path)
        time = F.current_timestamp() if now is None else now.cast("timestamp")
        meta = written.agg(F.count("*").alias("count")).select("count", F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("time")).first()
        return {"folder": folder, "timestamp": meta["time"], "count": meta["count"], "note": note}

    # ---- catalog life cycle -------------------------------------------------------------------------------

    def seed(self, generated: DataFrame) -> int:
        """Save generated metrics as the first version; 0 and nothing written when the catalog has content."""

        def first(current: DataFrame) -> DataFrame:
            if not current.isEmpty():
                raise _Seeded
            return generated

        try:
            self.update(first, "metrics", "auto-seed from datasource")
        except _Seeded:
            return 0
        return self.load("metrics").count()

    def propose(self, proposals: DataFrame, kind: str = "metric") -> int:
        """Add pending proposals."""
        pending = proposals.withColumns({"status": F.lit("pending"), "review_note": F.lit(None).cast("string")})
        return self.update(lambda current: current.unionByName(pending), f"{kind}_proposals", "proposed")

    def approve(self, proposal_id: str, reviewer: str, note: str | None = None) -> None:
        """Approve a pending metric proposal into a new catalog version."""
        now, label = F.current_timestamp(), f"approved {proposal_id}"
        changed = lambda metrics, proposals: plans.approve(metrics, proposals, proposal_id, reviewer, now, note)
        # The catalog goes first: if the second write is lost, the proposal is pending and can be approved again.
        self.update(lambda current: changed(current, self.load("metric_proposals"))[0], "metrics", label)
        self.update(lambda current: changed(self.load("metrics"), current)[1], "metric_proposals", label)

    def reject(self, proposal_id: str, reason: str) -> None:
        """Reject a pending metric proposal."""
        self.update(lambda current: plans.reject(current, proposal_id, reason), "metric_proposals", f"rejected {proposal_id}")

    def approve_join(self, proposal_id: str, reviewer: str) -> None:
        """Approve a pending join proposal."""
        label = f"approved {proposal_id}"
        changed = lambda joins, proposals: plans.approve_join(joins, proposals, proposal_id, reviewer, F.current_timestamp())
        self.update(lambda current: changed(current, self.load("join_proposals"))[0], "joins", label)
        self.update(lambda current: changed(self.load("joins"), current)[1], "join_proposals", label)

    def reject_join(self, proposal_id: str, reason: str) -> None:
        """Reject a pending join proposal."""
        self.update(lambda current: plans.reject(current, proposal_id, reason), "join_proposals", f"rejected {proposal_id}")


class _Seeded(Exception):
    """The catalog has content."""
