"""Metric definitions, their generation from a profile, and catalog frames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.frames import small_frame
from tallyward.operators.profile import TableProfile
from tallyward.operators.topn import latest_per_key, upsert

# ---- Fixed values: names and phrases that must equal the documented ones --------------------------------
AGGREGATES = ("sum", "mean", "count", "nunique", "max", "min")
MONEY_WORDS = ("revenue", "sales", "income", "amount")
MONEY_SYNONYMS = (
    "revenue", "total revenue", "total sales", "sales total", "overall revenue", "overall sales", "sum of sales",
)
# {words}: lower case, underscores as blanks; {name}: blanks as underscores; {raw}: as it is.
COLUMN_SYNONYMS = {
    "sum": (
        "total {words}", "{words} total", "sum of {words}", "how much {words}", "overall {words}",
        "sum {words}", "total_{name}",
    ),
    "mean": ("average {words}", "avg {words}", "mean {words}", "typical {words}", "{words} average"),
    "max": ("highest {words}", "maximum {words}"),
    "min": ("lowest {words}", "minimum {words}"),
}
COLUMN_METRICS = (
    ("sum", "total_{name}", "Sum of {raw} across all rows."),
    ("mean", "avg_{name}", "Average (mean) of {raw}."),
    ("max", "max_{name}", "Maximum value of {raw}."),
    ("min", "min_{name}", "Minimum value of {raw}."),
)
ROW_COUNT_SYNONYMS = (
    "how many rows", "row count", "number of rows", "how many records", "dataset size", "total rows",
)
UNIQUE_SYNONYMS = ("number of {spaced}", "count of {spaced}", "how many {spaced}", "distinct {raw}")
SUM_BY_SYNONYMS = (
    "{raw} by {group}", "{raw} per {group}", "breakdown of {raw} by {group}", "total {raw} by {group}",
)
MEAN_BY_SYNONYMS = ("average {raw} by {group}", "avg {raw} per {group}", "mean {raw} by {group}")
COUNT_BY_SYNONYMS = ("count by {group}", "number of items per {group}", "distribution of {group}")
ROW_COUNT_TEXT = "Total number of rows in the table."
UNIQUE_TEXT = "Number of unique values in {raw}."
SUM_BY_TEXT = "Sum of {raw} grouped by {group}."
MEAN_BY_TEXT = "Average of {raw} grouped by {group}."
COUNT_BY_TEXT = "Row count grouped by {group}."
ID_NAMES = ("id", "index", "row_id", "pk")
# ---------------------------------------------------------------------------------------------------------

HIGH_CARDINALITY = 5

METRIC_SCHEMA = (
    "name string, synonyms array<string>, description string, `column` string, agg string, groupby string, "
    "base_filters map<string,string>, status string, version int, created_by string, created_at timestamp, "
    "approved_by string, approved_at timestamp, risk string, source string, proposal_id string, ordinal int"
)
VISIBLE_FIELDS = ("name", "synonyms", "description", "column", "agg", "groupby", "base_filters")
BRIEF_FIELDS = ("name", "synonyms", "description")


@dataclass(frozen=True)
class MetricDefinition:
    """One governed metric."""

    name: str
    column: str
    agg: str
    groupby: str | None = None
    synonyms: tuple[str, ...] = ()
    description: str = ""
    base_filters: Mapping[str, object] = field(default_factory=dict)
    status: str = "approved"
    source: str = "auto"


@dataclass(frozen=True)
class JoinPolicy:
    """An approved way to join two registered tables."""

    name: str
    left_table: str
    right_table: str
    left_key: str
    right_key: str
    join_type: str = "inner"
    description: str = ""
    status: str = "draft"

    def __post_init__(self) -> None:
        if self.join_type not in ("inner", "left"):
            raise ValueError("join_type must be inner or left")


def is_id_like(name: str, extra_suffixes: Iterable[str] = ()) -> bool:
    """Is a column an identifier by its name, so that summing it means nothing?"""
    low = name.lower().strip()
    return low in ID_NAMES or low.endswith(("_id", *extra_suffixes))


def _phrases(templates: Iterable[str], column: str, group: str = "") -> tuple[str, ...]:
    values = {
        "raw": column, "name": column.replace(" ", "_"), "group": group,
        "words": column.lower().replace("_", " "), "spaced": column.replace("_", " "),
    }
    return tuple(dict.fromkeys(t.format(**values) for t in templates))


def column_synonyms(column: str, agg: str) -> tuple[str, ...]:
    """Phrases a question may use for one aggregate of one column, in order and without repeats."""
    phrases = _phrases(COLUMN_SYNONYMS.get(agg, ()), column)
    if agg == "sum" and any(word in column.lower() for word in MONEY_WORDS):
        phrases += MONEY_SYNONYMS
    return tuple(dict.fromkeys(phrases))


def generate_metrics(
    profile: TableProfile, strict_ids: bool = False, extra_id_suffixes: Iterable[str] = ()
) -> dict[str, MetricDefinition]:
    """The safe metrics of a table by name, in catalog order; a later metric replaces one of the same name.

    Works on the profile alone, one entry per column, so it is driver work whatever the table's size.
    `strict_ids` uses the narrow identifier rule throughout and leaves identifiers out of the breakdowns.
    """
    metrics: dict[str, MetricDefinition] = {}

    def add(name: str, column: str, agg: str, groupby: str | None, synonyms: tuple[str, ...], text: str) -> None:
        metrics[name] = MetricDefinition(name, column, agg, groupby, synonyms, text)

    suffixes = tuple(extra_id_suffixes)
    identifier = lambda name: is_id_like(name, suffixes)
    for column in profile.numeric:
        if identifier(column):
            continue
        for agg, name, text in COLUMN_METRICS:
            (name,), (text,) = _phrases([name], column), _phrases([text], column)
            add(name, column, agg, None, column_synonyms(column, agg), text)

    add("row_count", "*", "count", None, ROW_COUNT_SYNONYMS, ROW_COUNT_TEXT)

    loose = [c.name for c in profile.columns if (identifier(c.name) if strict_ids else "id" in c.name.lower())]
    varied = [c.name for c in profile.columns if c.is_categorical and c.n_unique > HIGH_CARDINALITY]
    for column in loose + varied:
        (name,), synonyms = _phrases(["unique_{name}"], column), _phrases(UNIQUE_SYNONYMS, column)
        add(name, column, "nunique", None, synonyms, UNIQUE_TEXT.format(raw=column))

    for column in profile.numeric:
        if strict_ids and identifier(column):
            continue
        for group in profile.categorical:
            pair = f"{column.replace(' ', '_')}_by_{group.replace(' ', '_')}"
            add(pair, column, "sum", group, _phrases(SUM_BY_SYNONYMS, column, group), SUM_BY_TEXT.format(raw=column, group=group))
            add(
                f"avg_{pair}", column, "mean", group, _phrases(MEAN_BY_SYNONYMS, column, group),
                MEAN_BY_TEXT.format(raw=column, group=group),
            )
    for group in profile.categorical:
        add(
            f"count_by_{group.replace(' ', '_')}", "*", "count", group, _phrases(COUNT_BY_SYNONYMS, "", group),
            COUNT_BY_TEXT.format(group=group),
        )
    return metrics


def catalog_frame(spark: SparkSession, metrics: Mapping[str, MetricDefinition], created_by: str = "system") -> DataFrame:
    """Definitions as rows of the metric catalog table."""
    rows = [
        {
            "name": m.name, "synonyms": m.synonyms, "description": m.description, "column": m.column, "agg": m.agg,
            "groupby": m.groupby, "base_filters": {k: str(v) for k, v in m.base_filters.items()}, "status": m.status,
            "version": 1, "created_by": created_by, "risk": "low", "source": m.source, "ordinal": i,
        }
        for i, m in enumerate(metrics.values())
    ]
    return small_frame(spark, rows, METRIC_SCHEMA)


def definitions(catalog: DataFrame) -> dict[str, MetricDefinition]:
    """Approved rows as definitions by name, in catalog order. Driver work on catalog-sized data."""
    rows = catalog.where(F.col("status") == "approved").orderBy("ordinal", "name").collect()
    return {
        r["name"]: MetricDefinition(
            r["name"], r["column"], r["agg"], r["groupby"], tuple(r["synonyms"] or ()), r["description"],
            dict(r["base_filters"] or {}), r["status"], r["source"],
        )
        for r in rows
    }


# ---- frames of metrics and proposals ----------------------------------------------------------------------


def approved_only(catalog: DataFrame, brief: bool = False) -> DataFrame:
    """What a planner may see: approved rows, and of those only the visible fields."""
    fields = BRIEF_FIELDS if brief else VISIBLE_FIELDS
    return catalog.where(F.col("status") == "approved").select(*[F.col(f"`{f}`") for f in fields])


def pending_only(proposals: DataFrame) -> DataFrame:
    """Proposals still waiting for a reviewer."""
    return proposals.where(F.col("status") == "pending")


def merge_catalogs(approved: DataFrame, generated: DataFrame) -> DataFrame:
    """Both catalogs as one; on equal names the generated definition wins."""
    ranked = approved.withColumn("_priority", F.lit(1)).unionByName(
        generated.withColumn("_priority", F.lit(0)), allowMissingColumns=True
    )
    return latest_per_key(ranked, ["name"], [F.col("_priority")]).drop("_priority")


def validate_proposals(proposals: DataFrame, columns: DataFrame) -> DataFrame:
    """Adds `valid` and `problem` to proposals (column, agg, groupby), given the table's column names.

    The first failing rule is reported: unknown column, unknown aggregate, unknown group column.
    """
    known = columns.select(F.col("name").alias("_known")).distinct()
    found_column = known.select(F.col("_known").alias("_column"))
    found_group = known.select(F.col("_known").alias("_group"))
    joined = proposals.join(found_column, F.col("column") == F.col("_column"), "left").join(
        found_group, F.col("groupby") == F.col("_group"), "left"
    )
    grouped = F.coalesce(F.col("groupby"), F.lit("")) != ""
    problem = (
        F.when(F.col("_column").isNull(), F.lit("column"))
        .when(~F.coalesce(F.col("agg").isin(*AGGREGATES), F.lit(False)), F.lit("agg"))
        .when(grouped & F.col("_group").isNull(), F.lit("groupby"))
    )
    checked = joined.withColumn("problem", problem).withColumn("valid", F.col("problem").isNull())
    return checked.drop("_column", "_group")


def approve(catalog: DataFrame, proposals: DataFrame, proposal_id: str, reviewer: str, when: Column, note: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(catalog, proposals) after approving a pending metric proposal; raises if it is not pending.

    Looks the proposal up, so this runs a small job; the returned frames are lazy.
    """
    _require_pending(proposals, proposal_id)
    chosen = proposals.where(F.col("proposal_id") == proposal_id)
    position = F.coalesce(F.max("ordinal"), F.lit(-1)) + 1
    metric = chosen.select("metric.*").withColumns(
        {
            "status": F.lit("approved"), "approved_by": F.lit(reviewer), "approved_at": when,
            "proposal_id": F.lit(proposal_id), "source": F.lit("proposed"),
            "ordinal": catalog.agg(position.cast("int")).scalar(),
        }
    )
    return upsert(catalog, metric, ["name"]), review(proposals, proposal_id, "approved", note)


def reject(proposals: DataFrame, proposal_id: str, reason: str) -> DataFrame:
    """Proposals after rejecting a pending one; raises if it is not pending."""
    _require_pending(proposals, proposal_id)
    return review(proposals, proposal_id, "rejected", reason)


def approve_join(policies: DataFrame, proposals: DataFrame, proposal_id: str, reviewer: str, when: Column) -> tuple[DataFrame, DataFrame]:
    """(policies, proposals) after approving a pending join proposal; raises if it is not pending."""
    _require_pending(proposals, proposal_id)
    chosen = proposals.where(F.col("proposal_id") == proposal_id).select("join.*")
    stamped = chosen.withColumns({"status": F.lit("approved"), "approved_by": F.lit(reviewer), "approved_at": when})
    return upsert(policies, stamped, ["name"]), review(proposals, proposal_id, "approved", None)


def review(proposals: DataFrame, proposal_id: str, status: str, note: str | None) -> DataFrame:
    """Proposals with the outcome of one review written in."""
    hit = F.col("proposal_id") == proposal_id
    return proposals.withColumns(
        {
            "status": F.when(hit, F.lit(status)).otherwise(F.col("status")),
            "review_note": F.when(hit, F.lit(note).cast("string")).otherwise(F.col("review_note")),
        }
    )


def _require_pending(proposals: DataFrame, proposal_id: str) -> None:
    if pending_only(proposals).where(F.col("proposal_id") == proposal_id).isEmpty():
        raise ValueError("no pending proposal with this id")


def status_counts(catalog: DataFrame, keys: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Approved and pending metrics per tenant; the names stay rows, see `approved_only`."""
    return catalog.groupBy(*keys).agg(
        F.count_if(F.col("status") == "approved").alias("approved_count"),
        F.count_if(F.col("status") == "pending").alias("pending_count"),
    )

