"""Steps: what a plan may run, checked against the catalog, then run as lazy frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyward.dataset import Dataset
from tallyward.frames import small_frame
from tallyward.operators import stats, verify
from tallyward.operators.guards import allowed_filters, cap_rows, cap_steps, column_ref, run_with_timeout
from tallyward.operators.limits import TenantLimits
from tallyward.operators.masking import scrub_result
from tallyward.operators.metrics import equality_filter, merge_filters, run_metric
from tallyward.plans.catalog import JoinPolicy, MetricDefinition
from tallyward.sources.registry import DatasetRegistry

RUN_METRIC, RUN_STATS = "run_metric", "run_stats"


@dataclass(frozen=True)
class Step:
    """One step of a plan."""

    target: str
    action: str = RUN_METRIC
    filters: Mapping[str, object] = field(default_factory=dict)
    args: Mapping[str, object] = field(default_factory=dict)
    join_policy: str | None = None


class RefusedPlan(ValueError):
    """A step is outside the allowlist, so nothing of the plan is run."""


@dataclass(frozen=True)
class CheckedSteps:
    """What of a plan is run, and what of it is left out: steps beyond the limit, and filters outside the allowlist by step."""

    steps: tuple[Step, ...]
    left_out: tuple[Step, ...] = ()
    dropped_filters: tuple[tuple[str, ...], ...] = ()


def check_steps(
    steps: Sequence[Step],
    metrics: Mapping[str, MetricDefinition],
    policies: Mapping[str, JoinPolicy],
    filter_columns: Sequence[str],
    max_steps: int | None = None,
) -> CheckedSteps:
    """The steps to run, filters reduced to allowed columns; raises RefusedPlan if any step is not allowed.

    An unknown action counts as a metric run. Every step is checked, also those beyond the step limit. What is
    not run, or not filtered by, is named in the result.
    """
    checked, dropped = [], []
    for step in steps:
        action = step.action if step.action in (RUN_METRIC, RUN_STATS) else RUN_METRIC
        if action == RUN_METRIC and step.target not in metrics:
            raise RefusedPlan(f"metric {step.target!r} is not in the catalog")
        if action == RUN_STATS and step.target not in stats.TOOLS:
            raise RefusedPlan(f"tool {step.target!r} is not allowed")
        if step.join_policy and (step.join_policy not in policies or policies[step.join_policy].status != "approved"):
            raise RefusedPlan(f"join policy {step.join_policy!r} is not approved")
        allowed = allowed_filters(step.filters, filter_columns)
        dropped.append(tuple(k for k in step.filters if k not in allowed))
        checked.append(replace(step, action=action, filters=allowed))
    kept = cap_steps(checked, max_steps)
    return CheckedSteps(tuple(kept), tuple(checked[len(kept) :]), tuple(dropped[: len(kept)]))


def validate_step_table(steps: DataFrame, metrics: DataFrame, tools: DataFrame, policies: DataFrame, plan_col: str = "plan_id") -> DataFrame:
    """(plan, steps, ok) for a table of steps (plan, action, target, join_policy).

    `metrics`, `tools` and `policies` hold the allowed names in column `name`. A plan is ok if all its steps are.
    """
    allowed = (
        metrics.select(F.lit(RUN_METRIC).alias("_action"), F.col("name").alias("_target"))
        .unionByName(tools.select(F.lit(RUN_STATS).alias("_action"), F.col("name").alias("_target")))
        .distinct()
    )
    approved = policies.select(F.col("name").alias("_policy")).distinct()
    action = F.when(F.col("action") == RUN_STATS, RUN_STATS).otherwise(RUN_METRIC)
    known = steps.withColumn("_a", action).join(
        allowed, (F.col("_a") == F.col("_action")) & (F.col("target") == F.col("_target")), "left"
    ).join(approved, F.col("join_policy") == F.col("_policy"), "left")
    no_join = F.coalesce(F.col("join_policy"), F.lit("")) == ""
    fine = F.col("_target").isNotNull() & (no_join | F.col("_policy").isNotNull())
    return known.groupBy(plan_col).agg(F.count("*").alias("steps"), F.bool_and(fine).alias("ok"))


def step_source(
    dataset: Dataset,
    step: Step,
    registry: DatasetRegistry | None = None,
    policies: Mapping[str, JoinPolicy] | None = None,
) -> Dataset:
    """The table a step runs on: the dataset, or the joined view of its policy, masked as every loaded table is."""
    if not step.join_policy:
        return dataset
    if registry is None or not policies or step.join_policy not in policies:
        raise RefusedPlan(f"join policy {step.join_policy!r} is not approved")
    return Dataset.from_frame(registry.joined_view(policies[step.join_policy]), f"joined_{step.join_policy}")


def _run(target: Dataset, step: Step, metrics: Mapping[str, MetricDefinition]) -> DataFrame:
    if step.action == RUN_STATS:
        return stats.run_tool(target.df, step.target, step.args)
    if step.target not in metrics:
        raise RefusedPlan(f"metric {step.target!r} is not in the catalog")
    return run_metric(target.df, metrics[step.target], step.filters)


def run_step(
    dataset: Dataset,
    step: Step,
    metrics: Mapping[str, MetricDefinition] | None = None,
    registry: DatasetRegistry | None = None,
    policies: Mapping[str, JoinPolicy] | None = None,
) -> DataFrame:
    """The lazy result of one checked step; on a join policy it runs over the joined, masked view and its own metrics."""
    target = step_source(dataset, step, registry, policies)
    known = target.metrics if step.action != RUN_STATS and (step.join_policy or metrics is None) else metrics or {}
    return _run(target, step, known)


def expected_total(target: Dataset, step: Step, metrics: Mapping[str, MetricDefinition]) -> DataFrame | None:
    """One row (expected_total) for steps whose parts must add up, worked out from the table by itself, else None."""
    if step.action == RUN_METRIC:
        metric = metrics[step.target]
        if metric.agg != "sum" or not metric.groupby:
            return None
        return verify.source_total(equality_filter(target.df, merge_filters(metric.base_filters, step.filters)), metric.column)
    args = step.args
    if step.target == "group_compare" and args.get("agg", "sum") == "sum":
        return verify.source_total(target.df, args["value_col"])
    if step.target == "trend":
        return verify.source_total(target.df.where(column_ref(args["date_col"]).isNotNull()), args["value_col"])
    return None


Sink = Callable[[int, Step, DataFrame], object]


@dataclass(frozen=True)
class Delivery:
    """What the sink made of each result, in order, and the checks on exactly the rows it was given: a row per step, with `rows` and
    `fingerprint` of the result."""

    results: tuple[object, ...]
    checks: DataFrame


@dataclass(frozen=True)
class _Part:
    """A step's result before scrubbing, with what its check needs."""

    step: Step
    result: DataFrame
    target: Dataset
    total: DataFrame | None
    notes: str


@dataclass(frozen=True)
class PlanRun:
    """A plan's lazy results in order, one row of checks per step, and what was left out.

    `checks` is lazy as well, and runs the results once more, for a look at them before they are handed out. `deliver` hands them
    out and takes the checks from the rows on their way.
    """

    results: tuple[tuple[Step, DataFrame], ...]
    checks: DataFrame
    left_out: tuple[Step, ...]
    plan_type: str = "stats_tool"
    parts: tuple[_Part, ...] = ()
    seconds: float = 0

    def deliver(self, sink: Sink) -> Delivery:
        """Give each result to `sink(number, step, frame)`, which runs it by one action, such as a write or a collect.

        Sums, counts and the fingerprint are observed while that action runs, so that they are of the rows as delivered, and no
        result is run twice. The table's rows and total are counted from the table by themselves. Under a tenant's limits a step
        that takes too long is cancelled and raises.
        """
        made, rows = [], []
        for number, part in enumerate(self.parts):
            numbers, whole = Observation(), Observation()
            observed = part.result.observe(numbers, *_measures(part.result, part.total is not None))
            delivered = scrub_result(observed)
            frame = delivered.observe(whole, *verify.fingerprint(delivered))
            made.append(run_with_timeout(frame.sparkSession, partial(sink, number, part.step, frame), self.seconds))
            table = part.target.df.agg(F.count("*").alias("n")).first()["n"]
            total = None if part.total is None else part.total.first()[0]
            seen = numbers.get | whole.get
            rows.append({
                "step": number, "target": part.step.target, "plan_type": self.plan_type, "value": seen["value"], "source_rows": table,
                "breakdown_sum": seen["breakdown_sum"], "expected_total": total, "truncated": bool(seen["truncated"]), "rows": seen["rows"],
                "fingerprint": seen["fingerprint"],
                "lineage": {"metrics_or_tools_used": [part.step.target], "filters_applied": {k: str(v) for k, v in part.step.filters.items()}, "notes": part.notes},
            })
        checks = small_frame(self.checks.sparkSession, rows, f"{CHECKS}, rows bigint, fingerprint string")
        return Delivery(tuple(made), verify.with_confidence(verify.result_flags(checks)))


def _measures(delivered: DataFrame, has_total: bool) -> list[Column]:
    """The scalar value, the sum of the parts and the cut of a result, as aggregates of its rows."""
    scalar = "value" in delivered.columns and "key" not in delivered.columns and "period" not in delivered.columns
    # Whether the scalar is a number is known from its type; a sum of parts is only asked for where a total is.
    value = F.max(F.col("value").cast("double")) if scalar and not has_total else F.max(F.lit(None).cast("double"))
    parts = F.sum(F.col("value").cast("double")) if has_total else F.max(F.lit(None).cast("double"))
    return [value.alias("value"), parts.alias("breakdown_sum"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated")]


def step_check(number: int, step: Step, delivered: DataFrame, target: Dataset, total: DataFrame | None, plan_type: str, notes: str) -> DataFrame:
    """One row about a delivered result: its scalar value, whether it was cut, the sum of its parts next to the total
    of the table, the table's rows, and the lineage."""
    row = delivered.agg(*_measures(delivered, total is not None))
    row = row.withColumns({
        "step": F.lit(number), "target": F.lit(step.target), "plan_type": F.lit(plan_type),
        "source_rows": target.df.agg(F.count("*")).scalar(),
        "expected_total": F.lit(None).cast("double") if total is None else total.scalar(),
    })
    lineage = verify.with_lineage(row, [step.target], step.filters, notes)
    return lineage.select("step", "target", "plan_type", "value", "source_rows", "breakdown_sum", "expected_total", "truncated", "lineage")


def run_plan(
    dataset: Dataset,
    steps: Sequence[Step],
    metrics: Mapping[str, MetricDefinition] | None = None,
    registry: DatasetRegistry | None = None,
    policies: Mapping[str, JoinPolicy] | None = None,
    max_steps: int | None = None,
    max_rows: int | None = None,
    limits: TenantLimits | None = None,
) -> PlanRun:
    """Check a whole plan, then give each step's lazy result, capped and scrubbed, and the checks on all of them.

    A single bad step refuses the plan. A result has a `truncated` column that tells whether the row cap cut it.
    `checks` has a row per step with the flags, the confidence that follows from them and the lineage; a
    breakdown is held against a total of its own, so a result that lost a part is flagged. `limits`, a tenant's own, give the
    steps, the rows and the seconds of a step where these are not named.
    """
    if limits is not None:
        max_steps = limits.max_plan_steps if max_steps is None else max_steps
        max_rows = limits.max_rows_per_query if max_rows is None else max_rows
    known = dataset.metrics if metrics is None else metrics
    plan = check_steps(steps, known, policies or {}, dataset.profile.filterable, max_steps)
    plan_type = "multi_step" if len(plan.steps) > 1 else "single_metric" if plan.steps and plan.steps[0].action == RUN_METRIC else "stats_tool"
    parts, checks = [], []
    for number, (step, dropped) in enumerate(zip(plan.steps, plan.dropped_filters)):
        target = step_source(dataset, step, registry, policies)
        own = target.metrics if step.action == RUN_METRIC and step.join_policy else known
        result = _run(target, step, own)
        delivered = cap_rows(result, max_rows, result_order(result))
        notes = f"filters not allowed: {', '.join(dropped)}" if dropped else ""
        parts.append(_Part(step, delivered, target, expected_total(target, step, own), notes))
        checks.append(step_check(number, step, delivered, target, parts[-1].total, plan_type, notes))
    every = reduce(DataFrame.unionByName, checks) if checks else dataset.df.sparkSession.createDataFrame([], CHECKS)
    results = tuple((part.step, scrub_result(part.result)) for part in parts)
    return PlanRun(results, verify.with_confidence(verify.result_flags(every)), plan.left_out, plan_type, tuple(parts), limits.query_timeout_seconds if limits else 0)


CHECKS = (
    "step int, target string, plan_type string, value double, source_rows bigint, breakdown_sum double, expected_total double, "
    "truncated boolean, lineage struct<metrics_or_tools_used:array<string>,filters_applied:map<string,string>,notes:string>"
)


def result_order(result: DataFrame) -> list:
    """The order in which a result's rows are kept when it is cut: breakdowns by value, series by period, others as they come."""
    if "period" in result.columns:
        return [F.col("period")]
    if {"key", "value"} <= set(result.columns):
        return [F.desc_nulls_last("value"), F.asc_nulls_last("key")]
    return []
