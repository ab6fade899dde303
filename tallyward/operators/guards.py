"""Preconditions and caps enforced around the operators."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyward.errors import ResourceLimitError, TenantContextError

# Default limits.
MAX_ROWS_PER_QUERY = 100_000
MAX_PLAN_STEPS = 3
QUERY_TIMEOUT_SECONDS = 30
MAX_INPUT_MB = 50

R = TypeVar("R")


def is_numeric_type(data_type: T.DataType) -> bool:
    """Numbers, and booleans, which the profile counts as numbers."""
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def identifier(name: str) -> str:
    """A column name as SQL text, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(text: str) -> str:
    """A string as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column_ref(name: str) -> Column:
    """A column by its literal name."""
    return F.col(identifier(name))


# Expressions over many columns are put together as SQL text: one call builds what would take a dozen per column.


def number_sql(df: DataFrame, name: str) -> str:
    """A numeric column ready for arithmetic: booleans become 0/1, NaN becomes null."""
    column, data_type = identifier(name), df.schema[name].dataType
    if isinstance(data_type, T.BooleanType):
        return f"CAST({column} AS INT)"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return f"nanvl({column}, CAST(NULL AS {data_type.simpleString()}))"
    return column


def additive_sql(df: DataFrame, name: str) -> str:
    """A numeric column ready to be summed: integers become doubles, as their sum over a huge table overflows."""
    whole = isinstance(df.schema[name].dataType, (T.IntegralType, T.BooleanType))
    return f"CAST({number_sql(df, name)} AS DOUBLE)" if whole else number_sql(df, name)


def value_sql(df: DataFrame, name: str) -> str:
    """A column with NaN as null if it is numeric, else as it is."""
    return number_sql(df, name) if is_numeric_type(df.schema[name].dataType) else identifier(name)


def number(df: DataFrame, name: str) -> Column:
    """`number_sql` as a column."""
    return F.expr(number_sql(df, name))


def additive(df: DataFrame, name: str) -> Column:
    """`additive_sql` as a column."""
    return F.expr(additive_sql(df, name))


def inline_rows(rows: Sequence[Mapping[str, str]]) -> Column:
    """One output row per entry; each maps field names, which are plain words, to SQL text."""
    structs = ("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in row.items()) + ")" for row in rows)
    return F.expr("inline(array(" + ", ".join(structs) + "))")


def one_row_each(df: DataFrame, rows: Sequence[Mapping[str, str]]) -> DataFrame:
    """Aggregate `df` once and turn the result into one row per entry, each of aggregate SQL text."""
    names = [{k: f"v{i}_{k}" for k in row} for i, row in enumerate(rows)]
    aggregates = [F.expr(f"{sql} AS {names[i][k]}") for i, row in enumerate(rows) for k, sql in row.items()]
    return df.agg(*aggregates).select(inline_rows(names))


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Raise ValueError naming the available columns when one is missing."""
    for name in names:
        if name not in df.columns:
            raise ValueError(f"no column {name!r}; available: {sorted(df.columns)}")


def require_numeric(df: DataFrame, names: Sequence[str]) -> None:
    """Raise ValueError unless every column exists and is numeric."""
    require_columns(df, names)
    for name in names:
        if not is_numeric_type(df.schema[name].dataType):
            raise ValueError(f"column {name!r} is not numeric")


def allowed_filters(filters: Mapping[str, object] | None, allowlist: Sequence[str]) -> dict[str, object]:
    """Keep only the filters on allowed columns."""
    allowed = set(allowlist)
    return {key: value for key, value in (filters or {}).items() if key in allowed}


def require_tenant(tenant_id: str | None) -> str:
    """The trimmed tenant id; raises rather than fall back to all tenants."""
    tenant = str(tenant_id).strip() if tenant_id else ""
    if not tenant:
        raise TenantContextError("a tenant id is required")
    return tenant


def tenant_scope(df: DataFrame, tenant_id: str | None, column: str = "tenant_id") -> DataFrame:
    """Only the rows of one tenant. On a table partitioned by tenant this prunes to its folder."""
    return df.where(column_ref(column) == F.lit(require_tenant(tenant_id)))


def cap_rows(df: DataFrame, max_rows: int | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """The first `max_rows` rows with a `truncated` flag; a cap of zero or less means no cap.

    Reads one row more than the cap to learn whether anything was cut, never the full count. Give `order` when
    the kept rows must be the same on every run.
    """
    cap = MAX_ROWS_PER_QUERY if max_rows is None else max_rows
    if cap <= 0:
        return df.withColumn("truncated", F.lit(False))
    probe = (df.orderBy(*order) if order else df).limit(cap + 1)
    # The window sees at most cap + 1 rows, so one task holds them; a second scan to count is not needed.
    flagged = probe.withColumn("truncated", F.count("*").over(Window.partitionBy()) > cap)
    return (flagged.orderBy(*order) if order else flagged).limit(cap)


def original_rows(df: DataFrame) -> DataFrame:
    """Exact row count of the uncapped result; a pass of its own, so only on request."""
    return df.agg(F.count("*").alias("original_rows"))


def cap_steps(steps: Sequence[R], max_steps: int | None = None) -> list[R]:
    """The first steps of a plan, up to the limit."""
    return list(steps[: MAX_PLAN_STEPS if max_steps is None else max_steps])


def check_input_size(spark: SparkSession, path: str, max_mb: float = MAX_INPUT_MB) -> int:
    """Total size of the files under a path; raises when above the limit. Reads no file content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if size > max_mb * 1024 * 1024:
        raise ResourceLimitError(f"input of {size / 1048576:.1f} MB is over the limit of {max_mb} MB")
    return size


def run_with_timeout(spark: SparkSession, action: Callable[[], R], seconds: float | None = None) -> R:
    """Run an action and cancel its Spark jobs when it takes too long."""
    limit = QUERY_TIMEOUT_SECONDS if seconds is None else seconds
    if limit <= 0:
        return action()
    # A tag of the context, not of the session: the session's tags are known only to the thread that set them.
    context, tag = spark.sparkContext, f"limit-{uuid.uuid4().hex}"
    expired, done = threading.Event(), threading.Event()

    def watch() -> None:
        if done.wait(limit):
            return
        expired.set()
        # Again and again, as the action may be planning its next job at the moment of a cancel.
        while not done.wait(0.1):
            context.cancelJobsWithTag(tag)

    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        return action()
    except Exception as error:
        if expired.is_set():
            raise ResourceLimitError(f"query took longer than {limit} s") from error
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
