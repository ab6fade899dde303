"""Table profile: counts per column, and the roles the metric catalog is generated from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.frames import small_frame
from tallyward.operators.topn import first_per_key
from tallyward.operators.guards import (
    column_ref,
    identifier,
    inline_rows,
    number_sql,
    one_row_each,
    require_columns,
    text_literal,
    value_sql,
)

# Role thresholds.
CATEGORY_CEILING = 50
CATEGORY_FLOOR = 10
ROWS_PER_CATEGORY = 20
FILTERABLE_CEILING = 30
LIVE_SAMPLE_ROWS = 500
EXAMPLES_PER_COLUMN = 3
SAMPLE_ROWS = 5

NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
# Longer text is compared by digest, so that counting distinct texts does not shuffle the texts.
LONG_TEXT = 64


@dataclass(frozen=True)
class ColumnProfile:
    """What is known about one column."""

    name: str
    dtype: str
    n_unique: int
    n_null: int
    is_numeric: bool
    is_temporal: bool
    is_categorical: bool
    is_filterable: bool
    examples: tuple = ()


@dataclass(frozen=True)
class TableProfile:
    """Driver-side profile of one table; one entry per column."""

    name: str
    n_rows: int
    columns: tuple[ColumnProfile, ...]
    sample_rows: tuple[dict, ...] = field(default=())
    distinct: str = "exact"

    @property
    def n_cols(self) -> int:
        return len(self.columns)

    @property
    def numeric(self) -> list[str]:
        return [c.name for c in self.columns if c.is_numeric]

    @property
    def temporal(self) -> list[str]:
        return [c.name for c in self.columns if c.is_temporal]

    @property
    def categorical(self) -> list[str]:
        return [c.name for c in self.columns if c.is_categorical]

    @property
    def filterable(self) -> list[str]:
        return [c.name for c in self.columns if c.is_filterable]

    def column(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.name == name)


# ---- counts ---------------------------------------------------------------------------------------------


def value_cell(df: DataFrame, name: str) -> dict[str, str]:
    """A column's value in the slot of its type, ready to be counted across columns."""
    data_type, column = df.schema[name].dataType, identifier(name)
    whole, fraction, text = "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS STRING)"
    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        whole = f"CAST({column} AS BIGINT)"
    elif isinstance(data_type, T.DateType):
        whole = f"CAST(unix_date({column}) AS BIGINT)"
    elif isinstance(data_type, T.TimestampType):
        whole = f"unix_micros({column})"
    elif isinstance(data_type, (T.FloatType, T.DoubleType)):
        fraction = f"CAST({number_sql(df, name)} AS DOUBLE)"
    else:
        text = f"to_json({column})" if isinstance(data_type, NESTED) else f"CAST({column} AS STRING)"
        text = f"CASE WHEN length({text}) > {LONG_TEXT} THEN sha2({text}, 256) ELSE {text} END"
    return {"whole": whole, "fraction": fraction, "text": text}


def column_counts(df: DataFrame, columns: Sequence[str] | None = None, distinct: str = "exact") -> DataFrame:
    """(ordinal, name, dtype, n_rows, n_unique, n_null), one row per column.

    `distinct`: "exact" counts (column, value) pairs in one scan, pre-aggregated before the shuffle and spread
    over all tasks by value, so no column is counted in one task. "approx" uses a sketch per column, one scan
    that shuffles one row per task; every column is then an estimate. The caller chooses, never the size.
    """
    names = list(df.columns if columns is None else columns)
    require_columns(df, names)
    if distinct not in ("exact", "approx"):
        raise ValueError("distinct must be exact or approx")
    counts = _exact_counts(df, list(enumerate(names))) if distinct == "exact" else _sketched_counts(df, names)
    label = lambda values: F.expr(f"get(array({', '.join(map(text_literal, values))}), ordinal)")
    return counts.select(
        "ordinal", label(names).alias("name"), label([df.schema[c].dataType.simpleString() for c in names]).alias("dtype"),
        "n_rows", "n_unique", "n_null",
    )


def _exact_counts(df: DataFrame, places: Sequence[tuple[int, str]]) -> DataFrame:
    cells = df.select(inline_rows([{"ordinal": str(i), **value_cell(df, c)} for i, c in places]))
    per_value = cells.groupBy("ordinal", "whole", "fraction", "text").agg(F.count("*").alias("n"))
    # A row that counts nothing for each column, so that an empty table still has its columns.
    schema = "ordinal int, whole bigint, fraction double, text string, n bigint"
    nothing = small_frame(df.sparkSession, [{"ordinal": i, "n": 0} for i, _ in places], schema)
    missing = F.col("whole").isNull() & F.col("fraction").isNull() & F.col("text").isNull()
    return per_value.unionByName(nothing).groupBy("ordinal").agg(
        F.sum("n").alias("n_rows"),
        F.count_if(~missing).alias("n_unique"),
        F.sum(F.when(missing, F.col("n")).otherwise(F.lit(0))).cast("bigint").alias("n_null"),
    )


def _sketched_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = []
    for i, name in enumerate(names):
        value = value_sql(df, name)
        if isinstance(df.schema[name].dataType, NESTED):
            value = f"xxhash64(to_json({value}))"
        counts = {"n_rows": "count(*)", "n_unique": f"approx_count_distinct({value})", "n_null": f"count(*) - count({value})"}
        rows.append({"ordinal": f"any_value({i})", **counts})
    return one_row_each(df, rows)


# ---- roles ----------------------------------------------------------------------------------------------


def with_roles(counts: DataFrame) -> DataFrame:
    """Role flags as expressions over the counts."""
    numeric_names = "^(tinyint|smallint|int|bigint|float|double|boolean|decimal.*)$"
    ceiling = F.least(
        F.lit(CATEGORY_CEILING), F.greatest(F.lit(CATEGORY_FLOOR), F.floor(F.col("n_rows") / ROWS_PER_CATEGORY))
    )
    flagged = (
        counts.withColumn("is_numeric", F.col("dtype").rlike(numeric_names))
        .withColumn("is_temporal", F.col("dtype").rlike("^(date|timestamp.*)$") | F.lower("name").contains("date"))
        .withColumn("is_categorical", ~F.col("is_numeric") & (F.col("n_unique") <= ceiling))
    )
    few = (F.col("n_unique") > 0) & (F.col("n_unique") <= FILTERABLE_CEILING)
    return flagged.withColumn("is_filterable", F.col("is_categorical") | F.col("is_temporal") | few)


def profile_frame(
    df: DataFrame, distinct: str = "exact", sample: int | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """The profile as a frame, one row per column. Exact over all rows unless told otherwise."""
    source = df if sample is None else df.limit(sample)
    return with_roles(column_counts(source, columns, distinct))


def column_list(df: DataFrame) -> DataFrame:
    """(ordinal, name, dtype) from the schema alone."""
    rows = [{"ordinal": i, "name": f.name, "dtype": f.dataType.simpleString()} for i, f in enumerate(df.schema.fields)]
    return small_frame(df.sparkSession, rows, "ordinal int, name string, dtype string")


def table_summary(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def filterable_columns(profile: DataFrame) -> DataFrame:
    """Names of the columns users may filter on."""
    return profile.where("is_filterable").select("ordinal", "name")


def example_values(df: DataFrame, categorical: Sequence[str] = (), per_column: int = EXAMPLES_PER_COLUMN) -> DataFrame:
    """(ordinal, name, examples): values of each column as text, the same on every run.

    Categorical columns give their most frequent values; these are few and are counted before the shuffle. Of
    the others, which may all differ, the smallest and the largest value are shown.
    """
    def text(name: str) -> str:
        nested = isinstance(df.schema[name].dataType, NESTED)
        return f"to_json({identifier(name)})" if nested else f"CAST({identifier(name)} AS STRING)"

    def ends(name: str) -> str:
        value = text(name) if isinstance(df.schema[name].dataType, NESTED) else identifier(name)
        both = f"array_distinct(array(min({value}), max({value})))"
        return f"transform(filter({both}, x -> x IS NOT NULL), x -> CAST(x AS STRING))"

    few = set(categorical)
    require_columns(df, list(few))
    parts = []
    rest = [(i, c) for i, c in enumerate(df.columns) if c not in few]
    if rest:
        parts.append(one_row_each(df, [
            {"ordinal": f"any_value({i})", "name": f"any_value({text_literal(c)})", "examples": ends(c)} for i, c in rest
        ]))
    if few:
        places = [(i, c) for i, c in enumerate(df.columns) if c in few]
        cells = df.select(inline_rows([{"ordinal": str(i), "name": text_literal(c), "value": text(c)} for i, c in places]))
        counted = cells.groupBy("ordinal", "name", "value").agg(F.count("value").alias("n"))
        best = first_per_key(counted, ["ordinal", "name"], [F.desc("n"), F.asc_nulls_last("value")], per_column)
        listed = best.groupBy("ordinal", "name").agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("v"))
        parts.append(listed.select("ordinal", "name", F.filter("v.value", lambda x: x.isNotNull()).alias("examples")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def sample_rows(df: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """A few rows with every value that is not a plain scalar turned into text."""
    scalar = (T.NumericType, T.BooleanType, T.StringType)
    keep = [column_ref(c) if isinstance(df.schema[c].dataType, scalar) else _as_text(df, c).alias(c) for c in df.columns]
    return df.limit(n).select(*keep)


def _as_text(df: DataFrame, name: str) -> Column:
    nested = isinstance(df.schema[name].dataType, NESTED)
    return F.to_json(column_ref(name)) if nested else column_ref(name).cast("string")


def build_profile(
    df: DataFrame, name: str = "data", distinct: str = "exact", sample: int | None = None, with_examples: bool = False
) -> TableProfile:
    """Run the profile and bring its one row per column to the driver.

    With distinct="approx" the distinct counts, and the roles that follow from them, are estimates; the profile
    says so in `distinct`.
    """
    rows = profile_frame(df, distinct, sample).orderBy("ordinal").collect()
    examples, samples = {}, ()
    if with_examples:
        source = df if sample is None else df.limit(sample)
        found = example_values(source, [r["name"] for r in rows if r["is_categorical"]])
        examples = {r["name"]: tuple(r["examples"]) for r in found.collect()}
        samples = tuple(r.asDict() for r in sample_rows(df).collect())
    columns = tuple(
        ColumnProfile(
            r["name"], r["dtype"], r["n_unique"], r["n_null"], r["is_numeric"], r["is_temporal"],
            r["is_categorical"], r["is_filterable"], examples.get(r["name"], ()),
        )
        for r in rows
    )
    return TableProfile(name, rows[0]["n_rows"] if rows else 0, columns, samples, distinct)
