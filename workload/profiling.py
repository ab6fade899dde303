"""Scans, profiles and catalog generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators import guards, profile, verify
from tallyward.plans import catalog
from tallyward.sources.files import read_parquet
from workload.inputs import oracle, table

# Column names and types as the profile reports them.
COLUMNS = {
    "orders": {
        "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    },
    "events": {
        "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double",
        "props": "string",
    },
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "lineitem": {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
        "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
        "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
    },
}


def counts_sql(name: str, source: str | None = None) -> str:
    """(ordinal, name, dtype, n_rows, n_unique, n_null) of a table."""
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS name, '{kind}' AS dtype, count(*) AS n_rows, "
        f"count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS n_null FROM {source or name}"
        for i, (c, kind) in enumerate(COLUMNS[name].items())
    )


def roles_sql(name: str, source: str | None = None) -> str:
    """The counts with role flags."""
    return f"""
    SELECT *, is_categorical OR is_temporal OR (n_unique > 0 AND n_unique <= 30) AS is_filterable FROM (
      SELECT *, NOT is_numeric AND n_unique <= least(50, greatest(10, n_rows // 20)) AS is_categorical FROM (
        SELECT *, dtype IN ('bigint', 'int', 'double') AS is_numeric,
               dtype LIKE 'timestamp%' OR lower(name) LIKE '%date%' AS is_temporal
        FROM ({counts_sql(name, source)})))
    """


def generated_sql(name: str, source: str | None = None) -> str:
    """(name, column, agg, groupby, description) of every generated metric."""
    plain = "lower(name) NOT LIKE '%\\_id' ESCAPE '\\' AND lower(name) NOT IN ('id', 'index', 'row_id', 'pk')"
    scalars = [("sum", "total_", "Sum of ", " across all rows."), ("mean", "avg_", "Average (mean) of ", "."),
               ("max", "max_", "Maximum value of ", "."), ("min", "min_", "Minimum value of ", ".")]
    parts = [
        f"SELECT '{prefix}' || name AS name, name AS \"column\", '{agg}' AS agg, CAST(NULL AS VARCHAR) AS groupby, "
        f"'{before}' || name || '{after}' AS description FROM p WHERE is_numeric AND {plain}"
        for agg, prefix, before, after in scalars
    ]
    parts.append("SELECT 'row_count', '*', 'count', NULL, 'Total number of rows in the table.'")
    parts.append(
        "SELECT 'unique_' || name, name, 'nunique', NULL, 'Number of unique values in ' || name || '.' FROM p "
        "WHERE lower(name) LIKE '%id%' OR (is_categorical AND n_unique > 5)"
    )
    pairs = "FROM p n JOIN p c ON n.is_numeric AND c.is_categorical"
    parts.append(
        f"SELECT n.name || '_by_' || c.name, n.name, 'sum', c.name, 'Sum of ' || n.name || ' grouped by ' || c.name || '.' {pairs}"
    )
    parts.append(
        "SELECT 'avg_' || n.name || '_by_' || c.name, n.name, 'mean', c.name, "
        f"'Average of ' || n.name || ' grouped by ' || c.name || '.' {pairs}"
    )
    parts.append(
        "SELECT 'count_by_' || name, '*', 'count', name, 'Row count grouped by ' || name || '.' FROM p WHERE is_categorical"
    )
    return f"WITH p AS ({roles_sql(name, source)}) " + " UNION ALL ".join(parts)


def generated(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Catalog rows generated from a table's exact profile."""
    found = profile.build_profile(table(spark, sf_dir, name), name)
    return catalog.catalog_frame(spark, catalog.generate_metrics(found))


def verified_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total order value by priority: profiled, generated as a metric, run and verified."""
    orders = read_parquet(spark, f"{sf_dir}/orders.parquet")
    found = profile.build_profile(orders, "orders")
    metric = catalog.generate_metrics(found)["o_totalprice_by_o_orderpriority"]
    checked = verify.verified_breakdown(orders, metric.column, metric.groupby)
    return checked.withColumn("value", F.round("value", 2))


def _approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generated(spark, sf_dir, "events")
    held_back = F.col("agg").isin("min", "nunique")
    return rows.withColumn("status", F.when(held_back, "pending").otherwise("approved"))


def _catalog_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.approved_only(_approved(spark, sf_dir)).select("name", "description", "column", "agg", "groupby")


def _catalog_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    curated = _approved(spark, sf_dir).where("agg in ('sum', 'count')")
    curated = curated.withColumns({"description": F.concat(F.lit("Curated: "), "name"), "source": F.lit("manual")})
    own = curated.withColumn("name", F.when(F.col("agg") == "sum", F.concat(F.lit("my_"), "name")).otherwise(F.col("name")))
    merged = catalog.merge_catalogs(own, generated(spark, sf_dir, "events"))
    return merged.select("name", "column", "agg", "groupby", "description", "source")


PROPOSALS = """
SELECT event_id AS proposal_id,
       CASE event_type WHEN 'view' THEN 'value' WHEN 'click' THEN 'user_id' WHEN 'error' THEN 'price' ELSE 'props' END AS "column",
       CASE WHEN value < 20 THEN 'median' WHEN value < 40 THEN 'mean' ELSE 'sum' END AS agg,
       CASE WHEN user_id < 50 THEN 'event_type' WHEN user_id < 100 THEN 'country' WHEN user_id < 120 THEN '' END AS groupby
FROM {events}
"""


def _proposal_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    proposals = spark.sql(PROPOSALS.replace('"', "`"), events=events)
    return catalog.validate_proposals(proposals, profile.column_list(events))


def _synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, sf_dir, "lineitem").select("name", F.explode("synonyms").alias("synonym"))


def _profile(name: str, *columns: str):
    return lambda s, d: profile.profile_frame(table(s, d, name), "exact").select(*columns)


QUERIES = {
    "entry": verified_totals,
    "scan_parquet": lambda s, d: read_parquet(s, f"{d}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"
    ),
    "profile_table": lambda s, d: profile.table_summary(table(s, d, "orders")),
    "profile_columns": _profile("orders", "ordinal", "name", "dtype", "n_rows", "n_unique", "n_null"),
    "profile_text": _profile("documents", "ordinal", "name", "dtype", "n_rows", "n_unique", "n_null"),
    "profile_roles": _profile("events", "name", "is_numeric", "is_temporal", "is_categorical", "is_filterable"),
    "profile_filterable": lambda s, d: profile.filterable_columns(profile.profile_frame(table(s, d, "lineitem"), "exact")),
    "catalog_generate": lambda s, d: generated(s, d, "events").select("name", "column", "agg", "groupby", "description"),
    "catalog_generate_wide": lambda s, d: generated(s, d, "lineitem").select("name", "column", "agg", "groupby", "description"),
    "catalog_synonyms": _synonyms,
    "catalog_approved": _catalog_approved,
    "catalog_merge": _catalog_merge,
    "proposal_validate": _proposal_validate,
    "row_cap": lambda s, d: guards.cap_rows(table(s, d, "lineitem"), 1000, [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "truncated"
    ),
}

# Phrases for one column's metrics as SQL over its name in words.
PHRASES = {
    "sum": ["'total ' || w", "w || ' total'", "'sum of ' || w", "'how much ' || w", "'overall ' || w", "'sum ' || w", "'total_' || \"column\""],
    "mean": ["'average ' || w", "'avg ' || w", "'mean ' || w", "'typical ' || w", "w || ' average'"],
    "max": ["'highest ' || w", "'maximum ' || w"],
    "min": ["'lowest ' || w", "'minimum ' || w"],
    "nunique": ["'number of ' || w", "'count of ' || w", "'how many ' || w", "'distinct ' || \"column\""],
}
GROUP_PHRASES = {
    "sum": ["c || ' by ' || g", "c || ' per ' || g", "'breakdown of ' || c || ' by ' || g", "'total ' || c || ' by ' || g"],
    "mean": ["'average ' || c || ' by ' || g", "'avg ' || c || ' per ' || g", "'mean ' || c || ' by ' || g"],
    "count": ["'count by ' || g", "'number of items per ' || g", "'distribution of ' || g"],
}
ROW_PHRASES = ["how many rows", "row count", "number of rows", "how many records", "dataset size", "total rows"]


def synonyms_sql(name: str) -> str:
    """(name, synonym) of every generated metric; no column here is called after money."""
    parts = [
        f"SELECT name, unnest([{', '.join(p)}]) AS synonym FROM m WHERE groupby IS NULL AND agg = '{agg}'" for agg, p in PHRASES.items()
    ] + [
        f"SELECT name, unnest([{', '.join(p)}]) FROM m WHERE groupby IS NOT NULL AND agg = '{agg}'" for agg, p in GROUP_PHRASES.items()
    ]
    parts.append(f"SELECT name, unnest({ROW_PHRASES}) FROM m WHERE name = 'row_count'")
    words = "lower(replace(\"column\", '_', ' '))"
    return f"WITH m AS (SELECT *, {words} AS w, \"column\" AS c, groupby AS g FROM ({generated_sql(name)})) " + " UNION ALL ".join(parts)


ORACLES = {
    "catalog_synonyms": synonyms_sql("lineitem"),
    "entry": "SELECT o_orderpriority AS key, round(sum(o_totalprice), 2) AS value, true AS breakdown_ok FROM orders GROUP BY 1",
    "scan_parquet": "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_shipdate FROM lineitem",
    "profile_table": "SELECT count(*) AS n_rows, CAST(6 AS INTEGER) AS n_cols FROM orders",
    "profile_columns": counts_sql("orders"),
    "profile_text": counts_sql("documents"),
    "profile_roles": f"SELECT name, is_numeric, is_temporal, is_categorical, is_filterable FROM ({roles_sql('events')})",
    "profile_filterable": f"SELECT ordinal, name FROM ({roles_sql('lineitem')}) WHERE is_filterable",
    "catalog_generate": generated_sql("events"),
    "catalog_generate_wide": generated_sql("lineitem"),
    "catalog_approved": f"SELECT name, description, \"column\", agg, groupby FROM ({generated_sql('events')}) WHERE agg NOT IN ('min', 'nunique')",
    "catalog_merge": f"""
    WITH g AS ({generated_sql('events')}),
    m AS (SELECT CASE WHEN agg = 'sum' THEN 'my_' || name ELSE name END AS name, "column", agg, groupby,
                 'Curated: ' || name AS description FROM g WHERE agg IN ('sum', 'count'))
    SELECT name, "column", agg, groupby, description, 'auto' AS source FROM g
    UNION ALL SELECT name, "column", agg, groupby, description, 'manual' FROM m WHERE name NOT IN (SELECT name FROM g)
    """,
    "proposal_validate": oracle(
        """SELECT *, problem IS NULL AS valid FROM (SELECT *, CASE
             WHEN "column" NOT IN ('event_id', 'ts', 'user_id', 'event_type', 'value', 'props') THEN 'column'
             WHEN agg NOT IN ('sum', 'mean', 'count', 'nunique', 'max', 'min') THEN 'agg'
             WHEN groupby <> '' AND groupby NOT IN ('event_id', 'ts', 'user_id', 'event_type', 'value', 'props') THEN 'groupby'
           END AS problem FROM proposals)""",
        proposals=PROPOSALS,
    ),
    "row_cap": """SELECT l_orderkey, l_linenumber, l_extendedprice, (SELECT count(*) FROM lineitem) > 1000 AS truncated
                  FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 1000""",
}
