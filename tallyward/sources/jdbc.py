"""Reading from databases over JDBC, read-only and with timeouts."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal
from math import floor
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---- Fixed values ---------------------------------------------------------------------------------------
CONNECT_TIMEOUT_SECONDS = 10
STATEMENT_TIMEOUT_SECONDS = 30
DIALECT_ALIASES = {"postgres": "postgresql", "mariadb": "mysql"}
READ_ONLY_STATEMENTS = {
    "postgresql": "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY",
    "mysql": "SET SESSION TRANSACTION READ ONLY",
}
# ---------------------------------------------------------------------------------------------------------

# Connections of a read that is split by a key.
CONNECTIONS = 8
# Driver properties for the connect timeout: seconds for the one, milliseconds for the other.
_CONNECT_OPTIONS = {
    "postgresql": {"connectTimeout": str(CONNECT_TIMEOUT_SECONDS)},
    "mysql": {"connectTimeout": str(CONNECT_TIMEOUT_SECONDS * 1000)},
}


@dataclass(frozen=True)
class Split:
    """How to read a table in parallel: ranges of a column, one connection each."""

    column: str
    lower: int | str
    upper: int | str
    partitions: int


def dialect_of(url: str) -> str:
    """Database kind of a connection URL, without driver suffix and with aliases resolved."""
    scheme = url.lower().removeprefix("jdbc:").split(":", 1)[0].split("+", 1)[0].strip()
    return DIALECT_ALIASES.get(scheme, scheme)


def jdbc_url(url: str) -> tuple[str, dict[str, str]]:
    """(JDBC URL, credentials) of a connection URL; a JDBC URL passes unchanged."""
    if url.startswith("jdbc:"):
        return url, {}
    dialect = dialect_of(url)
    if dialect == "sqlite":
        return "jdbc:sqlite:" + re.sub(r"^[^:]+:/{0,3}", "", url, count=1), {}
    parts = urlsplit(url)
    host = parts.hostname or "localhost"
    target = f"jdbc:{dialect}://{host}{f':{parts.port}' if parts.port else ''}{parts.path}"
    login = {"user": parts.username, "password": parts.password}
    return target + (f"?{parts.query}" if parts.query else ""), {k: unquote(v) for k, v in login.items() if v}


def source_option(table_or_query: str) -> dict[str, str]:
    """A bare name is read as a table, a SELECT as a query."""
    text = table_or_query.strip().rstrip(";")
    return {"query": text} if re.match(r"(?i)(select|with)\s", text) else {"dbtable": text}


def read_options(url: str, table_or_query: str, split: Split | None = None, fetch_size: int = 10_000) -> dict[str, str]:
    """Every option of a read-only JDBC read. A split needs a table, as Spark cannot split a query."""
    target, login = jdbc_url(url)
    dialect = dialect_of(url)
    options = {
        "url": target, **login, **source_option(table_or_query),
        "queryTimeout": str(STATEMENT_TIMEOUT_SECONDS), "fetchsize": str(fetch_size),
        **_CONNECT_OPTIONS.get(dialect, {}),
    }
    if dialect in READ_ONLY_STATEMENTS:
        options["sessionInitStatement"] = READ_ONLY_STATEMENTS[dialect]
    if split is not None:
        if "query" in options:
            options["dbtable"] = f"({options.pop('query')}) AS source"
        options |= {
            "partitionColumn": split.column, "lowerBound": str(split.lower), "upperBound": str(split.upper),
            "numPartitions": str(split.partitions),
        }
    return options


def read_database(
    spark: SparkSession,
    url: str,
    table_or_query: str,
    split: Split | None = None,
    key: str | None = None,
    connections: int = CONNECTIONS,
    **extra: str,
) -> DataFrame:
    """A database table or query as a frame; filters and columns are pushed into the database.

    With a `key`, a column of numbers, dates or timestamps, the read is split by ranges of it over so many connections, for which the
    database is asked for its least and greatest value. Without `key` or `split` it is one connection and one task.
    """
    if split is None and key is not None:
        split = key_split(_load(spark, read_options(url, bounds_query(table_or_query, key)), extra), key, connections)
    return _load(spark, read_options(url, table_or_query, split), extra)


def bounds_query(table_or_query: str, key: str) -> str:
    """The query for the least and the greatest key of a table or query."""
    if not re.fullmatch(r"[A-Za-z_]\w*", key, re.ASCII):
        raise ValueError(f"{key!r} is no plain column name")
    option = source_option(table_or_query)
    source = option.get("dbtable") or f"({option['query']}) AS source"
    return f"SELECT MIN({key}) AS lower_key, MAX({key}) AS upper_key FROM {source}"


def key_split(bounds: DataFrame, key: str, connections: int = CONNECTIONS) -> Split | None:
    """The split between the bounds of a one-row frame; None where there is no row to split, or too little between them.

    Rows without a key and keys beyond the bounds, of rows that came since, are read as well, by the first and the last connection.
    """
    for field in bounds.schema:
        if not isinstance(field.dataType, (T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise ValueError(f"can not split by {key!r}, which is {field.dataType.simpleString()}")
    lower, upper = bounds.first() or (None, None)
    if lower is None or lower == upper or connections < 2:
        return None
    if isinstance(lower, Decimal):
        # Spark takes whole bounds; one more at the upper end keeps the last range as wide as the others.
        lower, upper = floor(lower), floor(upper) + 1
    whole = isinstance(lower, int)
    return Split(key, lower if whole else str(lower), upper if whole else str(upper), connections)


def _load(spark: SparkSession, options: Mapping[str, str], extra: Mapping[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**{**options, **extra}).load()
