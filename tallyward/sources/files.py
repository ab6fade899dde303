"""File scans."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tallyward.dataset import Dataset
from tallyward.operators.evaluation import CASE_SCHEMA
from tallyward.operators.guards import check_input_size

Schema = StructType | str | None


def read_csv(spark: SparkSession, path: str, schema: Schema = None, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """Delimited text with a header row; quotes inside quoted values are doubled.

    A quoted value may hold line breaks. A file is then one task, as a break does not tell where a record ends;
    give `multi_line=False` for large files known to have none, which can be split. Give a schema for large
    input: inferring one reads the files twice.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", multi_line)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: Schema = None, multi_line: bool = True) -> DataFrame:
    """Tab-separated text with a header row."""
    return read_csv(spark, path, schema, "\t", multi_line)


def read_parquet(spark: SparkSession, path: str, schema: Schema = None) -> DataFrame:
    """Parquet; filters and columns reach the scan."""
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema: Schema = None, lines: bool = False) -> DataFrame:
    """An array of records per file, or with `lines` one record per line, which is the form that splits."""
    reader = spark.read.option("multiLine", not lines)
    return reader.schema(schema).json(path) if schema else reader.json(path)


READERS: dict[str, Callable[..., DataFrame]] = {
    ".csv": read_csv, ".tsv": read_tsv, ".parquet": read_parquet, ".pq": read_parquet, ".json": read_json,
    ".jsonl": lambda spark, path, schema=None: read_json(spark, path, schema, lines=True),
}


def load_file(
    spark: SparkSession,
    path: str,
    name: str = "data",
    schema: Schema = None,
    max_mb: float | None = None,
    mask: bool = True,
    multi_line: bool = True,
) -> Dataset:
    """Load a file or folder by its suffix as a masked dataset; `max_mb` limits its size.

    `multi_line=False` lets Spark split large CSV and TSV files, which then must have no line breaks in values. Other types ignore it.
    """
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in READERS:
        raise ValueError(f"unsupported file type {suffix!r}; known: {sorted(READERS)}")
    if max_mb is not None:
        check_input_size(spark, path, max_mb)
    options = {"multi_line": multi_line} if suffix in (".csv", ".tsv") else {}
    return Dataset.from_frame(READERS[suffix](spark, path, schema, **options), name, mask)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, one JSON record per line."""
    return spark.read.schema(CASE_SCHEMA).json(path)
