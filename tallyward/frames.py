"""Small metadata as frames."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _plain(value: object) -> object:
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    raise TypeError(type(value).__name__)


def small_frame(spark: SparkSession, rows: Iterable[Mapping[str, object]], schema: str) -> DataFrame:
    """Driver-side metadata as a frame of a 'name type, …' schema.

    The rows become one literal in the plan. Spark so knows how small the frame is and broadcasts it in a join,
    which it would not do for a frame made from Python objects.
    """
    text = json.dumps(list(rows), default=_plain)
    parsed = F.from_json(F.lit(text), f"array<struct<{struct_fields(schema)}>>")
    return spark.range(1).select(F.inline(parsed))


def struct_fields(schema: str) -> str:
    """'a string, b map<string,string>' as the inside of a struct type: 'a: string, b: map<string,string>'."""
    fields, depth, field = [], 0, ""
    for char in schema + ",":
        depth += {"<": 1, ">": -1}.get(char, 0)
        if char == "," and depth == 0:
            name, kind = field.strip().split(" ", 1)
            fields.append(f"{name}: {kind}")
            field = ""
        else:
            field += char
    return ", ".join(fields)
