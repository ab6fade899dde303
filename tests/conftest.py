import datetime
import tempfile

import pytest

from tallyward import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="run-", dir="/tmp"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture(scope="session")
def orders(spark):
    """Six orders with known answers."""
    day = lambda text: datetime.date.fromisoformat(text)
    rows = [
        (1, 10, 100.0, 1, "North", "A", day("2024-01-15")),
        (2, 10, 200.0, 2, "South", "B", day("2024-02-20")),
        (3, 20, 300.0, 3, "North", "A", day("2024-03-10")),
        (4, 30, 150.0, 1, "East", "C", day("2024-04-05")),
        (5, 30, 250.0, 2, "West", "B", day("2024-05-12")),
        (6, 40, 400.0, 4, "South", "A", day("2024-06-18")),
    ]
    schema = "order_id bigint, customer_id bigint, revenue double, quantity bigint, region string, category string, order_date date"
    return spark.createDataFrame(rows, schema).cache()


def values(frame, *columns):
    """The rows of a frame as tuples."""
    return [tuple(r) for r in (frame.select(*columns) if columns else frame).collect()]


def scans(frame):
    """How often the executed plan reads files."""
    return frame._jdf.queryExecution().executedPlan().toString().count("FileScan")
