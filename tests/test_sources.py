import datetime
import json

import pytest
from pyspark.sql import functions as F

from tallyward.errors import ResourceLimitError
from tallyward.frames import small_frame
from tallyward.sources import files, jdbc, refresh
from tallyward.sources.refresh import LiveTable, live_files
from tests.conftest import values

CSV = "order_id,due_date,sales\nA1,2024-01-05,10.5\nA2,2024-02-06,20\n"


def write(folder, name, text):
    with open(f"{folder}/{name}", "w", encoding="utf-8") as out:
        out.write(text)
    return f"{folder}/{name}"


def test_csv_and_tsv(spark, folder):
    data = files.load_file(spark, write(folder, "a.csv", CSV))
    assert data.df.dtypes == [("order_id", "string"), ("due_date", "date"), ("sales", "double")]
    assert data.profile.temporal == ["due_date"] and data.profile.n_rows == 2
    tabs = files.load_file(spark, write(folder, "b.TSV", CSV.replace(",", "\t")))
    assert values(tabs.df) == values(data.df)
    given = files.load_file(spark, write(folder, "c.csv", CSV), schema="order_id string, due_date string, sales double")
    assert dict(given.df.dtypes)["due_date"] == "string"


def test_quotes_commas_and_line_breaks(spark, folder):
    rows = [(1, 'say "hi", twice'), (2, "line one\nline two"), (3, '{"k": 1, "b": "2,3"}'), (4, None), (5, '""')]
    frame = spark.createDataFrame(rows, "id int, note string")
    for name, sep in (("a.csv", ","), ("b.tsv", "\t")):
        frame.coalesce(1).write.option("header", True).option("escape", '"').option("sep", sep).csv(f"{folder}/{name}")
        read = files.READERS["." + name.split(".")[1]](spark, f"{folder}/{name}", "id int, note string")
        assert sorted(values(read)) == rows


def test_exported_audit_reads_back(spark, folder):
    from tallyward.operators import audit
    from tallyward.sources import sinks

    now = datetime.datetime(2024, 1, 2, tzinfo=datetime.timezone.utc)
    row = {"id": "1", "timestamp": "2024-01-01T00:00:00", "username": 'a "b"', "role": "r", "action_type": "QUERY",
           "details": '{"q": "x, y"}\nz', "ip_address": "::1", "tenant_id": "t"}
    rows = small_frame(spark, [row], "id string, timestamp timestamp, username string, role string, action_type string, details string, ip_address string, tenant_id string")
    expected = audit.export(rows, "t", F.lit(now), 30)
    sinks.export_audit(rows, f"{folder}/out.csv", "t", F.lit(now), 30, "csv")
    kinds = ", ".join(f"{n} string" for n in expected.columns)
    assert values(files.read_csv(spark, f"{folder}/out.csv", kinds), "username", "details", "tenant_id") == values(expected, "username", "details", "tenant_id")


def test_json(spark, folder):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    assert values(files.load_file(spark, write(folder, "a.json", json.dumps(rows, indent=1))).df) == [(1, "x"), (2, "y")]
    lines = "\n".join(map(json.dumps, rows))
    assert values(files.load_file(spark, write(folder, "a.jsonl", lines)).df) == [(1, "x"), (2, "y")]


def test_parquet_reads_only_what_is_used(spark, folder):
    spark.range(10).select("id", (F.col("id") * 2).alias("x")).write.parquet(f"{folder}/t.parquet")
    data = files.load_file(spark, f"{folder}/t.parquet")
    plan = data.df.where("x > 4").select("id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(x), GreaterThan(x,4)]" in plan


def test_suffix_and_size(spark, folder):
    with pytest.raises(ValueError):
        files.load_file(spark, "table.xml")
    path = write(folder, "a.csv", CSV)
    with pytest.raises(ResourceLimitError):
        files.load_file(spark, path, max_mb=0.00001)
    assert files.load_file(spark, path, max_mb=1).df.count() == 2


def test_cases(spark, folder):
    case = {"id": "p1", "question": "q", "dataset": "d", "expect": {"plan_types_allowed": ["no_match"], "check_pii": True, "min_confidence": None}}
    row = files.read_cases(spark, write(folder, "cases.jsonl", json.dumps(case) + "\n\n")).first()
    assert row["expect"]["plan_types_allowed"] == ["no_match"] and row["expect"]["check_pii"] and row["expect"]["must_include_numbers"] is None


def test_dialects():
    assert jdbc.dialect_of("postgresql+psycopg2://u:p@h/db") == "postgresql" and jdbc.dialect_of("postgres://h/db") == "postgresql"
    assert jdbc.dialect_of("mariadb://h/db") == "mysql" and jdbc.dialect_of("jdbc:mysql://h/db") == "mysql"
    assert jdbc.dialect_of("sqlite:///a.db") == "sqlite"


def test_jdbc_options():
    options = jdbc.read_options("postgresql+psycopg2://me:p%40ss@db:5433/shop", "orders")
    assert options["url"] == "jdbc:postgresql://db:5433/shop" and options["user"] == "me" and options["password"] == "p@ss"
    assert options["dbtable"] == "orders" and options["queryTimeout"] == "30" and options["connectTimeout"] == "10"
    assert "READ ONLY" in options["sessionInitStatement"]
    mysql = jdbc.read_options("jdbc:mysql://h/db", "SELECT * FROM t;")
    assert mysql["query"] == "SELECT * FROM t" and mysql["connectTimeout"] == "10000" and "dbtable" not in mysql
    sqlite = jdbc.read_options("sqlite:////data/a.db", "t")
    assert sqlite["url"] == "jdbc:sqlite:/data/a.db" and "sessionInitStatement" not in sqlite
    split = jdbc.read_options("jdbc:mysql://h/db", "SELECT 1 AS id", jdbc.Split("id", 0, 100, 8))
    assert split["dbtable"] == "(SELECT 1 AS id) AS source" and split["numPartitions"] == "8" and "query" not in split


def test_reads_are_split_by_a_key(spark, monkeypatch):
    asked, bounds = [], {}

    def load(session, options, extra):
        asked.append({**options, **extra})
        return spark.sql(f"SELECT {bounds['lower']} AS lower_key, {bounds['upper']} AS upper_key")

    monkeypatch.setattr(jdbc, "_load", load)

    def options(lower, upper, source="orders", **more):
        bounds.update(lower=lower, upper=upper)
        asked.clear()
        jdbc.read_database(spark, "postgres://h/db", source, key="id", **more)
        return asked[-1]

    read = options("5", "905", connections=4, driver="d")
    assert asked[0]["query"] == "SELECT MIN(id) AS lower_key, MAX(id) AS upper_key FROM orders" and "READ ONLY" in asked[0]["sessionInitStatement"]
    assert (read["partitionColumn"], read["lowerBound"], read["upperBound"], read["numPartitions"]) == ("id", "5", "905", "4")
    assert read["dbtable"] == "orders" and asked[0]["driver"] == read["driver"] == "d"
    assert options("date'2024-01-01'", "date'2024-06-01'")["upperBound"] == "2024-06-01"
    assert options("timestamp_ntz'2024-01-01 00:00:00'", "timestamp_ntz'2024-01-01 10:00:00.5'")["upperBound"] == "2024-01-01 10:00:00.500000"
    assert options("-1.5", "7.25")["lowerBound"] == "-2" and options("-1.5", "7.25")["upperBound"] == "8"
    query = options("1", "9", "SELECT * FROM t;")
    assert asked[0]["query"].endswith("FROM (SELECT * FROM t) AS source") and query["dbtable"] == "(SELECT * FROM t) AS source"
    for same in (("CAST(NULL AS INT)", "CAST(NULL AS INT)"), ("3", "3")):
        assert "partitionColumn" not in options(*same)
    with pytest.raises(ValueError):
        options("'a'", "'b'")
    with pytest.raises(ValueError):
        jdbc.read_database(spark, "postgres://h/db", "orders", key="id; DROP TABLE orders")


def test_refresh_modes(spark, monkeypatch):
    reads, now = [], [0.0]

    def read(key):
        reads.append(key)
        return spark.range(len(reads))

    ttl = LiveTable(read, "ttl", 30, clock=lambda: now[0])
    assert ttl.frame().count() == 1 and ttl.frame().count() == 1 and len(reads) == 1
    now[0] = 31
    assert ttl.frame().count() == 2
    ttl.frame("other")
    assert reads == [None, None, "other"]
    monkeypatch.setattr(refresh, "MAX_SNAPSHOTS", 3)
    for i in range(6):
        ttl.frame(str(i))
    assert len(ttl._snapshots) == 3
    ttl.clear()
    always = LiveTable(read, "always")
    before = len(reads)
    always.frame(), always.frame()
    assert len(reads) == before + 2
    with pytest.raises(ValueError):
        LiveTable(read, "never")


def test_growing_folder(spark, folder):
    path = f"{folder}/live"
    spark.range(1).write.parquet(path)
    fresh, kept = live_files(spark, path), live_files(spark, path, "ttl", 3600)
    assert fresh.frame().count() == 1 and kept.frame().count() == 1
    spark.range(4).write.mode("append").parquet(path)
    assert fresh.frame().count() == 5 and kept.frame().count() == 1
