import re

import pytest
from pyspark.sql import functions as F

from tallyward import Dataset
from tallyward.functions import numbers, pii_patterns, text
from tallyward.operators import leaks, masking
from tests.conftest import values


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (1, "Alice Johnson", "alice@example.com", "+1-555-0101-22", "North", 5.0, "call +1-555-0101-22"),
        (2, None, None, None, "South", 7.0, "2024-01-15"),
        (3, "Bob", "b@x.org", "555", "East", 9.0, "plain"),
    ]
    schema = "order_id bigint, customer_name string, customer_email string, customer_phone string, region string, revenue double, note string"
    return spark.createDataFrame(rows, schema)


def test_masking(people):
    masked = masking.mask_frame(people)
    rows = values(masked)
    assert rows[0] == (1, "Customer [REDACTED]", "customer.masked@masked.local", "+91-XXXXX-XXXXX", "North", 5.0, pii_patterns.VALUE_TOKEN)
    assert rows[1] == (2, None, None, None, "South", 7.0, "2024-01-15")
    assert values(masking.mask_frame(masked)) == rows
    assert masking.name_masked_columns(people) == ["customer_name", "customer_email", "customer_phone"]


def test_dataset_is_masked_once(spark, people):
    data = Dataset.from_frame(people, "people")
    assert data.masked_columns == ("customer_name", "customer_email", "customer_phone")
    assert spark.table("people").where("customer_email LIKE 'alice%'").count() == 0
    assert Dataset.from_frame(people, "raw", mask=False).df.where("customer_email LIKE 'alice%'").count() == 1


def test_numeric_column_is_never_personal(spark):
    df = spark.createDataFrame([(5551234567, "x")], "phone bigint, other string")
    assert values(masking.mask_frame(df)) == [(5551234567, "x")]


def test_personal_columns(people):
    got = {r["column"]: (r["by_name"], r["by_value"]) for r in masking.personal_columns(people).collect()}
    assert got["customer_email"] == (True, True) and got["region"] == (False, False) and got["note"] == (False, True)
    assert masking.personal_columns(people, sample=1).count() == 5


def test_vault(spark):
    customers = spark.createDataFrame(
        [(7, "Ann", "Lee", "a@b.org", "123", "1 Main St", "R", "Rome"), (1234, "Bo", "Ray", "b@b.org", "456", "2 Main St", "R", "Oslo")],
        "customer_id int, first_name string, last_name string, email string, phone string, address string, region string, city string",
    )
    masked = values(masking.mask_customers(customers))
    assert masked[0] == (7, "Customer", "007", "customer.007@masked.local", "+91-XXXXX-X007", "[REDACTED], Rome", "R", "Rome")
    assert masked[1][2] == "1234"
    key = F.lit("0123456789abcdef").cast("binary")
    vault = masking.vault_rows(customers, key)
    assert vault.count() == 10 and vault.schema["original_value"].dataType.simpleString() == "binary"
    assert not [r for r in vault.collect() if b"Ann" in bytes(r["original_value"])]
    opened = {(r["customer_id"], r["field_name"]): r["original_value"] for r in masking.reveal(vault, key).collect()}
    assert opened[(7, "email")] == "a@b.org"
    preview = masking.before_after(masking.vault_rows(customers), 1)
    assert [r["field_name"] for r in preview.collect()] == ["address", "email", "first_name", "last_name", "phone"]
    stats = {r["entity_type"]: (r["n"], r["avg_confidence"], r["is_total"]) for r in masking.vault_stats(masking.vault_rows(customers)).collect()}
    assert stats == {"KNOWN_PII": (10, 1.0, False), None: (10, 1.0, True)}
    assert masking.empty_vault(vault).count() == 0


SAMPLES = [
    "write to alice.johnson@example.com, please", "call +1-555-0101 or 555 0101 22", "at 123 Main St or 9 Old Mill Road now", "nothing here",
    "", None, "order 12345678 and 123456789", "2024-01-15", "éa@b.co x", "Élan Vital met Jean Dupont", "JeanéDupont Marie", "٣٤٥ ٦٧٨ ٩٠١ ٢٢",
    "1 High Street", "x@y", "12 the long Way", "Customer#000000001", "_a@b.org", "Best Änderung", "Anna\nBell", "+91-XXXXX-XXXXX",
]


def test_patterns_equal_python(spark):
    """Word edges, digits and blanks of any script, as Python's own regular expressions have them."""
    plain = lambda p: re.compile(re.sub(r"^\(\?(i?)U\)", lambda m: "(?i)" if m.group(1) else "", p))
    email, phone, address, quick = map(plain, (pii_patterns.EMAIL, pii_patterns.PHONE, pii_patterns.ADDRESS, pii_patterns.PREFILTER))
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    got = df.select("i", pii_patterns.leak_hit(F.col("s")), pii_patterns.prefilter_hit(F.col("s")), pii_patterns.leak_matches(F.col("s"))).collect()
    for i, leak, suspect, matches in got:
        s = SAMPLES[i] or ""
        assert leak == bool(email.search(s) or phone.search(s) or address.search(s)), s
        assert suspect == bool(quick.search(s)), s
        expected = [f"{k}:{m.group(0)}" for k, p in (("email", email), ("phone", phone), ("address", address)) for m in p.finditer(s)]
        assert matches == expected, s


def test_masked_output_has_no_leak_but_the_tokens(spark, people):
    masked = masking.mask_frame(people)
    cells = masked.select(F.explode(F.array("customer_name", "customer_email", "customer_phone", "region", "note")).alias("cell"))
    left = {r["match"] for r in leaks.leak_rows(cells.withColumn("k", F.lit(1)), ["k"], "cell").collect()}
    assert left <= {"customer.masked@masked.local", "2024-01-15"}


def test_scrub(spark):
    df = spark.createDataFrame([(1, "Jane Doe"), (2, "North"), (3, None)], "i int, s string")
    assert values(masking.scrub_result(df)) == [(1, pii_patterns.VALUE_TOKEN), (2, "North"), (3, None)]


def test_questions(spark):
    questions = ["  Total   Revenue?! ", "total revenue", "a b.", "Ends . ", "?!", "\x1cX\x1f y", None]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "i int, q string")
    got = [r[0] for r in df.orderBy("i").select(text.normalize_question(F.col("q"))).collect()]
    expected = [re.sub(r"[?!.,]+$", "", re.sub(r"\s+", " ", q.lower().strip())).strip() if q is not None else None for q in questions]
    assert got == expected


def test_question_key(spark):
    import hashlib
    import json

    filters = {"region": 'No"rth', "b": "é", "a": "x\\y"}
    df = spark.createDataFrame([("t", "d", " Total?", filters), (None, None, "Total", None)], "t string, d string, q string, f map<string,string>")
    got = [r[0] for r in df.select(text.question_key(F.col("t"), F.col("d"), F.col("q"), F.col("f"))).collect()]
    raw = "t|d|total|" + json.dumps(filters, sort_keys=True, ensure_ascii=False)
    assert got == [hashlib.sha256(raw.encode()).hexdigest(), hashlib.sha256(b"||total|{}").hexdigest()]


def test_number_text(spark):
    df = spark.createDataFrame([(7, 1234567.891, "2024-01"), (-7, 0.0, "2024/01"), (12345, -2.5, "20-24-01")], "i int, x double, k string")
    got = values(df.select(numbers.zero_padded(F.col("i"), 3), numbers.grouped_number(F.col("x")), numbers.looks_like_date(F.col("k")), numbers.correlation_strength(F.col("x"))))
    assert got == [("007", "1,234,567.89", True, "strong"), ("-07", "0.00", False, "weak"), ("12345", "-2.50", False, "strong")]
