"""Masking, vault and leak tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators import leaks, masking
from workload.inputs import CUSTOMERS, oracle, table, view

# The leak patterns in the oracle's dialect.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"\b(?:\+?\d[\d\-\s]{7,}\d)\b"
ADDRESS = (
    r"(?i)\b\d{1,5}\s+[A-Za-z][A-Za-z\s]+"
    r"(?:St|Street|Ave|Avenue|Rd|Road|Dr|Drive|Ln|Lane|Blvd|Boulevard|Way|Ct|Court|Pkwy|Parkway)\b"
)
# Its word boundaries know ASCII only; letters of any script are spelled out where a name begins and ends.
EDGE = r"[^\p{L}\p{N}\p{M}_]"
PREFILTER = rf"@|(\+?\d[\d\-\s]{{7,}}\d)|((^|{EDGE})[A-Z][a-z]+\s[A-Z][a-z]+($|{EDGE}))"
CALENDAR = r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*$"


def hit(column: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


def leak(column: str) -> str:
    return hit(column, EMAIL, PHONE, ADDRESS)


def personal(column: str) -> str:
    return f"({hit(column, EMAIL)} OR ({hit(column, PHONE)} AND NOT {hit(column, CALENDAR)}))"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CUSTOMERS)


def _vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.vault_rows(_customers(spark, sf_dir))


# New records for rich customers: another address each, and customers the vault does not know yet.
INCOMING = """
SELECT c_custkey AS customer_id, 'address' AS field_name, concat('Box ', c_custkey) AS original_value, '[REDACTED]' AS masked_value,
       'LOCATION' AS entity_type, CAST(0.85 AS DOUBLE) AS confidence FROM {customer} WHERE c_acctbal > 5000
UNION ALL
SELECT 1000000000 + s_suppkey, 'email', concat(s_name, '@supply.example.com'), 'masked', 'EMAIL_ADDRESS', CAST(0.6 AS DOUBLE) FROM {supplier}
"""

TOKENS = {
    "first_name": "'Customer'",
    "last_name": "lpad(CAST(customer_id AS VARCHAR), CAST(greatest(3, length(CAST(customer_id AS VARCHAR))) AS INTEGER), '0')",
}
TOKENS["email"] = f"'customer.' || {TOKENS['last_name']} || '@masked.local'"
TOKENS["phone"] = f"'+91-XXXXX-X' || {TOKENS['last_name']}"
TOKENS["address"] = "'[REDACTED], ' || city"
VAULT = " UNION ALL ".join(
    f"SELECT customer_id, '{f}' AS field_name, {f} AS original_value, {t} AS masked_value, 'KNOWN_PII' AS entity_type, "
    f"CAST(1.0 AS DOUBLE) AS confidence FROM customers"
    for f, t in TOKENS.items()
)
UPSERTED = "SELECT * FROM incoming UNION ALL SELECT * FROM vault v WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.customer_id = v.customer_id AND i.field_name = v.field_name)"


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.write_to_vault(_vault(spark, sf_dir), view(spark, sf_dir, INCOMING))


def _mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as cells of a table."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "content"))
    return masking.mask_frame(lines)


def _scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "content"))
    return masking.scrub_result(lines)


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), "source").alias("source"), "text")
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("html").alias("text"))
    return docs.unionByName(pages)


QUERIES = {
    "pii_columns": lambda s, d: masking.personal_columns(table(s, d, "documents")),
    "pii_columns_named": lambda s, d: masking.personal_columns(_customers(s, d)),
    "pii_mask_columns": lambda s, d: masking.mask_frame(_customers(s, d)),
    "pii_mask_values": _mask_values,
    "pii_prefilter": lambda s, d: leaks.flag_suspects(table(s, d, "documents"), "text").select("doc_id", "may_hold_pii"),
    "pii_leak_flag": lambda s, d: leaks.flag_leaks(table(s, d, "documents"), "text").select("doc_id", "leaks"),
    "pii_leak_flag_pages": lambda s, d: leaks.flag_leaks(table(s, d, "pages"), "html").select("page_id", "leaks"),
    "pii_leak_matches": lambda s, d: leaks.leak_rows(table(s, d, "documents"), ["doc_id"], "text"),
    "pii_leak_rate": lambda s, d: leaks.leak_rate(_both(s, d), "source", "text"),
    "mask_customers": lambda s, d: masking.mask_customers(_customers(s, d)),
    "vault_rows": _vault,
    "vault_upsert": _upserted,
    "vault_before_after": lambda s, d: masking.before_after(_vault(s, d)),
    "vault_stats": lambda s, d: masking.vault_stats(_upserted(s, d)),
    "scrub_result": _scrub,
}

# Positions count from 0: a list's elements are numbered from 1.
MATCHES = f"""
SELECT doc_id, CAST(unnest(range(len(found))) AS INTEGER) AS position, unnest(found) AS f FROM (
  SELECT doc_id, list_concat(list_concat(
    list_transform(regexp_extract_all(text, '{EMAIL}'), lambda m: 'email:' || m),
    list_transform(regexp_extract_all(text, '{PHONE}'), lambda m: 'phone:' || m)),
    list_transform(regexp_extract_all(text, '{ADDRESS}'), lambda m: 'address:' || m)) AS found FROM documents)
"""
LINES = "SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)"
TOKEN = "[REDACTED - possible PII detected]"

ORACLES = {
    "pii_columns": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", false AS by_name, coalesce(bool_or({personal(c)}), false) AS by_value FROM documents"
        for c in ("text", "lang", "source")
    ),
    "pii_columns_named": oracle(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {str(c in ('first_name', 'last_name', 'email', 'phone', 'address')).lower()} AS by_name, "
            f"coalesce(bool_or({personal(c)}), false) AS by_value FROM customers"
            for c in ("first_name", "last_name", "email", "phone", "address", "region", "city")
        ),
        customers=CUSTOMERS,
    ),
    "pii_mask_columns": oracle(
        """SELECT customer_id, 'Customer [REDACTED]' AS first_name, 'Customer [REDACTED]' AS last_name, 'customer.masked@masked.local' AS email,
           '+91-XXXXX-XXXXX' AS phone, '[REDACTED]' AS address, region, city FROM customers""",
        customers=CUSTOMERS,
    ),
    "pii_mask_values": f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN {personal('content')} THEN '{TOKEN}' ELSE content END AS content FROM ({LINES})",
    "pii_prefilter": f"SELECT doc_id, {hit('text', PREFILTER)} AS may_hold_pii FROM documents",
    "pii_leak_flag": f"SELECT doc_id, {leak('text')} AS leaks FROM documents",
    "pii_leak_flag_pages": f"SELECT page_id, {leak('html')} AS leaks FROM pages",
    "pii_leak_matches": f"""SELECT doc_id, position, split_part(f, ':', 1) AS kind, substring(f, length(split_part(f, ':', 1)) + 2) AS match FROM ({MATCHES})""",
    "pii_leak_rate": f"""SELECT source, count(*) AS n, count(*) FILTER ({leak('text')}) AS leaks,
        round(count(*) FILTER ({leak('text')}) / count(*), 4) AS leak_rate
        FROM (SELECT 'documents/' || source AS source, text FROM documents UNION ALL SELECT 'pages', html FROM pages) GROUP BY 1""",
    "mask_customers": oracle("SELECT customer_id, " + ", ".join(f"{t} AS {f}" for f, t in TOKENS.items()) + ", region, city FROM customers", customers=CUSTOMERS),
    "vault_rows": oracle(VAULT, customers=CUSTOMERS),
    "vault_upsert": oracle(UPSERTED, customers=CUSTOMERS, vault=VAULT, incoming=INCOMING),
    "vault_before_after": oracle(
        "SELECT * FROM vault WHERE customer_id IN (SELECT DISTINCT customer_id FROM vault ORDER BY 1 LIMIT 5)", customers=CUSTOMERS, vault=VAULT
    ),
    "vault_stats": oracle(
        f"""SELECT entity_type, count(*) AS n, round(avg(confidence), 3) AS avg_confidence, false AS is_total FROM u GROUP BY 1
            UNION ALL SELECT NULL, count(*), round(avg(confidence), 3), true FROM u""",
        customers=CUSTOMERS, vault=VAULT, incoming=INCOMING, u=UPSERTED,
    ),
    "scrub_result": f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN {hit('content', PREFILTER)} THEN '{TOKEN}' ELSE content END AS content FROM ({LINES})",
}
