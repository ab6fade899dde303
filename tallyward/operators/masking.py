"""Masking personal data in tables, and the vault of what was masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions import pii_patterns as pii
from tallyward.functions.numbers import zero_padded
from tallyward.operators.guards import column_ref, is_numeric_type
from tallyward.operators.topn import upsert

# Fields of a customer that are masked, and what the vault says of a field known to be personal.
VAULT_FIELDS = ("first_name", "last_name", "email", "phone", "address")
KNOWN_ENTITY, KNOWN_CONFIDENCE = "KNOWN_PII", 1.0
PREVIEW_IDS = 5


# ---- whole tables ---------------------------------------------------------------------------------------


def name_masked_columns(df: DataFrame) -> list[str]:
    """Columns that are personal by name; numeric columns never are. Reads the schema only."""
    return [
        f.name
        for f in df.schema.fields
        if not is_numeric_type(f.dataType) and any(word in f.name.lower() for word in pii.NAME_KEYWORDS)
    ]


def _name_token(column: str) -> str | None:
    low = column.lower()
    return next((token for word, token in pii.NAME_TOKENS if word in low), None)


def redact_values(text: Column) -> Column:
    """The text, or the redaction token when it holds personal data; null stays null."""
    return F.when(pii.personal_value(text), F.lit(pii.VALUE_TOKEN)).otherwise(text)


def mask_frame(df: DataFrame) -> DataFrame:
    """Mask a table once: columns personal by name take their token, other text columns lose personal values.

    One projection, no job. A column personal by a keyword without a token of its own is treated by value.
    """
    personal, columns = set(name_masked_columns(df)), []
    for f in df.schema.fields:
        column, token = column_ref(f.name), _name_token(f.name) if f.name in personal else None
        if token is not None:
            column = F.when(column.isNotNull(), F.lit(token))
        elif isinstance(f.dataType, T.StringType):
            column = redact_values(column)
        columns.append(column.alias(f.name))
    return df.select(*columns)


def personal_columns(df: DataFrame, sample: int | None = None) -> DataFrame:
    """(column, by_name, by_value) for the text columns, one aggregation over the whole table.

    `sample` looks at the first rows only, for a quick look at a live source.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    named = set(name_masked_columns(df))
    source = df if sample is None else df.limit(sample)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(c in named).alias("by_name"),
            F.coalesce(F.bool_or(pii.personal_value(column_ref(c))), F.lit(False)).alias("by_value"),
        )
        for c in texts
    ]
    return source.agg(F.array(*rows).alias("all")).select(F.inline("all"))


def scrub_result(df: DataFrame) -> DataFrame:
    """Last guard on a result: every text cell the cheap test suspects is redacted."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    scrub = lambda c: F.when(pii.prefilter_hit(c), F.lit(pii.VALUE_TOKEN)).otherwise(c)
    return df.select(*[scrub(column_ref(c)).alias(c) if c in texts else column_ref(c) for c in df.columns])


# ---- customers and vault --------------------------------------------------------------------------------


def _tokens(id_column: Column, city: Column) -> dict[str, Column]:
    # Fixed formats: the tokens a customer's fields are replaced by.
    padded = zero_padded(id_column, 3)
    return {
        "first_name": F.lit("Customer"),
        "last_name": padded,
        "email": F.concat(F.lit("customer."), padded, F.lit("@masked.local")),
        "phone": F.concat(F.lit("+91-XXXXX-X"), padded),
        "address": F.concat(F.lit("[REDACTED], "), city),
    }


def mask_customers(customers: DataFrame, id_column: str = "customer_id", city_column: str = "city") -> DataFrame:
    """Customers with tokens in their personal fields; id, region, city and the rest stay."""
    tokens = _tokens(F.col(id_column), F.col(city_column))
    return customers.withColumns({f: tokens[f] for f in VAULT_FIELDS})


def vault_rows(
    customers: DataFrame,
    key: Column | None = None,
    id_column: str = "customer_id",
    city_column: str = "city",
) -> DataFrame:
    """(customer_id, field_name, original_value, masked_value, entity_type, confidence), a row per field.

    With a `key` (16, 24 or 32 bytes) the original is AES-encrypted, so that no raw value is stored.
    """
    tokens = _tokens(F.col(id_column), F.col(city_column))
    cells = [
        F.struct(
            F.lit(f).alias("field_name"), F.col(f).cast("string").alias("original_value"), tokens[f].alias("masked_value")
        )
        for f in VAULT_FIELDS
    ]
    rows = customers.select(F.col(id_column).alias("customer_id"), F.inline(F.array(*cells)))
    if key is not None:
        rows = rows.withColumn("original_value", F.aes_encrypt("original_value", key))
    return rows.withColumns({"entity_type": F.lit(KNOWN_ENTITY), "confidence": F.lit(KNOWN_CONFIDENCE)})


def reveal(vault: DataFrame, key: Column) -> DataFrame:
    """The vault with originals decrypted."""
    return vault.withColumn("original_value", F.aes_decrypt("original_value", key).cast("string"))


def write_to_vault(vault: DataFrame, rows: DataFrame) -> DataFrame:
    """The vault after insert-or-replace by customer and field."""
    return upsert(vault, rows, ["customer_id", "field_name"])


def empty_vault(vault: DataFrame) -> DataFrame:
    """The vault with every record cleared, to be written over it."""
    return vault.limit(0)


def before_after(vault: DataFrame, limit: int = PREVIEW_IDS) -> DataFrame:
    """The vault rows of the first `limit` customers, in id and field order."""
    first = vault.select("customer_id").distinct().orderBy("customer_id").limit(limit)
    return vault.join(first, "customer_id", "left_semi").orderBy("customer_id", "field_name")


def vault_stats(vault: DataFrame) -> DataFrame:
    """(entity_type, n, avg_confidence) and a total row, from one pass; `is_total` marks the total."""
    return vault.rollup("entity_type").agg(
        F.count("*").alias("n"),
        F.round(F.avg("confidence"), 3).alias("avg_confidence"),
        (F.grouping_id() == 1).alias("is_total"),
    )

