"""Patterns and tokens of the PII operators, and the column tests built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values -------------------------------------------------------------------------------------
# Keywords that mark a column as personal by its name.
NAME_KEYWORDS = (
    "email", "phone", "name", "address", "ssn", "credit", "card",
    "password", "dob", "birth", "social", "account",
)
# Replacement by keyword in the column name, first hit wins.
NAME_TOKENS = (
    ("email", "customer.masked@masked.local"),
    ("phone", "+91-XXXXX-XXXXX"),
    ("name", "Customer [REDACTED]"),
    ("address", "[REDACTED]"),
)
VALUE_TOKEN = "[REDACTED - possible PII detected]"

# Cheap test: an at sign, a long digit run, or two capitalised words.
PREFILTER = r"(?U)@|(\+?\d[\d\-\s]{7,}\d)|(\b[A-Z][a-z]+\s[A-Z][a-z]+\b)"
# Leak test, by kind and in reporting order.
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?U)\b(?:\+?\d[\d\-\s]{7,}\d)\b"
ADDRESS = (
    r"(?iU)\b\d{1,5}\s+[A-Za-z][A-Za-z\s]+"
    r"(?:St|Street|Ave|Avenue|Rd|Road|Dr|Drive|Ln|Lane|Blvd|Boulevard|Way|Ct|Court|Pkwy|Parkway)\b"
)
# -------------------------------------------------------------------------------------------------------

LEAK_PATTERNS = (("email", EMAIL), ("phone", PHONE), ("address", ADDRESS))
# A calendar date or time stamp has the shape of a digit run but is no phone number.
CALENDAR_VALUE = r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*$"


def prefilter_hit(text: Column) -> Column:
    """May the text hold personal data? False for null and empty text."""
    return F.coalesce(text.rlike(PREFILTER), F.lit(False))


def leak_hit(text: Column) -> Column:
    """Does the text hold an e-mail address, phone number or street address?"""
    return F.coalesce(has_email(text) | text.rlike(PHONE) | text.rlike(ADDRESS), F.lit(False))


def has_email(text: Column) -> Column:
    """The e-mail pattern, tried only on text with an at sign."""
    return text.contains("@") & text.rlike(EMAIL)


def leak_matches(text: Column) -> Column:
    """Every match as 'kind:match', kinds in fixed order."""
    found = F.concat(*[_labelled(text, kind, pattern) for kind, pattern in LEAK_PATTERNS])
    return F.coalesce(found, F.array().cast("array<string>"))


def _labelled(text: Column, kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.concat(F.lit(f"{kind}:"), m))


def personal_value(text: Column) -> Column:
    """Is a table cell personal: an e-mail address, or a phone-shaped value that is not a calendar value?

    Stands in for entity recognition by a model, see the README.
    """
    return F.coalesce(has_email(text) | (text.rlike(PHONE) & ~text.rlike(CALENDAR_VALUE)), F.lit(False))
