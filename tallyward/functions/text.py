"""Question text: normalising, stemming, keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks as Unicode sees them plus the four ASCII separators that count as blanks in question text.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
TRAILING_MARKS = r"[?!.,]+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value worked out once per row, also where a lambda inside it uses the value many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_blanks(text: Column) -> Column:
    """Drop leading and trailing blanks of any kind."""
    return F.regexp_replace(text, rf"^{BLANKS}|{BLANKS}$", "")


def normalize_question(question: Column) -> Column:
    """Lower case, single blanks, no closing punctuation."""
    text = F.regexp_replace(trim_blanks(F.lower(question)), BLANKS, " ")
    return trim_blanks(F.regexp_replace(text, TRAILING_MARKS, ""))


def words(text: Column) -> Column:
    """Lowered blank-separated words."""
    return F.filter(F.split(F.lower(text), BLANKS), lambda word: word != "")


def stem(word: Column) -> Column:
    """Strip every trailing plural s."""
    return F.rtrim(word, F.lit("s"))


def sorted_map_json(pairs: Column) -> Column:
    """A string map as JSON text with its keys in order and blanks after the separators."""
    entry = lambda kv: F.concat(_json_text(kv["key"]), F.lit(": "), _json_text(kv["value"]))
    body = F.array_join(F.transform(F.array_sort(F.map_entries(pairs)), entry), ", ")
    return F.coalesce(F.concat(F.lit("{"), body, F.lit("}")), F.lit("{}"))


def _json_text(value: Column) -> Column:
    # One-element array through to_json gives correct escaping; the brackets go again.
    quoted = F.to_json(F.array(value))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def question_key(tenant: Column, dataset: Column, question: Column, filters: Column) -> Column:
    """SHA-256 over tenant, dataset, normalised question and sorted filters, joined by a pipe."""
    blank = F.lit("")
    parts = [
        F.coalesce(tenant.cast("string"), blank),
        F.coalesce(dataset.cast("string"), blank),
        normalize_question(question),
        sorted_map_json(filters),
    ]
    return F.sha2(F.concat_ws("|", *parts), 256)
