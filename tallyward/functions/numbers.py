"""Rounding, safe division and number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Correlation labels and their lower bounds on |r|, strongest first.
STRENGTH_BOUNDS = (("strong", 0.6), ("moderate", 0.3))
WEAKEST_STRENGTH = "weak"


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to two decimals, ties to even; 0.0 when there is no whole."""
    share = part.cast("double") / whole.cast("double") * 100.0
    return F.when(whole > 0, F.rint(share * 100.0) / 100.0).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / max(whole, 1), rounded."""
    return F.round(part.cast("double") / F.greatest(whole, F.lit(1)).cast("double"), digits)


def z_score(value: Column, mean: Column, std: Column) -> Column:
    """Unrounded z; null when the spread is zero or unknown."""
    return F.when(std > 0, (value.cast("double") - mean) / std)


def grouped_number(value: Column, digits: int = 2) -> Column:
    """1234.5 -> '1,234.50'."""
    return F.format_number(value, digits)


def correlation_strength(r: Column) -> Column:
    """Label of a correlation by its absolute size."""
    label = F.lit(WEAKEST_STRENGTH)
    for name, bound in reversed(STRENGTH_BOUNDS):
        label = F.when(F.abs(r) > bound, F.lit(name)).otherwise(label)
    return label


def looks_like_date(key: Column) -> Column:
    """Text of the shape YYYY-MM…: at least seven characters with a dash in fifth place."""
    text = key.cast("string")
    return (F.length(text) >= 7) & text.rlike(r"^(?s).{4}-")


def zero_padded(number: Column, width: int) -> Column:
    """Zero-padded text that never truncates a longer number; the sign stays in front."""
    text = number.cast("string")
    negative = text.startswith("-")
    digits = F.when(negative, F.substring(text, 2, 2**31 - 1)).otherwise(text)
    room = F.greatest(F.lit(width) - F.when(negative, F.lit(1)).otherwise(F.lit(0)), F.length(digits))
    return F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), F.lpad(digits, room, F.lit("0")))
