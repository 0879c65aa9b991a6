"""Number parsing, half-up rounding and number printing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthmark.functions.text import WHITESPACE


def half_up(value: Column) -> Column:
    """Round halves towards plus infinity (Spark's ``round`` moves them away from zero)."""
    return F.floor(value + F.lit(0.5))


def one_decimal(value: Column) -> Column:
    return F.floor(value * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)


def parse_number(text: Column) -> Column:
    """Tolerant number: the last of comma and dot is the decimal mark."""
    kept = F.regexp_replace(F.regexp_replace(text, WHITESPACE, ""), r"[^\d.,-]", "")
    after_comma = F.length(F.substring_index(kept, ",", -1))
    after_dot = F.length(F.substring_index(kept, ".", -1))
    comma_last = F.contains(kept, F.lit(",")) & (after_comma < after_dot)
    french = F.regexp_replace(F.regexp_replace(kept, r"\.", ""), "^([^,]*),", "$1.")
    english = F.regexp_replace(kept, ",", "")
    plain = F.when(comma_last, french).otherwise(english)
    return F.when(plain.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))


def number_text(value: Column) -> Column:
    """Shortest decimal print of a double: no exponent, no trailing zeros."""
    wide = F.regexp_replace(
        F.regexp_replace(value.cast("string").cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"),
        r"\.$",
        "",
    )
    return (
        F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("bigint").cast("string"))
        .when((F.abs(value) >= 1e-3) & (F.abs(value) < 1e7), value.cast("string"))
        .otherwise(wide)
    )


def proximity(left: Column, right: Column) -> Column:
    """Relative closeness of two numbers in 0..1; equal numbers (zeros too) give 1."""
    widest = F.greatest(F.abs(left), F.abs(right))
    near = F.lit(1.0) - F.abs(left - right) / widest
    return (
        F.when(left.isNull() | right.isNull(), F.lit(None).cast("double"))
        .when(widest == 0, F.lit(1.0))
        .when(near < 0, F.lit(0.0))
        .otherwise(near)
    )


def range_fit(value: Column, low: Column, high: Column, margin: float = 0.25) -> Column:
    """1 inside the range, then a linear decay over a share of the violated bound."""

    def decay(gap: Column, bound: Column) -> Column:
        reach = F.greatest(F.lit(1.0), F.abs(bound) * F.lit(margin))
        return F.greatest(F.lit(0.0), F.lit(1.0) - gap / reach)

    return (
        F.when(low.isNotNull() & (value < low), decay(low - value, low))
        .when(high.isNotNull() & (value > high), decay(value - high, high))
        .otherwise(F.lit(1.0))
    )


def percent_change(before: Column, after: Column) -> Column:
    """Change in percent to one decimal; null when either price is missing or zero."""
    return F.when(
        (before != 0) & (after != 0),
        F.floor((after - before) / before * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0),
    )
