"""Scalar expressions. All are built-in Spark functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def text_or(col: Column | str, default: str = UNKNOWN) -> Column:
    """Trimmed text; null and blank become the default."""
    return F.coalesce(F.nullif(F.trim(_col(col).cast("string")), F.lit("")), F.lit(default))


def clean_category(col: Column | str, trim: bool = False) -> Column:
    """Lower-cased category text, null as "unknown"; optionally trimmed."""
    lowered = F.lower(_col(col))
    return F.coalesce(F.trim(lowered) if trim else lowered, F.lit(UNKNOWN))


def long_or(col: Column | str, default: int = 0) -> Column:
    """Whole number read through double, so "3.7" is 3; anything unreadable is the default."""
    return F.coalesce(_col(col).try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def double_or(col: Column | str, default: float = 0.0) -> Column:
    """Double; anything unreadable (or NaN) is the default."""
    value = _col(col).try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(float(default)))


def binary_label(col: Column | str) -> Column:
    """0 or 1 read through double, null for every other value."""
    value = _col(col).try_cast("double").try_cast("bigint")
    return F.when(value.isin(0, 1), value)


def level1(code: Column | str) -> Column:
    """First token of a dotted category code."""
    return F.get(F.split(_col(code), r"\."), F.lit(0))


def level2(code: Column | str) -> Column:
    """Second token of a dotted category code, "unknown" when there is none."""
    return F.coalesce(F.get(F.split(_col(code), r"\."), F.lit(1)), F.lit(UNKNOWN))


def level1_rest(code: Column | str) -> Column:
    """First token, lower-cased; blank, null and a leading dot give "unknown"."""
    head = F.get(F.split(F.trim(_col(code)), r"\.", 2), F.lit(0))
    return F.lower(F.coalesce(F.nullif(head, F.lit("")), F.lit(UNKNOWN)))


def level2_rest(code: Column | str) -> Column:
    """Everything after the first dot, lower-cased; "unknown" when there is no dot."""
    rest = F.get(F.split(F.trim(_col(code)), r"\.", 2), F.lit(1))
    return F.lower(F.coalesce(rest, F.lit(UNKNOWN)))


def weekday(ts: Column | str, default: int | None = None) -> Column:
    """Monday 0 to Sunday 6."""
    value = F.weekday(_col(ts)).cast("bigint")
    return value if default is None else F.coalesce(value, F.lit(default).cast("bigint"))


def hour(ts: Column | str, default: int | None = None) -> Column:
    """Hour of day, 0 to 23."""
    value = F.hour(_col(ts)).cast("bigint")
    return value if default is None else F.coalesce(value, F.lit(default).cast("bigint"))


def guarded_rate(num: Column | str, den: Column | str) -> Column:
    """num / den where den > 0, else 0. Not capped."""
    return F.when(_col(den) > 0, _col(num) / _col(den)).otherwise(F.lit(0.0))


def clipped_rate(num: Column | str, den: Column | str) -> Column:
    """num / max(den, 1), at most 1; null for a null numerator."""
    rate = F.least(_col(num) / F.greatest(_col(den), F.lit(1)), F.lit(1.0))
    return F.when(_col(num).isNotNull(), rate)


def ratio_or_one(num: Column | str, den: Column | str) -> Column:
    """num / den where den > 0, else 1."""
    return F.when(_col(den) > 0, _col(num) / _col(den)).otherwise(F.lit(1.0))


def share(num: Column, den: Column, scale: float = 1.0) -> Column:
    """scale * num / den, 0 for an empty denominator."""
    return F.when(den > 0, num / den * F.lit(scale)).otherwise(F.lit(0.0))


def round_exact(col: Column | str, digits: int) -> Column:
    """Round the exact binary value to digits, ties to even: what correct decimal printing gives.

    The product with 10^d is taken together with its rounding error (by splitting the factor in
    two halves), so a value next to a tie goes to the right side. Give it a plain column: the
    expression is used several times.
    """
    x, factor = _col(col).cast("double"), float(10**digits)
    big = x * 134217729.0
    high = big - (big - x)
    product = x * factor
    error = (high * factor - product) + (x - high) * factor
    whole = F.floor(product)
    over = ((product - whole) - 0.5) + error
    odd = F.pmod(whole, F.lit(2)) == 1
    up = ((over > 0) | ((over == 0) & odd)).cast("int")
    return (whole + up) / F.lit(factor)


def hash32(*cols: Column | str, seed: int = 42) -> Column:
    """Repeatable 32-bit number from key columns and a seed, even over its range."""
    text = F.concat_ws(":", *[_col(c).cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
