"""Number expressions: finiteness, exact decimals, safe rates, versions, times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EXACT = "decimal(38,20)"


def finite(value: Column) -> Column:
    """True for a present number that is neither NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite_or_null(value: Column) -> Column:
    return F.when(finite(value), value)


def exact_decimal(value: Column) -> Column:
    """The decimal written by the number's shortest text; NULL if not finite."""
    return finite_or_null(value).cast("string").cast(EXACT)


def exact_difference(left: Column, right: Column) -> Column:
    return (exact_decimal(left) - exact_decimal(right)).cast("double")


def rate(numerator: Column, denominator: Column) -> Column:
    """Numerator over denominator; nothing out of nothing counts as one."""
    return F.when(denominator == 0, F.lit(1.0)).otherwise(numerator.cast("double") / denominator)


def fraction(numerator: Column, denominator: Column) -> Column:
    """Numerator over denominator; nothing out of nothing counts as zero."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator.cast("double") / denominator)


def version_key(text: Column) -> Column:
    """Dotted version as an integer array (compares numerically); NULL if malformed."""
    return F.when(F.trim(text).rlike(r"^[0-9]+(\.[0-9]+)*$"), F.split(F.trim(text), "[.]").cast("array<int>"))


def zoned_timestamp(text: Column) -> Column:
    """ISO date-time with a mandatory zone, as a UTC timestamp; NULL otherwise."""
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$")
    return F.when(zoned, F.try_to_timestamp(text))


def json_number(raw: Column) -> Column:
    """A JSON token as a finite double; NULL for strings, words and non-finite values."""
    looks = F.trim(raw).rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")
    return F.when(looks, finite_or_null(F.trim(raw).try_cast("double")))
