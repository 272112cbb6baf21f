"""Column expressions shared by the operators.

All of them are built-in Catalyst expressions, so they compile into the
whole-stage-codegen span of whatever projection uses them.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values (must agree with the reference behaviour): the period text
# formats accepted (strptime spelling: %Y-%m, %Y-%m-%d, %Y/%m, %Y/%m/%d,
# %d/%m/%Y). Parsing goes through PERIOD_REWRITES below, one rewrite per format.
PERIOD_PATTERNS = ("yyyy-M", "yyyy-M-d", "yyyy/M", "yyyy/M/d", "d/M/yyyy")
# Each accepted format is first rewritten to the canonical yyyy-M-d text by
# one anchored rewrite (fixed values; d/M/yyyy, yyyy/M/d, yyyy/M, yyyy-M in
# turn), then parsed once. A value matching no shape is left as it is and
# fails the final shape test, so mixed forms such as 2026/01-05 stay invalid.
# One parse per value: a failed parse raises inside Spark, so trying five
# formats per value would cost up to four raised errors per row.
PERIOD_REWRITES = (
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "$3-$2-$1"),
    (r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})$", "$1-$2-$3"),
    (r"^([0-9]{4})/([0-9]{1,2})$", "$1-$2"),
    (r"^([0-9]{4})-([0-9]{1,2})$", "$1-$2-1"),
)
CANONICAL_SHAPE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
CANONICAL_PATTERN = "yyyy-M-d"

# A quantity given as text: optional sign, digits with an optional fraction
# (or a bare fraction), optional exponent. Commas are removed first.
NUMBER_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Scale used for exact, order-independent sums of input quantities.
EXACT_DECIMAL = T.DecimalType(28, 9)


# Whitespace stripped around periods and quantities (``trim`` alone only
# removes spaces): space, tab, newline, vertical tab, form feed, carriage return.
WHITESPACE = " \t\n\x0b\x0c\r"


def strip_ws(c: Column) -> Column:
    """Trim leading/trailing whitespace (a character-set trim, no regex)."""
    return F.btrim(c, F.lit(WHITESPACE))


def canonical_period_text(stripped: Column) -> Column:
    """Stripped period text rewritten to ``yyyy-M-d`` when it has an accepted
    shape (left unchanged otherwise)."""
    s = stripped
    for pattern, replacement in PERIOD_REWRITES:
        s = F.regexp_replace(s, pattern, replacement)
    return s


def parse_canonical_period(canonical: Column) -> Column:
    """First of month of a canonical ``yyyy-M-d`` text; null when not a date."""
    return F.trunc(F.when(canonical.rlike(CANONICAL_SHAPE), F.try_to_date(canonical, CANONICAL_PATTERN)), "month")


def number_text(stripped: Column) -> Column:
    """Stripped quantity text without thousands separators."""
    return F.translate(stripped, ",", "")


def parse_number_text(text: Column) -> Column:
    """DOUBLE of a number text (null unless it has the accepted shape)."""
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def finite(d: Column) -> Column:
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def _is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def _is_datelike(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def period_month(c: Column, dtype: T.DataType) -> Column:
    """First day of the month of a period given as text, date or timestamp.

    Null where the value is missing or cannot be read (see ``period_reason``).
    """
    if _is_datelike(dtype):
        return F.trunc(c.cast("date"), "month")
    if _is_text(dtype):
        return parse_canonical_period(canonical_period_text(strip_ws(c)))
    return F.lit(None).cast("date")


def period_reason(
    c: Column, dtype: T.DataType, parsed: Column | None = None, stripped: Column | None = None
) -> Column:
    """Why a period value is rejected, or null when it is usable.
    ``parsed``/``stripped``: already computed ``period_month`` / stripped text."""
    if _is_datelike(dtype):
        return F.when(c.isNull(), F.lit("period_null"))
    if _is_text(dtype):
        month = parsed if parsed is not None else period_month(c, dtype)
        text = stripped if stripped is not None else strip_ws(c)
        return (
            F.when(c.isNull(), F.lit("period_null"))
            .when(text == "", F.lit("period_empty"))
            .when(month.isNull(), F.lit("period_invalid"))
        )
    return F.when(c.isNull(), F.lit("period_null")).otherwise(F.lit("period_type"))


def _is_number(dtype: T.DataType) -> bool:
    return isinstance(
        dtype,
        (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType),
    )


def quantity_value(c: Column, dtype: T.DataType) -> Column:
    """A quantity as DOUBLE; null when it is missing or unusable (see ``quantity_reason``)."""
    if _is_number(dtype):
        return finite(c.cast("double"))
    if _is_text(dtype):
        return finite(parse_number_text(number_text(strip_ws(c))))
    return F.lit(None).cast("double")


def quantity_reason(
    c: Column, dtype: T.DataType, parsed: Column | None = None, stripped: Column | None = None
) -> Column:
    """Why a quantity value is rejected, or null when it is usable.
    ``parsed``/``stripped``: already computed ``quantity_value`` / stripped text."""
    value = parsed if parsed is not None else quantity_value(c, dtype)
    if _is_number(dtype):
        return F.when(c.isNull(), F.lit("qty_null")).when(value.isNull(), F.lit("qty_non_numeric"))
    if _is_text(dtype):
        text = stripped if stripped is not None else strip_ws(c)
        return (
            F.when(c.isNull(), F.lit("qty_null"))
            .when(text == "", F.lit("qty_empty"))
            .when(value.isNull(), F.lit("qty_non_numeric"))
        )
    if isinstance(dtype, T.BooleanType):
        return F.when(c.isNull(), F.lit("qty_null")).otherwise(F.lit("qty_non_numeric"))
    return F.when(c.isNull(), F.lit("qty_null")).otherwise(F.lit("qty_type"))


# Doubles of this size and more are whole numbers; they are summed as such, below
# ``BEYOND`` with room for 1e11 of them. Larger ones are refused.
WHOLE, BEYOND = 1e18, 1e27
WHOLE_DECIMAL = T.DecimalType(38, 0)


def exact_sum(c: Column | str, decimals: int = 0, over: WindowSpec | None = None) -> Column:
    """Sum (over a window, if one is given) of doubles through decimal types, so
    independent of row order and partitioning; 0 (not null) for a group without
    values. Each value counts to nine decimals (or to three more than ``decimals``,
    if that is finer). Values of 1e18 to 1e27 are summed apart, as whole numbers,
    and added; a finite value of 1e27 or more is an error (infinite ones and NaN are
    left out, as nulls are)."""
    col = F.col(c) if isinstance(c, str) else c
    total = lambda part: F.sum(part) if over is None else F.sum(part).over(over)
    if decimals + 3 > EXACT_DECIMAL.scale:
        return F.coalesce(total(col.cast(T.DecimalType(38, min(decimals + 3, 30)))).cast("double"), F.lit(0.0))
    size = F.abs(col)
    usual = F.coalesce(total(F.when(size < WHOLE, col).cast(EXACT_DECIMAL)).cast("double"), F.lit(0.0))
    refused = F.raise_error(F.concat(F.lit("A value is too large to be summed exactly: "), col.cast("string"))).cast("double")
    large = F.when((size >= WHOLE) & (size < BEYOND), col).when((size >= BEYOND) & (size < float("inf")), refused)
    whole = total(large.cast(WHOLE_DECIMAL)).cast("double")
    return F.when(whole.isNull(), usual).otherwise(usual + whole)


# Decimal types for a group's total, by the group's largest magnitude: groups
# below 1 are summed to 27 decimals, groups from 1e18 on to six.
TINY, HUGE = 1.0, 1e18
_TOTALS = {"tiny": T.DecimalType(38, 27), "huge": T.DecimalType(38, 6)}


def exact_total(c: Column | str) -> Column:
    """Sum of a group's baselines at a scale that suits the group: as
    ``exact_sum``, but small fractions keep their proportions and values beyond
    the usual range add up. The scale follows from the largest magnitude, so the
    result does not depend on row order or partitioning."""
    col = F.col(c) if isinstance(c, str) else c
    size = F.abs(col)
    top = F.coalesce(F.max(size), F.lit(0.0))
    tiny = F.sum(F.when(size < TINY, col).cast(_TOTALS["tiny"])).cast("double")
    usual = F.sum(F.when(size < HUGE, col).cast(EXACT_DECIMAL)).cast("double")
    huge = F.sum(F.when(size < 1e30, col).cast(_TOTALS["huge"])).cast("double")
    return F.coalesce(F.when(top < TINY, tiny).when(top < HUGE, usual).otherwise(huge), F.lit(0.0))


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, null when the denominator is 0 or null (ANSI-safe)."""
    return F.when(den != 0, num / den)


def floor_double(c: Column) -> Column:
    """``floor`` kept as DOUBLE. Spark's floor(double) is BIGINT and saturates
    beyond 2^63; every double of magnitude 2^52 or more is already whole, so
    those are returned as they are."""
    return F.when(F.abs(c) < F.lit(float(2**52)), F.floor(c).cast("double")).otherwise(c)
