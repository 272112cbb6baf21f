"""Reusable Column expressions (period parsing, number parsing, exact sums)."""

from plan_alloc.functions.columns import (
    EXACT_DECIMAL,
    NUMBER_PATTERN,
    PERIOD_PATTERNS,
    PERIOD_REWRITES,
    canonical_period_text,
    exact_sum,
    finite,
    floor_double,
    number_text,
    parse_canonical_period,
    parse_number_text,
    period_month,
    period_reason,
    quantity_reason,
    quantity_value,
    ratio,
    strip_ws,
)

__all__ = [
    "EXACT_DECIMAL",
    "NUMBER_PATTERN",
    "PERIOD_PATTERNS",
    "PERIOD_REWRITES",
    "canonical_period_text",
    "exact_sum",
    "finite",
    "floor_double",
    "number_text",
    "parse_canonical_period",
    "parse_number_text",
    "period_month",
    "period_reason",
    "quantity_reason",
    "quantity_value",
    "ratio",
    "strip_ws",
]
