"""Input checks and standardising (``chk_*``, ``std_*``).

Column-level checks (duplicate names, missing columns) look at the schema on
the driver and cost nothing. Row-level rules (null keys, unreadable periods
or quantities) are counted in one pass over the table by a single aggregate;
duplicate business keys need a ``groupBy`` on the key. None of them runs
until ``enforce`` is called, which evaluates all of them in one job.

Rows that fail are not lost: ``rejects`` holds them with a reason code; a
malformed CSV line is one of them, with its raw text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plan_alloc.functions.columns import (
    _is_text,
    canonical_period_text,
    finite,
    number_text,
    parse_canonical_period,
    parse_number_text,
    period_month,
    period_reason,
    quantity_reason,
    quantity_value,
    strip_ws,
)
from plan_alloc.operators.checks import Check
from plan_alloc.session import spread
from plan_alloc.sources.csv_text import MALFORMED
from plan_alloc.spec import AllocSpec, DataError, SchemaError

REASON = "reason"

# Reject reason codes.
REASON_CODES = (
    "csv_malformed",
    "period_null",
    "period_empty",
    "period_invalid",
    "period_type",
    "qty_null",
    "qty_empty",
    "qty_non_numeric",
    "qty_type",
)


@dataclass(frozen=True)
class SchemaReport:
    dataset: str
    row_count: int
    column_count: int
    required_columns: tuple[str, ...]
    actual_columns: tuple[str, ...]


@dataclass(frozen=True)
class Standardized:
    table: DataFrame
    rejects: DataFrame
    profile: DataFrame
    checks: list[Check] = field(default_factory=list)


def duplicate_columns(columns: list[str]) -> list[str]:
    """Names that occur more than once, in order of first repetition."""
    seen: Counter[str] = Counter()
    out: list[str] = []
    for c in columns:
        seen[c] += 1
        if seen[c] == 2:
            out.append(c)
    return out


def check_columns(df: DataFrame, required: tuple[str, ...], dataset: str) -> None:
    """``chk_dup_columns`` and ``chk_missing``: schema only, no job."""
    dups = duplicate_columns(df.columns)
    if dups:
        raise SchemaError(f"{dataset} table repeats column(s): {', '.join(dups)}.")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SchemaError(f"{dataset} table lacks required column(s): {', '.join(missing)}.")


def _well_formed(df: DataFrame) -> Column:
    return F.col(MALFORMED).isNull() if MALFORMED in df.columns else F.lit(True)


def null_profile(df: DataFrame, key_columns: tuple[str, ...], dataset: str) -> DataFrame:
    """``chk_profile``/``chk_null_keys``: one row with the row count, the column
    count and the number of nulls in each key column (one scan). Malformed CSV
    lines count as rows; they have no keys to be null."""
    names = [c for c in df.columns if c != MALFORMED]
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(F.col(c).isNull() & _well_formed(df)).cast("long").alias(f"null_{c}") for c in key_columns],
    ).select(
        F.lit(dataset).alias("dataset"),
        F.col("row_count"),
        F.lit(len(names)).cast("long").alias("column_count"),
        *[F.col(f"null_{c}") for c in key_columns],
    )


def validate_schema(df: DataFrame, spec: AllocSpec, dataset: str) -> SchemaReport:
    """``chk_profile`` as a report: duplicate and missing columns (schema
    only), then null keys (one aggregate job). ``dataset`` is 'macro' or
    'granular'; raises ``SchemaError`` in that order."""
    if dataset == "macro":
        required, keys = spec.macro_required, tuple(spec.group_keys)
    elif dataset == "granular":
        required, keys = spec.granular_required, spec.granular_keys
    else:
        raise ValueError("dataset is 'macro' or 'granular'.")
    check_columns(df, required, dataset)
    row = null_profile(df, keys, dataset).first()
    nulls = [c for c in keys if row[f"null_{c}"] > 0]
    if nulls:
        raise SchemaError(f"{dataset} table has nulls in required column(s): {', '.join(nulls)}.")
    actual = tuple(c for c in df.columns if c != MALFORMED)
    return SchemaReport(dataset, int(row["row_count"]), len(actual), tuple(required), actual)


def duplicate_keys(df: DataFrame, key_columns: tuple[str, ...], rows: int | None = None) -> DataFrame:
    """``chk_dup_keys``: business keys carried by more than one row. With the number
    of ``rows`` known, they are dealt by key to as many tasks as that asks for."""
    if rows is not None:
        df = spread(df.select(*key_columns), rows, *key_columns)
    return (
        df.groupBy(*key_columns)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .filter(F.col("row_count") > 1)
    )


def annotate(df: DataFrame, spec: AllocSpec, qty_col: str) -> DataFrame:
    """Parsed period and quantity plus the first reason a row is unusable.

    Text is parsed in stages, one projection each (stripped text → canonical
    text → value), so every intermediate is computed once per row: Spark does
    not share a subexpression that sits inside a CASE branch.
    """
    schema = {f.name: f.dataType for f in df.schema.fields}
    period = spec.columns.period
    with_period = period in spec.group_keys
    p_text = with_period and _is_text(schema[period])
    q_text = _is_text(schema[qty_col])
    out = df
    stage1 = {}
    if p_text:
        stage1["_p_strip"] = strip_ws(F.col(period))
    if q_text:
        stage1["_q_strip"] = strip_ws(F.col(qty_col))
    if stage1:
        out = out.withColumns(stage1)
    stage2 = {}
    if p_text:
        stage2["_p_canon"] = canonical_period_text(F.col("_p_strip"))
    if q_text:
        stage2["_q_num"] = parse_number_text(number_text(F.col("_q_strip")))
    if stage2:
        out = out.withColumns(stage2)
    stage3 = {
        "_qty": finite(F.col("_q_num")) if q_text else quantity_value(F.col(qty_col), schema[qty_col]),
    }
    if with_period:
        stage3["_period"] = (
            parse_canonical_period(F.col("_p_canon")) if p_text else period_month(F.col(period), schema[period])
        )
    out = out.withColumns(stage3)
    reasons = []
    if MALFORMED in df.columns:
        reasons.append(F.when(~_well_formed(df), F.lit("csv_malformed")))
    if with_period:
        reasons.append(
            period_reason(
                F.col(period), schema[period], F.col("_period"), F.col("_p_strip") if p_text else None
            )
        )
    reasons.append(
        quantity_reason(F.col(qty_col), schema[qty_col], F.col("_qty"), F.col("_q_strip") if q_text else None)
    )
    out = out.withColumn(REASON, F.coalesce(*reasons))
    out = out.drop(*[c for c in ("_p_strip", "_q_strip", "_p_canon", "_q_num") if c in out.columns])
    # Optimizer barrier: the table and the rejects filter on ``reason``. Left
    # alone, Catalyst pushes that filter below these projections by
    # substituting the parse expressions into it, so every row would be parsed
    # twice (and every upstream expression copied into each reference). A
    # one-element ``inline`` is a Generate node, which filters on its output
    # cannot cross: rows are parsed once and filtered after.
    # Only the parsed columns pass through it: the others can still be pruned, and
    # filters on them still reach the scan.
    parsed = [c for c in ("_qty", "_period", REASON) if c in out.columns]
    rest = [F.col(f"`{c}`") for c in out.columns if c not in parsed]
    return out.select(*rest, F.inline(F.array(F.struct(*parsed))))


def _standardize(
    df: DataFrame,
    spec: AllocSpec,
    dataset: str,
    key_columns: tuple[str, ...],
    qty_col: str,
    carry: tuple[str, ...] = (),
    rows: int | None = None,
) -> Standardized:
    check_columns(df, (*key_columns, qty_col, *carry), dataset)
    annotated = annotate(df, spec, qty_col)
    period = spec.columns.period
    canonical = [
        (F.col("_period").alias(period) if c == period and period in spec.group_keys else F.col(c))
        for c in key_columns
    ] + [F.col("_qty").alias(qty_col)] + [F.col(c) for c in carry]
    table = annotated.filter(F.col(REASON).isNull()).select(*canonical)
    rejects = annotated.filter(F.col(REASON).isNotNull()).select(*df.columns, REASON)
    profile = null_profile(df, key_columns, dataset)
    any_null = F.lit(False)
    for c in key_columns:
        any_null = any_null | F.col(c).isNull()
    rule_counts = annotated.agg(
        F.count_if(any_null & _well_formed(df)).cast("long").alias("null_keys"),
        F.count_if(F.col(REASON).isNotNull()).cast("long").alias("rejected"),
    )
    checks = [
        Check(
            f"{dataset}_null_keys",
            SchemaError,
            f"{dataset} table has nulls in key column(s) {', '.join(key_columns)}",
            rule_counts,
            count_col="null_keys",
        ),
        Check(
            f"{dataset}_rejected_values",
            DataError,
            f"{dataset} table has unreadable period or quantity values (see rejects)",
            rule_counts,
            count_col="rejected",
        ),
        Check(
            f"{dataset}_duplicate_keys",
            DataError,
            f"{dataset} table repeats business keys {', '.join(key_columns)}",
            duplicate_keys(table, key_columns, rows),
        ),
    ]
    return Standardized(table=table, rejects=rejects, profile=profile, checks=checks)


def standardize_macro(df: DataFrame, spec: AllocSpec, carry: tuple[str, ...] = ()) -> Standardized:
    """``std_macro``: one target per control group, period as first of month.
    ``carry``: extra columns passed through unchanged."""
    return _standardize(df, spec, "macro", tuple(spec.group_keys), spec.columns.target, carry)


def standardize_granular(df: DataFrame, spec: AllocSpec, carry: tuple[str, ...] = (), rows: int | None = None) -> Standardized:
    """``std_granular``: one baseline per group, client and sku.
    ``carry``: extra columns passed through unchanged. ``rows``: their number, if known."""
    return _standardize(df, spec, "granular", spec.granular_keys, spec.columns.baseline, carry, rows)
