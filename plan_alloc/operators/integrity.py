"""Integrity of a rounded allocation (``int_*``).

Per-group control totals, negative rows and a one-row summary. The summary
is a global aggregate over a union of one-row aggregates (no join), so it
costs one job whatever the inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plan_alloc.functions.columns import exact_sum
from plan_alloc.operators.allocate import FINAL
from plan_alloc.operators.checks import Check
from plan_alloc.spec import AllocSpec, IntegrityError

SUMMARY_COLUMNS = (
    "validated_group_count",
    "groups_with_gap_count",
    "negative_allocation_count",
    "unmatched_macro_group_count",
    "unmatched_granular_group_count",
)

# Failure reasons, in the order they are reported.
REASONS = (
    ("groups_with_gap_count", "some groups' final totals miss their target"),
    ("negative_allocation_count", "some final allocations are negative"),
    ("unmatched_macro_group_count", "some targets have no baseline rows"),
    ("unmatched_granular_group_count", "some baseline groups have no target"),
)


@dataclass(frozen=True)
class Integrity:
    summary: DataFrame
    group_checks: DataFrame
    negative_allocations: DataFrame
    unmatched_macro: DataFrame
    unmatched_granular: DataFrame
    counts: DataFrame | None = None  # one row: groups, groups with a gap, negative rows


def _group_facts(rounded: DataFrame, spec: AllocSpec) -> DataFrame:
    """``group_checks`` and each group's negative rows, from one aggregate."""
    target = spec.columns.target
    gap = F.col(target) - F.col("final_allocated_total")
    return (
        rounded.groupBy(*spec.keys)
        .agg(
            F.max(target).alias(target),
            exact_sum(FINAL, spec.quantity_decimals).alias("final_allocated_total"),
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(F.col(FINAL) < 0).alias("_negative_rows"),
        )
        .withColumns(
            {
                "allocation_gap": gap,
                "exact_match": F.col(target) == F.col("final_allocated_total"),
                "absolute_gap": F.abs(gap),
                "within_tolerance": F.abs(gap) <= F.lit(spec.tolerance + spec.slack),
            }
        )
    )


def group_checks(rounded: DataFrame, spec: AllocSpec) -> DataFrame:
    return _group_facts(rounded, spec).drop("_negative_rows")


def validate_integrity(
    rounded: DataFrame,
    unmatched_macro: DataFrame,
    unmatched_granular: DataFrame,
    spec: AllocSpec,
) -> Integrity:
    needed = {*spec.group_keys, spec.columns.target, FINAL}
    missing = sorted(needed - set(rounded.columns))
    if missing:
        raise IntegrityError(f"Integrity checks need column(s) {', '.join(missing)}.")
    facts = _group_facts(rounded, spec)
    # The allocation is read once: gaps and negative rows come from one aggregate.
    counts = facts.agg(
        F.count(F.lit(1)).alias("validated_group_count"),
        F.count_if(~F.col("within_tolerance")).alias("groups_with_gap_count"),
        F.coalesce(F.sum("_negative_rows"), F.lit(0)).alias("negative_allocation_count"),
    )
    stacked = (
        counts.unionByName(unmatched_macro.agg(F.count(F.lit(1)).alias("unmatched_macro_group_count")), allowMissingColumns=True)
        .unionByName(
            unmatched_granular.agg(F.count(F.lit(1)).alias("unmatched_granular_group_count")), allowMissingColumns=True
        )
    )
    summary = stacked.agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in SUMMARY_COLUMNS])
    negative_fails = F.lit(False) if spec.allow_negative else F.col("negative_allocation_count") > 0
    invalid = (
        (F.col("groups_with_gap_count") > 0)
        | negative_fails
        | (F.col("unmatched_macro_group_count") > 0)
        | (F.col("unmatched_granular_group_count") > 0)
    )
    summary = summary.withColumn("is_valid", ~invalid)
    return Integrity(
        summary=summary,
        group_checks=facts.drop("_negative_rows"),
        negative_allocations=rounded.filter(F.col(FINAL) < 0),
        unmatched_macro=unmatched_macro,
        unmatched_granular=unmatched_granular,
        counts=counts,
    )


def enforce_integrity(result: Integrity, spec: AllocSpec) -> dict:
    """Collect the one-row summary; raise with every failed reason (in fixed
    order) when exact totals are enforced and the result is not valid."""
    return raise_if_invalid(result.summary.first().asDict(), spec)


SUMMARY_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in SUMMARY_COLUMNS] + [T.StructField("is_valid", T.BooleanType())]
)


def count_checks(result: Integrity) -> list[Check]:
    """The summary's counts as count-only checks, so a job can compute them in
    the same single Spark job as its rule checks (see ``checks.violation_counts``)."""
    counted = ("validated_group_count", "groups_with_gap_count", "negative_allocation_count")
    return [
        *[Check(c, IntegrityError, "", result.counts, count_col=c) for c in counted],
        Check("unmatched_macro_group_count", IntegrityError, "", result.unmatched_macro),
        Check("unmatched_granular_group_count", IntegrityError, "", result.unmatched_granular),
    ]


def summary_from_counts(spark: SparkSession, counts: dict, spec: AllocSpec) -> tuple[dict, DataFrame]:
    """The one-row summary (as a dict and a DataFrame) from collected counts."""
    row = {c: int(counts[c]) for c in SUMMARY_COLUMNS}
    negative_fails = row["negative_allocation_count"] > 0 and not spec.allow_negative
    row["is_valid"] = not (
        row["groups_with_gap_count"] > 0
        or negative_fails
        or row["unmatched_macro_group_count"] > 0
        or row["unmatched_granular_group_count"] > 0
    )
    return row, spark.createDataFrame([tuple(row[c] for c in (*SUMMARY_COLUMNS, "is_valid"))], SUMMARY_SCHEMA)


def raise_if_invalid(row: dict, spec: AllocSpec) -> dict:
    """``int_enforce``: every failed reason, in fixed order."""
    if spec.enforce_exact_totals and not row["is_valid"]:
        reasons = [
            text
            for col, text in REASONS
            if row[col] > 0 and not (col == "negative_allocation_count" and spec.allow_negative)
        ]
        raise IntegrityError("The allocation is not valid: " + "; ".join(reasons) + ".")
    return row
