"""Lazy rule checks and one-job enforcement.

A ``Check`` pairs a rule with the DataFrame of rows that break it. Building a
check runs nothing. ``enforce`` counts the violations of many checks in a
single Spark job (a union of one-row aggregates) and raises the first broken
rule in the order given, so a lazy job fails the same way an eager one
would, without one job per rule.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plan_alloc.spec import AllocError


@dataclass(frozen=True)
class Check:
    name: str
    error: type[AllocError]
    message: str
    violations: DataFrame
    # When set, ``violations`` is a pre-aggregated frame and this column holds
    # the number of violating rows (lets several rules share one scan).
    count_col: str | None = None

    def count_frame(self, position: int) -> DataFrame:
        if self.count_col is None:
            n = F.count(F.lit(1))
        else:
            n = F.coalesce(F.sum(self.count_col), F.lit(0))
        return self.violations.agg(n.cast("long").alias("n")).select(F.lit(position).alias("pos"), F.col("n"))


def violation_counts(checks: list[Check]) -> dict[str, int]:
    """Number of violating rows per check, computed in one job."""
    if not checks:
        return {}
    frames = [c.count_frame(i) for i, c in enumerate(checks)]
    rows = reduce(DataFrame.unionByName, frames).collect()
    by_pos = {r["pos"]: r["n"] for r in rows}
    return {c.name: int(by_pos.get(i, 0)) for i, c in enumerate(checks)}


def enforce(checks: list[Check]) -> dict[str, int]:
    """Raise the first broken check (in list order); return all counts."""
    counts = violation_counts(checks)
    for c in checks:
        if counts[c.name] > 0:
            raise c.error(f"{c.message} ({counts[c.name]} violating rows; check '{c.name}').")
    return counts
