"""plan_alloc: top-down plan allocation as lazy Spark DataFrame operators."""

from plan_alloc.spec import (
    AllocError,
    AllocSpec,
    AllocationError,
    ColumnNames,
    DataError,
    IntegrityError,
    SchemaError,
    SpecError,
    TargetError,
    ZeroBaselineError,
)

from plan_alloc.plans.job import JobResult, run_job, run_stages  # noqa: E402
from plan_alloc.sources.tables import read_table, write_bundle  # noqa: E402

__all__ = [
    "JobResult",
    "read_table",
    "run_job",
    "run_stages",
    "write_bundle",
    "AllocError",
    "AllocSpec",
    "AllocationError",
    "ColumnNames",
    "DataError",
    "IntegrityError",
    "SchemaError",
    "SpecError",
    "TargetError",
    "ZeroBaselineError",
]
