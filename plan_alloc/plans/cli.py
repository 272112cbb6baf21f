"""Command-line job: ``spark-submit -m plan_alloc.plans.cli ...`` (or
``python -m plan_alloc.plans.cli`` locally).

Reads the macro and granular tables (CSV, Parquet or catalog tables), builds
targets (direct, or from an annual share with optional locks), allocates,
checks and publishes the four result tables as one run under ``<out>``. Exits
non-zero with the rule's message when a check fails.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from plan_alloc.operators import targets as TG
from plan_alloc.plans.job import run_job
from plan_alloc.sources.tables import read_table
from plan_alloc.spec import AllocError, AllocSpec


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="plan_alloc", description="Top-down plan allocation on Spark.")
    p.add_argument("--macro", required=True, help="targets (direct mode) or market totals (share mode)")
    p.add_argument("--granular", required=True, help="baseline per period, market, channel, client, sku")
    p.add_argument("--out", required=True, help="folder that receives the run (read it with read_bundle)")
    p.add_argument("--format", choices=("csv", "parquet", "table"), default=None, help="input format (default: from suffix)")
    p.add_argument("--out-format", choices=("csv", "parquet"), default="parquet")
    p.add_argument("--basis", choices=("units", "value"), default="units")
    p.add_argument("--mode", choices=("direct", "share"), default="direct")
    p.add_argument("--share", type=float, default=None, help="annual market share (share mode)")
    p.add_argument("--locks", default=None, help="lock table: period, market, channel, is_locked, locked_target")
    p.add_argument("--lock-periods", default=None, help="comma-separated months to lock at their granular totals")
    p.add_argument("--decimals", type=int, default=0, help="rounding precision (0 = whole units)")
    p.add_argument("--zero-baseline", choices=("fail", "equal_split"), default="fail")
    p.add_argument("--allow-negative", action="store_true")
    p.add_argument("--no-enforce", action="store_true", help="report integrity instead of failing the run")
    p.add_argument("--hot-group-rows", type=int, default=AllocSpec().hot_group_rows)
    p.add_argument("--hot-rows-per-task", type=int, default=AllocSpec().hot_rows_per_task)
    p.add_argument("--no-rebalance", action="store_true", help="skip rebalancing partitioned writes by period")
    p.add_argument("--ordered", action="store_true", help="sort the outputs by their keys (a global sort per table)")
    p.add_argument("--run", default=None, help="run id (default: UTC timestamp)")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parse_args(argv)
    spark = spark or SparkSession.builder.appName("plan_alloc").getOrCreate()
    spec = AllocSpec(
        quantity_mode="decimal" if args.decimals else "integer",
        quantity_decimals=args.decimals,
        zero_baseline=args.zero_baseline,
        allow_negative=args.allow_negative,
        enforce_exact_totals=not args.no_enforce,
        hot_group_rows=args.hot_group_rows,
        hot_rows_per_task=args.hot_rows_per_task,
    )
    macro = read_table(spark, args.macro, args.format)
    granular = read_table(spark, args.granular, args.format)
    locks = read_table(spark, args.locks, args.format) if args.locks else None
    if args.lock_periods:
        template = TG.lock_template(granular, args.basis, [p.strip() for p in args.lock_periods.split(",")])
        locks = template if locks is None else TG.stack_locks(locks, template)
    result = run_job(
        macro, granular, spec=spec, basis=args.basis, mode=args.mode, share=args.share, locks=locks, ordered=args.ordered
    )
    paths = result.write(args.out, fmt=args.out_format, run=args.run, rebalance=False if args.no_rebalance else None)
    result.release()
    return {"tables": paths, "integrity": result.integrity, "checks": result.counts, "groups": result.layout.describe()}


def run() -> None:
    """Console entry: print the written paths and figures as JSON; exit 2 on a
    broken rule."""
    try:
        print(json.dumps(main(), default=str))
    except AllocError as err:
        print(f"plan_alloc: {type(err).__name__}: {err}", file=sys.stderr)
        sys.exit(2)


if __name__ == "__main__":
    run()
