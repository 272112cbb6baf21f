import os
import tempfile

import pytest
from pyspark.sql import functions as F

from plan_alloc import AllocSpec
from plan_alloc.plans.job import run_job, run_stages
from plan_alloc.sources.tables import BUNDLE_TABLES, read_table, write_bundle
from plan_alloc.spec import DataError, IntegrityError, TargetError

from datetime import date

from conftest import JAN, rows

G = "period string, market string, channel string, client string, sku string, baseline_qty double, baseline_value double"
M = "period string, market string, channel string, macro_target_qty double, macro_target_value double"


def _inputs(spark):
    granular = spark.createDataFrame(
        [("2026-01-01", "N", "Web", "c", "a", 60.0, 600.0), ("2026-01-01", "N", "Web", "c", "b", 40.0, 400.0)], G
    )
    macro = spark.createDataFrame([("2026-01-01", "N", "Web", 120.0, 1500.0)], M)
    return macro, granular


def test_units_basis(spark):
    macro, granular = _inputs(spark)
    res = run_job(macro, granular, basis="units")
    assert rows(res.final_allocations, "sku", "final_allocated_qty", "final_allocated_value") == [
        ("a", 72.0, 720.0),
        ("b", 48.0, 480.0),
    ]
    assert res.integrity["is_valid"] is True
    g = res.group_summary.first()
    assert g["final_allocated_group_qty"] == 120.0 and g["row_count"] == 2
    res.release()


def test_value_basis(spark):
    granular = spark.createDataFrame(
        [("2026-01-01", "N", "Web", "c", "a", 10.0, 100.0), ("2026-01-01", "N", "Web", "c", "b", 20.0, 200.0)], G
    )
    macro = spark.createDataFrame([("2026-01-01", "N", "Web", None, 330.0)], M)
    res = run_job(macro, granular, basis="value")
    assert rows(res.final_allocations, "sku", "final_allocated_value", "final_allocated_qty", "macro_target_value") == [
        ("a", 110.0, 11.0, 330.0),
        ("b", 220.0, 22.0, 330.0),
    ]
    res.release()


def test_share_mode_needs_share(spark):
    macro, granular = _inputs(spark)
    with pytest.raises(TargetError):
        run_job(macro, granular, mode="share")


def test_unmatched_macro_group_fails_the_run(spark):
    macro, granular = _inputs(spark)
    extra = spark.createDataFrame([("2026-02-01", "N", "Web", 5.0, 50.0)], M)
    with pytest.raises(IntegrityError, match="targets have no baseline"):
        run_job(macro.unionByName(extra), granular)


def test_write_and_read_back(spark):
    macro, granular = _inputs(spark)
    res = run_job(macro, granular)
    base = tempfile.mkdtemp(prefix="plan_alloc_out_")
    paths = res.write(base, fmt="csv", run="t1")
    assert list(paths) == list(BUNDLE_TABLES)
    back = read_table(spark, paths["group_summary"], fmt="csv")
    assert back.first()["final_allocated_group_qty"] == "120.0"
    assert os.path.isdir(os.path.join(paths["final_allocations"], "period=2026-01-01"))
    paths = res.write(base, fmt="parquet", run="t2")
    fa = read_table(spark, paths["final_allocations"], fmt="parquet")
    assert fa.count() == 2
    res.release()


def test_bundle_checks_and_formats(spark):
    with pytest.raises(DataError):
        write_bundle({"final_allocations": None}, "/tmp/nowhere")
    with pytest.raises(DataError, match="Unsupported input"):
        read_table(spark, "/tmp/file.xlsx")


def test_csv_input_through_stages(spark):
    folder = tempfile.mkdtemp(prefix="plan_alloc_in_")
    with open(os.path.join(folder, "granular.csv"), "w") as fh:
        fh.write("period,market,channel,client,sku,baseline_qty\n2026-01,N,Web,c,a,\"1,000\"\n2026-01,N,Web,c,b,3000\n")
    with open(os.path.join(folder, "macro.csv"), "w") as fh:
        fh.write("period,market,channel,macro_target_qty\n2026-01-01,N,Web,10\n")
    granular = read_table(spark, os.path.join(folder, "granular.csv"))
    macro = read_table(spark, os.path.join(folder, "macro.csv"))
    out = run_stages(macro, granular, AllocSpec())
    assert rows(out["allocations"], "sku", "final_allocated_qty") == [("a", 3.0), ("b", 7.0)]
    assert out["integrity_summary"].first()["is_valid"] is True
    assert rows(out["sku_variance"], "sku", "final_weight") == [("a", 0.3), ("b", 0.7)]
    assert rows(out["group_summary"], "period", "final_allocated_group_qty") == [(JAN, 10.0)]


def test_hot_groups_do_not_change_the_job(spark):
    from plan_alloc.sources.cube import Cube, granular_cube, macro_cube

    from conftest import SF_SMALL

    cube = Cube(channel="status")
    cols = ("period", "market", "channel", "client", "sku", "final_allocated_qty", "final_allocated_value")
    lenient = dict(enforce_exact_totals=False)
    base = run_job(macro_cube(spark, SF_SMALL, cube), granular_cube(spark, SF_SMALL, cube), spec=AllocSpec(**lenient))
    hot = run_job(
        macro_cube(spark, SF_SMALL, cube),
        granular_cube(spark, SF_SMALL, cube),
        spec=AllocSpec(hot_group_rows=2, broadcast_group_limit=0, **lenient),
    )
    assert hot.layout.hot_keys is not None and not hot.layout.broadcast
    assert rows(hot.final_allocations, *cols) == rows(base.final_allocations, *cols)
    assert hot.integrity == base.integrity
    assert rows(hot.sku_variance, "sku", "client", "final_weight_value") == rows(base.sku_variance, "sku", "client", "final_weight_value")
    base.release()
    hot.release()


def test_rebalanced_write(spark):
    macro, granular = _inputs(spark)
    res = run_job(macro, granular)
    paths = res.write(tempfile.mkdtemp(prefix="plan_alloc_rb_"), run="r", rebalance=True)
    assert read_table(spark, paths["sku_variance"], fmt="parquet").count() == 2
    res.release()


def test_materialize_uses_checkpoint_folder(spark):
    from plan_alloc.session import checkpoint_dir, materialize

    df = materialize(spark.range(5), "t")
    assert df.count() == 5
    assert checkpoint_dir(spark).rstrip("/").split("/")[-1] in df.inputFiles()[0]


def test_command_line_job(spark):
    from plan_alloc.plans import cli

    folder = tempfile.mkdtemp(prefix="plan_alloc_cli_")
    with open(os.path.join(folder, "granular.csv"), "w") as fh:
        fh.write("period,market,channel,client,sku,baseline_qty,baseline_value\n")
        fh.write("2026-01-01,GEN,Retail,c,a,30,150\n2026-02-01,GEN,Retail,c,a,10,50\n2026-03-01,GEN,Retail,c,a,10,50\n")
    with open(os.path.join(folder, "market.csv"), "w") as fh:
        fh.write("period,market,channel,total_market_qty,total_market_value\n")
        for m in ("01", "02", "03"):
            fh.write(f"2026-{m}-01,GEN,Retail,200,1000\n")
    out = cli.main(
        [
            "--macro", os.path.join(folder, "market.csv"),
            "--granular", os.path.join(folder, "granular.csv"),
            "--out", os.path.join(folder, "out"),
            "--mode", "share", "--share", "0.25", "--lock-periods", "2026-01-01", "--run", "cli",
        ],
        spark=spark,
    )
    assert out["integrity"]["is_valid"] is True
    assert out["groups"]["groups"] == 3 and out["groups"]["largest_group_rows"] == 1
    assert out["groups"]["hot_groups"] == 0 and out["groups"]["per_group_tables_broadcast"] is True
    fa = read_table(spark, out["tables"]["final_allocations"], fmt="parquet")
    # annual 150; January locked at its granular 30; 120 left over two equal months
    assert rows(fa, "period", "final_allocated_qty") == [
        (JAN, 30.0),
        (date(2026, 2, 1), 60.0),
        (date(2026, 3, 1), 60.0),
    ]


def test_validate_schema_report(spark):
    from plan_alloc.operators.standardize import validate_schema
    from plan_alloc.spec import SchemaError

    macro, granular = _inputs(spark)
    rep = validate_schema(granular, AllocSpec(), "granular")
    assert rep.row_count == 2 and rep.column_count == 7
    assert rep.required_columns == ("period", "market", "channel", "client", "sku", "baseline_qty")
    bad = spark.createDataFrame([("2026-01", None, "W", 1.0)], "period string, market string, channel string, macro_target_qty double")
    with pytest.raises(SchemaError, match="market"):
        validate_schema(bad, AllocSpec(), "macro")


def test_failed_run_releases_its_cache(spark):
    macro, granular = _inputs(spark)
    extra = spark.createDataFrame([("2026-02-01", "N", "Web", 5.0, 50.0)], M)
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    with pytest.raises(IntegrityError):
        run_job(macro.unionByName(extra), granular)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_bad_input_with_hot_groups_fails_before_ranking(spark):
    from plan_alloc.session import written
    from plan_alloc.spec import DataError

    macro, granular = _inputs(spark)
    dup = granular.unionByName(granular.limit(1))
    before = written(spark)
    with pytest.raises(DataError, match="repeats business keys"):
        run_job(macro, dup, spec=AllocSpec(hot_group_rows=1))
    assert written(spark) == before


def test_ordered_run_keeps_row_order_in_files(spark):
    macro, granular = _inputs(spark)
    res = run_job(macro, granular, ordered=True)
    paths = res.write(tempfile.mkdtemp(prefix="plan_alloc_ord_"), run="o")
    back = spark.read.parquet(paths["final_allocations"] + "/period=2026-01-01")
    assert [r["sku"] for r in back.collect()] == ["a", "b"]
    res.release()


def test_decimal_precision_value_basis(spark):
    granular = spark.createDataFrame(
        [("2026-01-01", "N", "Web", "c", s, 1.0, v) for s, v in (("a", 1.0), ("b", 1.0), ("c", 1.0))], G
    )
    macro = spark.createDataFrame([("2026-01-01", "N", "Web", None, 10.0)], M)
    res = run_job(macro, granular, spec=AllocSpec(quantity_mode="decimal", quantity_decimals=2), basis="value")
    got = rows(res.final_allocations, "sku", "final_allocated_value", "final_allocated_qty")
    assert got == [("a", 3.34, 3.34), ("b", 3.33, 3.33), ("c", 3.33, 3.33)]
    assert res.integrity["is_valid"]
    res.release()


def test_custom_group_keys_through_stages(spark):
    granular = spark.createDataFrame(
        [("2026-01", "N", "c", "a", "3"), ("2026-01", "N", "c", "b", "1"), ("2026-02", "N", "c", "a", "2")],
        "period string, market string, client string, sku string, baseline_qty string",
    )
    macro = spark.createDataFrame(
        [("2026-01", "N", "9"), ("2026-02", "N", "5")], "period string, market string, macro_target_qty string"
    )
    out = run_stages(macro, granular, AllocSpec(group_keys=("period", "market")))
    assert rows(out["allocations"], "period", "sku", "final_allocated_qty") == [
        (JAN, "a", 7.0),
        (JAN, "b", 2.0),
        (date(2026, 2, 1), "a", 5.0),
    ]
    assert out["integrity_summary"].first()["is_valid"] is True


def test_command_line_reports_a_broken_rule(spark, capsys):
    from plan_alloc.plans import cli

    folder = tempfile.mkdtemp(prefix="plan_alloc_cli_bad_")
    with open(os.path.join(folder, "granular.csv"), "w") as fh:
        fh.write("period,market,channel,client,sku,baseline_qty,baseline_value\n2026-01-01,N,W,c,a,0,0\n")
    with open(os.path.join(folder, "macro.csv"), "w") as fh:
        fh.write("period,market,channel,macro_target_qty\n2026-01-01,N,W,5\n")
    args = ["--macro", os.path.join(folder, "macro.csv"), "--granular", os.path.join(folder, "granular.csv"),
            "--out", os.path.join(folder, "out")]
    with pytest.raises(SystemExit) as done:
        import sys

        old = sys.argv
        sys.argv = ["plan_alloc", *args]
        try:
            cli.run()
        finally:
            sys.argv = old
    assert done.value.code == 2
    assert "ZeroBaselineError" in capsys.readouterr().err


def test_report_unmatched_granular_groups(spark):
    macro, granular = _inputs(spark)
    stray = spark.createDataFrame([("2026-03-01", "N", "Web", "c", "z", 5.0, 50.0)], G)
    lenient = AllocSpec(enforce_exact_totals=False)
    quiet = run_job(macro, granular.unionByName(stray), spec=lenient)
    assert quiet.integrity["unmatched_granular_group_count"] == 0  # aligned away, as the reference pipeline does
    loud = run_job(macro, granular.unionByName(stray), spec=lenient, report_unmatched_granular=True)
    assert loud.integrity["unmatched_granular_group_count"] == 1 and loud.integrity["is_valid"] is False
    assert rows(loud.final_allocations, "sku") == [("a",), ("b",)]
    quiet.release()
    loud.release()


def test_empty_granular_input_fails_clearly(spark):
    from plan_alloc.spec import AllocationError

    macro, granular = _inputs(spark)
    with pytest.raises(AllocationError, match="no allocation rows"):
        run_job(macro, granular.limit(0))


def test_disk_only_storage(spark):
    from pyspark import StorageLevel

    macro, granular = _inputs(spark)
    res = run_job(macro, granular, storage=StorageLevel.DISK_ONLY)
    assert res.rounded.storageLevel == StorageLevel.DISK_ONLY
    assert rows(res.final_allocations, "sku", "final_allocated_qty") == [("a", 72.0), ("b", 48.0)]
    res.release()


def test_rebalanced_write_makes_few_files_per_period(spark):
    import glob

    from plan_alloc.sources.cube import granular_cube, macro_cube

    from conftest import SF_SMALL

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        res = run_job(macro_cube(spark, SF_SMALL), granular_cube(spark, SF_SMALL), spec=AllocSpec(enforce_exact_totals=False))
        base = tempfile.mkdtemp(prefix="plan_alloc_files_")
        plain = res.write(base, run="plain", rebalance=False)["final_allocations"]
        balanced = res.write(base, run="balanced", rebalance=True)["final_allocations"]
        res.release()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

    def files_per_period(path):
        periods = glob.glob(f"{path}/period=*")
        return max(len(glob.glob(f"{p}/*.parquet")) for p in periods), len(periods)

    most_plain, periods = files_per_period(plain)
    most_balanced, same_periods = files_per_period(balanced)
    cube = granular_cube(spark, SF_SMALL).select("period").distinct()
    assert periods == same_periods == cube.join(macro_cube(spark, SF_SMALL), "period", "left_semi").distinct().count()
    assert most_balanced <= 2 < most_plain


def test_command_line_ordered_csv(spark):
    from plan_alloc.plans import cli

    folder = tempfile.mkdtemp(prefix="plan_alloc_cli_ord_")
    with open(os.path.join(folder, "granular.csv"), "w") as fh:
        fh.write("period,market,channel,client,sku,baseline_qty,baseline_value\n")
        fh.write("2026-01-01,N,W,c,b,1,10\n2026-01-01,N,W,c,a,3,30\n")
    with open(os.path.join(folder, "macro.csv"), "w") as fh:
        fh.write("period,market,channel,macro_target_qty,macro_target_value\n2026-01-01,N,W,8,80\n")
    out = cli.main(
        ["--macro", os.path.join(folder, "macro.csv"), "--granular", os.path.join(folder, "granular.csv"),
         "--out", os.path.join(folder, "out"), "--out-format", "csv", "--ordered", "--run", "o"],
        spark=spark,
    )
    part = os.path.join(out["tables"]["final_allocations"], "period=2026-01-01")
    lines = []
    for name in sorted(os.listdir(part)):
        if name.endswith(".csv"):
            lines += open(os.path.join(part, name)).read().splitlines()[1:]
    assert [line.split(",")[3] for line in lines] == ["a", "b"]


def test_job_over_custom_group_keys(spark):
    """(market): no period at all, client and sku below it; (sku): the item is the group."""
    granular = spark.createDataFrame(
        [("N", "c1", "a", 1.0, 10.0), ("N", "c2", "a", 3.0, 60.0), ("S", "c1", "a", 5.0, 5.0)],
        "market string, client string, sku string, baseline_qty double, baseline_value double",
    )
    macro = spark.createDataFrame([("N", 8.0, 100.0), ("S", 3.0, 9.0)], "market string, macro_target_qty double, macro_target_value double")
    res = run_job(macro, granular, spec=AllocSpec(group_keys=("market",)))
    cols = ("market", "client", "sku", "final_allocated_qty", "final_allocated_value")
    assert rows(res.final_allocations, *cols) == [("N", "c1", "a", 2.0, 20.0), ("N", "c2", "a", 6.0, 120.0), ("S", "c1", "a", 3.0, 3.0)]
    assert res.integrity["is_valid"] and res.sku_variance.columns[:3] == ["market", "client", "sku"]
    assert rows(res.group_summary, "market", "row_count") == [("N", 2), ("S", 1)]
    res.release()
    by_sku = granular.groupBy("sku", "client").agg(F.sum("baseline_qty").alias("baseline_qty"), F.sum("baseline_value").alias("baseline_value"))
    target = spark.createDataFrame([("a", 18.0, 1.0)], "sku string, macro_target_qty double, macro_target_value double")
    res = run_job(target, by_sku, spec=AllocSpec(group_keys=("sku",)))
    assert rows(res.final_allocations, "sku", "client", "final_allocated_qty") == [("a", "c1", 12.0), ("a", "c2", 6.0)]
    res.release()
