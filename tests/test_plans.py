"""Plan shape: one hash exchange of granular rows, no Python in the core,
filters and column pruning reach the scan."""

import contextlib
import io
import re
import tempfile

from plan_alloc import AllocSpec
from pyspark.sql import functions as F

from plan_alloc.operators import allocate as A
from plan_alloc.operators import reports as R
from plan_alloc.plans import queries as Q
from plan_alloc.sources.cube import Cube, granular_cube, macro_cube

from conftest import SF_SMALL

CUBE = Cube(channel="status")


def _plan(df, mode="simple") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def _tables(spark):
    folder = tempfile.mkdtemp(prefix="plan_alloc_plan_")
    granular_cube(spark, SF_SMALL, CUBE).drop("baseline_value").write.parquet(f"{folder}/g")
    macro_cube(spark, SF_SMALL, CUBE).drop("macro_target_value").write.parquet(f"{folder}/m")
    return spark.read.parquet(f"{folder}/g"), spark.read.parquet(f"{folder}/m")


def test_core_allocation_plan(spark):
    spec = AllocSpec()
    g, m = _tables(spark)
    totals = A.group_totals(g, spec)
    layout = A.measure_groups(totals, spec)
    w = A.calculate_weights(g, spec, totals=totals, layout=layout)
    r = A.apply_rounding(A.redistribute(m, w.weights, spec, layout=layout).allocations, spec, layout=layout)
    plan = _plan(r.allocations)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    exchanges = re.findall(r"Exchange (\w+)\(([^)]*)\)", plan)
    hashed = [args for kind, args in exchanges if kind == "hashpartitioning"]
    # one exchange of granular rows (feeds the rank/residual window) and one of
    # map-side pre-aggregated group totals; nothing keyed on client or sku
    assert len(hashed) == 2
    assert all(re.fullmatch(r"period#\d+, market#\d+, channel#\d+, \d+", a) for a in hashed)
    assert plan.count("BroadcastHashJoin") == 2  # totals and targets, size checked
    assert len(re.findall(r"\bWindow \[", plan)) == 1  # rank and residual share one window
    assert len(re.findall(r"\bSort \[", plan)) == 1


def test_ledger_joins_the_rows_once(spark):
    spec = AllocSpec()
    g, m = _tables(spark)
    totals = A.group_totals(g, spec)
    layout = A.measure_groups(totals, spec)
    plan = _plan(A.allocate(g, m, spec, totals, layout)[1].allocations)
    rows = plan[: plan.index("BroadcastExchange")]
    assert rows.count("BroadcastHashJoin") == 1 and "Exchange hashpartitioning" not in rows


def test_hot_groups_are_ranked_by_bucket(spark):
    """One exchange on (group, bucket) for the usual rows; no sampling pass, no
    scratch table, and no window on whole groups of rows."""
    spec = AllocSpec(hot_group_rows=1)
    g, m = _tables(spark)
    totals = A.group_totals(g, spec)
    layout = A.measure_groups(totals, spec)
    r = A.apply_rounding(A.allocate(g, m, spec, totals, layout)[1].allocations, spec, layout=layout)
    plan = _plan(r.allocations)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "rangepartitioning" not in plan and "_pid" not in plan
    windows = re.findall(r"Window \[row_number\(\)[^\n]*", plan)
    assert sum("_bucket" not in w for w in windows) <= 1  # the groups of one row
    assert sum("_bucket" in w for w in windows) == 2  # usual and crowded buckets


def _spread(df):
    """Rows of every task that has made any."""
    return sorted(n for (n,) in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).select("n").collect())


def test_a_group_with_a_third_of_the_rows_is_spread_over_tasks(spark):
    """With nothing broadcast, neither the joins nor the ranking read more than
    twice the median in one task."""
    settings = {
        "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spec = AllocSpec(hot_group_rows=2_000, hot_rows_per_task=50, broadcast_group_limit=0)
        n = F.col("id")
        g = spark.range(30_000).select(
            F.lit("2026-01-01").cast("date").alias("period"),
            F.when(n < 10_000, F.lit("hot")).otherwise(F.concat(F.lit("m"), n % 400)).alias("market"),
            F.lit("web").alias("channel"), F.lit("c").alias("client"), F.format_string("sku-%06d", n).alias("sku"),
            (1 + n % 977).cast("double").alias("baseline_qty"),
        )
        m = g.select("period", "market", "channel").distinct().withColumn("macro_target_qty", F.lit(12_345.0))
        totals = A.group_totals(g, spec)
        layout = A.measure_groups(totals, spec)
        assert not layout.broadcast and layout.hot_groups == 1 and layout.salts.count() == 1
        weighted = A.calculate_weights(g, spec, totals=totals, layout=layout).weights
        shared = A.allocate(g, m, spec, totals, layout)[1].allocations
        ranked = A.apply_rounding(shared, spec, layout=layout).allocations
        reported = R.sku_report(ranked, spec, layout=layout)
        for df in (weighted, shared, ranked.where("market = 'hot'"), reported):
            tasks = _spread(df)
            assert sum(tasks) in (30_000, 10_000)
            assert tasks[-1] <= 2 * tasks[len(tasks) // 2] and len(tasks) == 16
        plain = AllocSpec()
        want = A.apply_rounding(A.redistribute(m, A.calculate_weights(g, plain).weights, plain).allocations, plain).allocations
        assert ranked.exceptAll(want).count() == 0 and ranked.count() == 30_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_equal_remainders_are_ranked_by_the_heads_of_their_skus(spark):
    spec = AllocSpec(hot_group_rows=10, hot_rows_per_task=100, broadcast_group_limit=0)
    g = spark.range(3_000).select(
        F.lit("2026-01-01").cast("date").alias("period"), F.lit("N").alias("market"), F.lit("web").alias("channel"),
        F.concat(F.lit("c"), F.col("id") % 2).alias("client"), F.format_string("sku-%06d", F.floor(F.col("id") / 2)).alias("sku"),
        F.lit(1.0).alias("baseline_qty"),
    )
    m = g.select("period", "market", "channel").distinct().withColumn("macro_target_qty", F.lit(4_001.0))
    totals = A.group_totals(g, spec)
    layout = A.measure_groups(totals, spec)
    ranked = A.apply_rounding(A.allocate(g, m, spec, totals, layout)[1].allocations, spec, layout=layout).allocations
    got = [(r.sku, r.client) for r in ranked.orderBy("residual_rank").collect()]
    assert got == sorted(got) and ranked.agg(F.sum("final_allocated_qty")).first()[0] == 4_001.0
    assert [r.residual_rank for r in ranked.select("residual_rank").orderBy("residual_rank").collect()] == list(range(1, 3_001))


def test_row_report_computes_the_allocation_once(spark):
    """The final totals come from a window on rows that lie by group already."""
    df = Q.QUERIES["rep_sku"](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"FileScan parquet \[l_", final)) == 1
    assert len(re.findall(r"Window \[row_number\(\)", final)) == 1


def test_scans_are_pruned(spark):
    """All order years feed the cube, so there is no date filter to push down."""
    plan = _plan(granular_cube(spark, SF_SMALL))
    lineitem = [l for l in plan.splitlines() if "FileScan parquet" in l and "l_orderkey" in l]
    assert lineitem and "l_shipdate" not in lineitem[0] and "l_tax" not in lineitem[0]
    orders = [l for l in plan.splitlines() if "FileScan parquet" in l and "o_orderkey" in l]
    assert orders and "o_totalprice" not in orders[0] and "o_clerk" not in orders[0]


def test_no_broadcast_plan_keeps_one_granular_exchange(spark):
    """Above the broadcast bound (and with Spark's own size-based broadcast off)
    the per-group tables are shuffle-joined; the granular rows are still hashed
    on the group keys only once: the join's partitioning is what the rank
    window needs."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        spec = AllocSpec(broadcast_group_limit=0)
        g, m = _tables(spark)
        totals = A.group_totals(g, spec)
        layout = A.measure_groups(totals, spec)
        assert not layout.broadcast
        w = A.calculate_weights(g, spec, totals=totals, layout=layout)
        r = A.apply_rounding(A.redistribute(m, w.weights, spec, layout=layout).allocations, spec, layout=layout)
        plan = _plan(r.allocations)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert len(re.findall(r"\bWindow \[", plan)) == 1
    # granular scan → one exchange on the group keys → joins → window: the
    # exchange right above the granular scan is the only one its rows cross
    granular = re.findall(r"Exchange hashpartitioning\(period#\d+, market#\d+, channel#\d+, \d+\)[^\n]*\n(?:[^\n]*\n)*?[^\n]*FileScan parquet \[period#\d+,market#\d+,channel#\d+,client", plan)
    assert len(granular) >= 1
    hashed = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert all("client" not in h and "sku" not in h for h in hashed)


def test_no_registered_query_runs_python_on_rows(spark):
    """Every registered query stays JVM-side: no Python UDF or pandas node."""
    import __spark_entry__ as E

    python_nodes = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF", "MapInArrow")
    for name, query in E.QUERIES.items():
        plan = _plan(query(spark, SF_SMALL))
        assert not any(node in plan for node in python_nodes), name


def test_targets_are_broadcast_only_for_counted_groups(spark):
    """Targets of groups without granular rows are never part of a broadcast."""
    spec = AllocSpec(broadcast_group_limit=2)
    g = spark.createDataFrame([("2026-01", "m", "c", "k", "s", 1.0)], "period string, market string, channel string, client string, sku string, baseline_qty double")
    m = spark.createDataFrame([("2026-01", f"m{i}", "c", 5.0) for i in range(10)] + [("2026-01", "m", "c", 5.0)], "period string, market string, channel string, macro_target_qty double")
    totals = A.group_totals(g, spec)
    layout = A.measure_groups(totals, spec)
    w = A.calculate_weights(g, spec, totals=totals, layout=layout)
    red = A.redistribute(m, w.weights, spec, granular_groups=totals, layout=layout)
    assert "LeftSemi" in _plan(red.allocations) and red.allocations.count() == 1


def test_standardising_reads_needed_columns_and_pushes_key_filters(spark):
    from plan_alloc.operators.standardize import standardize_granular

    folder = tempfile.mkdtemp(prefix="plan_alloc_std_")
    wide = granular_cube(spark, SF_SMALL, CUBE).selectExpr("*", "1 as extra_one", "2 as extra_two")
    wide.write.parquet(f"{folder}/g")
    table = standardize_granular(spark.read.parquet(f"{folder}/g"), AllocSpec()).table.filter("market = 'm'")
    scan = _plan(table, "formatted")
    assert "extra_one" not in scan.split("ReadSchema:")[1].splitlines()[0]
    assert "EqualTo(market,m)" in scan


def test_integrity_reads_the_allocation_once(spark):
    from plan_alloc.operators.integrity import validate_integrity

    g, m = _tables(spark)
    spec = AllocSpec()
    w = A.calculate_weights(g, spec)
    rounded = A.apply_rounding(A.redistribute(m, w.weights, spec).allocations, spec).allocations
    nothing = m.limit(0).select(*spec.keys)
    plan = _plan(validate_integrity(rounded, nothing, nothing, spec).summary)
    assert len(re.findall(r"\bWindow \[", plan)) == 1
