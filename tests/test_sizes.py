"""Tasks and volumes of the planning rows: partitions follow the number of rows, whatever
the session's, and what several jobs read is computed once."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from plan_alloc import session
from plan_alloc.operators import allocate as A
from plan_alloc.operators import reports as R
from plan_alloc.operators import standardize as S
from plan_alloc.plans import job as J
from plan_alloc.plans import queries as Q
from plan_alloc.sources import cube
from plan_alloc.spec import AllocSpec, DataError

LINES = 960


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """960 lines of 240 orders over two years, in two markets and two channels."""
    out = str(tmp_path_factory.mktemp("tables"))

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{out}/{name}.parquet")

    write("region", [(0, "ASIA"), (1, "EUROPE")], "r_regionkey int, r_name string")
    write("nation", [(0, "JAPAN", 0), (1, "FRANCE", 1)], "n_nationkey int, n_name string, n_regionkey int")
    write("customer", [(c, c % 2, f"SEG{c % 3}") for c in range(12)], "c_custkey long, c_nationkey int, c_mktsegment string")
    write("part", [(p, f"Brand#{p % 5}") for p in range(40)], "p_partkey long, p_brand string")
    orders = [(o, o % 12, datetime(1996 + o // 12 % 2, 1 + o % 3, 5), f"{1 + o % 2}-P", "FO"[o % 2]) for o in range(240)]
    write("orders", orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string, o_orderstatus string")
    lines = [(i // 4, (i * 7) % 40, 1 + i % 4, float(1 + i % 9), 10.0 + i % 13, "NR"[i % 2]) for i in range(LINES)]
    write("lineitem", lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string")
    return out


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 20)


def test_cube_tasks_follow_the_lines(spark, tables, few):
    """F15, F16, F21 and others: the cube's tasks held all rows over the session's partitions."""
    by_row = cube._by_row(spark, tables, cube.Cube(channel="status"))
    assert by_row.rdd.getNumPartitions() == LINES // 20
    assert by_row.agg(F.sum("qty")).first()[0] == sum(1 + i % 9 for i in range(LINES))


def test_salted_join_and_buckets_follow_the_rows(spark, few):
    """neither the salted join nor the ranking depends on the session's partitions."""
    spec = AllocSpec(hot_group_rows=1, hot_rows_per_task=5, broadcast_group_limit=0)
    rows = [(date(2026, 1, 1), f"M{i % 2}", "C", "K", f"S{i:04d}", 1.0) for i in range(400)]
    granular = spark.createDataFrame(rows, "period date, market string, channel string, client string, sku string, baseline_qty double")
    macro = spark.createDataFrame([(date(2026, 1, 1), f"M{m}", "C", 77.0) for m in range(2)], "period date, market string, channel string, macro_target_qty double")
    totals = A.group_totals(granular, spec)
    layout = A.measure_groups(totals, spec)
    assert A.join_groups(granular, totals, spec, layout).rdd.getNumPartitions() == 400 // 20
    alloc = A.allocate(granular, macro, spec, totals, layout)[1].allocations
    out = A.apply_rounding(alloc, spec, layout=layout).allocations
    assert [r["t"] for r in out.groupBy("market").agg(F.sum(A.FINAL).alias("t")).collect()] == [77.0, 77.0]


def test_salted_rows_move_once_to_be_ranked(spark, tables, monkeypatch):
    """lines were joined once for every use of a row, and rows dealt by bucket for
    each of the usual, the crowded and the counted ones, the crowded twice more."""
    monkeypatch.setattr(session, "ROWS_PER_TASK", 60)
    cleaned = []
    write = session.materialize
    monkeypatch.setattr(session, "materialize", lambda df, label: (cleaned.append((label, spark.conf.get(session._FILE_CLEANUP))), write(df, label))[1])
    before = spark.conf.get(session._FILE_CLEANUP)
    got = Q.QUERIES["rnd_apportion_salted"](spark, tables)
    assert cleaned == [("cube", "true"), ("lean", "true")] and spark.conf.get(session._FILE_CLEANUP) == before
    assert not any("lineitem" in f for f in got.inputFiles())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression" in line and "_bucket#" in line]
    assert len(dealt) == 2  # rows, and what is counted of their buckets
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()
    want = Q.QUERIES["rnd_apportion_integer"](spark, tables)
    assert got.count() and sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("per_task, lean", [(1, True), (3, False), (10_000, True)])
def test_cells_give_the_ranks_of_the_window(spark, few, per_task, lean):
    """ties, null and repeated skus, a group without remainders, skus alike for long."""
    schema = "period date, market string, channel string, client string, sku string, baseline_qty double"
    rows = [(date(2026, 1, 1), f"M{i % 3}", "C", f"K{i % 2}", None if i % 41 == 0 else f"brand-{i % 3}-{i * 7 % 60}", float(i % 4) / 3 if i % 3 else 0.0) for i in range(400)]
    granular = spark.createDataFrame(rows, schema)
    macro = spark.createDataFrame([(date(2026, 1, 1), f"M{m}", "C", 31.0 + m) for m in (0, 1)], "period date, market string, channel string, macro_target_qty double")

    def ranked(spec, lean):
        totals = A.group_totals(granular, spec)
        layout = A.measure_groups(totals, spec)
        red = A.allocate(granular, macro, spec, totals, layout)[1]
        out = A.apply_rounding(red.allocations, spec, layout=layout, lean=red.lean if lean else None).allocations
        return out.columns, sorted(map(str, out.collect()))

    for policy in ("fail", "equal_split"):
        want = ranked(AllocSpec(zero_baseline=policy), False)
        assert ranked(AllocSpec(zero_baseline=policy, hot_group_rows=1, hot_rows_per_task=per_task, broadcast_group_limit=0), lean) == want


def test_rows_lying_by_group_get_the_same_ranks(spark, few):
    spec = AllocSpec()
    rows = [(date(2026, 1 + i % 3, 1), "M", None if i % 11 == 0 else "C", "K", None if i == 5 else f"S{i % 50:04d}", float(i % 4)) for i in range(200)]
    granular = spark.createDataFrame(rows, "period date, market string, channel string, client string, sku string, baseline_qty double").unionAll(
        spark.createDataFrame([(date(2026, 1, 1), "M", "C", "K", "S9999", 3.0)] * 2, "period date, market string, channel string, client string, sku string, baseline_qty double")
    )
    macro = spark.createDataFrame([(date(2026, m, 1), "M", "C", 31.0) for m in (1, 2)], "period date, market string, channel string, macro_target_qty double")
    totals = A.group_totals(granular, spec)
    layout = A.measure_groups(totals, spec)
    red = A.allocate(granular, macro, spec, totals, layout)[1]
    usual = A.apply_rounding(red.allocations, spec, layout=layout).allocations
    lying = A.apply_rounding(red.allocations, spec, layout=layout, by_group=red.by_group).allocations
    assert sorted(map(str, usual.collect())) == sorted(map(str, lying.collect()))
    # They were moved before the ledger widened them: F9, F11, F12, F13.
    plan = lying._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    assert plan.index(A.GROUP_TOTAL) < plan.index("RepartitionByExpression")


def test_reference_join_follows_the_rows(spark, few):
    """the engine rows and the reference meet in as many tasks as there are rows."""
    schema = "period date, market string, channel string, client string, sku string"
    keys = [(date(2026, 1, 1), "M", "C", "K", f"S{i:04d}") for i in range(400)]
    figures = ("baseline_qty", "group_baseline_qty", "weight", "raw_allocated_qty", "rounded_allocated_qty", "final_allocated_qty")
    engine = spark.createDataFrame(keys, schema).withColumns({c: F.lit(2.0) for c in figures})
    reference = spark.createDataFrame(keys, schema).withColumns({"baseline_qty": F.lit(1.0), "unit_price": F.lit(2.0)})
    targets = spark.createDataFrame([(date(2026, 1, 1), "M", "C", 5.0, 6.0)], "period date, market string, channel string, macro_target_qty double, macro_target_value double")
    layout = A.GroupLayout(1, 400, True)
    out = R.dual_outputs(engine, targets, reference, "value", layout=layout, groups=targets).final_allocations
    assert out.rdd.getNumPartitions() == 400 // 20
    assert out.where("final_allocated_qty = 1 and macro_target_value = 6").count() == 400


def test_duplicate_keys_with_the_rows_known(spark, few):
    df = spark.range(200).select((F.col("id") % 150).alias("k"), F.when(F.col("id") < 0, "x").alias("x"))
    found = S.duplicate_keys(df, ("k", "x"), rows=200)
    assert found.rdd.getNumPartitions() == 10
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in S.duplicate_keys(df, ("k", "x")).collect())


@pytest.mark.parametrize("query", ["job_direct_units", "job_market_keys", "job_stages_units", "job_share_value", "dual_group", "dual_sku", "alloc_redistribute"])
def test_the_lines_are_joined_once(spark, tables, query, monkeypatch):
    """F3, F5, F6, F10 to F14: measuring, checks and result each joined the lines again."""
    monkeypatch.setattr(Q, "SHARE_OF_MARKET", 1.0)  # the locked months hold much of so small a market
    files = Q.QUERIES[query](spark, tables).inputFiles()
    assert files and not any("lineitem" in f for f in files)


@pytest.mark.parametrize("query", ["dual_allocations_units", "dual_reconstruct_joined", "dual_group", "dual_sku"])
def test_dual_targets_are_known_to_be_few(spark, tables, query):
    """nothing said that the targets are few, so all rows were shuffled to meet them, each time they were read."""
    assert any("plan_alloc_targets" in f for f in Q.QUERIES[query](spark, tables).inputFiles())


def test_bundle_leaves_its_tables_only(spark, tables, few):
    """nothing is computed per table, and what the job kept goes with the last write."""
    before = set(session.written(spark))
    got = Q.QUERIES["snk_bundle_roundtrip"](spark, tables)
    left = [p for p in session.written(spark) if p not in before]
    assert len(left) == 1 and "plan_alloc_bundle_" in left[0]
    want = Q.QUERIES["job_direct_units"](spark, tables)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_kept_job_equals_lazy_job(spark, tables):
    """F8: the summary and the four tables are those of a job that keeps nothing."""
    granular, macro = cube.granular_cube(spark, tables), cube.macro_cube(spark, tables)
    spec = AllocSpec(enforce_exact_totals=False)
    lazy = J.run_job(macro, granular, spec=spec, persist=False)
    kept = J.run_job(macro, granular, spec=spec, files=True)
    for name, table in kept.tables().items():
        assert sorted(map(str, table.collect())) == sorted(map(str, lazy.tables()[name].collect())), name
    paths = [f.kept_at for f in kept._files]
    kept.release()
    assert paths and not set(paths) & set(session.written(spark))


def test_failed_job_keeps_no_files(spark, tables):
    before = session.written(spark)
    granular, macro = cube.granular_cube(spark, tables), cube.macro_cube(spark, tables)
    with pytest.raises(DataError, match="granular_duplicate_keys"):
        J.run_job(macro, granular.unionAll(granular), spec=AllocSpec(enforce_exact_totals=False), files=True)
    assert session.written(spark) == before
