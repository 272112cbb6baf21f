import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from plan_alloc import AllocSpec
from plan_alloc.operators import allocate as A
from plan_alloc.operators.checks import enforce
from plan_alloc.spec import AllocationError, IntegrityError, ZeroBaselineError

from conftest import JAN, FEB, rows

ALLOC = "period date, market string, channel string, sku string, macro_target_qty double, raw_allocated_qty double"
GRAN = "period date, market string, channel string, sku string, baseline_qty double"


def _alloc(spark, raws, target, sku_prefix="s", period=JAN, client=None):
    data = [(period, "N", "Web", f"{sku_prefix}{i}", float(target), float(r)) for i, r in enumerate(raws)]
    return spark.createDataFrame(data, ALLOC)


def test_group_totals_and_weights(spark):
    g = spark.createDataFrame([(JAN, "N", "W", "a", 60.0), (JAN, "N", "W", "b", 40.0), (FEB, "N", "W", "a", 5.0)], GRAN)
    w = A.calculate_weights(g, AllocSpec())
    assert rows(w.weights, "period", "sku", "group_baseline_qty", "weight") == [
        (JAN, "a", 100.0, 0.6),
        (JAN, "b", 100.0, 0.4),
        (FEB, "a", 5.0, 1.0),
    ]
    assert enforce(w.checks) == {"zero_baseline": 0}


def test_zero_baseline_fails(spark):
    g = spark.createDataFrame([(JAN, "N", "W", "a", 0.0), (JAN, "N", "W", "b", 0.0)], GRAN)
    w = A.calculate_weights(g, AllocSpec())
    assert rows(w.zero_groups) == [(JAN, "N", "W")]
    with pytest.raises(ZeroBaselineError):
        enforce(w.checks)


def test_zero_baseline_equal_split(spark):
    g = spark.createDataFrame(
        [(JAN, "N", "W", s, 0.0) for s in "abc"] + [(FEB, "N", "W", "a", 3.0), (FEB, "N", "W", "b", 1.0)], GRAN
    )
    w = A.calculate_weights(g, AllocSpec(zero_baseline="equal_split"))
    got = dict(((r["period"], r["sku"]), r["weight"]) for r in w.weights.collect())
    assert got[(JAN, "a")] == pytest.approx(1 / 3) and got[(JAN, "c")] == pytest.approx(1 / 3)
    assert got[(FEB, "a")] == 0.75 and got[(FEB, "b")] == 0.25


def test_negative_baselines_cancel_to_zero(spark):
    g = spark.createDataFrame([(JAN, "N", "W", "a", 5.0), (JAN, "N", "W", "b", -5.0)], GRAN)
    assert rows(A.calculate_weights(g, AllocSpec()).zero_groups) == [(JAN, "N", "W")]


def test_redistribute_and_unmatched(spark):
    g = spark.createDataFrame([(JAN, "N", "W", "a", 60.0), (JAN, "N", "W", "b", 40.0), (FEB, "N", "W", "a", 1.0)], GRAN)
    m = spark.createDataFrame([(JAN, "N", "W", 120.0), (date(2026, 3, 1), "N", "W", 7.0)],
                              "period date, market string, channel string, macro_target_qty double")
    spec = AllocSpec()
    red = A.redistribute(m, A.calculate_weights(g, spec).weights, spec)
    assert rows(red.allocations, "sku", "raw_allocated_qty") == [("a", 72.0), ("b", 48.0)]
    assert rows(red.unmatched_macro) == [(date(2026, 3, 1), "N", "W")]
    assert rows(red.unmatched_granular) == [(FEB, "N", "W")]


def test_redistribute_input_checks(spark):
    g = spark.createDataFrame([(JAN, "N", "W", "a", 1.0)], GRAN)
    m = spark.createDataFrame([(JAN, "N", "W", 1.0)], "period date, market string, channel string, macro_target_qty double")
    with pytest.raises(AllocationError, match="weight"):
        A.redistribute(m, g, AllocSpec())


def test_equal_remainders_go_to_first_sku(spark):
    r = A.apply_rounding(_alloc(spark, [33.333333] * 3, 100), AllocSpec())
    assert rows(r.allocations, "sku", "rounded_allocated_qty", "final_allocated_qty") == [
        ("s0", 33.0, 34.0),
        ("s1", 33.0, 33.0),
        ("s2", 33.0, 33.0),
    ]
    s = r.group_summary.first()
    assert (s["rounded_group_total"], s["final_group_total"], s["final_gap"]) == (99.0, 100.0, 0.0)


def test_largest_remainder_order(spark):
    r = A.apply_rounding(_alloc(spark, [4.8, 2.3, 2.9], 10), AllocSpec())
    assert rows(r.allocations, "sku", "rounded_allocated_qty", "residual_rank", "residual_adjustment", "final_allocated_qty") == [
        ("s0", 4.0, 2, 1.0, 5.0),
        ("s1", 2.0, 3, 0.0, 2.0),
        ("s2", 2.0, 1, 1.0, 3.0),
    ]


def test_two_decimals(spark):
    r = A.apply_rounding(_alloc(spark, [0.444, 0.556], 1.0), AllocSpec(quantity_mode="decimal", quantity_decimals=2))
    assert rows(r.allocations, "sku", "final_allocated_qty") == [("s0", 0.44), ("s1", 0.56)]


def test_target_finer_than_precision_keeps_gap(spark):
    spec = AllocSpec(quantity_mode="decimal", quantity_decimals=2)
    r = A.apply_rounding(_alloc(spark, [0.003], 0.003), spec)
    assert rows(r.allocations, "final_allocated_qty") == [(0.0,)]
    assert r.group_summary.first()["final_gap"] == pytest.approx(0.003)
    enforce(r.checks)  # within half a unit: no error


def test_groups_are_independent(spark):
    a = _alloc(spark, [1.5, 1.5], 3, period=JAN).unionByName(_alloc(spark, [2.5, 0.5], 3, period=FEB))
    r = A.apply_rounding(a, AllocSpec())
    assert rows(r.allocations, "period", "sku", "final_allocated_qty") == [
        (JAN, "s0", 2.0),
        (JAN, "s1", 1.0),
        (FEB, "s0", 3.0),
        (FEB, "s1", 0.0),
    ]


def test_client_breaks_ties(spark):
    df = spark.createDataFrame(
        [(JAN, "N", "W", c, "a", 3.0, 1.5) for c in ("zeta", "alpha")],
        "period date, market string, channel string, client string, sku string, macro_target_qty double, raw_allocated_qty double",
    )
    r = A.apply_rounding(df, AllocSpec())
    assert rows(r.allocations, "client", "residual_rank", "final_allocated_qty") == [("alpha", 1, 2.0), ("zeta", 2, 1.0)]


def test_empty_input_is_an_error(spark):
    r = A.apply_rounding(spark.createDataFrame([], ALLOC), AllocSpec())
    with pytest.raises(AllocationError, match="no allocation rows"):
        enforce(r.checks)


def test_negative_residual_is_an_error(spark):
    r = A.apply_rounding(_alloc(spark, [3.0, 3.0], 5), AllocSpec())
    with pytest.raises(IntegrityError, match="negative residual"):
        enforce(r.checks)


def test_gap_check_can_be_disabled(spark):
    bad = _alloc(spark, [1.0, 1.0], 5)  # raw values do not add up to the target
    with pytest.raises(IntegrityError, match="miss the macro target"):
        enforce(A.apply_rounding(bad, AllocSpec()).checks)
    enforce(A.apply_rounding(bad, AllocSpec(enforce_exact_totals=False)).checks)


def test_missing_columns(spark):
    with pytest.raises(AllocationError, match="raw_allocated_qty"):
        A.apply_rounding(spark.createDataFrame([(JAN, "a")], "period date, sku string"), AllocSpec())


def test_hot_group_path_matches_window_path(spark):
    import random

    rnd = random.Random(3)
    data = []
    for g in range(6):
        n = 5 if g else 400  # one big group, several small
        raws = [rnd.choice([1.25, 2.5, 3.75, rnd.random() * 9]) for _ in range(n)]
        target = float(round(sum(raws)))
        data += [(JAN, f"M{g}", "W", f"s{i % 37}", f"c{i}", target, r) for i, r in enumerate(raws)]
    df = spark.createDataFrame(
        data,
        "period date, market string, channel string, sku string, client string, macro_target_qty double, raw_allocated_qty double",
    )
    cols = ("market", "sku", "client", "residual_rank", "final_allocated_qty")
    window = rows(A.apply_rounding(df, AllocSpec()).allocations, *cols)
    hot_one = rows(A.apply_rounding(df, AllocSpec(hot_group_rows=50), rows_per_task=40).allocations, *cols)
    hot_all = rows(A.apply_rounding(df, AllocSpec(hot_group_rows=1), rows_per_task=7).allocations, *cols)
    assert window == hot_one == hot_all
    layout = A.measure_groups(df.groupBy("period", "market", "channel").agg(F.count(F.lit(1)).alias("_group_rows")),
                              AllocSpec(hot_group_rows=50))
    assert layout.group_count == 6 and layout.hot_rows == 400 and layout.hot_keys.count() == 1


def test_one_hot_group_with_equal_remainders_is_spread_evenly(spark):
    """Worst case for skew: every row in one group, every remainder equal. The
    crowded bucket goes by the heads of its skus."""
    from plan_alloc.sources.cube import granular_cube

    from conftest import SF_SMALL

    g = granular_cube(spark, SF_SMALL).select(
        F.lit(JAN).alias("period"), F.lit("ALL").alias("market"), F.lit("ALL").alias("channel"),
        "client", "sku", F.lit(1.0).alias("baseline_qty"),
    )
    n = g.count()
    m = spark.createDataFrame([(JAN, "ALL", "ALL", n / 2 + 0.5)], "period date, market string, channel string, macro_target_qty double")
    spec = AllocSpec(hot_group_rows=50)
    r = A.apply_rounding(A.redistribute(m, A.calculate_weights(g, spec).weights, spec).allocations, spec, rows_per_task=100)
    got = r.allocations.agg(F.sum("final_allocated_qty").alias("t"), F.countDistinct("residual_rank").alias("k")).first()
    assert got["t"] == math.floor(n / 2 + 0.5 + 0.5) and got["k"] == n  # half away from zero
    ranked = [(x.sku, x.client) for x in r.allocations.orderBy("residual_rank").collect()]
    assert ranked == sorted(ranked)


@pytest.mark.parametrize(
    "baselines, weights",
    [([3e-10, 1e-10], [0.75, 0.25]), ([1.5e-9] * 3, [1 / 3] * 3), ([2e19, 6e19], [0.25, 0.75]), ([1e-12, 0.0], [1.0, 0.0])],
)
def test_totals_of_very_small_and_very_large_baselines(spark, baselines, weights):
    g = spark.createDataFrame([(JAN, "N", "W", f"s{i}", b) for i, b in enumerate(baselines)], GRAN)
    w = A.calculate_weights(g, AllocSpec())
    assert w.zero_groups.count() == 0
    assert [r[1] for r in rows(w.weights, "sku", "weight")] == pytest.approx(weights, rel=1e-12)
    macro = spark.createDataFrame([(JAN, "N", "W", 100.0)], "period date, market string, channel string, macro_target_qty double")
    done = A.apply_rounding(A.redistribute(macro, w.weights, AllocSpec()).allocations, AllocSpec())
    assert sum(r[0] for r in rows(done.allocations, "final_allocated_qty")) == 100.0
