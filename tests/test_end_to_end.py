"""All stages on a small literal input, outputs checked value by value."""

from datetime import date

from plan_alloc import AllocSpec
from plan_alloc.plans.job import run_stages

from conftest import rows

G = "period string, market string, channel string, client string, sku string, baseline_qty string"
M = "period string, market string, channel string, macro_target_qty string"
JAN, FEB = date(2026, 1, 1), date(2026, 2, 1)


def test_all_stages(spark):
    granular = spark.createDataFrame(
        [
            ("2026-01", "N", "Web", "c1", "a", "10"),
            ("2026-01", "N", "Web", "c1", "b", "30"),
            ("2026/01/15", "N", "Shop", "c1", "a", "1"),
            ("2026-01-02", "N", "Shop", "c1", "b", "1"),
            ("02/01/2026", "N", "Shop", "c1", "c", "1"),
            ("2026-02", "S", "Web", "c2", "a", "5"),
            ("2026-02", "S", "Web", "c2", "b", "0"),
            ("2026/2", "S", "Shop", "c2", "x", "2.5"),
            ("2026-02-28", "S", "Shop", "c2", "y", "7.5"),
        ],
        G,
    )
    macro = spark.createDataFrame(
        [
            ("2026-01", "N", "Web", "100"),
            ("2026-01", "N", "Shop", "10"),
            ("2026-02", "S", "Web", "7"),
            ("2026-02", "S", "Shop", "3"),
        ],
        M,
    )
    out = run_stages(macro, granular, AllocSpec())
    # weights 1/4, 3/4 | 1/3 each: 3+3+3 and one unit to the first sku |
    # 1, 0 | raw 0.75, 2.25: the larger remainder (x) gets the unit
    assert rows(out["allocations"], "period", "channel", "sku", "raw_allocated_qty", "residual_rank", "final_allocated_qty") == [
        (JAN, "Shop", "a", (1 / 3) * 10, 1, 4.0),
        (JAN, "Shop", "b", (1 / 3) * 10, 2, 3.0),
        (JAN, "Shop", "c", (1 / 3) * 10, 3, 3.0),
        (JAN, "Web", "a", 25.0, 1, 25.0),
        (JAN, "Web", "b", 75.0, 2, 75.0),
        (FEB, "Shop", "x", 0.75, 1, 1.0),
        (FEB, "Shop", "y", 2.25, 2, 2.0),
        (FEB, "Web", "a", 7.0, 1, 7.0),
        (FEB, "Web", "b", 0.0, 2, 0.0),
    ]
    assert out["integrity_summary"].first().asDict() == {
        "validated_group_count": 4,
        "groups_with_gap_count": 0,
        "negative_allocation_count": 0,
        "unmatched_macro_group_count": 0,
        "unmatched_granular_group_count": 0,
        "is_valid": True,
    }
    assert rows(
        out["group_summary"], "period", "channel", "baseline_group_qty", "final_allocated_group_qty",
        "sku_count", "group_delta_pct", "final_gap_to_target",
    ) == [
        (JAN, "Shop", 3.0, 10.0, 3, 7 / 3, 0.0),
        (JAN, "Web", 40.0, 100.0, 2, 1.5, 0.0),
        (FEB, "Shop", 10.0, 3.0, 2, -0.7, 0.0),
        (FEB, "Web", 5.0, 7.0, 2, 0.4, 0.0),
    ]
    assert rows(out["sku_variance"], "period", "channel", "sku", "baseline_weight", "final_weight", "sku_delta_pct") == [
        (JAN, "Shop", "a", 1 / 3, 0.4, 3.0),
        (JAN, "Shop", "b", 1 / 3, 0.3, 2.0),
        (JAN, "Shop", "c", 1 / 3, 0.3, 2.0),
        (JAN, "Web", "a", 0.25, 0.25, 1.5),
        (JAN, "Web", "b", 0.75, 0.75, 1.5),
        (FEB, "Shop", "x", 0.25, 1 / 3, -0.6),
        (FEB, "Shop", "y", 0.75, 2 / 3, -11 / 15),
        (FEB, "Web", "a", 1.0, 1.0, 0.4),
        (FEB, "Web", "b", 0.0, 0.0, None),
    ]
