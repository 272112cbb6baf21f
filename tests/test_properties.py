"""Property tests of the rounding on random small allocations."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plan_alloc import AllocSpec
from plan_alloc.operators import allocate as A

from conftest import JAN

SCHEMA = "period date, market string, channel string, client string, sku string, macro_target_qty double, raw_allocated_qty double"

groups = st.lists(
    st.lists(
        st.one_of(
            st.floats(min_value=0, max_value=50, allow_nan=False, allow_infinity=False),
            st.sampled_from([0.5, 1.25, 2.5, 3.75, 10.0 / 3]),
        ),
        min_size=1,
        max_size=12,
    ),
    min_size=1,
    max_size=4,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(groups=groups, decimals=st.sampled_from([0, 1, 2]))
def test_largest_remainder_properties(spark, groups, decimals):
    spec = AllocSpec(quantity_mode="decimal" if decimals else "integer", quantity_decimals=decimals)
    scale = 10**decimals
    data = []
    for g, raws in enumerate(groups):
        target = round(sum(round(r * scale) for r in raws)) / scale  # a target the raws can reach
        data += [(JAN, f"M{g}", "W", f"c{i % 3}", f"s{i}", target, float(r)) for i, r in enumerate(raws)]
    df = spark.createDataFrame(data, SCHEMA)
    cols = ["market", "client", "sku", "macro_target_qty", "rounded_allocated_qty", "residual_rank", "final_allocated_qty"]
    window = sorted(tuple(r) for r in A.apply_rounding(df, spec).allocations.select(*cols).collect())
    ranged = sorted(
        tuple(r) for r in A.apply_rounding(df, AllocSpec(
            quantity_mode=spec.quantity_mode, quantity_decimals=decimals, hot_group_rows=1), rows_per_task=3
        ).allocations.select(*cols).collect()
    )
    assert window == ranged
    by_group: dict[str, list] = {}
    for market, _, _, target, rounded, rank, final in window:
        by_group.setdefault(market, []).append((target, rounded, rank, final))
        assert -1e-9 <= final - rounded <= 1.0 / scale + 1e-9
    for rows in by_group.values():
        target = rows[0][0]
        assert abs(sum(r[3] for r in rows) - target) <= 0.5 / scale + 1e-6
        assert sorted(r[2] for r in rows) == list(range(1, len(rows) + 1))
