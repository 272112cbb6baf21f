import pytest

from plan_alloc import AllocSpec
from plan_alloc.operators.integrity import enforce_integrity, validate_integrity
from plan_alloc.spec import IntegrityError

from conftest import JAN, FEB, rows

R = "period date, market string, channel string, sku string, macro_target_qty double, final_allocated_qty double"
KEYS = "period date, market string, channel string"


def _empty(spark):
    return spark.createDataFrame([], KEYS)


def test_valid_result(spark):
    r = spark.createDataFrame([(JAN, "N", "W", "a", 10.0, 6.0), (JAN, "N", "W", "b", 10.0, 4.0)], R)
    res = validate_integrity(r, _empty(spark), _empty(spark), AllocSpec())
    assert rows(res.group_checks, "macro_target_qty", "final_allocated_total", "row_count", "allocation_gap",
                "exact_match", "within_tolerance") == [(10.0, 10.0, 2, 0.0, True, True)]
    row = enforce_integrity(res, AllocSpec())
    assert row == {
        "validated_group_count": 1,
        "groups_with_gap_count": 0,
        "negative_allocation_count": 0,
        "unmatched_macro_group_count": 0,
        "unmatched_granular_group_count": 0,
        "is_valid": True,
    }


def test_gap_detected(spark):
    r = spark.createDataFrame([(JAN, "N", "W", "a", 10.0, 8.0)], R)
    res = validate_integrity(r, _empty(spark), _empty(spark), AllocSpec())
    assert res.summary.first()["groups_with_gap_count"] == 1
    with pytest.raises(IntegrityError, match="miss their target"):
        enforce_integrity(res, AllocSpec())


def test_negatives_allowed_or_not(spark):
    r = spark.createDataFrame([(JAN, "N", "W", "a", 5.0, 10.0), (JAN, "N", "W", "b", 5.0, -5.0)], R)
    allowed = AllocSpec(allow_negative=True)
    res = validate_integrity(r, _empty(spark), _empty(spark), allowed)
    row = enforce_integrity(res, allowed)
    assert row["is_valid"] and row["negative_allocation_count"] == 1
    assert rows(res.negative_allocations, "sku") == [("b",)]
    res = validate_integrity(r, _empty(spark), _empty(spark), AllocSpec())
    with pytest.raises(IntegrityError, match="are negative"):
        enforce_integrity(res, AllocSpec())


def test_unmatched_groups_and_reason_order(spark):
    r = spark.createDataFrame([(JAN, "N", "W", "a", 10.0, 8.0)], R)
    um = spark.createDataFrame([(FEB, "N", "W")], KEYS)
    ug = spark.createDataFrame([(FEB, "S", "W")], KEYS)
    res = validate_integrity(r, um, ug, AllocSpec())
    with pytest.raises(IntegrityError) as err:
        enforce_integrity(res, AllocSpec())
    msg = str(err.value)
    parts = ["miss their target", "targets have no baseline", "baseline groups have no target"]
    assert [msg.index(p) for p in parts] == sorted(msg.index(p) for p in parts)


def test_not_enforced_returns_invalid_summary(spark):
    r = spark.createDataFrame([(JAN, "N", "W", "a", 10.0, 8.0)], R)
    spec = AllocSpec(enforce_exact_totals=False)
    row = enforce_integrity(validate_integrity(r, _empty(spark), _empty(spark), spec), spec)
    assert row["is_valid"] is False


def test_missing_columns(spark):
    r = spark.createDataFrame([(JAN, "N", "W", "a", 10.0)], "period date, market string, channel string, sku string, macro_target_qty double")
    with pytest.raises(IntegrityError, match="final_allocated_qty"):
        validate_integrity(r, _empty(spark), _empty(spark), AllocSpec())


def test_gap_of_five_units_at_ten_decimals(spark):
    spec = AllocSpec(quantity_mode="decimal", quantity_decimals=10)
    r = spark.createDataFrame([(JAN, "N", "W", "a", 8e-10, 3e-10)], R)
    res = validate_integrity(r, _empty(spark), _empty(spark), spec)
    assert rows(res.group_checks, "final_allocated_total", "within_tolerance") == [(3e-10, False)]
