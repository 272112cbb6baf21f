from datetime import date

import pytest

from plan_alloc import AllocSpec
from plan_alloc.operators.checks import enforce, violation_counts
from plan_alloc.operators.standardize import (
    check_columns,
    duplicate_columns,
    standardize_granular,
    standardize_macro,
)
from plan_alloc.spec import DataError, SchemaError

from conftest import rows

G = "period string, market string, channel string, client string, sku string, baseline_qty string"
M = "period string, market string, channel string, macro_target_qty string"


def test_macro_mixed_number_text(spark):
    df = spark.createDataFrame([("2026-01", "N", "Web", "1,200"), ("2026-02-01", "N", "Web", "35")], M)
    std = standardize_macro(df, AllocSpec())
    assert rows(std.table) == [(date(2026, 1, 1), "N", "Web", 1200.0), (date(2026, 2, 1), "N", "Web", 35.0)]
    assert enforce(std.checks) == {"macro_null_keys": 0, "macro_rejected_values": 0, "macro_duplicate_keys": 0}


def test_granular_mixed_dates_and_numbers(spark):
    df = spark.createDataFrame(
        [
            ("2026/01/20", "N", "Web", "c1", "a", "10"),
            ("20/02/2026", "N", "Web", "c1", "a", "2,500.25"),
        ],
        G,
    )
    std = standardize_granular(df, AllocSpec())
    assert std.table.columns == ["period", "market", "channel", "client", "sku", "baseline_qty"]
    assert rows(std.table, "period", "baseline_qty") == [(date(2026, 1, 1), 10.0), (date(2026, 2, 1), 2500.25)]


def test_extra_columns_are_dropped(spark):
    df = spark.createDataFrame([("2026-01", "N", "Web", "5", "x")], M + ", note string")
    assert standardize_macro(df, AllocSpec()).table.columns == ["period", "market", "channel", "macro_target_qty"]


def test_duplicate_business_keys(spark):
    df = spark.createDataFrame(
        [("2026-01", "N", "Web", "c", "a", "1"), ("2026-01-09", "N", "Web", "c", "a", "2")], G
    )
    std = standardize_granular(df, AllocSpec())
    with pytest.raises(DataError, match="repeats business keys"):
        enforce(std.checks)


def test_bad_values_go_to_rejects(spark):
    df = spark.createDataFrame(
        [
            ("2026-01", "N", "Web", "c", "a", None),
            ("2026-01", "N", "Web", "c", "b", "   "),
            ("2026-01", "N", "Web", "c", "d", "abc"),
            ("2026-13", "N", "Web", "c", "e", "4"),
            ("2026-01", "N", "Web", "c", "f", "7"),
        ],
        G,
    )
    std = standardize_granular(df, AllocSpec())
    assert rows(std.rejects, "sku", "reason") == [
        ("a", "qty_null"),
        ("b", "qty_empty"),
        ("d", "qty_non_numeric"),
        ("e", "period_invalid"),
    ]
    assert rows(std.table, "sku") == [("f",)]
    with pytest.raises(DataError, match="unreadable"):
        enforce(std.checks)


def test_boolean_quantity_is_rejected(spark):
    df = spark.createDataFrame([("2026-01", "N", "Web", True)], "period string, market string, channel string, macro_target_qty boolean")
    std = standardize_macro(df, AllocSpec())
    assert rows(std.rejects, "reason") == [("qty_non_numeric",)]


def test_missing_and_duplicate_columns(spark):
    df = spark.createDataFrame([("2026-01", "N", "5")], "period string, market string, macro_target_qty string")
    with pytest.raises(SchemaError, match="channel"):
        standardize_macro(df, AllocSpec())
    g = spark.createDataFrame([("2026-01", "N", "W", "a", "5")], "period string, market string, channel string, sku string, baseline_qty string")
    with pytest.raises(SchemaError, match="client"):
        standardize_granular(g, AllocSpec())
    dup = spark.createDataFrame([(1, 2)], "a int, b int").toDF("a", "a")
    with pytest.raises(SchemaError, match="repeats column"):
        check_columns(dup, ("a",), "macro")
    assert duplicate_columns(["a", "b", "a", "a", "b"]) == ["a", "b"]


def test_null_keys_are_schema_errors(spark):
    df = spark.createDataFrame([("2026-01", "N", "Web", None, "a", "5")], G)
    std = standardize_granular(df, AllocSpec())
    with pytest.raises(SchemaError, match="nulls in key"):
        enforce(std.checks)
    prof = std.profile.first()
    assert prof["row_count"] == 1 and prof["null_client"] == 1 and prof["null_sku"] == 0
    assert prof["column_count"] == 6


def test_custom_group_keys_without_period(spark):
    spec = AllocSpec(group_keys=("market", "channel"))
    df = spark.createDataFrame([("not a date", "N", "Web", "5")], M)
    std = standardize_macro(df, spec)
    assert rows(std.table) == [("N", "Web", 5.0)]


def test_checks_counted_in_one_pass(spark):
    df = spark.createDataFrame([("2026-01", "N", "Web", "x"), ("2026-01", "N", "Web", "1")], M)
    counts = violation_counts(standardize_macro(df, AllocSpec()).checks)
    assert counts == {"macro_null_keys": 0, "macro_rejected_values": 1, "macro_duplicate_keys": 0}


def test_reject_reasons_are_the_documented_codes(spark):
    from plan_alloc.operators.standardize import REASON_CODES
    from plan_alloc.sources.cube import text_lines

    from conftest import SF_SMALL

    std = standardize_granular(text_lines(spark, SF_SMALL), AllocSpec())
    seen = {r["reason"] for r in std.rejects.select("reason").distinct().collect()}
    assert seen and seen <= set(REASON_CODES)
