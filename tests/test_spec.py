import pytest

from plan_alloc import AllocError, AllocSpec, ColumnNames, SpecError
from plan_alloc.spec import DataError, IntegrityError, SchemaError, TargetError, ZeroBaselineError


def test_defaults():
    spec = AllocSpec()
    assert spec.group_keys == ("period", "market", "channel")
    assert spec.quantity_mode == "integer" and spec.quantity_decimals == 0
    assert spec.zero_baseline == "fail"
    assert spec.allow_negative is False and spec.enforce_exact_totals is True
    assert spec.macro_required == ("period", "market", "channel", "macro_target_qty")
    assert spec.granular_required == ("period", "market", "channel", "client", "sku", "baseline_qty")
    assert spec.scale == 1 and spec.tolerance == 0.5


def test_decimal_mode_scale():
    spec = AllocSpec(quantity_mode="decimal", quantity_decimals=2)
    assert spec.scale == 100 and spec.unit == 0.01 and spec.tolerance == 0.005


@pytest.mark.parametrize(
    "kwargs",
    [
        {"group_keys": ()},
        {"group_keys": ("period", "period")},
        {"quantity_mode": "float"},
        {"quantity_decimals": -1},
        {"quantity_mode": "integer", "quantity_decimals": 2},
        {"zero_baseline": "skip"},
        {"hot_group_rows": 0},
    ],
)
def test_invalid_specs(kwargs):
    with pytest.raises(SpecError):
        AllocSpec(**kwargs)


def test_spec_error_is_value_error():
    with pytest.raises(ValueError):
        AllocSpec(quantity_decimals=-3)


def test_custom_column_names():
    cols = ColumnNames(sku="item", client="customer", target="goal", baseline="base")
    spec = AllocSpec(group_keys=("period", "market"), columns=cols)
    assert spec.macro_required == ("period", "market", "goal")
    assert spec.granular_required == ("period", "market", "customer", "item", "base")


def test_sku_in_group_keys_is_not_repeated():
    spec = AllocSpec(group_keys=("period", "sku"))
    assert spec.granular_keys == ("period", "sku", "client")


def test_error_family():
    for err in (SpecError, SchemaError, DataError, IntegrityError, ZeroBaselineError, TargetError):
        assert issubclass(err, AllocError)
    assert issubclass(ZeroBaselineError, Exception)
