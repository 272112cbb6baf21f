"""DuckDB SQL for the oracle side of every registered query.

Written independently of the Spark code, from the rules themselves; the two
must agree on every value. CTE chains are built from small named pieces so
each query only appends its final SELECT.
"""

from __future__ import annotations

from plan_alloc.functions.columns import NUMBER_PATTERN
from plan_alloc.operators.targets import NULL_MARKET
from plan_alloc.sources.cube import Cube, granular_sql, macro_sql, market_totals_sql, text_lines_sql

KEYS = "period, market, channel"


def _using(keys: str = KEYS) -> str:
    return f"USING ({keys})"


def with_ctes(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes)
    return f"WITH {body}\n{final}"


def to_exact(col: str) -> str:
    """DOUBLE → DECIMAL(28,9) rounding the shortest decimal text of the double
    half-up (what Spark's cast does); a direct DuckDB cast rounds ``x * 1e9``."""
    return f"CAST(CAST({col} AS VARCHAR) AS DECIMAL(28,9))"


def exact_sum(col: str) -> str:
    return f"COALESCE(CAST(SUM({to_exact(col)}) AS DOUBLE), 0.0)"


def allocation_ctes(
    cube: Cube = Cube(),
    decimals: int = 0,
    zero_baseline: str = "fail",
    granular_name: str = "granular",
    macro_name: str = "macro",
    baseline: str = "baseline_qty",
    target: str = "macro_target_qty",
    include_inputs: bool = True,
) -> list[tuple[str, str]]:
    """granular, macro → totals → weighted → alloc → scaled → ranked → rounded."""
    scale = float(10**decimals)
    ctes: list[tuple[str, str]] = []
    if include_inputs:
        ctes += [(granular_name, granular_sql(cube)), (macro_name, macro_sql(cube))]
    if zero_baseline == "equal_split":
        weight = (
            f"CASE WHEN t.group_baseline_qty = 0 THEN 1.0::DOUBLE / CAST(t.n AS DOUBLE) "
            f"WHEN t.group_baseline_qty <> 0 THEN g.{baseline} / t.group_baseline_qty END"
        )
    else:
        weight = f"CASE WHEN t.group_baseline_qty <> 0 THEN g.{baseline} / t.group_baseline_qty END"
    ctes += [
        (
            "totals",
            f"SELECT {KEYS}, {exact_sum(baseline)} AS group_baseline_qty, COUNT(*) AS n "
            f"FROM {granular_name} GROUP BY {KEYS}",
        ),
        (
            "weighted",
            f"SELECT g.period, g.market, g.channel, g.client, g.sku, g.{baseline}, "
            f"t.group_baseline_qty, {weight} AS weight "
            f"FROM {granular_name} g JOIN totals t {_using()}",
        ),
        (
            "alloc",
            f"SELECT w.*, m.{target}, w.weight * m.{target} AS raw_allocated_qty "
            f"FROM weighted w JOIN (SELECT {KEYS}, {target} FROM {macro_name}) m {_using()}",
        ),
        (
            "scaled",
            f"SELECT *, raw_allocated_qty * {scale}::DOUBLE AS raw_s, "
            f"round({target} * {scale}::DOUBLE, 0) AS tgt_s, "
            f"CAST(floor(raw_allocated_qty * {scale}::DOUBLE) AS DOUBLE) AS floor_s, "
            f"raw_allocated_qty * {scale}::DOUBLE - CAST(floor(raw_allocated_qty * {scale}::DOUBLE) AS DOUBLE) AS rem_s "
            f"FROM alloc",
        ),
        (
            "ranked",
            f"SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEYS} ORDER BY rem_s DESC NULLS LAST, sku ASC, client ASC) "
            f"AS residual_rank, "
            f"MAX(tgt_s) OVER (PARTITION BY {KEYS}) - SUM(floor_s) OVER (PARTITION BY {KEYS}) AS residual "
            f"FROM scaled",
        ),
        (
            "rounded",
            f"SELECT period, market, channel, client, sku, {baseline}, group_baseline_qty, weight, {target}, "
            f"raw_allocated_qty, floor_s / {scale}::DOUBLE AS rounded_allocated_qty, "
            f"rem_s / {scale}::DOUBLE AS rounding_remainder, residual_rank, "
            f"(CASE WHEN residual_rank <= residual THEN 1.0 ELSE 0.0 END)::DOUBLE / {scale}::DOUBLE "
            f"AS residual_adjustment, "
            f"(floor_s + (CASE WHEN residual_rank <= residual THEN 1.0 ELSE 0.0 END)::DOUBLE) / {scale}::DOUBLE "
            f"AS final_allocated_qty "
            f"FROM ranked",
        ),
    ]
    return ctes


def group_summary_sql(decimals: int = 0, target: str = "macro_target_qty") -> str:
    """SELECT over the ``scaled`` CTE (rnd_group_summary)."""
    scale = float(10**decimals)
    added = f"GREATEST(LEAST(MAX(tgt_s) - SUM(floor_s), CAST(COUNT(*) AS DOUBLE)), 0.0)"
    return (
        f"SELECT {KEYS}, MAX({target}) AS {target}, {exact_sum('raw_allocated_qty')} AS raw_group_total, "
        f"SUM(floor_s) / {scale}::DOUBLE AS rounded_group_total, "
        f"(SUM(floor_s) + {added}) / {scale}::DOUBLE AS final_group_total, "
        f"{added} / {scale}::DOUBLE AS residual_added_total, "
        f"MAX({target}) - SUM(floor_s) / {scale}::DOUBLE AS rounded_gap, "
        f"MAX({target}) - (SUM(floor_s) + {added}) / {scale}::DOUBLE AS final_gap "
        f"FROM scaled GROUP BY {KEYS}"
    )


def integrity_ctes(tolerance: float, target: str = "macro_target_qty") -> list[tuple[str, str]]:
    """group_checks over ``rounded``; unmatched groups from ``macro``/``totals``."""
    return [
        (
            "group_checks",
            f"SELECT *, {target} - final_allocated_total AS allocation_gap, "
            f"{target} = final_allocated_total AS exact_match, "
            f"abs({target} - final_allocated_total) AS absolute_gap, "
            f"abs({target} - final_allocated_total) <= {tolerance!r} AS within_tolerance "
            f"FROM (SELECT {KEYS}, MAX({target}) AS {target}, {exact_sum('final_allocated_qty')} "
            f"AS final_allocated_total, COUNT(*) AS row_count FROM rounded GROUP BY {KEYS}) x",
        ),
        (
            "unmatched_macro",
            f"SELECT DISTINCT {KEYS} FROM macro m WHERE NOT EXISTS (SELECT 1 FROM totals t "
            "WHERE t.period = m.period AND t.market = m.market AND t.channel = m.channel)",
        ),
        (
            "unmatched_granular",
            f"SELECT {KEYS} FROM totals t WHERE NOT EXISTS (SELECT 1 FROM macro m "
            "WHERE t.period = m.period AND t.market = m.market AND t.channel = m.channel)",
        ),
    ]


def integrity_summary_sql(allow_negative: bool) -> str:
    neg = "FALSE" if allow_negative else "negative_allocation_count > 0"
    return (
        "SELECT *, NOT (groups_with_gap_count > 0 OR " + neg + " OR unmatched_macro_group_count > 0 "
        "OR unmatched_granular_group_count > 0) AS is_valid FROM (SELECT "
        "(SELECT COUNT(*) FROM group_checks) AS validated_group_count, "
        "(SELECT COUNT(*) FROM group_checks WHERE NOT within_tolerance) AS groups_with_gap_count, "
        "(SELECT COUNT(*) FROM rounded WHERE final_allocated_qty < 0) AS negative_allocation_count, "
        "(SELECT COUNT(*) FROM unmatched_macro) AS unmatched_macro_group_count, "
        "(SELECT COUNT(*) FROM unmatched_granular) AS unmatched_granular_group_count) s"
    )


STRIP = "trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def annotated_text_ctes(cube: Cube = Cube()) -> list[tuple[str, str]]:
    """text lines → parsed period/quantity → first reason."""
    formats = ["%Y-%m", "%Y-%m-%d", "%Y/%m", "%Y/%m/%d", "%d/%m/%Y"]
    parsed = ", ".join(f"try_strptime(p_s, '{f}')" for f in formats)
    return [
        ("t", text_lines_sql(cube)),
        (
            "a",
            f"SELECT *, {STRIP.format(c='period')} AS p_s, {STRIP.format(c='baseline_qty')} AS q_t, "
            f"replace({STRIP.format(c='baseline_qty')}, ',', '') AS q_s FROM t",
        ),
        (
            "b",
            f"SELECT *, CAST(date_trunc('month', coalesce({parsed})) AS DATE) AS p_d, "
            f"CASE WHEN regexp_matches(q_s, '{NUMBER_PATTERN}') AND abs(TRY_CAST(q_s AS DOUBLE)) <> 'inf'::DOUBLE "
            f"THEN TRY_CAST(q_s AS DOUBLE) END AS q_d FROM a",
        ),
        (
            "c",
            "SELECT *, CASE WHEN period IS NULL THEN 'period_null' WHEN p_s = '' THEN 'period_empty' "
            "WHEN p_d IS NULL THEN 'period_invalid' END AS p_reason, "
            "CASE WHEN baseline_qty IS NULL THEN 'qty_null' WHEN q_t = '' THEN 'qty_empty' "
            "WHEN q_d IS NULL THEN 'qty_non_numeric' END AS q_reason FROM b",
        ),
        ("d", "SELECT *, coalesce(p_reason, q_reason) AS reason FROM c"),
    ]


def standardize_oracle() -> dict[str, str]:
    ctes = annotated_text_ctes()
    gkeys = "period, market, channel, client, sku"
    std = ctes + [
        (
            "std",
            "SELECT p_d AS period, market, channel, client, sku, q_d AS baseline_qty FROM d WHERE reason IS NULL",
        )
    ]
    null_ctes = annotated_text_ctes(Cube(null_market="ASIA"))
    nulls = ", ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in gkeys.split(", "))
    return {
        "std_period_formats": with_ctes(
            ctes, "SELECT l_orderkey, l_linenumber, period AS period_text, p_d AS period, p_reason AS reason FROM d"
        ),
        "std_quantity_text": with_ctes(
            ctes, "SELECT l_orderkey, l_linenumber, baseline_qty AS qty_text, q_d AS qty, q_reason AS reason FROM d"
        ),
        "std_granular": with_ctes(std, "SELECT * FROM std"),
        "std_rejects": with_ctes(
            ctes,
            "SELECT l_orderkey, l_linenumber, period, market, channel, client, sku, baseline_qty, reason "
            "FROM d WHERE reason IS NOT NULL",
        ),
        "chk_duplicate_keys": with_ctes(
            std, f"SELECT {gkeys}, COUNT(*) AS row_count FROM std GROUP BY {gkeys} HAVING COUNT(*) > 1"
        ),
        "chk_null_profile": with_ctes(
            null_ctes[:1],
            f"SELECT 'granular' AS dataset, COUNT(*) AS row_count, CAST(8 AS BIGINT) AS column_count, {nulls} FROM t",
        ),
    }


def malformed_csv_oracle() -> dict[str, str]:
    """Lines with a surplus field, a missing field or an unclosed quote are rejects
    with their raw text; the others are rows."""
    ctes = annotated_text_ctes()[:3] + [
        (
            "k",
            "SELECT *, (l_orderkey + l_linenumber) % 6 AS kind, coalesce(p_d, DATE '1990-01-01') AS month, "
            "'1,0' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '.5' AS qty FROM b",
        ),
        (
            "l",
            "SELECT *, strftime(month, '%Y-%m') || ',' || market || ',' || channel || ',\"' || client || ' \"\"A\"\"\",' || sku || "
            "CASE kind WHEN 1 THEN ',' || qty WHEN 3 THEN '' WHEN 5 THEN ',\"' || qty END AS line FROM k",
        ),
    ]
    nulls = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in ("period", "market", "channel", "client", "sku", "baseline_qty"))
    return {
        "src_csv_malformed": with_ctes(ctes, f"SELECT {nulls}, line, 'csv_malformed' AS reason FROM l WHERE kind IN (1, 3, 5)"),
        "src_csv_wellformed": with_ctes(
            ctes,
            "SELECT month AS period, market, channel, client || ' \"A\"' AS client, sku, "
            "CAST(replace(qty, ',', '') AS DOUBLE) AS baseline_qty FROM l WHERE kind NOT IN (1, 3, 5)",
        ),
    }


__all__ = ["allocation_ctes", "exact_sum", "granular_sql", "group_summary_sql", "macro_sql", "market_totals_sql", "with_ctes", "KEYS"]


# --------------------------------------------------------------------------
# planning layer and two-metric outputs
# --------------------------------------------------------------------------
SENTINEL = f"'{NULL_MARKET}'"
ROW_KEYS = "period, market, channel, client, sku"


def wsum(expr: str, part: str = "yr, market, channel") -> str:
    return f"COALESCE(CAST(SUM({to_exact(expr)}) OVER (PARTITION BY {part}) AS DOUBLE), 0.0)"


def reference_ctes(cube: Cube) -> list[tuple[str, str]]:
    return [
        ("granular", granular_sql(cube)),
        (
            "ref",
            f"SELECT period, COALESCE(market, {SENTINEL}) AS market, channel, client, sku, "
            "CAST(baseline_qty AS DOUBLE) AS baseline_qty, CAST(baseline_value AS DOUBLE) AS baseline_value, "
            "CASE WHEN baseline_qty > 0 THEN baseline_value / baseline_qty END AS unit_price FROM granular",
        ),
    ]


def direct_target_ctes(cube: Cube) -> list[tuple[str, str]]:
    return [
        ("macro", macro_sql(cube)),
        (
            "targets",
            f"SELECT DISTINCT period, COALESCE(market, {SENTINEL}) AS market, channel, "
            "CAST(macro_target_qty AS DOUBLE) AS macro_target_qty, "
            "CAST(macro_target_value AS DOUBLE) AS macro_target_value FROM macro",
        ),
    ]


def lock_template_sql(basis: str, months: tuple[str, ...]) -> str:
    metric = "baseline_qty" if basis == "units" else "baseline_value"
    inlist = ", ".join(f"DATE '{m}'" for m in months)
    return (
        f"SELECT {KEYS}, TRUE AS is_locked, {exact_sum(metric)} AS locked_target "
        f"FROM ref WHERE period IN ({inlist}) GROUP BY {KEYS}"
    )


def share_target_ctes(cube: Cube, basis: str, share: float, months: tuple[str, ...]) -> list[tuple[str, str]]:
    """ref → market totals ⟕ monthly granular ⟕ locks → annual windows → targets."""
    driver = "total_market_qty" if basis == "units" else "total_market_value"
    source = "baseline_qty" if basis == "units" else "baseline_value"
    if basis == "units":
        tq = "driver_target"
        tv = "CASE WHEN mup IS NOT NULL AND mup > 0 THEN driver_target * mup END"
    else:
        tv = "driver_target"
        tq = "CASE WHEN mup IS NOT NULL AND mup > 0 THEN driver_target / mup END"
    return reference_ctes(cube) + [
        ("mt", market_totals_sql(cube)),
        ("monthly", f"SELECT {KEYS}, {exact_sum(source)} AS glt FROM ref GROUP BY {KEYS}"),
        ("locks", f"SELECT DISTINCT * FROM ({lock_template_sql(basis, months)}) lt" if months else
         "SELECT NULL::DATE AS period, NULL AS market, NULL AS channel, NULL::BOOLEAN AS is_locked, "
         "NULL::DOUBLE AS locked_target WHERE FALSE"),
        (
            "sw",
            f"SELECT m.period, m.market, m.channel, m.total_market_qty, m.total_market_value, "
            f"year(m.period) AS yr, mo.glt, COALESCE(l.is_locked, FALSE) AS is_locked, l.locked_target "
            f"FROM (SELECT period, COALESCE(market, {SENTINEL}) AS market, channel, "
            f"CAST(total_market_qty AS DOUBLE) AS total_market_qty, "
            f"CAST(total_market_value AS DOUBLE) AS total_market_value FROM (SELECT DISTINCT * FROM mt) d) m "
            f"LEFT JOIN monthly mo {_using()} LEFT JOIN locks l {_using()}",
        ),
        (
            "sx",
            f"SELECT *, CASE WHEN total_market_qty IS NOT NULL AND total_market_value IS NOT NULL "
            f"AND total_market_qty > 0 THEN total_market_value / total_market_qty END AS mup, "
            f"{wsum(driver)} * CAST({share!r} AS DOUBLE) AS annual, "
            f"CASE WHEN is_locked THEN COALESCE(locked_target, glt) END AS eff FROM sw",
        ),
        (
            "sy",
            f"SELECT *, {wsum('COALESCE(eff, 0.0)')} AS locked_total, "
            f"{wsum(f'CASE WHEN NOT is_locked THEN {driver} ELSE 0.0 END')} AS unlocked_w, "
            f"SUM(CASE WHEN NOT is_locked THEN 1 ELSE 0 END) OVER (PARTITION BY yr, market, channel) AS unlocked_months "
            f"FROM sx",
        ),
        (
            "sz",
            f"SELECT *, annual - locked_total AS remaining, "
            f"CASE WHEN is_locked THEN eff ELSE (CASE WHEN (unlocked_w) > 0 "
            f"THEN (annual - locked_total) * {driver} / unlocked_w ELSE 0.0 END) END AS driver_target FROM sy",
        ),
        (
            "targets",
            f"SELECT DISTINCT {KEYS}, CAST({tq} AS DOUBLE) AS macro_target_qty, "
            f"CAST({tv} AS DOUBLE) AS macro_target_value FROM sz",
        ),
    ]


def share_violations_sql() -> str:
    return (
        f"SELECT 'lock_without_source' AS rule, {KEYS} FROM sz WHERE is_locked AND eff IS NULL "
        f"UNION ALL SELECT 'lock_exceeds_annual', {KEYS} FROM sz WHERE remaining < -1e-9 "
        f"UNION ALL SELECT 'no_unlocked_weight', {KEYS} FROM sz "
        f"WHERE NOT is_locked AND remaining > 1e-9 AND unlocked_w <= 0 "
        f"UNION ALL SELECT 'annual_target_unreached', {KEYS} FROM sz WHERE unlocked_months = 0 AND remaining > 1e-9"
    )


def dual_ctes(basis: str, decimals: int = 0) -> list[tuple[str, str]]:
    """After ``ref`` and ``targets``: engine inputs → allocation → both metrics."""
    drive_t = "macro_target_qty" if basis == "units" else "macro_target_value"
    drive_b = "baseline_qty" if basis == "units" else "baseline_value"
    priced = "f.unit_price IS NOT NULL AND f.unit_price > 0"
    if basis == "units":
        metrics = (
            "r.baseline_qty, f.baseline_value, f.unit_price, r.weight, m.macro_target_qty, m.macro_target_value, "
            + ", ".join(
                f"r.{s}_allocated_qty, CASE WHEN {priced} THEN r.{s}_allocated_qty * f.unit_price END "
                f"AS {s}_allocated_value"
                for s in ("raw", "rounded", "final")
            )
        )
    else:
        metrics = (
            "f.baseline_qty, r.baseline_qty AS baseline_value, f.unit_price, r.weight, m.macro_target_qty, "
            "m.macro_target_value, "
            + ", ".join(
                f"CASE WHEN {priced} THEN r.{s}_allocated_qty / f.unit_price END AS {s}_allocated_qty, "
                f"r.{s}_allocated_qty AS {s}_allocated_value"
                for s in ("raw", "rounded", "final")
            )
        )
    ctes = [
        ("engine_macro", f"SELECT {KEYS}, {drive_t} AS macro_target_qty FROM targets"),
        (
            "engine_granular",
            f"SELECT {ROW_KEYS}, {drive_b} AS baseline_qty FROM ref "
            f"WHERE ({KEYS}) IN (SELECT ({KEYS}) FROM engine_macro)",
        ),
    ]
    ctes += allocation_ctes(
        decimals=decimals, granular_name="engine_granular", macro_name="engine_macro", include_inputs=False
    )
    ctes += [
        ("valid", f"SELECT DISTINCT {KEYS} FROM rounded"),
        (
            "macro_ref",
            f"SELECT DISTINCT {KEYS}, macro_target_qty, macro_target_value FROM targets "
            f"WHERE ({KEYS}) IN (SELECT ({KEYS}) FROM valid)",
        ),
        (
            "final_allocations",
            f"SELECT r.period, r.market, r.channel, r.client, r.sku, {metrics} FROM rounded r "
            f"LEFT JOIN ref f ON f.period = r.period AND f.market = r.market AND f.channel = r.channel "
            f"AND f.client = r.client AND f.sku = r.sku "
            f"LEFT JOIN macro_ref m ON m.period = r.period AND m.market = r.market AND m.channel = r.channel",
        ),
    ]
    return ctes


def _without_channels(sql: str, row_keys: str, figures: tuple[str, ...]) -> str:
    sums = ", ".join(f"CAST(SUM(CAST({c} AS DECIMAL(28,2))) AS DOUBLE) AS {c}" for c in figures)
    return f"SELECT period, market, 'all' AS channel, {row_keys}{sums} FROM ({sql}) x GROUP BY ALL"


def _replaced(ctes: list[tuple[str, str]], **new: str) -> list[tuple[str, str]]:
    return [(name, new.get(name, sql)) for name, sql in ctes]


def market_keys_sql() -> str:
    """Groups of one channel each are groups of (period, market)."""
    granular = _without_channels(granular_sql(), "client, sku, ", ("baseline_qty", "baseline_value"))
    macro = _without_channels(macro_sql(), "", ("macro_target_qty", "macro_target_value"))
    ctes = _replaced(reference_ctes(Cube()) + direct_target_ctes(Cube()), granular=granular, macro=macro)
    return with_ctes(ctes + dual_ctes("units"), "SELECT * EXCLUDE (channel) FROM final_allocations")


def share_by_market_sql(months: tuple[str, ...]) -> str:
    granular = _without_channels(granular_sql(), "client, sku, ", ("baseline_qty", "baseline_value"))
    totals = _without_channels(market_totals_sql(), "", ("total_market_qty", "total_market_value"))
    ctes = _replaced(share_target_ctes(Cube(), "units", 1.0, months), granular=granular, mt=totals)
    return with_ctes(ctes, "SELECT * EXCLUDE (channel) FROM targets")


def lock_rules_sql(cube: Cube) -> str:
    totals = market_totals_sql(cube)
    ctes = _replaced(
        share_target_ctes(cube, "units", 0.05, ("1997-01-01",)),
        granular=f"SELECT * FROM ({granular_sql(cube)}) x WHERE channel = 'F'",
        mt=f"SELECT period, market, channel, CASE WHEN channel = 'O' AND month(period) > 2 THEN 0.0 ELSE total_market_qty END "
        f"AS total_market_qty, total_market_value FROM ({totals}) x",
        locks=f"SELECT period, market, channel, TRUE AS is_locked, CASE WHEN channel = 'O' THEN NULL WHEN channel = 'F' THEN 0.25 "
        f"ELSE total_market_qty END AS locked_target FROM ({totals}) x WHERE channel = 'F' OR month(period) <= 2",
    )
    return with_ctes(ctes, share_violations_sql())


def broken_groups_sql() -> str:
    """Group totals summed from the rows' final quantities."""
    ctes = allocation_ctes()
    factor = "CASE market WHEN 'ASIA' THEN 1.5 WHEN 'EUROPE' THEN 0.2 ELSE 1.0 END"
    ctes = [(n, sql if n != "alloc" else f"SELECT * REPLACE (raw_allocated_qty * {factor} AS raw_allocated_qty) FROM ({sql}) x") for n, sql in ctes]
    return with_ctes(
        ctes,
        f"SELECT * FROM (SELECT {KEYS}, SUM(final_allocated_qty) AS final_group_total, SUM(residual_adjustment) AS residual_added_total, "
        f"MAX(macro_target_qty) - SUM(final_allocated_qty) AS final_gap, "
        f"round(MAX(macro_target_qty), 0) < SUM(rounded_allocated_qty) AS negative_residual FROM rounded GROUP BY {KEYS}) g "
        "WHERE abs(final_gap) > 0.500001",
    )


def dual_group_sql() -> str:
    return (
        "SELECT *, final_allocated_group_qty - baseline_group_qty AS group_delta_qty, "
        "final_allocated_group_value - baseline_group_value AS group_delta_value, "
        "CASE WHEN baseline_group_qty <> 0 THEN (final_allocated_group_qty - baseline_group_qty) "
        "/ baseline_group_qty END AS group_delta_qty_pct, "
        "CASE WHEN baseline_group_value <> 0 THEN (final_allocated_group_value - baseline_group_value) "
        "/ baseline_group_value END AS group_delta_value_pct, "
        "macro_target_qty - final_allocated_group_qty AS final_gap_to_target_qty, "
        "macro_target_value - final_allocated_group_value AS final_gap_to_target_value "
        f"FROM (SELECT {KEYS}, MAX(macro_target_qty) AS macro_target_qty, "
        "MAX(macro_target_value) AS macro_target_value, "
        f"{exact_sum('baseline_qty')} AS baseline_group_qty, {exact_sum('baseline_value')} AS baseline_group_value, "
        f"{exact_sum('final_allocated_qty')} AS final_allocated_group_qty, "
        f"{exact_sum('final_allocated_value')} AS final_allocated_group_value, COUNT(*) AS row_count "
        f"FROM final_allocations GROUP BY {KEYS}) g"
    )


def dual_sku_sql() -> str:
    return (
        f"SELECT a.period, a.market, a.channel, a.client, a.sku, a.baseline_qty, a.baseline_value, a.unit_price, "
        "a.weight, a.raw_allocated_qty, a.raw_allocated_value, a.rounded_allocated_qty, a.rounded_allocated_value, "
        "a.final_allocated_qty, a.final_allocated_value, "
        "CASE WHEN t.fq <> 0 THEN a.final_allocated_qty / t.fq END AS final_weight_qty, "
        "CASE WHEN t.fv <> 0 THEN a.final_allocated_value / t.fv END AS final_weight_value, "
        "a.final_allocated_qty - a.baseline_qty AS sku_delta_qty, "
        "CASE WHEN a.baseline_qty <> 0 THEN (a.final_allocated_qty - a.baseline_qty) / a.baseline_qty END "
        "AS sku_delta_qty_pct, "
        "a.final_allocated_value - a.baseline_value AS sku_delta_value, "
        "CASE WHEN a.baseline_value <> 0 THEN (a.final_allocated_value - a.baseline_value) / a.baseline_value END "
        "AS sku_delta_value_pct "
        f"FROM final_allocations a JOIN (SELECT {KEYS}, {exact_sum('final_allocated_qty')} AS fq, "
        f"{exact_sum('final_allocated_value')} AS fv FROM final_allocations GROUP BY {KEYS}) t "
        "ON a.period = t.period AND a.market = t.market AND a.channel = t.channel"
    )


def report_group_sql() -> str:
    return (
        "SELECT *, final_allocated_group_qty - baseline_group_qty AS group_delta_qty, "
        "CASE WHEN baseline_group_qty <> 0 THEN (final_allocated_group_qty - baseline_group_qty) "
        "/ baseline_group_qty END AS group_delta_pct, "
        "macro_target_qty - final_allocated_group_qty AS final_gap_to_target "
        f"FROM (SELECT {KEYS}, MAX(macro_target_qty) AS macro_target_qty, "
        f"{exact_sum('baseline_qty')} AS baseline_group_qty, "
        f"{exact_sum('raw_allocated_qty')} AS raw_allocated_group_qty, "
        f"{exact_sum('rounded_allocated_qty')} AS rounded_group_qty, "
        f"{exact_sum('final_allocated_qty')} AS final_allocated_group_qty, COUNT(*) AS sku_count "
        f"FROM rounded GROUP BY {KEYS}) g"
    )


def report_sku_sql() -> str:
    return (
        "SELECT r.period, r.market, r.channel, r.client, r.sku, r.baseline_qty, r.group_baseline_qty, r.weight, "
        "r.raw_allocated_qty, r.rounded_allocated_qty, r.final_allocated_qty, "
        "CASE WHEN r.group_baseline_qty <> 0 THEN r.baseline_qty / r.group_baseline_qty END AS baseline_weight, "
        "CASE WHEN t.ft <> 0 THEN r.final_allocated_qty / t.ft END AS final_weight, "
        "r.final_allocated_qty - r.baseline_qty AS sku_delta_qty, "
        "CASE WHEN r.baseline_qty <> 0 THEN (r.final_allocated_qty - r.baseline_qty) / r.baseline_qty END "
        "AS sku_delta_pct, "
        "(CASE WHEN t.ft <> 0 THEN r.final_allocated_qty / t.ft END) - "
        "(CASE WHEN r.group_baseline_qty <> 0 THEN r.baseline_qty / r.group_baseline_qty END) AS weight_delta "
        f"FROM rounded r JOIN (SELECT {KEYS}, {exact_sum('final_allocated_qty')} AS ft FROM rounded "
        f"GROUP BY {KEYS}) t ON r.period = t.period AND r.market = t.market AND r.channel = t.channel"
    )
