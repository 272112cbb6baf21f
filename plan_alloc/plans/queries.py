"""Registered queries: Spark callables ``(spark, sf_dir) -> DataFrame`` and
their DuckDB oracle SQL. Every query reads the given tables (through the
planning cube) over all order years."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plan_alloc.operators import allocate as A
from plan_alloc.operators import integrity as I
from plan_alloc.operators import reports as R
from plan_alloc.operators import standardize as S
from plan_alloc.operators import targets as TG
from plan_alloc.plans import job as J
from plan_alloc.functions.columns import period_month, period_reason, quantity_reason, quantity_value
from plan_alloc.plans import oracle as O
from pyspark.sql import functions as F

from plan_alloc.session import keep
from plan_alloc.sources.cube import Cube, granular_cube, kept_cubes, macro_cube, market_totals, text_lines
from plan_alloc.spec import AllocSpec

Query = Callable[[SparkSession, str], DataFrame]

CORE = Cube()  # market = region, channel = order priority
NATION = Cube(market="nation")  # finer markets: groups on one side only
ZERO = Cube(market="nation", returned_only=True)  # baseline = returned lines only: zero groups
NET = Cube(market="nation", net_of_returns=True)  # returns count negative: negative rows
STATUS = Cube(channel="status")
SHARE = Cube(channel="status", brands=("Brand#1", "Brand#2", "Brand#3"))  # a few brands in their market
LOCKED_MONTHS = ("1997-01-01", "1997-02-01")
SHARE_OF_MARKET = 0.12


def _units_inputs(spark: SparkSession, sf_dir: str, cube: Cube = CORE, kept: bool = False) -> tuple[DataFrame, DataFrame]:
    """``kept``: for queries of several jobs, see ``kept_cubes``."""
    granular, macro = kept_cubes(spark, sf_dir, cube, values=False) if kept else (granular_cube(spark, sf_dir, cube), macro_cube(spark, sf_dir, cube))
    return granular.drop("baseline_value"), macro.drop("macro_target_value")


def _rounded(spark: SparkSession, sf_dir: str, spec: AllocSpec, cube: Cube = CORE, kept: bool = False) -> A.Rounding:
    """Weights → redistribution → rounding, the groups measured once on the
    granular totals (size-checked broadcasts and hot-group routing for all
    three steps, as the job does)."""
    return _measured_rounding(spark, sf_dir, spec, cube, kept)[0]


def _measured_rounding(spark: SparkSession, sf_dir: str, spec: AllocSpec, cube: Cube = CORE, kept: bool = False) -> tuple[A.Rounding, A.GroupLayout]:
    """``kept``: for hot groups, whose buckets are counted before rows are ranked.
    Lines are joined once, and rows meet the ledger once."""
    granular, macro = _units_inputs(spark, sf_dir, cube, kept)
    totals, layout = _measured(granular, spec)
    red = A.allocate(granular, macro, spec, totals, layout)[1]
    if not kept:
        return A.apply_rounding(red.allocations, spec, layout=layout, by_group=red.by_group), layout
    lean = red.lean if layout.broadcast else keep(red.lean, "lean", clean=True)
    alloc = A.share(lean, spec).select(*red.allocations.columns)
    return A.apply_rounding(alloc, spec, layout=layout, by_group=red.by_group, lean=lean), layout


# ---- core allocation ------------------------------------------------------
def q_alloc_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    granular, _ = _units_inputs(spark, sf_dir, kept=True)
    return A.calculate_weights(granular, AllocSpec(), *_measured(granular, AllocSpec())).weights


def q_alloc_redistribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = AllocSpec()
    granular, macro = _units_inputs(spark, sf_dir, kept=True)
    totals, layout = _measured(granular, spec)
    weights = A.calculate_weights(granular, spec, totals, layout).weights
    return A.redistribute(macro, weights, spec, granular_groups=totals, layout=layout).allocations


def q_rnd_apportion_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spark, sf_dir, AllocSpec()).allocations


def q_rnd_apportion_decimal2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spark, sf_dir, AllocSpec(quantity_mode="decimal", quantity_decimals=2)).allocations


def q_rnd_apportion_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same result as the integer apportionment, every group forced through the
    bucketed (hot group) ranking path."""
    return _rounded(spark, sf_dir, AllocSpec(hot_group_rows=1, hot_rows_per_task=5_000), kept=True).allocations


def q_rnd_apportion_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same again with nothing broadcast: the ledger meets the rows of every
    group spread over salts, and crowded buckets go by the heads of their skus."""
    return _rounded(spark, sf_dir, AllocSpec(hot_group_rows=1, hot_rows_per_task=50, broadcast_group_limit=0), kept=True).allocations


def q_rnd_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spark, sf_dir, AllocSpec()).group_summary


def q_rnd_broken_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that break a rounding rule because the raw values don't add up to
    the target: too much in one market (a negative residual), too little in another."""
    spec = AllocSpec(enforce_exact_totals=False)
    granular, macro = _units_inputs(spark, sf_dir)
    totals, layout = _measured(granular, spec)
    factor = F.when(F.col("market") == "ASIA", 1.5).when(F.col("market") == "EUROPE", 0.2).otherwise(1.0)
    alloc = A.allocate(granular, macro, spec, totals, layout)[1].allocations.withColumn(A.RAW, F.col(A.RAW) * factor)
    summary = A.apply_rounding(alloc, spec, layout=layout).group_summary
    return summary.filter(F.abs("final_gap") > spec.tolerance + spec.slack).select(
        *spec.keys, "final_group_total", "residual_added_total", "final_gap",
        (F.round("macro_target_qty") < F.col("rounded_group_total")).alias("negative_residual"),
    )


# ---- zero baselines and unmatched groups ---------------------------------
def q_alloc_zero_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    granular, _ = _units_inputs(spark, sf_dir, ZERO)
    return A.calculate_weights(granular, AllocSpec()).zero_groups


def q_alloc_equal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    granular, _ = _units_inputs(spark, sf_dir, ZERO)
    return A.calculate_weights(granular, AllocSpec(zero_baseline="equal_split")).weights


def _measured(granular: DataFrame, spec: AllocSpec) -> tuple[DataFrame, A.GroupLayout]:
    totals = A.group_totals(granular, spec)
    return totals, A.measure_groups(totals, spec)


def _nation_redistribution(
    spark: SparkSession, sf_dir: str, cube: Cube, spec: AllocSpec
) -> tuple[A.Redistribution, A.GroupLayout]:
    granular, macro = _units_inputs(spark, sf_dir, cube)
    totals, layout = _measured(granular, spec)
    return A.allocate(granular, macro, spec, totals, layout)[1], layout


def q_alloc_unmatched_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_redistribution(spark, sf_dir, NATION, AllocSpec())[0].unmatched_macro


def q_alloc_unmatched_granular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_redistribution(spark, sf_dir, NATION, AllocSpec())[0].unmatched_granular


# ---- integrity ------------------------------------------------------------
def _net_integrity(spark: SparkSession, sf_dir: str) -> I.Integrity:
    spec = AllocSpec(zero_baseline="equal_split", allow_negative=True)
    red, layout = _nation_redistribution(spark, sf_dir, NET, spec)
    rounded = A.apply_rounding(red.allocations, spec, layout=layout, by_group=red.by_group).allocations
    return I.validate_integrity(rounded, red.unmatched_macro, red.unmatched_granular, spec)


def q_int_group_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _net_integrity(spark, sf_dir).group_checks


def q_int_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _net_integrity(spark, sf_dir).negative_allocations


def q_int_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _net_integrity(spark, sf_dir).summary


# ---- standardising --------------------------------------------------------
def q_std_period_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text_lines(spark, sf_dir)
    dtype = t.schema["period"].dataType
    return t.withColumn("_month", period_month(F.col("period"), dtype)).select(
        "l_orderkey",
        "l_linenumber",
        F.col("period").alias("period_text"),
        F.col("_month").alias("period"),
        period_reason(F.col("period"), dtype, F.col("_month")).alias("reason"),
    )


def q_std_quantity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text_lines(spark, sf_dir)
    dtype = t.schema["baseline_qty"].dataType
    return t.withColumn("_qty", quantity_value(F.col("baseline_qty"), dtype)).select(
        "l_orderkey",
        "l_linenumber",
        F.col("baseline_qty").alias("qty_text"),
        F.col("_qty").alias("qty"),
        quantity_reason(F.col("baseline_qty"), dtype, F.col("_qty")).alias("reason"),
    )


def q_std_granular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.standardize_granular(text_lines(spark, sf_dir), AllocSpec()).table


def q_std_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.standardize_granular(text_lines(spark, sf_dir), AllocSpec()).rejects


def q_std_macro_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets rendered as text (a period format chosen by the month, numbers
    with thousands separators) and standardised back: the round trip is exact."""
    from plan_alloc.sources.cube import PERIOD_TEXT_FORMATS

    macro = macro_cube(spark, sf_dir).drop("macro_target_value")
    k = F.month("period") % 5
    text = F.when(k == 0, F.date_format("period", PERIOD_TEXT_FORMATS[0]))
    for i, fmt in enumerate(PERIOD_TEXT_FORMATS[1:], start=1):
        text = text.when(k == i, F.date_format("period", fmt))
    as_text = macro.select(
        text.alias("period"), "market", "channel", F.format_number("macro_target_qty", 1).alias("macro_target_qty")
    )
    return S.standardize_macro(as_text, AllocSpec()).table


def q_chk_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = AllocSpec()
    table = S.standardize_granular(text_lines(spark, sf_dir), spec).table
    return S.duplicate_keys(table, spec.granular_keys)


def q_chk_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = AllocSpec()
    return S.standardize_granular(text_lines(spark, sf_dir, Cube(null_market="ASIA")), spec).profile


# ---- reports ---------------------------------------------------------------
def q_rep_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_report(_rounded(spark, sf_dir, AllocSpec()).allocations, AllocSpec())


def q_rep_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounding, layout = _measured_rounding(spark, sf_dir, AllocSpec())
    return R.sku_report(rounding.allocations, AllocSpec(), layout=layout)


# ---- planning layer --------------------------------------------------------
def q_plan_market_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TG.normalize_market(granular_cube(spark, sf_dir, Cube(null_market="ASIA")))


def q_plan_unit_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TG.granular_reference(granular_cube(spark, sf_dir))


def q_plan_direct_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TG.direct_targets(macro_cube(spark, sf_dir))


def q_plan_lock_template_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TG.lock_template(granular_cube(spark, sf_dir, STATUS), "units", list(LOCKED_MONTHS))


def q_plan_lock_template_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TG.lock_template(granular_cube(spark, sf_dir, STATUS), "value", list(LOCKED_MONTHS))


def _engine_value(spark: SparkSession, sf_dir: str):
    reference = TG.granular_reference(granular_cube(spark, sf_dir))
    targets = TG.direct_targets(macro_cube(spark, sf_dir))
    return J.engine_inputs(targets, reference, "value", AllocSpec())


def q_plan_engine_macro_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value target under the engine's column name, standardised."""
    return _engine_value(spark, sf_dir)[0].table


def q_plan_engine_granular_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value baseline under the engine's column name, standardised (the
    carried second metric left out)."""
    return _engine_value(spark, sf_dir)[1].table.select("period", "market", "channel", "client", "sku", "baseline_qty")


def q_plan_granular_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TG.granular_monthly(TG.granular_reference(granular_cube(spark, sf_dir, STATUS)))


def q_plan_lock_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lock table given twice over (whole-row duplicates) comes out once."""
    template = TG.lock_template(granular_cube(spark, sf_dir, STATUS), "units", list(LOCKED_MONTHS))
    return TG.prepare_locks(template.unionByName(template), spark)


def _share(spark: SparkSession, sf_dir: str, basis: str, share: float = SHARE_OF_MARKET) -> TG.ShareTargets:
    granular = granular_cube(spark, sf_dir, SHARE)
    locks = TG.lock_template(granular, basis, list(LOCKED_MONTHS))
    return TG.share_targets(market_totals(spark, sf_dir, SHARE), granular, share, basis, locks)


def q_plan_share_targets_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _share(spark, sf_dir, "units").targets


def q_plan_share_targets_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _share(spark, sf_dir, "value").targets


def q_plan_lock_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a 1% share the locked months exceed the annual target."""
    return _share(spark, sf_dir, "units", share=0.01).violations


def q_plan_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TG.align(macro_cube(spark, sf_dir, NATION), granular_cube(spark, sf_dir, NATION))


# ---- two metrics -------------------------------------------------------------
def _dual(spark: SparkSession, sf_dir: str, basis: str) -> R.DualOutputs:
    """As the job does it: the other metric and the price travel with the rows."""
    spec = AllocSpec()
    rows, sums = kept_cubes(spark, sf_dir)
    # Written, the targets are known to be few: aligned rows are not shuffled to meet them.
    reference, targets = TG.granular_reference(rows), keep(TG.direct_targets(sums), "targets")
    macro, granular = (x.table for x in J.engine_inputs(targets, reference, basis, spec))
    aligned = TG.align(macro, granular)
    totals, layout = _measured(aligned, spec)
    red = A.allocate(aligned, macro, spec, totals, layout)[1]
    rounded = A.apply_rounding(red.allocations, spec, layout=layout, by_group=red.by_group).allocations
    return R.dual_outputs(rounded, targets, None, basis, layout=layout, groups=totals)


def q_dual_reconstruct_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine rows without price and second metric (of another engine): both are
    joined back from the reference rows on the full row key."""
    spec = AllocSpec()
    rows, sums = kept_cubes(spark, sf_dir)
    # Written, the targets are known to be few: aligned rows are not shuffled to meet them.
    reference, targets = TG.granular_reference(rows), keep(TG.direct_targets(sums), "targets")
    macro, granular = (x.table for x in J.engine_inputs(targets, reference, "value", spec))
    plain = TG.align(macro, granular).drop(R.CARRIED, "unit_price")
    totals, layout = _measured(plain, spec)
    red = A.allocate(plain, macro, spec, totals, layout)[1]
    rounded = A.apply_rounding(red.allocations, spec, layout=layout, by_group=red.by_group).allocations
    return R.dual_outputs(rounded, targets, reference, "value", layout=layout, groups=totals).final_allocations


def q_dual_allocations_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dual(spark, sf_dir, "units").final_allocations


def q_dual_allocations_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dual(spark, sf_dir, "value").final_allocations


def q_dual_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dual(spark, sf_dir, "units").group_summary


def q_dual_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dual(spark, sf_dir, "units").sku_variance


# ---- end-to-end jobs ---------------------------------------------------------
def _job_direct(spark: SparkSession, sf_dir: str) -> J.JobResult:
    """Direct unit targets end to end. Integrity is reported in the summary
    rather than raised: at some scales a target month has no baseline rows.
    Nothing is cached: whoever reads the frame could not release it. What
    several jobs read is written to files."""
    granular, macro = kept_cubes(spark, sf_dir)
    result = J.run_job(macro, granular, spec=AllocSpec(enforce_exact_totals=False), basis="units", files=True)
    result._files.append(granular)  # ``release`` ends the cube too
    return result


def q_job_direct_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _job_direct(spark, sf_dir).final_allocations


def q_job_stages_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single-metric chain stage by stage, its checks enforced in one job."""
    granular, macro = _units_inputs(spark, sf_dir, kept=True)
    return J.run_stages(macro, granular, AllocSpec(enforce_exact_totals=False), files=True)["allocations"]


def q_snk_bundle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job's four tables published in the shared scratch folder (row tables
    partitioned by period) and the final allocations of the run read back."""
    from plan_alloc.session import scratch_path
    from plan_alloc.sources.tables import read_bundle

    result = _job_direct(spark, sf_dir)
    base = scratch_path(spark, "bundle")
    result.write(base, fmt="parquet")
    result.release()
    return read_bundle(spark, base)["final_allocations"]


def q_src_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The granular table written as CSV, read back as text (no inference) and
    standardised: the same rows and values come back."""
    from plan_alloc.session import scratch_path
    from plan_alloc.sources.tables import read_table

    path = scratch_path(spark, "csv") + "/granular.csv"
    granular_cube(spark, sf_dir).drop("baseline_value").write.option("header", True).csv(path)
    return S.standardize_granular(read_table(spark, path, fmt="csv"), AllocSpec()).table


def _malformed_csv(spark: SparkSession, sf_dir: str) -> S.Standardized:
    """Order lines written as CSV, every third line malformed in one of three
    ways, read back and standardised."""
    from plan_alloc.session import scratch_path
    from plan_alloc.sources.cube import CSV_HEADER, csv_lines
    from plan_alloc.sources.tables import read_table

    path = scratch_path(spark, "lines") + "/lines.csv"
    # The header as the CSV writer spells it: one column whose name is the header line.
    csv_lines(spark, sf_dir).toDF(CSV_HEADER).write.options(header=True, sep="\x00\x01\x00", quote="", escape="").csv(path)
    return S.standardize_granular(read_table(spark, path, fmt="csv"), AllocSpec())


def q_src_csv_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects of a CSV with surplus fields, missing fields and unclosed quotes."""
    return _malformed_csv(spark, sf_dir).rejects.withColumnRenamed("_malformed_line", "line")


def q_src_csv_wellformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of that CSV: quoted thousands and doubled quotes come out right."""
    return _malformed_csv(spark, sf_dir).table


def _by_market(df: DataFrame, rows: bool) -> DataFrame:
    """A planning table without channels: one row per (period, market), and client and sku."""
    keys = ("period", "market", *(("client", "sku") if rows else ()))
    figures = [c for c, t in df.dtypes if t == "double"]
    return df.groupBy(*keys).agg(*[F.sum(F.col(c).cast("decimal(28,2)")).cast("double").alias(c) for c in figures])


def q_job_market_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over other group keys: targets of (period, market), no channels."""
    spec = AllocSpec(group_keys=("period", "market"), enforce_exact_totals=False)
    rows, sums = kept_cubes(spark, sf_dir)
    macro, granular = (keep(_by_market(df, of_rows), "by_market") for df, of_rows in ((sums, False), (rows, True)))
    return J.run_job(macro, granular, spec=spec, basis="units", files=True).final_allocations


def q_plan_share_targets_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share targets over (period, market): the year's group is the market alone."""
    keys = ("period", "market")
    granular = _by_market(granular_cube(spark, sf_dir), True)
    locks = TG.lock_template(granular, "units", list(LOCKED_MONTHS), keys=keys)
    totals = _by_market(market_totals(spark, sf_dir), False)
    return TG.share_targets(totals, granular, 1.0, "units", locks, keys=keys).targets


def q_plan_lock_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locks and market totals that break every rule of share targets: by month,
    locks without a value where there are no granular rows; a market of no size
    in its open months; locks above the annual target; every month locked below it."""
    granular = granular_cube(spark, sf_dir, STATUS).where("channel = 'F'")
    totals = market_totals(spark, sf_dir, STATUS)
    month, channel = F.month("period"), F.col("channel")
    lock = F.when(channel == "O", F.lit(None).cast("double")).when(channel == "F", F.lit(0.25)).otherwise(F.col("total_market_qty"))
    locks = totals.where((channel == "F") | (month <= 2)).select("period", "market", "channel", F.lit(True).alias("is_locked"), lock.alias("locked_target"))
    emptied = totals.withColumn("total_market_qty", F.when((channel == "O") & (month > 2), F.lit(0.0)).otherwise(F.col("total_market_qty")))
    return TG.share_targets(emptied, granular, 0.05, "units", locks).violations


def q_job_integrity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _job_direct(spark, sf_dir).integrity_summary


def q_job_share_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    granular, _ = kept_cubes(spark, sf_dir, SHARE)
    locks = TG.lock_template(granular, "value", list(LOCKED_MONTHS))
    result = J.run_job(
        keep(market_totals(spark, sf_dir, SHARE), "market_totals"),
        granular,
        spec=AllocSpec(enforce_exact_totals=False),
        basis="value",
        mode="share",
        share=SHARE_OF_MARKET,
        locks=locks,
        files=True,
    )
    return result.final_allocations


QUERIES: dict[str, Query] = {
    "alloc_weights": q_alloc_weights,
    "alloc_redistribute": q_alloc_redistribute,
    "rnd_apportion_integer": q_rnd_apportion_integer,
    "rnd_apportion_decimal2": q_rnd_apportion_decimal2,
    "rnd_apportion_bucketed": q_rnd_apportion_bucketed,
    "rnd_apportion_salted": q_rnd_apportion_salted,
    "rnd_group_summary": q_rnd_group_summary,
    "rnd_broken_groups": q_rnd_broken_groups,
    "alloc_zero_groups": q_alloc_zero_groups,
    "alloc_equal_split": q_alloc_equal_split,
    "alloc_unmatched_macro": q_alloc_unmatched_macro,
    "alloc_unmatched_granular": q_alloc_unmatched_granular,
    "int_group_checks": q_int_group_checks,
    "int_negative": q_int_negative,
    "int_summary": q_int_summary,
    "std_period_formats": q_std_period_formats,
    "std_quantity_text": q_std_quantity_text,
    "std_granular": q_std_granular,
    "std_rejects": q_std_rejects,
    "chk_duplicate_keys": q_chk_duplicate_keys,
    "chk_null_profile": q_chk_null_profile,
    "rep_group": q_rep_group,
    "rep_sku": q_rep_sku,
    "plan_market_sentinel": q_plan_market_sentinel,
    "plan_unit_price": q_plan_unit_price,
    "plan_direct_targets": q_plan_direct_targets,
    "plan_lock_template_units": q_plan_lock_template_units,
    "plan_lock_template_value": q_plan_lock_template_value,
    "plan_lock_prepare": q_plan_lock_prepare,
    "plan_granular_monthly": q_plan_granular_monthly,
    "plan_engine_macro_value": q_plan_engine_macro_value,
    "plan_engine_granular_value": q_plan_engine_granular_value,
    "plan_share_targets_units": q_plan_share_targets_units,
    "plan_share_targets_value": q_plan_share_targets_value,
    "plan_lock_violations": q_plan_lock_violations,
    "plan_align": q_plan_align,
    "dual_allocations_units": q_dual_allocations_units,
    "dual_allocations_value": q_dual_allocations_value,
    "dual_reconstruct_joined": q_dual_reconstruct_joined,
    "dual_group": q_dual_group,
    "dual_sku": q_dual_sku,
    "job_direct_units": q_job_direct_units,
    "job_share_value": q_job_share_value,
    "job_integrity_summary": q_job_integrity_summary,
    "std_macro_text": q_std_macro_text,
    "job_stages_units": q_job_stages_units,
    "snk_bundle_roundtrip": q_snk_bundle_roundtrip,
    "src_csv_roundtrip": q_src_csv_roundtrip,
    "job_market_keys": q_job_market_keys,
    "plan_share_targets_market": q_plan_share_targets_market,
    "plan_lock_rules": q_plan_lock_rules,
    "src_csv_malformed": q_src_csv_malformed,
    "src_csv_wellformed": q_src_csv_wellformed,
}


def _oracle() -> dict[str, str]:
    core = O.allocation_ctes()
    dec2 = O.allocation_ctes(decimals=2)
    rounded_cols = "*"
    out = {
        "alloc_weights": O.with_ctes(core[:4], "SELECT * FROM weighted"),
        "alloc_redistribute": O.with_ctes(core[:5], "SELECT * FROM alloc"),
        "rnd_apportion_integer": O.with_ctes(core, f"SELECT {rounded_cols} FROM rounded"),
        "rnd_apportion_decimal2": O.with_ctes(dec2, f"SELECT {rounded_cols} FROM rounded"),
        "rnd_apportion_bucketed": O.with_ctes(core, f"SELECT {rounded_cols} FROM rounded"),
        "rnd_apportion_salted": O.with_ctes(core, f"SELECT {rounded_cols} FROM rounded"),
        "rnd_group_summary": O.with_ctes(core[:6], O.group_summary_sql()),
    }
    zero = O.allocation_ctes(cube=ZERO)
    zero_eq = O.allocation_ctes(cube=ZERO, zero_baseline="equal_split")
    nation = O.allocation_ctes(cube=NATION)
    net = O.allocation_ctes(cube=NET, zero_baseline="equal_split")
    out["alloc_zero_groups"] = O.with_ctes(zero[:3], f"SELECT {O.KEYS} FROM totals WHERE group_baseline_qty = 0")
    out["alloc_equal_split"] = O.with_ctes(zero_eq[:4], "SELECT * FROM weighted")
    out["alloc_unmatched_macro"] = O.with_ctes(
        nation[:3], f"SELECT DISTINCT {O.KEYS} FROM macro m WHERE NOT EXISTS "
        "(SELECT 1 FROM totals t WHERE t.period = m.period AND t.market = m.market AND t.channel = m.channel)"
    )
    out["alloc_unmatched_granular"] = O.with_ctes(
        nation[:3], f"SELECT {O.KEYS} FROM totals t WHERE NOT EXISTS "
        "(SELECT 1 FROM macro m WHERE t.period = m.period AND t.market = m.market AND t.channel = m.channel)"
    )
    int_ctes = net + O.integrity_ctes(tolerance=AllocSpec().tolerance + 1e-9)
    out["int_group_checks"] = O.with_ctes(int_ctes, "SELECT * FROM group_checks")
    out["int_negative"] = O.with_ctes(net, "SELECT * FROM rounded WHERE final_allocated_qty < 0")
    out["int_summary"] = O.with_ctes(int_ctes, O.integrity_summary_sql(allow_negative=True))
    out.update(O.standardize_oracle())
    out["rep_group"] = O.with_ctes(core, O.report_group_sql())
    out["rep_sku"] = O.with_ctes(core, O.report_sku_sql())
    sentinel = O.reference_ctes(Cube(null_market="ASIA"))
    out["plan_market_sentinel"] = O.with_ctes(
        sentinel[:1],
        f"SELECT period, COALESCE(market, {O.SENTINEL}) AS market, channel, client, sku, baseline_qty, baseline_value "
        "FROM granular",
    )
    out["plan_unit_price"] = O.with_ctes(O.reference_ctes(CORE), "SELECT * FROM ref")
    out["plan_direct_targets"] = O.with_ctes(O.direct_target_ctes(CORE), "SELECT * FROM targets")
    status_ref = O.reference_ctes(STATUS)
    out["plan_lock_template_units"] = O.with_ctes(status_ref, O.lock_template_sql("units", LOCKED_MONTHS))
    out["plan_lock_template_value"] = O.with_ctes(status_ref, O.lock_template_sql("value", LOCKED_MONTHS))
    direct_core = O.reference_ctes(CORE) + O.direct_target_ctes(CORE)
    out["plan_engine_macro_value"] = O.with_ctes(
        direct_core, f"SELECT {O.KEYS}, macro_target_value AS macro_target_qty FROM targets"
    )
    out["plan_engine_granular_value"] = O.with_ctes(
        direct_core, "SELECT period, market, channel, client, sku, baseline_value AS baseline_qty FROM ref"
    )
    out["plan_granular_monthly"] = O.with_ctes(
        status_ref,
        f"SELECT {O.KEYS}, {O.exact_sum('baseline_qty')} AS granular_month_qty, "
        f"{O.exact_sum('baseline_value')} AS granular_month_value FROM ref GROUP BY {O.KEYS}",
    )
    out["plan_lock_prepare"] = O.with_ctes(
        status_ref + [("lt", O.lock_template_sql("units", LOCKED_MONTHS))],
        "SELECT DISTINCT * FROM (SELECT * FROM lt UNION ALL SELECT * FROM lt) x",
    )
    for basis in ("units", "value"):
        out[f"plan_share_targets_{basis}"] = O.with_ctes(
            O.share_target_ctes(SHARE, basis, SHARE_OF_MARKET, LOCKED_MONTHS), "SELECT * FROM targets"
        )
    out["plan_lock_violations"] = O.with_ctes(
        O.share_target_ctes(SHARE, "units", 0.01, LOCKED_MONTHS), O.share_violations_sql()
    )
    out["plan_align"] = O.with_ctes(
        [("granular", O.granular_sql(NATION)), ("macro", O.macro_sql(NATION))],
        f"SELECT * FROM granular WHERE ({O.KEYS}) IN (SELECT ({O.KEYS}) FROM macro)",
    )
    direct = O.reference_ctes(CORE) + O.direct_target_ctes(CORE)
    units = direct + O.dual_ctes("units")
    out["dual_allocations_units"] = O.with_ctes(units, "SELECT * FROM final_allocations")
    out["dual_allocations_value"] = O.with_ctes(direct + O.dual_ctes("value"), "SELECT * FROM final_allocations")
    out["dual_reconstruct_joined"] = out["dual_allocations_value"]
    out["dual_group"] = O.with_ctes(units, O.dual_group_sql())
    out["dual_sku"] = O.with_ctes(units, O.dual_sku_sql())
    out["job_direct_units"] = out["dual_allocations_units"]
    out["std_macro_text"] = O.with_ctes(
        [("macro", O.macro_sql(CORE))], "SELECT period, market, channel, macro_target_qty FROM macro"
    )
    out["job_stages_units"] = O.with_ctes(core, "SELECT * FROM rounded")
    out["snk_bundle_roundtrip"] = out["dual_allocations_units"]
    out["src_csv_roundtrip"] = O.with_ctes(
        [("granular", O.granular_sql(CORE))],
        "SELECT period, market, channel, client, sku, baseline_qty FROM granular",
    )
    out.update(O.malformed_csv_oracle())
    out["rnd_broken_groups"] = O.broken_groups_sql()
    out["job_market_keys"] = O.market_keys_sql()
    out["plan_share_targets_market"] = O.share_by_market_sql(LOCKED_MONTHS)
    out["plan_lock_rules"] = O.lock_rules_sql(STATUS)
    job_integrity = units + [
        (
            "group_checks",
            O.integrity_ctes(tolerance=AllocSpec().tolerance + 1e-9)[0][1],
        ),
        (
            "unmatched_macro",
            f"SELECT DISTINCT {O.KEYS} FROM engine_macro m WHERE NOT EXISTS (SELECT 1 FROM totals t "
            "WHERE t.period = m.period AND t.market = m.market AND t.channel = m.channel)",
        ),
        ("unmatched_granular", f"SELECT {O.KEYS} FROM totals WHERE FALSE"),
    ]
    out["job_integrity_summary"] = O.with_ctes(job_integrity, O.integrity_summary_sql(allow_negative=False))
    out["job_share_value"] = O.with_ctes(
        O.share_target_ctes(SHARE, "value", SHARE_OF_MARKET, LOCKED_MONTHS) + O.dual_ctes("value"),
        "SELECT * FROM final_allocations",
    )
    return out


ORACLE: dict[str, str] = _oracle()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end-to-end job: direct unit targets → final allocations (both metrics)."""
    return q_job_direct_units(spark, sf_dir)
