"""End-to-end jobs (``job_core``, ``job_run``, ``job_stages``).

    targets (direct or share-based) ─┐
    granular ─ reference ─ standardise ─ align ─ weights ─ redistribute ─ round
                                                                 │
                         integrity ── two-metric outputs ── write bundle

Everything stays lazy until two actions before the writes: one small job
measuring the control groups (decides broadcast and hot-group handling) and
one job counting every rule violation and every integrity figure at once.
The reference rows, the targets, the group totals and the rounded allocation
are persisted (memory and disk) because several of those actions read them;
a lost executor's blocks are recomputed from the same deterministic lineage.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plan_alloc.operators import allocate as A
from plan_alloc.operators import integrity as I
from plan_alloc.operators import reports as R
from plan_alloc.operators import standardize as S
from plan_alloc.operators import targets as TG
from plan_alloc.operators.checks import Check, enforce, violation_counts
from plan_alloc.session import forget
from plan_alloc.session import keep as keep_file
from plan_alloc.sources.csv_text import MALFORMED, drop_malformed
from plan_alloc.sources.tables import write_bundle
from plan_alloc.spec import AllocSpec, Basis, DataError, SpecError, TargetError


@dataclass
class JobResult:
    final_allocations: DataFrame
    group_summary: DataFrame
    sku_variance: DataFrame
    integrity_summary: DataFrame
    rounded: DataFrame
    targets: DataFrame
    layout: A.GroupLayout | None = None
    counts: dict = field(default_factory=dict)
    integrity: dict = field(default_factory=dict)
    ordered: bool = False
    _cached: list = field(default_factory=list)
    _files: list = field(default_factory=list)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "final_allocations": self.final_allocations,
            "group_summary": self.group_summary,
            "sku_variance": self.sku_variance,
            "integrity_summary": self.integrity_summary,
        }

    def write(
        self, base: str, fmt: str = "parquet", run: str | None = None, rebalance: bool | None = None
    ) -> dict[str, str]:
        """``job_run`` sink: the four tables, published as one run under ``base``. Row tables
        are rebalanced by period unless the run asked for ordered output (a
        rebalance would shuffle the order away)."""
        return write_bundle(self.tables(), base, fmt, run, (not self.ordered) if rebalance is None else rebalance)

    def release(self) -> None:
        """Drop cached blocks and kept files; call after the last write."""
        for df in self._cached:
            df.unpersist()
        self._cached.clear()
        forget(*self._files)
        self._files.clear()


def build_targets(
    macro: DataFrame,
    granular: DataFrame,
    basis: Basis,
    mode: str = "direct",
    share: float | None = None,
    locks: DataFrame | None = None,
    keep=lambda df: df,
    keys: tuple[str, ...] = TG.KEYS,
) -> tuple[DataFrame, list[Check]]:
    """``plan_mode``: direct targets, or targets from an annual share.
    ``keep`` caches the share detail table that the targets and the share
    checks all read (Spark's cache manager then serves every plan on it)."""
    if mode == "direct":
        metrics = TG.text_metrics(macro, ("macro_target_qty", "macro_target_value"))
        return TG.direct_targets(macro, keys=keys), [TG.unreadable_values(macro, metrics, "macro")] if metrics else []
    if mode == "share":
        if share is None:
            raise TargetError("Share-based targets need a market share.")
        built = TG.share_targets(macro, granular, share, basis, locks, keys=keys)
        keep(built.detail)
        return built.targets, built.checks
    raise SpecError("mode is 'direct' or 'share'.")


def malformed_lines(df: DataFrame, dataset: str) -> Check:
    """Lines of a CSV input that are not records of its header's fields."""
    return Check(f"{dataset}_malformed_lines", DataError, f"{dataset} input has malformed CSV lines", df.where(F.col(MALFORMED).isNotNull()))


def engine_inputs(
    targets: DataFrame, reference: DataFrame, basis: Basis, spec: AllocSpec, rows: int | None = None
) -> tuple[S.Standardized, S.Standardized]:
    """``plan_engine_macro``/``plan_engine_granular``: the driver metric under
    the engine's column names, standardised. The granular rows also carry the
    other metric and the unit price so the two-metric outputs need no join."""
    drive_t = "macro_target_qty" if basis == "units" else "macro_target_value"
    drive_b, other = ("baseline_qty", "baseline_value") if basis == "units" else ("baseline_value", "baseline_qty")
    macro = targets.select(*spec.keys, F.col(drive_t).alias(spec.columns.target))
    granular = reference.select(
        *TG.row_keys(spec.group_keys),
        F.col(drive_b).alias(spec.columns.baseline),
        F.col(other).alias(R.CARRIED),
        "unit_price",
    )
    return (
        S.standardize_macro(macro, spec),
        S.standardize_granular(granular, spec, carry=(R.CARRIED, "unit_price"), rows=rows),
    )


def run_job(
    macro: DataFrame,
    granular: DataFrame,
    spec: AllocSpec = AllocSpec(),
    basis: Basis = "units",
    mode: str = "direct",
    share: float | None = None,
    locks: DataFrame | None = None,
    check: bool = True,
    report_unmatched_granular: bool = False,
    persist: bool = True,
    ordered: bool = False,
    storage: StorageLevel = StorageLevel.MEMORY_AND_DISK,
    files: bool = False,
) -> JobResult:
    """``job_core``: the whole allocation run. Raises on the first broken rule
    (when ``check``) and on an invalid result (when exact totals are enforced).

    ``persist``/``storage``: the frames several actions read (reference rows,
    targets, group totals, rounded allocation) are kept at this storage level;
    ``DISK_ONLY`` suits very large inputs, ``persist=False`` re-reads instead
    (cheaper when the input is a plain Parquet scan). ``files``: targets, group
    totals and rounded allocation are written to the shared checkpoint folder
    instead and read from there, for results that are read lazily long after: the
    files go with ``release`` or when the driver's Python ends. The reference rows are
    read again; give inputs that are cheap to read."""
    if basis not in ("units", "value"):
        raise SpecError("basis is 'units' or 'value'.")
    keys = spec.keys
    cached: list[DataFrame] = []
    kept: list[DataFrame] = []

    def written(df: DataFrame, label: str) -> DataFrame:
        if not files:
            return keep(df)
        try:
            kept.append(keep_file(df, label))
        except Exception:
            forget(*kept)  # a failed run keeps no files
            raise
        return kept[-1]

    def keep(df: DataFrame) -> DataFrame:
        # Read by several actions (group measure, checks, integrity, writes):
        # materialise once instead of recomputing the lineage per action.
        if files or not persist:
            return df
        df = df.persist(storage)
        cached.append(df)
        return df

    tables = {"macro": macro, "granular": granular, "locks": locks}
    line_checks = [malformed_lines(df, name) for name, df in tables.items() if df is not None and MALFORMED in df.columns]
    macro, granular, locks = (df if df is None else drop_malformed(df) for df in tables.values())
    reference = keep(TG.granular_reference(granular, spec.group_keys))
    targets, target_checks = build_targets(macro, reference, basis, mode, share, locks, keep=keep, keys=spec.group_keys)
    targets = written(targets, "targets")
    std_macro, std_granular = engine_inputs(targets, reference, basis, spec, reference.count() if files else None)
    engine_macro = std_macro.table
    aligned = std_granular.table.join(engine_macro.select(*keys), keys, "left_semi")

    totals = written(A.group_totals(aligned, spec), "totals")
    layout = A.measure_groups(totals, spec)
    weights, red = A.allocate(aligned, engine_macro, spec, totals, layout)
    metrics = TG.text_metrics(granular, ("baseline_qty", "baseline_value"))
    metric_checks = [TG.unreadable_values(granular, metrics, "baseline")] if metrics else []
    input_rules = [*line_checks, *target_checks, *std_macro.checks, *std_granular.checks, *metric_checks, *weights.checks]
    rounding = A.apply_rounding(red.allocations, spec, layout=layout, by_group=red.by_group)
    rounded = written(rounding.allocations, "rounded")

    unmatched_granular = red.unmatched_granular
    if report_unmatched_granular:
        all_groups = std_granular.table.select(*keys).distinct()
        unmatched_granular = A.unmatched_groups(all_groups, engine_macro, keys)
    integrity = I.validate_integrity(rounded, red.unmatched_macro, unmatched_granular, spec)
    dual = R.dual_outputs(rounded, targets, reference, basis, layout=layout, ordered=ordered, groups=totals, keys=spec.group_keys, ranked=not files)
    result = JobResult(
        final_allocations=dual.final_allocations,
        group_summary=dual.group_summary,
        sku_variance=dual.sku_variance,
        integrity_summary=integrity.summary,
        rounded=rounded,
        targets=targets,
        layout=layout,
        ordered=ordered,
        _cached=cached,
        _files=kept,
    )
    if check:
        try:
            # One Spark job counts every rule and every integrity figure.
            rules = [*input_rules, *rounding.checks]
            counts = violation_counts([*rules, *I.count_checks(integrity)])
            result.counts = _raise_first(rules, counts)
            row, summary = I.summary_from_counts(rounded.sparkSession, counts, spec)
            result.integrity = I.raise_if_invalid(row, spec)
        except Exception:
            result.release()  # a failed run keeps no cached blocks
            raise
        # the one-row summary is already known: no second computation to write it
        result.integrity_summary = summary
    return result


def _raise_first(rules: list[Check], counts: dict[str, int]) -> dict[str, int]:
    for c in rules:
        if counts[c.name] > 0:
            raise c.error(f"{c.message} ({counts[c.name]} violating rows; check '{c.name}').")
    return {c.name: counts[c.name] for c in rules}


def run_stages(macro: DataFrame, granular: DataFrame, spec: AllocSpec = AllocSpec(), files: bool = False) -> dict[str, DataFrame]:
    """``job_stages``: the single-metric chain step by step (standardise,
    weights, redistribute, round, integrity, reports), each stage a
    ``DataFrame -> DataFrame`` building block; checks enforced in one job.
    ``files``: group totals and rounded allocation are written once (see ``run_job``)."""
    kept = keep_file if files else lambda df, label: df
    std_m = S.standardize_macro(macro, spec)
    std_g = S.standardize_granular(granular, spec, rows=granular.count() if files else None)
    totals = kept(A.group_totals(std_g.table, spec), "totals")
    layout = A.measure_groups(totals, spec)
    weights = A.calculate_weights(std_g.table, spec, totals, layout)
    red = A.redistribute(std_m.table, weights.weights, spec, granular_groups=weights.totals, layout=layout)
    rounding = A.apply_rounding(red.allocations, spec, layout=layout)
    enforce([*std_m.checks, *std_g.checks, *weights.checks, *rounding.checks])
    allocations = kept(rounding.allocations, "rounded")
    integrity = I.validate_integrity(allocations, red.unmatched_macro, red.unmatched_granular, spec)
    I.enforce_integrity(integrity, spec)
    reports = R.build_reports(allocations, spec)
    return {
        "allocations": allocations,
        "rounding_summary": rounding.group_summary,
        "integrity_summary": integrity.summary,
        "group_checks": integrity.group_checks,
        "group_summary": reports.group_summary,
        "sku_variance": reports.sku_variance,
    }
