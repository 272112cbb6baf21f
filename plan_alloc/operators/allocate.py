"""Core allocation: weights, redistribution and largest-remainder rounding.

Plan shape (per control group = ``spec.group_keys``):

* group totals are a ``groupBy`` with map-side partial aggregation, joined
  back to the rows (never a window over a whole group, so one huge group does
  not land in one task just to be summed);
* totals and targets meet in a ledger of one row per group, joined to the rows
  once. ``GroupLayout`` says when it is provably small enough to broadcast;
  otherwise it is a shuffle join, in which a hot group's rows are spread by a
  salt from (sku, client) and its ledger row is repeated for every salt;
* ranking rows by remainder needs an order inside each group. Groups up to
  ``spec.hot_group_rows`` rows are ranked by one window (one hash exchange on
  the group keys, reused by the residual sum). Larger ("hot") groups are
  ranked bucket by bucket: remainders are cut into buckets, buckets are counted
  with map-side combine, a running sum gives the rows before each bucket, and
  rows are numbered inside their bucket. Rows move once for it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plan_alloc.functions.columns import exact_sum, exact_total, floor_double, ratio
from plan_alloc.operators.checks import Check
from plan_alloc.session import spread as dealt
from plan_alloc.spec import AllocationError, AllocSpec, IntegrityError, ZeroBaselineError

GROUP_TOTAL = "group_baseline_qty"
WEIGHT = "weight"
RAW = "raw_allocated_qty"
ROUNDED = "rounded_allocated_qty"
REMAINDER = "rounding_remainder"
RANK = "residual_rank"
ADJUST = "residual_adjustment"
FINAL = "final_allocated_qty"
ROUNDING_COLUMNS = (ROUNDED, REMAINDER, RANK, ADJUST, FINAL)

# Work columns (dropped before results leave this module).
_RAW_S, _TGT_S, _FLOOR_S, _REM_S, _RESID = "_raw_s", "_tgt_s", "_floor_s", "_rem_s", "_residual"
_ROWS = "_group_rows"
_SALT, _SALTS = "_salt", "_salts"
_BUCKET, _BUCKET_ROWS, _BEFORE, _CELL, _HEAD = "_bucket", "_bucket_rows", "_before", "_cell", "_head"


# --------------------------------------------------------------------------
# group layout: what may be broadcast, which groups are hot
# --------------------------------------------------------------------------
@dataclass(frozen=True)
class GroupLayout:
    """Facts about the control groups, measured once on a per-group table.

    ``broadcast``: the number of groups is at most ``spec.broadcast_group_limit`` so tables
    with one row per group may be broadcast. ``hot_keys``: keys of the groups
    with more than ``spec.hot_group_rows`` rows; at most
    ``total_rows / hot_group_rows`` of them exist. None when there is no hot group.
    ``salts``: keys and number of salts of the groups whose rows a shuffle join on
    the group keys has to spread, fewer than ``spec.broadcast_hot_limit``; None
    when nothing has to be.
    """

    group_count: int
    row_count: int
    broadcast: bool
    hot_keys: DataFrame | None = None
    hot_rows: int = 0
    hot_groups: int = 0
    max_group_rows: int = 0
    salts: DataFrame | None = None

    def describe(self) -> dict:
        return {
            "groups": self.group_count,
            "rows": self.row_count,
            "largest_group_rows": self.max_group_rows,
            "per_group_tables_broadcast": self.broadcast,
            "hot_groups": self.hot_groups,
            "hot_rows": self.hot_rows,
            "joins_salted": self.salts is not None,
        }


def measure_groups(per_group: DataFrame, spec: AllocSpec, rows_col: str = _ROWS) -> GroupLayout:
    """One small job over a per-group table (keys + row count)."""
    hot = F.col(rows_col) > F.lit(spec.hot_group_rows)
    stats = per_group.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum(rows_col), F.lit(0)).alias("rows"),
        F.count_if(hot).alias("hot_groups"),
        F.coalesce(F.sum(F.when(hot, F.col(rows_col))), F.lit(0)).alias("hot_rows"),
        F.coalesce(F.max(rows_col), F.lit(0)).alias("max_rows"),
    ).first()
    hot_keys = per_group.filter(hot).select(*spec.keys) if stats["hot_groups"] else None
    broadcast = int(stats["groups"]) <= spec.broadcast_group_limit
    # Of groups above a part of all rows there are fewer than parts.
    most = max(spec.hot_group_rows, int(stats["rows"]) // spec.broadcast_hot_limit)
    salts = None
    if not broadcast and int(stats["max_rows"]) > most:
        n = F.ceil(F.col(rows_col) / spec.hot_rows_per_task).cast("int")
        salts = per_group.filter(F.col(rows_col) > most).select(*spec.keys, n.alias(_SALTS))
    return GroupLayout(
        group_count=int(stats["groups"]),
        row_count=int(stats["rows"]),
        broadcast=broadcast,
        hot_keys=hot_keys,
        hot_rows=int(stats["hot_rows"]),
        hot_groups=int(stats["hot_groups"]),
        max_group_rows=int(stats["max_rows"]),
        salts=salts,
    )


def join_groups(rows: DataFrame, per_group: DataFrame, spec: AllocSpec, layout: GroupLayout | None, how: str = "inner") -> DataFrame:
    """``rows`` joined on the group keys with a table of one row per group (of
    groups that ``layout`` counted): broadcast if the layout allows it, else a
    shuffle join in which the rows of large groups are spread over salts."""
    keys = spec.keys
    if layout is not None and layout.broadcast:
        return rows.join(F.broadcast(per_group), keys, how)
    if layout is None or layout.salts is None:
        return rows.join(per_group, keys, how)
    salts = F.broadcast(layout.salts)
    parts = [c for c in (spec.columns.sku, spec.columns.client) if c in rows.columns]
    salt = F.coalesce(F.pmod(F.xxhash64(*parts), F.col(_SALTS)), F.lit(0)).cast("int")
    spread = rows.join(salts, keys, "left").withColumn(_SALT, salt).drop(_SALTS)
    copies = per_group.join(salts, keys, "left").withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(_SALTS, F.lit(1)) - 1))).drop(_SALTS)
    # Copies: one for every salt, which are no more than rows.
    both = [dealt(side, layout.row_count, *keys, _SALT) for side in (spread, copies)]
    return both[0].join(both[1], [*keys, _SALT], how).drop(_SALT)


# --------------------------------------------------------------------------
# weights
# --------------------------------------------------------------------------
@dataclass(frozen=True)
class Weights:
    weights: DataFrame
    zero_groups: DataFrame
    totals: DataFrame
    checks: list[Check] = field(default_factory=list)


def group_totals(granular: DataFrame, spec: AllocSpec) -> DataFrame:
    """One row per group: exact baseline total and row count."""
    return granular.groupBy(*spec.keys).agg(
        exact_total(spec.columns.baseline).alias(GROUP_TOTAL),
        F.count(F.lit(1)).alias(_ROWS),
    )


def calculate_weights(
    granular: DataFrame,
    spec: AllocSpec,
    totals: DataFrame | None = None,
    layout: GroupLayout | None = None,
) -> Weights:
    """Each row's share of its group's baseline (``alloc_group_total``,
    ``alloc_zero_groups``, ``alloc_weights``, ``alloc_equal_split``)."""
    cols = spec.columns
    if cols.sku not in granular.columns:
        raise ZeroBaselineError(f"Weights need the sku column '{cols.sku}'.")
    totals = totals if totals is not None else group_totals(granular, spec)
    rows = join_groups(granular, totals, spec, layout)
    weights = rows.withColumn(WEIGHT, _weight(spec)).drop(_ROWS)
    checks, zero_groups = _zero_baselines(totals, spec)
    return Weights(weights=weights, zero_groups=zero_groups, totals=totals, checks=checks)


def _weight(spec: AllocSpec) -> Column:
    base, total = F.col(spec.columns.baseline), F.col(GROUP_TOTAL)
    if spec.zero_baseline == "equal_split":
        return F.when(total == 0, F.lit(1.0) / F.col(_ROWS).cast("double")).otherwise(ratio(base, total))
    return ratio(base, total)


def _zero_baselines(totals: DataFrame, spec: AllocSpec) -> tuple[list[Check], DataFrame]:
    zero_groups = totals.filter(F.col(GROUP_TOTAL) == 0).select(*spec.keys)
    checks = []
    if spec.zero_baseline == "fail":
        checks.append(
            Check(
                "zero_baseline",
                ZeroBaselineError,
                "Some control groups have a zero baseline total and cannot be weighted",
                zero_groups,
            )
        )
    return checks, zero_groups


# --------------------------------------------------------------------------
# both at once, through the group ledger
# --------------------------------------------------------------------------
def group_ledger(totals: DataFrame, macro: DataFrame, spec: AllocSpec) -> DataFrame:
    """One row per group that has both: baseline total, row count, target."""
    return totals.join(macro.select(*spec.keys, spec.columns.target), spec.keys, "inner")


def allocate(
    granular: DataFrame, macro: DataFrame, spec: AllocSpec, totals: DataFrame, layout: GroupLayout
) -> tuple[Weights, Redistribution]:
    """``calculate_weights`` and ``redistribute`` with one join of the rows: the
    ledger holds what both of them need of a group. ``Weights.weights`` holds the
    rows of groups with a target only."""
    ledger = group_ledger(totals, macro, spec)
    target = spec.columns.target
    columns = [F.col(f"`{c}`") for c in granular.columns]
    # What a row's shares follow from; the number of rows only where groups are split by it.
    facts = [GROUP_TOTAL, target, *([_ROWS] if spec.zero_baseline == "equal_split" else [])]

    def met(rows: DataFrame) -> DataFrame:
        return join_groups(rows, ledger, spec, layout).select(*columns, *facts)

    def shared(rows: DataFrame) -> DataFrame:
        return share(rows, spec).select(*columns, GROUP_TOTAL, WEIGHT, target, RAW)

    lean = met(granular)
    allocations = shared(lean)
    # The rows move before the ledger widens them.
    by_group = shared(met(dealt(granular, layout.row_count, *spec.keys))) if layout.broadcast and layout.hot_keys is None else None
    checks, zero_groups = _zero_baselines(totals, spec)
    weights = Weights(allocations.drop(target, RAW), zero_groups, totals, checks)
    unmatched = unmatched_groups(macro, totals, spec.keys), unmatched_groups(totals, macro, spec.keys)
    return weights, Redistribution(allocations, *unmatched, by_group, lean)


def share(lean: DataFrame, spec: AllocSpec) -> DataFrame:
    """Weight and raw allocation of rows that met the ledger."""
    return lean.withColumn(WEIGHT, _weight(spec)).withColumn(RAW, F.col(WEIGHT) * F.col(spec.columns.target))


# --------------------------------------------------------------------------
# redistribution
# --------------------------------------------------------------------------
@dataclass(frozen=True)
class Redistribution:
    allocations: DataFrame
    unmatched_macro: DataFrame
    unmatched_granular: DataFrame
    by_group: DataFrame | None = None  # the allocations, each group's rows in one task
    lean: DataFrame | None = None  # the rows and what ``share`` makes the allocations from


def unmatched_groups(left_groups: DataFrame, right_groups: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct groups of the left table that the right table lacks."""
    return left_groups.select(*keys).distinct().join(right_groups.select(*keys), keys, "left_anti")


def redistribute(
    macro: DataFrame,
    weighted: DataFrame,
    spec: AllocSpec,
    granular_groups: DataFrame | None = None,
    layout: GroupLayout | None = None,
) -> Redistribution:
    """``raw = weight * target`` per granular row of a group that has a target
    (``alloc_redistribute``), plus the groups found on one side only."""
    keys, target = spec.keys, spec.columns.target
    missing = sorted({GROUP_TOTAL, WEIGHT} - set(weighted.columns))
    if missing:
        raise AllocationError(f"Weighted rows lack column(s) {', '.join(missing)}; run calculate_weights first.")
    if target in weighted.columns:
        raise AllocationError(f"Weighted rows already carry the target column '{target}'.")
    groups = granular_groups if granular_groups is not None else weighted.select(*keys).distinct()
    macro_targets = macro.select(*keys, target)
    if granular_groups is None:
        joined = weighted.join(macro_targets, keys, "inner")
    else:
        # The layout counts granular groups only. Targets of other groups fall
        # out first, so what is broadcast has at most one row per counted group.
        own = groups.select(*keys)
        small = F.broadcast(own) if layout is not None and layout.broadcast else own
        joined = join_groups(weighted, macro_targets.join(small, keys, "left_semi"), spec, layout)
    allocations = joined.withColumn(RAW, F.col(WEIGHT) * F.col(target))
    return Redistribution(
        allocations=allocations,
        unmatched_macro=unmatched_groups(macro, groups, keys),
        unmatched_granular=unmatched_groups(groups, macro, keys),
    )


# --------------------------------------------------------------------------
# rounding
# --------------------------------------------------------------------------
@dataclass(frozen=True)
class Rounding:
    allocations: DataFrame
    group_summary: DataFrame
    checks: list[Check] = field(default_factory=list)


def _tie_order(df: DataFrame, spec: AllocSpec) -> list[Column]:
    """Remainder descending, then sku, then client: a total order inside a group."""
    order = [F.col(_REM_S).desc(), F.col(spec.columns.sku).asc()]
    if spec.columns.client in df.columns and spec.columns.client not in spec.group_keys:
        order.append(F.col(spec.columns.client).asc())
    return order


def _scaled(alloc: DataFrame, spec: AllocSpec) -> DataFrame:
    scale = F.lit(float(spec.scale))
    raw_s = F.col(RAW) * scale
    floor_s = floor_double(raw_s)
    return alloc.withColumns(
        {
            _RAW_S: raw_s,
            _TGT_S: F.round(F.col(spec.columns.target) * scale, 0),
            _FLOOR_S: floor_s,
            _REM_S: raw_s - floor_s,
        }
    )


def _rank_by_window(scaled: DataFrame, spec: AllocSpec, rows: int | None) -> DataFrame:
    """Rank and residual with one window spec: one exchange (none, if ``rows``, their
    number, is None: they lie by group already), one sort."""
    if rows is not None:
        scaled = dealt(scaled, rows, *spec.keys)
    ordered = Window.partitionBy(*spec.keys).orderBy(*_tie_order(scaled, spec))
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return scaled.withColumns(
        {
            RANK: F.row_number().over(ordered).cast("long"),
            _RESID: F.max(_TGT_S).over(whole) - F.sum(_FLOOR_S).over(whole),
        }
    )


def _rank_by_bucket(alloc: DataFrame, spec: AllocSpec, layout: GroupLayout, rows_per_task: int, lean: DataFrame | None = None) -> DataFrame:
    """Exact ranks for hot groups without putting a group in one task.

    1. The remainder, in descending order, is cut into ``buckets`` buckets; rows
       are counted by (group, bucket) with map-side combine, and a running sum over
       a group's buckets (at most ``buckets`` + 1 rows) gives the rows before each.
    2. A bucket above ``rows_per_task`` rows is so because remainders tie. If there is
       one (one small job tells), buckets are counted in finer cells, by the remainder
       and the head of the sku - as long as the skus of a crowded bucket have in
       common, and two to four characters more - which keeps the order.
    3. Rows move once, straight to their cell (or bucket), where they meet the number
       of rows before it and are numbered by one window. Only the given columns (of
       ``lean``, if the rows are its ``share``) move: what follows from them is
       computed again where they arrive.

    Nothing is sampled or written, and every step can be computed again.
    """
    keys, sku = spec.keys, spec.columns.sku
    per_task = max(1, rows_per_task // 8)
    buckets = 1 << max(4, min(16, math.ceil(math.log2(max(1.0, layout.max_group_rows / per_task)))))
    rem = F.col(_REM_S)
    # A row without a remainder comes last, as in a descending order.
    bucket = F.coalesce(F.greatest(F.lit(0), buckets - 1 - F.floor(rem * buckets).cast("int")), F.lit(buckets))
    source = alloc if lean is None else lean

    def computed(df: DataFrame) -> DataFrame:
        return _scaled(df if lean is None else share(df, spec), spec)

    rows = computed(source).withColumn(_BUCKET, bucket)
    place, cell = [*keys, _BUCKET], []
    head = _crowded_head(rows, spec, place, rows_per_task)
    if head:
        # A hash of the cell deals and joins; the cell itself is compared too.
        place, cell = [*place, _CELL], [_REM_S, _HEAD]
        rows = rows.withColumn(_HEAD, F.left(sku, F.lit(head))).withColumn(_CELL, F.hash(*cell))
    counted = F.count(F.lit(1)).alias(_BUCKET_ROWS)
    group = Window.partitionBy(*keys)
    before = group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, _BUCKET).agg(counted, F.sum(_FLOOR_S).alias("_floors"), F.max(_TGT_S).alias("_target"))
    whole = dealt(sizes, layout.hot_rows, *keys)
    spans = whole.select(
        *keys, _BUCKET,
        F.coalesce(F.sum(_BUCKET_ROWS).over(before), F.lit(0)).alias(_BEFORE),
        (F.max("_target").over(group) - F.sum("_floors").over(group)).alias(_RESID),
    )
    if head:
        inside = Window.partitionBy(*keys, _BUCKET).orderBy(rem.desc(), F.col(_HEAD).asc()).rowsBetween(Window.unboundedPreceding, -1)
        cells = dealt(rows.groupBy(*keys, *cell).agg(counted).withColumn(_BUCKET, bucket), layout.hot_rows, *keys, _BUCKET)
        cells = cells.withColumn("_cell_before", F.coalesce(F.sum(_BUCKET_ROWS).over(inside), F.lit(0))).drop(_BUCKET_ROWS)
        spans = cells.join(spans.hint("merge"), [*keys, _BUCKET], "inner").withColumn(_CELL, F.hash(*cell)).select(
            *place, *(F.col(c).alias(f"{c}_of") for c in cell), (F.col(_BEFORE) + F.col("_cell_before")).alias(_BEFORE), _RESID
        )
    # At most so many rows, whatever the data.
    if not head and layout.hot_groups * (buckets + 1) <= spec.broadcast_group_limit:
        spans = F.broadcast(spans)
    else:
        spans = dealt(spans, layout.hot_rows, *place).hint("merge")
    columns = [F.col(f"`{c}`") for c in source.columns]
    moved = computed(dealt(rows.select(*columns, *place[len(keys) :]), layout.hot_rows, *place))
    met = moved.join(spans, place, "inner")
    if head:
        met = met.withColumn(_HEAD, F.left(sku, F.lit(head)))
        for c in cell:
            # Not as an equality, for which rows would be dealt again.
            mine, other = F.col(c), F.col(f"{c}_of")
            met = met.filter(((mine >= other) & (mine <= other)) | (mine.isNull() & other.isNull()))
    number = F.row_number().over(Window.partitionBy(*place, *cell).orderBy(*_tie_order(alloc, spec)))
    ranked = met.withColumn(RANK, (F.col(_BEFORE) + number).cast("long"))
    return ranked.select(*[F.col(f"`{c}`") for c in alloc.columns], _RAW_S, _TGT_S, _FLOOR_S, _REM_S, _RESID, RANK)


def _crowded_head(rows: DataFrame, spec: AllocSpec, bucket: list[str], rows_per_task: int) -> int:
    """Length of the skus' heads that tell apart the rows of buckets above
    ``rows_per_task`` rows; 0 if there is no such bucket."""
    sku = spec.columns.sku
    sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias(_BUCKET_ROWS), F.min(sku).alias("_least"), F.max(sku).alias("_most"))
    shared = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("_least"), F.length("_most")))), lambda i: F.left("_least", i) == F.left("_most", i))
    facts = sizes.filter(F.col(_BUCKET_ROWS) > rows_per_task).agg(F.max(_BUCKET_ROWS).alias("rows"), F.max(F.coalesce(F.size(shared), F.lit(0))).alias("shared")).first()
    if facts["rows"] is None:
        return 0
    return facts["shared"] + max(2, min(4, math.ceil(math.log10(facts["rows"] / rows_per_task))))


def _side(alloc: DataFrame, spec: AllocSpec, layout: GroupLayout, how: str) -> DataFrame:
    """Rows of hot groups, or of the others."""
    if layout.hot_groups <= max(spec.broadcast_group_limit, spec.broadcast_hot_limit):
        return alloc.join(F.broadcast(layout.hot_keys), spec.keys, how)
    return join_groups(alloc, layout.hot_keys, spec, layout, how)


def apply_rounding(
    alloc: DataFrame,
    spec: AllocSpec,
    layout: GroupLayout | None = None,
    rows_per_task: int | None = None,
    by_group: DataFrame | None = None,
    lean: DataFrame | None = None,
) -> Rounding:
    """Round down to the precision, then give the missing units one by one to
    the largest remainders (Hamilton / largest-remainder method)
    (``rnd_floor``, ``rnd_residual``, ``rnd_rank``, ``rnd_apportion``,
    ``rnd_group_summary``, ``rnd_negative_residual``, ``rnd_gap_check``).

    ``layout``: group facts from ``measure_groups``; measured here (one small
    job) when not given. ``rows_per_task`` overrides ``spec.hot_rows_per_task``.
    ``by_group``: the rows of ``alloc`` lying by group, if there is such a frame
    (``Redistribution.by_group``); ranks are then given without moving them.
    ``lean``: rows of which ``alloc`` is the ``share`` (``Redistribution.lean``), for
    hot groups: fewer columns move.
    """
    cols = spec.columns
    required = {cols.sku, cols.target, RAW}
    missing = sorted(required - set(alloc.columns))
    if missing:
        raise AllocationError(f"Rounding needs column(s) {', '.join(missing)}.")
    if layout is None:
        layout = measure_groups(alloc.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias(_ROWS)), spec)
    scaled = _scaled(alloc, spec)
    if layout.hot_keys is None:
        ranked = _rank_by_window(scaled, spec, layout.row_count) if by_group is None else _rank_by_window(_scaled(by_group, spec), spec, None)
    else:
        per_task = rows_per_task or spec.hot_rows_per_task
        if layout.hot_groups == layout.group_count:  # nothing is left for the window
            ranked = _rank_by_bucket(alloc, spec, layout, per_task, lean)
        else:
            hot, cold = (_side(alloc, spec, layout, how) for how in ("left_semi", "left_anti"))
            ranked = _rank_by_window(_scaled(cold, spec), spec, layout.row_count - layout.hot_rows).unionByName(_rank_by_bucket(hot, spec, layout, per_task))
    scale = F.lit(float(spec.scale))
    adjust_s = F.when(F.col(RANK) <= F.col(_RESID), F.lit(1.0)).otherwise(F.lit(0.0))
    out = ranked.select(
        *[F.col(f"`{c}`") for c in alloc.columns],
        (F.col(_FLOOR_S) / scale).alias(ROUNDED),
        (F.col(_REM_S) / scale).alias(REMAINDER),
        F.col(RANK),
        (adjust_s / scale).alias(ADJUST),
        ((F.col(_FLOOR_S) + adjust_s) / scale).alias(FINAL),
    )
    summary = _group_summary(scaled, spec)
    # Both group rules come from one aggregate over the (small) group summary.
    rule_counts = summary.agg(
        F.count_if(F.col("_residual_units") < 0).alias("negative_residual"),
        F.count_if(F.abs(F.col("final_gap")) > F.lit(spec.tolerance + spec.slack)).alias("rounding_gap"),
    )
    checks = [
        Check(
            "empty_allocation",
            AllocationError,
            "There are no allocation rows to round",
            alloc.limit(1).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0),
        ),
        Check(
            "negative_residual",
            IntegrityError,
            "Rounding left a negative residual in some groups (the raw values exceed the target)",
            rule_counts,
            count_col="negative_residual",
        ),
    ]
    if spec.enforce_exact_totals:
        checks.append(
            Check(
                "rounding_gap",
                IntegrityError,
                "Final allocations miss the macro target of some groups",
                rule_counts,
                count_col="rounding_gap",
            )
        )
    return Rounding(allocations=out, group_summary=summary.drop("_residual_units"), checks=checks)


def _group_summary(scaled: DataFrame, spec: AllocSpec) -> DataFrame:
    """Per group: target, raw/rounded/final totals, units added, gaps.

    Computed from the floors alone (final total = floors + min(residual, rows)),
    so it is a plain partial-aggregate ``groupBy`` that does not wait for ranks.
    """
    scale = float(spec.scale)
    target = spec.columns.target
    g = scaled.groupBy(*spec.keys).agg(
        F.max(target).alias(target),
        F.max(_TGT_S).alias("_tgt_s"),
        exact_sum(RAW).alias("raw_group_total"),
        F.sum(_FLOOR_S).alias("_floor_total_s"),
        F.count(F.lit(1)).alias("_rows"),
    )
    residual = F.col("_tgt_s") - F.col("_floor_total_s")
    added = F.greatest(F.least(residual, F.col("_rows").cast("double")), F.lit(0.0))
    rounded_total = F.col("_floor_total_s") / scale
    final_total = (F.col("_floor_total_s") + added) / scale
    return g.select(
        *spec.keys,
        target,
        "raw_group_total",
        rounded_total.alias("rounded_group_total"),
        final_total.alias("final_group_total"),
        (added / scale).alias("residual_added_total"),
        (F.col(target) - rounded_total).alias("rounded_gap"),
        (F.col(target) - final_total).alias("final_gap"),
        residual.alias("_residual_units"),
    )
