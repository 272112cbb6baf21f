"""Near-duplicate vectors: a neighbour graph refined by NN-descent, its edges above a cosine kept.

Equal directions are one node. Lists of the ``k`` nearest nodes start from blocks of
neighbouring nodes in the order of random hyperplane codes. A round of descent brings
together, at every node, its neighbours and the nodes it is a neighbour of (the latter
in slots, so that no node gathers without bound), and whoever finds a nearer node there
puts it on its list. Rounds go on until they add under half a per cent of edges.

A list on which every entry is an edge is saturated: more edges may be missing. The
lists of all nodes that edges connect with such a node are enlarged to their whole
component, without making its pairs: with a and b the angles of two nodes to a centre,
they are linked for certain if a + b is within the threshold's angle and not if |a - b|
is beyond it. Nodes lie in blocks by their angle; what is certain is counted by sums
over blocks, and only pairs of blocks in between are multiplied out.

Recall is audited: the links of about ``sample`` nodes are counted against all nodes,
and unless ``target`` of them were found, lists are doubled, further starting blocks
added and the descent goes on, at most ``tries`` times; recall still below it is warned of.
All lists end exact to double precision: no edge below the threshold is kept.

A null, zero or empty vector, or one with a null or non-finite component, links with
nothing. Vectors of different lengths never link. Equal rows and repeated ids are rows
of their own: each counts as a link of the others. A row without an id takes part like
any other; a component's id is the smallest id in it (null if it has none).
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plan_alloc.llm.common import forget, keep, map_batches, small
from plan_alloc.llm.components import components

BITS = 16  # hyperplanes of a code
BLOCK = 128  # nodes compared at the start
SLOT = 16  # nodes that a node is a neighbour of, brought together at a time
OFFERS = 4  # nearer nodes that a meeting offers to each of its nodes
DENSE = 256  # nodes of a block of a dense component
FLOAT = 1e-3  # more than single precision can be off by
ANGLE = 1e-6  # more than an angle can be off by


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and lengths of a list column's rows (null: no values)."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes, sizes


def _matrices(column: pa.Array):
    """For every length of vector: which rows have it, and their matrix."""
    values, starts, sizes = _lists(column)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, values[starts[at][:, None] + np.arange(dim)]


def _nested(matrix: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(matrix).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(flat))


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, unit: the vectors at length one; null for those that take no part."""

    def work(batch):
        n = batch.num_rows
        out: list = [None] * n
        for _, at, x in _matrices(batch.column(1)):
            x = x.astype(np.float64)
            top = np.abs(x).max(1)
            fit = np.isfinite(top) & (top > 0)
            x = x[fit] / top[fit][:, None]
            x /= np.sqrt((x * x).sum(1))[:, None]
            for i, row in zip(at[fit].tolist(), x + 0.0, strict=True):
                out[i] = row
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["id", "unit"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return map_batches(rows, work, "id long, unit array<double>")


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest of every row."""
    k = min(k, sims.shape[1])
    col = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(sims)), k), col.ravel()


def _edges(node, nbr, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(nbr, pa.int64()), pa.array(sim, pa.float32())], ["node", "nbr", "sim"])


_EDGES = "node long, nbr long, sim float"


def start(nodes: DataFrame, k: int, tables: int, seed: int) -> DataFrame:
    """Edges between nodes that stand together in the order of their hyperplane codes."""

    def codes(batch):
        for dim, at, x in _matrices(batch.column(1)):
            ids = batch.column(0).to_numpy()[at]
            for table in range(tables):
                p = x @ np.random.default_rng((seed, table, dim)).standard_normal((dim, BITS + 1))
                code = (p[:, :BITS] > 0) @ (1 << np.arange(BITS)[::-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), table), pa.int32()), pa.array(np.full(len(at), dim), pa.int32()), pa.array(code, pa.int64()), pa.array(p[:, BITS]), pa.array(ids), _nested(x.astype(np.float32))], names)

    names = ["table", "dim", "code", "place", "node", "vec"]
    order = names[:5]
    coded = map_batches(nodes.select("node", "unit"), codes, "table int, dim int, code long, place double, node long, vec array<float>")

    def blocks(batch):
        table, dim, ids = (batch.column(i).to_numpy() for i in (0, 1, 4))
        values, starts, _ = _lists(batch.column(5))
        edge = np.flatnonzero((np.diff(table) != 0) | (np.diff(dim) != 0)) + 1
        for run in np.split(np.arange(len(ids)), edge):
            for part in np.array_split(run, -(-len(run) // BLOCK)):
                x = values[starts[part[0]] : starts[part[-1]] + dim[part[0]]].reshape(len(part), -1)
                if len(part) > 1:
                    sims = x @ x.T
                    np.fill_diagonal(sims, -np.inf)
                    row, col = _best(sims, min(k, len(part) - 1))
                    yield _edges(ids[part][row], ids[part][col], sims[row, col])

    return map_batches(coded.repartitionByRange(*order).sortWithinPartitions(*order), blocks, _EDGES)


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of every node's edges."""
    best = edges.groupBy("node", "nbr").agg(F.max("sim").alias("sim"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr"))
    return best.withColumn("place", place).where(F.col("place") <= k).drop("place")


def meet(nodes: DataFrame, lists: DataFrame, k: int, turn: int) -> DataFrame:
    """Edges found where nodes meet: among the neighbours of a node and those it is a neighbour of."""
    slots = lists.groupBy(F.col("nbr").alias("at")).agg(F.ceil(F.count(F.lit(1)) / SLOT).cast("int").alias("slots"))
    worst = lists.groupBy("node").agg(F.when(F.count(F.lit(1)) < k, F.lit(-2.0)).otherwise(F.min("sim")).cast("float").alias("worst"))
    known = nodes.join(worst, "node", "left").select(F.col("node").alias("id"), F.coalesce("worst", F.lit(-2.0)).cast("float").alias("worst"), F.col("unit").cast("array<float>").alias("vec"))
    back = lists.select(F.col("nbr").alias("at"), F.col("node").alias("id")).join(slots, "at").select("at", F.pmod(F.xxhash64("id", F.lit(turn)), "slots").cast("int").alias("slot"), "id")
    own = lists.select(F.col("node").alias("at"), F.col("nbr").alias("id")).unionAll(nodes.select(F.col("node").alias("at"), F.col("node").alias("id")))
    own = own.join(slots, "at", "left").select("at", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1)).alias("slot"), "id")
    members = back.unionAll(own).join(known, "id")
    groups = members.groupBy("at", "slot").agg(F.collect_list(F.struct("id", "worst", "vec")).alias("m")).select("m")

    def work(batch):
        column = batch.column(0)
        member = column.flatten()
        sizes = column.value_lengths().to_numpy()
        first = np.cumsum(sizes) - sizes
        ids, worst = member.field("id").to_numpy(), member.field("worst").to_numpy()
        values, starts, dims = _lists(member.field("vec"))
        for dim in np.unique(dims[first]).tolist():  # all of a meeting have one length
            some = np.flatnonzero(dims[first] == dim)
            some = some[np.argsort(sizes[some], kind="stable")]  # of like sizes: little padding
            for part in np.array_split(some, -(-len(some) // 256)):
                wide = int(sizes[part].max())
                fill = np.arange(wide) < sizes[part][:, None]
                at = np.where(fill, first[part][:, None] + np.arange(wide), first[part][:, None])
                x = values[starts[at][:, :, None] + np.arange(dim)]
                sims = x @ x.transpose(0, 2, 1)
                sims[~(fill[:, :, None] & fill[:, None, :]) | (ids[at][:, :, None] == ids[at][:, None, :])] = -np.inf
                sims = sims.reshape(-1, wide)
                row, col = _best(sims, OFFERS)
                sim = sims[row, col]
                mine, other = at.ravel()[row], at[row // wide, col]
                good = sim > worst[mine]
                yield _edges(ids[mine[good]], ids[other[good]], sim[good])

    return map_batches(groups, work, _EDGES)


def exact_edges(nodes: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """a, b: the pairs on lists whose cosine in double precision is at least ``threshold``, once."""
    pairs = lists.where(F.col("sim") >= threshold - FLOAT).select(F.least("node", "nbr").alias("a"), F.greatest("node", "nbr").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("unit").alias(f"unit_{end}")), end)

    def work(batch):
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for (_, at, x), (_, _, y) in zip(_matrices(batch.column(2)), _matrices(batch.column(3)), strict=True):
            linked = at[(x * y).sum(1) >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], ["a", "b"])

    return map_batches(pairs.select("a", "b", "unit_a", "unit_b"), work, "a long, b long")


def dense_links(members: DataFrame, threshold: float) -> DataFrame:
    """node, links: of every node of some components (component, node, unit, copies, degree),
    the rows of other nodes of its component within ``threshold``."""
    limit = math.acos(threshold)
    hub = members.groupBy("component").agg(F.max_by("unit", F.struct("degree", -F.col("node"))).alias("centre"))

    def turn(batch):
        for (dim, at, x), (_, _, c) in zip(_matrices(batch.column(2)), _matrices(batch.column(4)), strict=True):
            angle = np.arccos(np.clip((x * c).sum(1), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(angle), batch.column(1).take(pa.array(at)), _nested(x), batch.column(3).take(pa.array(at))], ["component", "angle", "node", "unit", "copies"])

    turned = map_batches(members.join(small(hub, 10_000), "component").select("component", "node", "unit", "copies", "centre"), turn, "component long, angle double, node long, unit array<double>, copies long")
    turned = keep(turned, "angles")

    def cut(batch):
        component, angle, node, copies = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
        values, starts, sizes = _lists(batch.column(3))
        for run in np.split(np.arange(len(node)), np.flatnonzero(np.diff(component)) + 1):
            for part in np.array_split(run, -(-len(run) // DENSE)):
                flat = values[starts[part[0]] : starts[part[-1]] + sizes[part[-1]]]
                row = [component[part[0]], angle[part[0]], angle[part[-1]], copies[part].sum(), node[part], copies[part], flat]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    names = ["component", "low", "high", "weight", "nodes", "copies", "units"]
    types = [pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
    ordered = turned.repartitionByRange("component", "angle", "node").sortWithinPartitions("component", "angle", "node")
    blocks = map_batches(ordered, cut, "component long, low double, high double, weight long, nodes array<long>, copies array<long>, units array<double>")
    blocks = keep(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")

    # Certain: every block b with high_b <= limit - high_a, by a running sum over blocks ordered by ``high``.
    ends = blocks.select("component", F.col("high").alias("key"), "weight", F.lit(None).cast("long").alias("block"))
    asked = blocks.select("component", (limit - ANGLE - F.col("high")).alias("key"), F.lit(0).cast("long").alias("weight"), "block")
    over = Window.partitionBy("component").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    certain = ends.unionAll(asked).withColumn("sum", F.sum("weight").over(over)).where("block is not null").select("block", F.col("sum").alias("certain"))
    each = blocks.join(certain, "block").select(F.explode(F.arrays_zip("nodes", "copies")).alias("x"), "certain", (2 * F.col("high") <= limit - ANGLE).alias("within"))
    counts = each.select(F.col("x.nodes").alias("node"), (F.col("certain") - F.when(F.col("within"), F.col("x.copies")).otherwise(0)).alias("links"))

    # In between: pairs of blocks that are neither all linked nor all apart.
    side = lambda s: blocks.select("component", F.col("block").alias(s), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}"))
    open_ = side("a").join(side("b"), "component").where((F.col("a") <= F.col("b")) & (F.col("high_a") + F.col("high_b") > limit - ANGLE) & (F.greatest(F.col("low_b") - F.col("high_a"), F.col("low_a") - F.col("high_b")) <= limit + ANGLE)).select("a", "b")
    for s in ("a", "b"):
        open_ = open_.join(blocks.select(F.col("block").alias(s), F.struct("nodes", "copies", "units").alias(f"block_{s}")), s)

    def multiply(batch):
        for i in range(batch.num_rows):
            one, two = (batch.column(c)[i].as_py() for c in (2, 3))
            x, y = (np.array(z["units"]).reshape(len(z["nodes"]), -1) for z in (one, two))
            linked = x @ y.T >= threshold
            own = batch.column(0)[i].as_py() == batch.column(1)[i].as_py()
            if own:
                np.fill_diagonal(linked, False)
            node, links = np.array(one["nodes"]), linked @ np.array(two["copies"])
            if not own:
                node, links = np.concatenate([node, two["nodes"]]), np.concatenate([links, linked.T @ np.array(one["copies"])])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64())], ["node", "links"])

    counts = counts.unionAll(map_batches(open_.select("a", "b", "block_a", "block_b"), multiply, "node long, links long"))
    return counts.groupBy("node").agg(F.sum("links").cast("long").alias("links"))


def count_links(nodes: DataFrame, lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """node, links (rows of other nodes that it is linked with), component, for every node that has links."""
    edges = keep(exact_edges(nodes, lists, threshold), "edges")
    of = keep(components(edges), "edge_components")
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("nbr")), F.struct(F.col("b").alias("node"), F.col("a").alias("nbr")))).alias("e")).select("e.*")
    listed = ends.join(nodes.select(F.col("node").alias("nbr"), "copies"), "nbr").groupBy("node").agg(F.sum("copies").alias("links"), F.count(F.lit(1)).alias("degree"))
    listed = keep(of.join(listed, "node"), "listed")
    full = lists.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("least")).where((F.col("n") >= k) & (F.col("least") >= threshold - FLOAT))
    dense = full.join(of, "node").select("component").distinct()
    many = listed.join(dense, "component", "left_semi").join(nodes.select("node", "unit", "copies"), "node").select("component", "node", "unit", "copies", "degree")
    enlarged = dense_links(many, threshold).withColumnRenamed("links", "all_links")
    return keep(listed.join(enlarged, "node", "left").select("node", F.coalesce("all_links", "links").alias("links"), "component"), "links")


def audit(nodes: DataFrame, found: DataFrame, threshold: float, sample: int, seed: int) -> float:
    """Share of the links of about ``sample`` nodes that were found."""
    part = sample / max(1, nodes.count())
    picked = nodes.where(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30)) < int(part * (1 << 30)) + 1)
    rows = picked.join(found, "node", "left").select("node", "unit", F.coalesce("links", F.lit(0)).alias("links")).collect()
    asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r.unit) for r in rows}:
        own = [r for r in rows if len(r.unit) == dim]
        asked[dim] = np.array([r.node for r in own]), np.array([r.unit for r in own])

    def work(batch):
        for dim, at, x in _matrices(batch.column(1)):
            if dim in asked:
                ids, y = asked[dim]
                linked = (y @ x.T >= threshold) & (ids[:, None] != batch.column(0).to_numpy()[at])
                n = linked @ batch.column(2).to_numpy()[at]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], ["node", "links"])

    true = map_batches(nodes.select("node", "unit", "copies"), work, "node long, links long").agg(F.sum("links")).first()[0]
    return sum(r.links for r in rows) / true if true else 1.0


def link(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, k: int = 10, tables: int = 8, sample: int = 256, target: float = 0.97, tries: int = 4, seed: int = 1) -> DataFrame:
    """Per row: id, n_links (rows that it is linked with), component_id (smallest id reachable by links), kept."""
    rows = keep(unit_rows(vectors, id_col, vector_col), "vectors")
    nodes = rows.where("unit is not null").groupBy("unit").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    lists = found = None
    recall = 1.0
    for attempt in range(tries):
        begun = start(nodes, k, tables, seed + attempt)
        lists = _next(lists, nearest(begun if lists is None else lists.unionAll(begun), k))
        edges, turn = lists.where(F.col("sim") >= threshold).count(), 0
        while True:
            before, turn = edges, turn + 1
            lists = _next(lists, nearest(lists.unionAll(meet(nodes, lists, k, 100 * attempt + turn)), k))
            edges = lists.where(F.col("sim") >= threshold).count()
            if edges - before <= 0.005 * edges:
                break
        found = _next(found, count_links(nodes, lists, k, threshold))
        recall = audit(nodes, found, threshold, sample, seed + attempt)
        if recall >= target:
            break
        k *= 2
    if recall < target:
        warnings.warn(f"near-duplicate vectors: the audit found {recall:.3f} of the links of its sample", stacklevel=2)
    named = nodes.join(found, "node", "left").select("unit", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("c"))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    known = named.join(least, "c").select("unit", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    taken = rows.where("unit is not null").join(known, "unit").select("id", "n_links", "component_id")
    alone = rows.where("unit is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return taken.unionAll(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _next(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """``new`` written; then ``old`` is no longer needed."""
    new = new if hasattr(new, "kept_at") else keep(new, "lists")
    if old is not None:
        forget(old)
    return new
