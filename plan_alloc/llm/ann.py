"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every vector is brought to unit length times its share of the largest norm, with
one more component that makes all lengths equal, so that the largest inner
product is the smallest distance. Each table hashes a vector by ``cuts``
projections on Gaussian (2-stable) directions, cut into cells of width ``width``.
A query visits its own cell and then perturbed ones in the order of their
estimated success: the chance, under the distance at which neighbours are
expected, that a neighbour's projections fall in that cell. It stops when the
visited cells hold ``success`` of that chance over all tables together. The
candidates of all tables are merged and ranked exactly, in double precision.
A query left with fewer than ``k`` goes on to the cells of smaller inner
products, and at last to all cells.

Cells of more than ``block`` vectors are dealt out in blocks, so no task holds
a hot cell whole; equal vectors are stored once with the ids that can be among
a query's nearest (the ``k`` + 1 smallest), the exact way for groups of copies.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do those of another length than most. Of rows that repeat an id one counts
(the smallest vector); rows without an id are no one's neighbour.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plan_alloc.llm.common import keep, ship, small

SEED = 11


def usable(vector: str):
    ok = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


class Tables:
    """Directions and offsets of all tables (made from the seed, the same everywhere)."""

    def __init__(self, dim: int, tables: int, cuts: int, width: float, top: float):
        r = np.random.default_rng(SEED)
        self.tables, self.cuts, self.width, self.top = tables, cuts, width, top
        self.directions = r.standard_normal((tables, cuts, dim + 1))
        self.offsets = r.uniform(0, width, (tables, cuts))

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Unit-length vectors whose distances order as the inner products do."""
        if query:
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            return np.hstack([x, np.zeros((len(x), 1))])
        x = x / self.top
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1, keepdims=True)))])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Row, table, cut: the projection in cell widths."""
        return (np.einsum("nd,tcd->ntc", x, self.directions) + self.offsets) / self.width

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.floor(self.project(x)).astype(np.int64)

    def probes(self, table: int, at: np.ndarray, cos: float, success: float) -> list[tuple[tuple[int, ...], float]]:
        """Cells for one query in one table, most promising first.

        ``at``: its projections in cell widths. A neighbour of inner product
        ``cos`` projects to a normal law around ``cos`` times the query's.
        """
        erf = np.vectorize(math.erf)
        base, lists = np.zeros(self.cuts, np.int64), []
        for c in range(self.cuts):
            offset = self.offsets[table, c] / self.width
            mean = cos * (at[c] - offset) + offset
            sd = math.sqrt(max(1e-9, 1 - cos * cos)) / self.width
            lo, hi = math.floor(mean - 4 * sd), math.floor(mean + 4 * sd) + 1
            edge = np.arange(lo, hi + 2)
            cdf = 0.5 * (1 + erf((edge - mean) / (sd * math.sqrt(2))))
            p = np.maximum(np.diff(cdf), 1e-12)
            order = np.argsort(-p, kind="stable")
            lists.append([(int(edge[i]), float(p[i])) for i in order])
        score = lambda pick: math.prod(lists[c][i][1] for c, i in enumerate(pick))
        first = (0,) * self.cuts
        heap, seen, out, total = [(-score(first), first)], {first}, [], 0.0
        while heap and total < success:
            s, pick = heapq.heappop(heap)
            out.append((tuple(lists[c][i][0] for c, i in enumerate(pick)), -s))
            total -= s
            for c in range(self.cuts):
                if pick[c] + 1 < len(lists[c]):
                    more = pick[:c] + (pick[c] + 1,) + pick[c + 1 :]
                    if more not in seen:
                        seen.add(more)
                        heapq.heappush(heap, (-score(more), more))
        return out


def _keys(cells: np.ndarray) -> np.ndarray:
    """One number for each cell (row, table, cut -> row, table); equal numbers by chance only add candidates."""
    out = np.broadcast_to(np.arange(cells.shape[1], dtype=np.int64) + 1, cells.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for c in range(cells.shape[2]):
            out = out * np.int64(6364136223846793005) + cells[:, :, c] + np.int64(1442695040888963407)
    return out


def _expected(queries: np.ndarray, rows: np.ndarray, k: int) -> float:
    """Inner product of queries and rows, each lifted as such, that a query's k
    nearest have at least, by a sample: the queries are those of the same rows.
    """
    if len(rows) < 3:
        return 0.5
    own = np.arange(0, len(rows), max(1, len(rows) // 64))
    near = queries[own] @ rows.T
    near[np.arange(len(own)), own] = -np.inf
    near = -np.sort(-near, axis=1)[:, :-1]
    return float(np.clip(np.quantile(near[:, min(k, near.shape[1]) - 1], 0.1), -0.98, 0.98))


def _nearest(query_ids, queries, wanted, ids, vectors, keys, k, tables):
    """Per query, its k best among the rows whose cell it visits: (query, id, score)."""
    cells, inverse = np.unique(keys, return_inverse=True)
    copies = k * tables
    out = []
    for q0 in range(0, len(queries), 256):
        part = queries[q0 : q0 + 256]
        open_ = np.zeros((len(part), len(cells)), bool)
        for i, w in enumerate(wanted[q0 : q0 + 256]):
            open_[i] = np.isin(cells, w)
        near = part @ vectors.T
        for i, row in enumerate(near):
            of = np.flatnonzero(open_[i][inverse] & (ids != query_ids[q0 + i]))
            if len(of) > copies:
                least = -np.partition(-row[of], copies - 1)[copies - 1]
                of = of[row[of] >= least - 1e-9 * max(1.0, abs(least))]
            if len(of):
                # A row may be here from every table: it counts once.
                of = of[np.unique(ids[of], return_index=True)[1]]
                # The same order of additions for every row: equal vectors, equal scores.
                score = (vectors[of] * part[i]).sum(1)
                best = np.lexsort((ids[of], -score))[:k]
                out.append((np.full(len(best), query_ids[q0 + i]), ids[of][best], score[best]))
    if not out:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, tables: int = 2, width: float = 2.0, success: float = 0.8, block: int = 8192, sample: int = 8192) -> DataFrame:
    """The ``k`` nearest found of every row whose id is divisible by ``every``:
    query_id, rank, vec_id, score. ``success``: the chance of a neighbour's cell
    being visited in each table; ``sample``: rows from which the expected
    distance of neighbours is read.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v"))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).orderBy(F.desc("n"), "dim").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dim, n, top = sizes["dim"], sizes["n"], math.sqrt(sizes["top"])
    rows = keep(rows.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")), "ann_rows")
    # A cell per axis and width; their number follows the rows.
    cuts = max(2, round(math.log(max(n, 600) / 200) / math.log(3)))
    index = Tables(dim, tables, cuts, width, top)
    drawn = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id")).limit(sample).collect()], dtype=float).reshape(-1, dim)
    cos = _expected(index.lift(drawn, query=True), index.lift(drawn), k)

    copies = Window.partitionBy("v").orderBy("id")
    base = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("id", "v")

    def hashed(batches):
        for pdf in batches:
            if len(pdf):
                x = index.lift(np.array(pdf["v"].tolist(), dtype=float).reshape(-1, dim))
                key = _keys(index.cells(x))
                for t in range(tables):
                    yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "key": key[:, t]})

    def probed(cos: float):
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    at = index.project(index.lift(np.array(pdf["v"].tolist(), dtype=float).reshape(-1, dim), query=True))
                    for i, q in enumerate(pdf["id"]):
                        cells = [np.array([c for c, _ in index.probes(t, at[i, t], cos, success)], np.int64) for t in range(tables)]
                        key = np.concatenate([_keys(np.repeat(c[:, None, :], tables, 1))[:, t] for t, c in enumerate(cells)])
                        yield pd.DataFrame({"id": q, "key": key})

        return run

    stored = keep(base.mapInPandas(hashed, "id long, v array<double>, key long"), "ann_index")
    cells = stored.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    cells = keep(cells, "ann_cells")
    blocks = max(1, math.ceil(n * tables / block))
    chunks = max(1, math.ceil(n / every / (8 * block)))
    place = lambda part: F.pmod(F.xxhash64("key", part), F.lit(blocks))
    left = stored.join(small(cells), "key").withColumn("block", place(F.pmod(F.xxhash64("id"), F.col("parts"))))
    left = left.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    def ranked(base_rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        get = lambda pdf: np.array(pdf["v"].tolist(), dtype=float).reshape(-1, dim)
        return _nearest(asked["id"].to_numpy(), get(asked), [np.asarray(x) for x in asked["keys"]], base_rows["id"].to_numpy(), get(base_rows), base_rows["key"].to_numpy(), k, tables)

    # A row found in several tables has one rank.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        ranks = found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
        return ranks.groupBy("query_id", "rank", "vec_id").agg(F.max("score").alias("score")).select("query_id", "rank", "vec_id", "score")

    def visited(queries: DataFrame, visits: DataFrame) -> DataFrame:
        """The best of the cells (id, key, parts) that each query visits."""
        visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("block", place(F.col("part")))
        visits = visits.groupBy("id", "block").agg(F.collect_set("key").alias("keys"))
        right = visits.join(queries, "id").withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
        found = left.select("block", "chunk", "id", "v", "key").groupBy("block", "chunk").cogroup(right.select("block", "chunk", "id", "v", "keys").groupBy("block", "chunk")).applyInPandas(ranked, "query_id long, vec_id long, score double")
        return best(found)

    queries = rows.where(F.col("id") % every == 0)
    walk = lambda some, c: visited(some, some.mapInPandas(probed(c), "id long, key long").join(small(cells), "key"))
    out = keep(walk(queries, cos), "ann_found")
    # Queries with too few candidates go on: to where smaller inner products lie, at last everywhere.
    enough = min(k, rows.count() - 1)
    for c in (cos / 2, 0.0, None) if cos > 0 else (None,):
        if enough < 1:
            break
        full = out.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough).select(F.col("query_id").alias("id"))
        short = keep(queries.join(full, "id", "left_anti"), "ann_short")
        if short.isEmpty():
            break
        more = visited(short, short.select("id").crossJoin(cells)) if c is None else walk(short, c)
        out = keep(best(out.drop("rank").unionByName(more.drop("rank"))), "ann_found")
    return out
