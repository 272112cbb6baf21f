"""Connected components, and the links among the members of shared buckets.

Both work on tables of links in rounds, each written to the shared checkpoint
folder, where it replaces the one before; nothing but counts and sums reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plan_alloc.llm.common import forget, keep


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node in ``links`` (a, b).

    Alternating large-star and small-star rounds: each node hands its larger
    (smaller) neighbours to the smallest one it knows, until nothing changes.
    A node with very many neighbours costs partial aggregation only: its minimum
    is found map-side, and the join that hands it out is split by Spark if skewed.
    """
    pairs = keep(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: a larger neighbour v of u now points to the smallest node around u.
        large = pairs.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: u and its smaller neighbours point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        before, pairs = pairs, keep(small, "links")
        forget(before)
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def bucket_components(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    split: Callable[[DataFrame], DataFrame] | None = None,
    crowded: int = 64,
) -> DataFrame:
    """node, component (its smallest reachable node) of the graph that all verified
    pairs of members of a bucket would make, without making all pairs. Nodes
    without a link may be absent.

    ``members``: bucket, node. First every member is verified against its
    bucket's smallest node, and the components of those links are found. Only in
    buckets that still hold members of different components are pairs made, of
    members whose components differ; what they link is components, so the second
    search runs on those alone. Pairs within a component are never needed, so no
    component is lost. ``verify`` keeps the pairs (a, b) that are links.

    ``split``: for buckets whose size has no bound. Buckets that still hold
    different components and more than ``crowded`` members make no pairs of their
    own: their members (node, c: the component so far) go to ``split``, which
    returns pairs (a, b) among which all links between components are.
    """
    members = keep(members.select("bucket", "node"), "members")
    centre = members.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").select("bucket", "a")
    star = members.join(centre, "bucket").where("node != a").select("a", F.col("node").alias("b")).distinct()
    of = keep(components(verify(star).select("a", "b")), "star_components")
    placed = members.join(of, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c"))
    placed = keep(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo != hi").select("bucket", "n")
    rest = placed.join(mixed if split is None else mixed.where(F.col("n") <= crowded), "bucket")
    left = rest.select("bucket", F.col("node").alias("a"), F.col("c").alias("ca"))
    right = rest.select("bucket", F.col("node").alias("b"), F.col("c").alias("cb"))
    # The stars' pairs are judged already; the rest of a bucket's pairs are made once.
    pairs = left.join(right, "bucket").where("a < b and ca != cb").select("a", "b")
    if split is not None:
        full = keep(placed.join(mixed.where(F.col("n") > crowded), "bucket").select("node", "c").distinct(), "crowded")
        if not full.isEmpty():
            pairs = pairs.unionAll(split(full).select("a", "b"))
    pairs = pairs.distinct()
    pairs = pairs.join(star, ["a", "b"], "left_anti")
    links = verify(pairs).select("a", "b")
    for end in ("a", "b"):
        named = of.select(F.col("node").alias(end), F.col("component").alias("c"))
        links = links.join(named, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    over = keep(components(links.select("a", "b")).withColumnsRenamed({"node": "part", "component": "whole"}), "components")
    found = of.join(over, of["component"] == over["part"], "left").select("node", F.coalesce("whole", "component").alias("component"))
    alone = over.join(of, over["part"] == of["node"], "left_anti").select(F.col("part").alias("node"), F.col("whole").alias("component"))
    return found.unionAll(alone)
