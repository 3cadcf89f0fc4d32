"""Connected components by contraction: every round hooks each node to a neighbour of least random rank and shrinks the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltstone.session import materialize


def without_leaves(edges: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, up)`` with every leaf under its only neighbour and all others under themselves, and the edges that are left."""
    degree = lambda c: near.select(F.col("node").alias(c), F.col("degree").alias(f"d{c}"))
    known = materialize(edges.join(degree("a"), "a").join(degree("b"), "b"), "cc-degrees")
    alone = F.col("db") == 1  # of two leaves the larger hangs under the smaller
    leaves = known.where(alone | (F.col("da") == 1)).select(F.when(alone, F.col("b")).otherwise(F.col("a")).alias("node"), F.when(alone, F.col("a")).otherwise(F.col("b")).alias("up"))
    pairs = known.where(alone & (F.col("da") == 1)).select(F.col("a").alias("node"), F.col("a").alias("up"))
    stay = near.where("degree > 1").select("node", F.col("node").alias("up"))
    return materialize(leaves.unionByName(pairs).unionByName(stay), "cc-hook"), known.where("da > 1 and db > 1").select("a", "b")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that has an edge; component is the smallest node of the component.

    Nulls and self-loops are ignored, repeated edges count once; no edge, no row. Ranks are hashes that change with the
    round, so that on a chain too only about every third node is the least of its neighbourhood; all others hook to one
    that is, or near it, and are replaced by it. So the edges shrink by a factor each round, whatever the shape of the
    graph, and rounds grow with the logarithm of the number of nodes. While half of the nodes or more have one neighbour
    only, as in trees and stars, a round takes all of them off at once instead. What was hooked where is written and put together
    from the last round back, each step a larger table. Only the answer whether edges are left reaches the driver.
    """
    left = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    left = materialize(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    hooks: list[DataFrame] = []
    while not left.isEmpty():
        rank = lambda c, salt=len(hooks): F.struct(F.xxhash64(c, F.lit(salt)).alias("r"), F.col(c).alias("n"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("least"), F.count(F.lit(1)).alias("degree"))
        near = materialize(near.select(F.col("a").alias("node"), F.least("least", rank("a"))["n"].alias("up"), "degree"), "cc-near")
        share = near.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("degree") == 1).alias("leaves")).first()
        if 2 * share["leaves"] >= share["n"]:
            hook, left = without_leaves(left, near)
            hooks.append(hook)
            continue
        hook = near.drop("degree")
        top = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook = materialize(hook.join(top, "up").select("node", F.col("top").alias("up")), "cc-hook")
        hooks.append(hook)
        left = left.join(hook.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(hook.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        left = left.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        left = materialize(left, "cc-edges")
    if not hooks:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = hooks.pop()
    while hooks:
        above = roots.select(F.col("node").alias("up"), F.col("up").alias("root"))
        roots = materialize(hooks.pop().join(above, "up", "left").select("node", F.coalesce("root", "up").alias("up")), "cc-roots")
    names = roots.groupBy("up").agg(F.min("node").alias("component"))
    return materialize(roots.join(materialize(names, "cc-names"), "up").select("node", "component"), "cc-components")
