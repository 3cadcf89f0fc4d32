"""Strongly connected components by forward and backward reachability on tables, and the order of what is left when they are one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.session import drop_path, fresh_path, materialize

TRIMS = 3


class Scratch:
    """Tables of one run; those that are no longer read are deleted."""

    def __init__(self, df: DataFrame):
        self.spark, self.paths = df.sparkSession, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(fresh_path(self.spark, name))
        return materialize(df, name, self.paths[-1])

    def drop(self) -> None:
        for path in self.paths:
            drop_path(self.spark, path)
        self.paths = []


def spread(edges: DataFrame, start: DataFrame, keep: Scratch, better: Column, most: Column) -> DataFrame:
    """Carry ``v`` of ``start`` (``node, v``) along the edges ``(src, dst)`` until no node gets a better one.

    ``better`` compares the new ``n`` with ``v``, ``most`` picks among several that arrive. In a round only nodes that changed
    pass on, so all rounds together move an edge as often as its source changes.
    """
    state, fresh = start, start
    while not fresh.isEmpty():
        came = edges.join(fresh.select(F.col("node").alias("src"), F.col("v").alias("n")), "src").groupBy(F.col("dst").alias("node")).agg(most.alias("n"))
        fresh = keep(state.join(came, "node").where(better).select("node", F.col("n").alias("v")), "scc-fresh")
        state = keep(state.join(fresh.withColumnRenamed("v", "w"), "node", "left").select("node", F.coalesce("w", "v").alias("v")), "scc-state")
    return state


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of an edge; component is the smallest node that it reaches and that reaches it.

    Nulls are left out, repeated edges and loops change nothing; no edge, no row. Nodes that nothing leads to, or that lead
    nowhere, are alone and go first. Then the smallest node that reaches a node is spread forward: it names a set that holds
    the whole component of that smallest node. From there edges are walked back within the set; what is met is one component
    of every set, all sets at once. Edges between sets, and of nodes that have their component, go; what is left is done
    again. Only answers whether rows are left reach the driver.
    """
    keep = Scratch(edges)
    given = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
    nodes = materialize(given.select(F.col("src").alias("node")).unionByName(given.select(F.col("dst").alias("node"))).distinct(), "scc-nodes")
    left, found = materialize(given.where("src <> dst").distinct(), "scc-edges"), None
    while not left.isEmpty():
        for _ in range(TRIMS):
            left = keep(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "scc-trimmed")
        own = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct().withColumn("v", F.col("node"))
        named = spread(left, keep(own, "scc-own"), keep, F.col("n") < F.col("v"), F.min("n"))
        ends = [named.select(F.col("node").alias(c), F.col("v").alias(f"{c}_set")) for c in ("src", "dst")]
        inside = keep(left.join(ends[0], "src").join(ends[1], "dst").where("src_set = dst_set").select("src", "dst", F.col("src_set").alias("s")), "scc-inside")
        # backwards: 1 for the node that names the set, then for all that lead to one with 1
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        marks = keep(named.select("node", (F.col("node") == F.col("v")).cast("int").alias("v"), F.col("v").alias("s")), "scc-marks")
        first = marks.where("v = 1").select("node", "v")
        met, front = first, first
        while not front.isEmpty():
            came = back.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
            front = keep(came.join(met.select("node"), "node", "left_anti").withColumn("v", F.lit(1)), "scc-back")
            met = met.unionByName(front)
        done = materialize(met.select("node").join(marks.select("node", "s"), "node").select("node", F.col("s").alias("component")), "scc-done")
        found = done if found is None else found.unionByName(done)
        for c in ("src", "dst"):
            inside = inside.join(done.select(F.col("node").alias(c)), c, "left_anti")
        left = materialize(inside.select("src", "dst"), "scc-edges")
        keep.drop()
    rest = nodes if found is None else nodes.join(found, "node", "left")
    return rest.select("node", F.col("node").alias("component") if found is None else F.coalesce("component", "node").alias("component"))
