"""Merkle manifest of a dataset, with proofs by octopus multiproofs.

Rows of a language, in order of their ids, are the leaves of a tree of fan-out 8; the trees' roots, in order of the languages,
are the leaves of one more. Leaves are numbered by a range sort and counts of its partitions, and the nodes above them are made
three levels a round by grouping whole blocks of 512, so no group grows with the table. For the proofs each part of a tree
works out which nodes its leaves need and can't derive from each other (their least union), fetches those once by a join,
derives all nodes between, and writes out the proof of every leaf from what it then holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.llm.common import release
from siltstone.session import fresh_path, materialize

FAN, ROUND = 8, 3
#: Leaves of a part, which one task holds: whole subtrees of five levels.
PART = FAN**5
#: Number of the tree over the roots of all trees.
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = "tree long, level int, idx long, digest string, n long"


def field(value: Column) -> Column:
    """A value with its length in bytes in front, ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def ranked(df: DataFrame, order: list[Column], name: str, at: str) -> DataFrame:
    """Add ``at``, the place of each row from 0 in the order given: range sort, then counts of the partitions before."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    dealt = materialize(dealt, name).withColumn("_p", F.shiftright("_m", 33))
    counts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    mask = F.lit((1 << 33) - 1).cast("long")
    return dealt.join(F.broadcast(starts), "_p").withColumn(at, F.col("_s") + F.col("_m").bitwiseAND(mask)).drop("_m", "_p", "_s")


def above(nodes: Column, n: Column) -> Column:
    """Digests one level up of a block's digests; none if the level has one node alone."""
    runs = F.sequence(F.lit(1), F.greatest(F.size(nodes), F.lit(1)), F.lit(FAN))
    return F.when((n > 1) & (F.size(nodes) > 0), F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i, FAN), ""), 256))).otherwise(F.array().cast("array<string>"))


def climb(leaves: DataFrame, most: int, path: str) -> DataFrame:
    """All nodes above the leaves ``(tree, idx, digest, n)``, ``n`` being the leaves of the tree: ``(tree, level, idx, digest, n)``.

    ``n`` is the number of nodes of the level, so a tree's root is where it is 1. ``most`` is the largest ``n``. A round
    groups blocks of 512 nodes and makes three levels of them.
    """
    spark, level, now = leaves.sparkSession, 0, leaves.select("tree", "idx", "digest", "n")
    block = FAN**ROUND
    while most > 1:
        sizes = [F.ceil(F.col("n") / FAN**k).cast("long") for k in range(ROUND + 1)]
        rows = now.where("n > 1").groupBy("tree", F.floor(F.col("idx") / block).alias("b")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("d"), F.max("n").alias("n"))
        rows = rows.withColumn("l0", F.transform("d", lambda x: x["digest"])).drop("d")
        for k in range(ROUND):
            rows = rows.withColumn(f"l{k + 1}", above(F.col(f"l{k}"), sizes[k]))
        levels = F.array(*[F.struct(F.lit(level + k).cast("int").alias("level"), F.lit(FAN ** (ROUND - k)).cast("long").alias("w"), sizes[k].alias("m"), F.col(f"l{k}").alias("ds")) for k in range(1, ROUND + 1)])
        made = rows.select("tree", "b", F.explode(levels).alias("v")).select("tree", "b", "v.*").select("tree", "level", "b", "w", "m", F.posexplode("ds").alias("i", "digest"))
        made.select("tree", "level", (F.col("b") * F.col("w") + F.col("i")).alias("idx"), "digest", F.col("m").alias("n")).write.mode("append").parquet(path)
        level, most = level + ROUND, -(-most // block)
        now = spark.read.schema(NODE).parquet(path).where(F.col("level") == level)
    return spark.read.schema(NODE).parquet(path) if level else leaves.select("tree", F.lit(0).alias("level"), "idx", "digest", "n").limit(0)


def sizes_of(n: int) -> list[int]:
    """Nodes of each level of a tree with ``n`` leaves, up to its root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def missing(wanted: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """The least union of nodes, by level, that the proofs of the sorted ``wanted`` leaves need and that can't be derived from them."""
    out = []
    for level, size in enumerate(sizes_of(n)[:-1]):
        parents = np.unique(wanted // FAN)
        children = (parents[:, None] * FAN + np.arange(FAN)).ravel()
        out.append((level, np.setdiff1d(children[children < size], wanted, assume_unique=True)))
        wanted = parents
    return out


def joined(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def completed(leaves: dict[int, str], n: int, fetch: Callable[[int, int], str]) -> list[dict[int, str]]:
    """The nodes of each level that proofs of the leaves touch: leaves and what was fetched, and what they make together."""
    sizes, held = sizes_of(n), [dict(leaves)]
    for level, gone in missing(np.array(sorted(leaves), np.int64), n):
        here = held[level]
        here.update((int(i), fetch(level, int(i))) for i in gone)
        parents = sorted({i // FAN for i in here})
        held.append({p: joined(here[i] for i in range(p * FAN, min(p * FAN + FAN, sizes[level]))) for p in parents})
    return held


def walk(at: int, n: int, held: list[dict[int, str]], leaf: str) -> tuple[list[str], str]:
    """The siblings of a leaf, level by level from left to right, and the root that they make with ``leaf`` in its place."""
    siblings = []
    for level, size in enumerate(sizes_of(n)[:-1]):
        start = at // FAN * FAN
        run = [held[level][i] for i in range(start, min(start + FAN, size))]
        siblings += run[: at - start] + run[at - start + 1 :]
        run[at - start] = leaf
        leaf, at = joined(run), at // FAN
    return siblings, leaf


class Manifest:
    """The trees of a table: ``leaves``, ``nodes`` above them, ``trees`` (one a language: number, leaves, root) and the ``root``.

    Rows are told apart by their place, so ids may repeat or be null (these come first), and equal rows are as many leaves.
    """

    def __init__(self, rows: DataFrame, leaf: str = "leaf", tree: str = "lang", order: str = "doc_id"):
        """``rows`` has the digest of each leaf, the column that names its tree (null: a tree of its own, the first), and the order in it."""
        given = materialize(rows.withColumn("_u", F.monotonically_increasing_id()), "merkle-given")
        by = [F.asc_nulls_first(tree), F.asc_nulls_first(order), F.col(leaf), F.col("_u")]
        placed = ranked(given, by, "merkle-sorted", "_g")
        trees = placed.groupBy(F.col(tree).alias("_tree")).agg(F.min("_g").alias("start"), F.count(F.lit(1)).alias("n"))
        trees = materialize(ranked(trees, [F.asc_nulls_first("_tree")], "merkle-names", "tree"), "merkle-trees")
        # the place in the sort is part of the key, so the largest tree too is joined in pieces of PART rows
        cut = placed.withColumn("_c", F.floor(F.col("_g") / PART))
        named = trees.withColumn("_c", F.explode(F.sequence(F.floor(F.col("start") / PART), F.floor((F.col("start") + F.col("n") - 1) / PART))))
        own = cut.join(named, (cut["_c"] == named["_c"]) & cut[tree].eqNullSafe(named["_tree"])).drop("_c", "_tree")
        own = own.withColumn("idx", F.col("_g") - F.col("start")).withColumn("part", F.floor(F.col("idx") / PART)).withColumnRenamed(leaf, "digest")
        self.leaves = materialize(own.drop("_u", "_g", "start"), "merkle-leaves")
        spark = rows.sparkSession
        size = trees.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("most")).first()
        self.n_trees, most = size["n"], size["most"] or 0
        nodes = climb(self.leaves, most, fresh_path(spark, "merkle-nodes"))
        roots = nodes.where("n = 1").select("tree", F.col("digest").alias("subroot")).unionByName(self.leaves.where("n = 1").select("tree", F.col("digest").alias("subroot")))
        self.trees = materialize(trees.join(roots, "tree"), "merkle-roots")
        heads = self.trees.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"), F.lit(self.n_trees).cast("long").alias("n"))
        top = climb(heads, self.n_trees, fresh_path(spark, "merkle-top"))
        level0 = lambda df: df.select("tree", F.lit(0).alias("level"), "idx", "digest", "n")
        self.nodes = level0(self.leaves).unionByName(nodes).unionByName(level0(heads)).unionByName(top)
        found = (heads if self.n_trees == 1 else top.where("n = 1")).select("digest").first()
        self.root = found["digest"] if found else None

    def prove(self, wanted: DataFrame | None = None, keep: tuple[str, ...] = (), instead: str = "digest") -> DataFrame:
        """``(*keep, leaf, subroot, proof_sha256, folded_root)`` of the wanted rows of ``leaves`` (none: all).

        The proof is the digest of all siblings from the leaf up to the root over all trees. ``instead`` names the column
        whose digest is folded up in place of the leaf.
        """
        rows = self.leaves if wanted is None else wanted
        n_trees = self.n_trees

        def union(key: tuple, part: pa.Table) -> pa.Table:
            tree = part.column("tree")[0].as_py()
            found = [(tree, *x) for x in missing(np.unique(part.column("idx").to_numpy()), part.column("n")[0].as_py())]
            found += [(TOP, *x) for x in missing(np.array([tree]), n_trees)]
            at = [(t, level, int(i)) for t, level, some in found for i in some]
            return pa.table({"part_tree": pa.array([tree] * len(at), pa.int64()), "part": pa.array([key[1].as_py()] * len(at), pa.int64()), "tree": pa.array([a[0] for a in at], pa.int64()), "level": pa.array([a[1] for a in at], pa.int32()), "idx": pa.array([a[2] for a in at], pa.int64())})

        need = rows.select("tree", "part", "idx", "n").groupBy("tree", "part").applyInArrow(union, "part_tree long, part long, tree long, level int, idx long")
        fetched = materialize(materialize(need, "merkle-need").join(self.nodes.drop("n"), ["tree", "level", "idx"]), "merkle-fetched")
        fields = {f.name: f for f in rows.schema.fields}
        schema = T.StructType([fields[c] for c in keep] + [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")])

        def expand(key: tuple, part: pa.Table, found: pa.Table) -> pa.Table:
            out = to_arrow_schema(schema)
            if not part.num_rows:
                return out.empty_table()
            known = {(t, level, i): d for t, level, i, d in zip(*(found.column(c).to_pylist() for c in ("tree", "level", "idx", "digest")))}
            tree, n, idx, leaf = part.column("tree")[0].as_py(), part.column("n")[0].as_py(), part.column("idx").to_pylist(), part.column("digest").to_pylist()
            held = completed(dict(zip(idx, leaf)), n, lambda level, i: known[tree, level, i])
            subroot = held[-1][0]
            over = completed({tree: subroot}, n_trees, lambda level, i: known[TOP, level, i])
            rest, _ = walk(tree, n_trees, over, subroot)
            proofs, folded = [], []
            for i, other in zip(idx, part.column(instead).to_pylist()):
                siblings, sub = walk(i, n, held, other)
                proofs.append(joined(siblings + rest))
                folded.append(walk(tree, n_trees, over, sub)[1])
            made = [pa.array(x, pa.string()) for x in (leaf, [subroot] * len(idx), proofs, folded)]
            release()
            return pa.Table.from_arrays([*[part.column(c).combine_chunks().cast(out.field(c).type) for c in keep], *made], schema=out)

        sides = rows.groupBy("tree", "part"), fetched.select(F.col("part_tree").alias("_t"), "part", "tree", "level", "idx", "digest").groupBy("_t", "part")
        return sides[0].cogroup(sides[1]).applyInArrow(expand, schema)


def leaves_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, leaf, tampered)``; tampering lower-cases A-Z of the text where 3 divides the CRC-32 of the id's digits."""
    names = ("doc_id", "source", "lang", "n_chars")
    rows = docs.select(*[F.col(f"`{c}`").alias(c) for c in (*names, "text")])
    head = [field(F.col(c)) for c in names]
    low = F.translate("text", UPPER, LOWER)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False)) & (low != F.col("text"))
    leaf = digest(*head, field(F.col("text")))
    return rows.select("doc_id", "lang", leaf.alias("leaf"), F.when(hit, digest(*head, field(low))).alias("tampered")).withColumn("tampered", F.coalesce("tampered", "leaf"))


def op13(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, folded from tampered leaves where a row is tampered with.

    Null fields count as ``-``, empty ones as ``0:``; a null id is never tampered with and comes first in its language, a null
    language is the first tree. Of rows with one id the order is by leaf, and equal rows are as many leaves. Texts of any length
    count whole. An empty table gives an empty result. Further columns are left out, whatever their names.
    """
    manifest = Manifest(leaves_of(docs))
    proven = manifest.prove(keep=("doc_id",), instead="tampered")
    root = F.lit(manifest.root).cast("string")
    return proven.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
