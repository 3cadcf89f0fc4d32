"""Property graphs as two tables: nodes ``(id, type, label, text)`` and edges ``(src, dst, type)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.functions import text as tx
from siltstone.operators.components import connected_components
from siltstone.operators.cycles import strong_components
from siltstone.session import materialize

LARGEST, KEYWORDS, SUMMARY_WORDS, SUMMARY_LABELS = 50, 12, 10, 8
ENTITIES, REPORTS, HIT_CHARS, NEAR_CHARS = 3, 3, 200, 120


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """Defaults: the label is the id, the type unknown, the text empty; of repeated ids one stays."""
    full = nodes.select(F.col("id").cast("string").alias("id"), F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("label", F.col("id").cast("string")).alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    return full.dropDuplicates(["id"])


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between two different nodes that both exist."""
    ids = nodes.select("id")
    kept = edges.where(F.col("src") != F.col("dst")).join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return kept.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, root)``: the smallest id of each node's component; a node without edges is its own."""
    found = connected_components(edges.select("src", "dst")).withColumnRenamed("node", "id")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("root"))


def communities(nodes: DataFrame, edges: DataFrame, largest: int = LARGEST) -> DataFrame:
    """``(id, type, community)``: components, those over ``largest`` split by node type; named by smallest id, and type."""
    own = components(nodes, edges)
    sizes = own.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    rows = nodes.select("id", "type").join(own, "id").join(sizes, "root")
    return rows.select("id", "type", F.when(F.col("size") > largest, F.concat_ws("/", "root", "type")).otherwise(F.col("root")).alias("community"))


def _first(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n)


def _listed(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", value))).alias("l")).select(key, F.transform("l", lambda x: x[value]).alias(name))


def reports(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``(community, n_nodes, main_type, main_count, types, keywords, labels, summary)``, one row a community.

    Ties of counts go to the smaller word or type, labels are by id. Counts are taken before anything is listed, so no
    list is longer than a report shows.
    """
    rows = members.select("id", "community").join(nodes, "id")
    types = rows.groupBy("community", "type").agg(F.count(F.lit(1)).alias("n"))
    per = types.groupBy("community").agg(F.sum("n").alias("n_nodes"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "type"))).alias("t"))
    per = per.select("community", "n_nodes", F.col("t")[0]["type"].alias("main_type"), (-F.col("t")[0]["m"]).alias("main_count"), F.array_join(F.transform("t", lambda x: F.concat_ws("×", x["type"], (-x["m"]).cast("string"))), ", ").alias("types"))
    words = rows.select("community", F.explode(tx.graph_terms(F.concat_ws(" ", "label", "text"))).alias("w")).groupBy("community", "w").agg(F.count(F.lit(1)).alias("n"))
    keys = _listed(_first(words, ["community"], [F.desc("n"), F.col("w")], KEYWORDS), "community", "w", "keywords")
    labels = _listed(_first(rows, ["community"], [F.col("id")], SUMMARY_LABELS), "community", "label", "labels")
    out = per.join(keys, "community", "left").join(labels, "community").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    summary = F.concat(F.lit("nodes: "), F.col("n_nodes").cast("string"), F.lit(", types: "), "types", F.lit("\nwords: "), F.array_join(F.slice("keywords", 1, SUMMARY_WORDS), ", "), F.lit("\nexamples: "), F.array_join("labels", ", "))
    return out.withColumn("summary", summary)


def stats(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: nodes, edges, communities, size of the largest."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.count(F.lit(1)).alias("n_communities"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_community"))
    for name, df in (("n_nodes", nodes), ("n_edges", edges)):
        row = row.join(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))), how="cross")  # one row each
    return row


def k_hop(edges: DataFrame, seeds: DataFrame, hop: int, keys: list[str]) -> DataFrame:
    """``(*keys, id, distance)``: what ``hop`` steps over undirected edges reach from the seeds ``(*keys, id)``, seeds included."""
    both = materialize(undirected(edges), "hop-edges")
    visited = seeds.select(*keys, "id").distinct().withColumn("distance", F.lit(0))
    frontier = visited
    for step in range(1, hop + 1):
        near = frontier.select(*keys, F.col("id").alias("src")).join(both, "src").select(*keys, F.col("dst").alias("id")).distinct()
        frontier = materialize(near.join(visited.select(*keys, "id"), [*keys, "id"], "left_anti").withColumn("distance", F.lit(step)), "hop")
        visited = visited.unionByName(frontier)
    return visited


def overlaps(questions: DataFrame, rows: DataFrame, query_id: str, key: str, terms: Column, question: str = "question") -> DataFrame:
    """``(query, key, score)``: share of the question's distinct terms that a row has, by an equi-join on the term."""
    asked = questions.select(query_id, F.array_distinct(tx.graph_terms(F.col(question))).alias("_terms")).select(query_id, F.size("_terms").alias("n"), F.explode("_terms").alias("term"))
    known = rows.select(key, F.explode(F.array_distinct(terms)).alias("term"))
    return asked.join(known, "term").groupBy(query_id, key, "n").agg(F.count(F.lit(1)).alias("c")).select(query_id, key, F.round(F.col("c") / F.col("n"), 6).alias("score"))


def local_query(nodes: DataFrame, edges: DataFrame, questions: DataFrame, query_id: str, entities: int = ENTITIES, hop: int = 1) -> DataFrame:
    """``(query, id, distance, line)``: the best nodes of each question and what lies within ``hop`` steps, as context lines."""
    scores = overlaps(questions, nodes, query_id, "id", tx.graph_terms(F.concat_ws(" ", "label", "text")))
    hits = _first(scores, [query_id], [F.desc("score"), F.col("id")], entities)
    around = k_hop(edges, hits, hop, [query_id]).join(nodes, "id")
    line = lambda mark, n: F.concat(F.lit(mark), "type", F.lit(":"), "label", F.lit(" — "), F.substring("text", 1, n))
    return around.select(query_id, "id", "distance", F.when(F.col("distance") == 0, line("[HIT] ", HIT_CHARS)).otherwise(line("[NB]  ", NEAR_CHARS)).alias("line"))


def global_query(report: DataFrame, questions: DataFrame, query_id: str, most: int = REPORTS) -> DataFrame:
    """``(query, community, score, rank)``: the reports whose keywords share most with the question."""
    scores = overlaps(questions, report, query_id, "community", F.col("keywords"))
    return _first(scores, [query_id], [F.desc("score"), F.col("community")], most).select(query_id, "community", "score", F.col("_r").alias("rank"))


def subgraph(nodes: DataFrame, edges: DataFrame, types: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of the types (none: all) whose label has the text in any case, and the edges between them."""
    kept = nodes.where((F.col("type").isin(types) if types else F.lit(True)) & F.contains(F.lower("label"), F.lit(text.lower())))
    return kept, valid_edges(kept, edges)


def neighbours(edges: DataFrame, relation: str | None = None) -> DataFrame:
    """Outgoing neighbours of every node, of one relation or all."""
    return edges.where(F.col("type") == relation if relation else F.lit(True)).select("src", "dst", "type")


def migration_order(tables: DataFrame, references: DataFrame) -> DataFrame:
    """``(table, layer)``: tables nobody left refers to come first; ``references`` has ``(child, parent)``.

    Tables that refer to each other in a cycle are one step and share its layer: they have to move together. References from
    or to other tables than the given ones do not count. A round a layer, as many as the longest chain has.
    """
    names = tables.select("table").distinct()
    known = references.select("child", "parent").join(names.withColumnRenamed("table", "child"), "child", "left_semi").join(names.withColumnRenamed("table", "parent"), "parent", "left_semi")
    step = strong_components(known, "child", "parent").withColumnRenamed("node", "table")
    member = materialize(names.join(step, "table", "left").select("table", F.coalesce("component", "table").alias("step")), "order-steps")
    of = lambda c: member.select(F.col("table").alias(c), F.col("step").alias(f"{c}_step"))
    refs = known.join(of("child"), "child").join(of("parent"), "parent").where("child_step <> parent_step").select("child_step", "parent_step").distinct()
    refs, left, out, layer = materialize(refs, "order-references"), materialize(member.select("step").distinct(), "order-left"), None, 0
    while not left.isEmpty():
        held = refs.join(left.withColumnRenamed("step", "child_step"), "child_step", "left_semi").select(F.col("parent_step").alias("step")).distinct()
        free = materialize(left.join(held, "step", "left_anti").withColumn("layer", F.lit(layer)), "order-layer")
        out = free if out is None else out.unionByName(free)
        left, layer = materialize(left.join(free.select("step"), "step", "left_anti"), "order-left"), layer + 1
    return member.withColumn("layer", F.lit(None).cast("int")).select("table", "layer") if out is None else member.join(out, "step").select("table", "layer")
