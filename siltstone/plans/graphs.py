"""Graph queries: nations, customers, suppliers and orders are nodes, their foreign keys edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import cycles, graph
from siltstone.session import materialize, table


def nodes(spark, sf_dir):
    def part(name, key, kind, label, text):
        return table(spark, sf_dir, name).select(F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), label.cast("string").alias("label"), text.alias("text"))

    col = F.col
    parts = [
        part("nation", "n_nationkey", "nation", col("n_name"), F.concat(F.lit("region "), col("n_regionkey").cast("string"))),
        part("customer", "c_custkey", "customer", col("c_name"), col("c_mktsegment")),
        part("supplier", "s_suppkey", "supplier", col("s_name"), F.lit("supplier")),
        part("orders", "o_orderkey", "orders", col("o_orderkey"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return graph.valid_nodes(out)


def edges(spark, sf_dir):
    def part(name, child, ck, parent, pk, kind):
        ref = lambda k, c: F.concat(F.lit(k + ":"), F.col(c).cast("string"))
        return table(spark, sf_dir, name).select(ref(child, ck).alias("src"), ref(parent, pk).alias("dst"), F.lit(kind).alias("type"))

    every = part("customer", "customer", "c_custkey", "nation", "c_nationkey", "lives_in").unionByName(part("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "sits_in"))
    return every.unionByName(part("orders", "orders", "o_orderkey", "customer", "o_custkey", "placed_by"))


def valid(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return n, graph.valid_edges(n, edges(spark, sf_dir))


def members(spark, sf_dir):
    n, e = valid(spark, sf_dir)
    return n, e, materialize(graph.communities(n, e), "communities")


def edge_validity(spark, sf_dir):
    """Edges that survive when customers of one segment are missing."""
    n = nodes(spark, sf_dir).where("text <> 'BUILDING'")
    return graph.valid_edges(n, edges(spark, sf_dir)).select("src", "dst", "type")


def undirected_edges(spark, sf_dir):
    return graph.undirected(edges(spark, sf_dir))


def components(spark, sf_dir):
    n, e = valid(spark, sf_dir)
    return graph.components(n, e)


def community_split(spark, sf_dir):
    return members(spark, sf_dir)[2]


def community_reports(spark, sf_dir):
    n, _, m = members(spark, sf_dir)
    return graph.reports(n, m).select("community", "n_nodes", "main_type", "main_count", "types", F.array_join("keywords", " ").alias("keywords"), "summary")


def graph_stats(spark, sf_dir):
    return graph.stats(*members(spark, sf_dir))


def kind_histogram(spark, sf_dir):
    counts = nodes(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("type", "n", F.concat_ws("=", "type", F.col("n").cast("string")).alias("summary"))


def nodes_of_kind(spark, sf_dir):
    return nodes(spark, sf_dir).where("type = 'customer'").select("id", "label")


def k_hop(spark, sf_dir):
    """Two steps from every order: its customer, the customer's nation and other orders."""
    n, e = valid(spark, sf_dir)
    seeds = n.where("type = 'orders'").select(F.col("id").alias("seed"), "id")
    return graph.k_hop(e, seeds, 2, ["seed"])


def questions(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("q"), F.concat(F.lit("what is the region of "), "n_name").alias("question"))


def local_query(spark, sf_dir):
    n, e = valid(spark, sf_dir)
    return graph.local_query(n, e, questions(spark, sf_dir), "q")


def global_query(spark, sf_dir):
    n, _, m = members(spark, sf_dir)
    return graph.global_query(graph.reports(n, m), questions(spark, sf_dir), "q")


def subgraph_filter(spark, sf_dir):
    n, e = valid(spark, sf_dir)
    kept, inner = graph.subgraph(n, e, ["customer", "nation"], "t")
    return inner.groupBy("type").agg(F.count(F.lit(1)).alias("n_edges")).join(kept.agg(F.count(F.lit(1)).alias("n_nodes")), how="cross")


def neighbours(spark, sf_dir):
    return graph.neighbours(edges(spark, sf_dir), "placed_by").groupBy("dst").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("dst", "id")


def migration_order(spark, sf_dir):
    """References between kinds of nodes as the edges show them."""
    kind = lambda c: F.substring_index(c, ":", 1)
    refs = edges(spark, sf_dir).select(kind("src").alias("child"), kind("dst").alias("parent")).distinct()
    return graph.migration_order(nodes(spark, sf_dir).select(F.col("type").alias("table")), materialize(refs, "references"))


def table_references(spark, sf_dir):
    """Customers as tables: the tables of a group of five refer to each other in a ring, the first of a group to one of the group at half its number; some also to themselves or to nobody known."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    group = F.floor(F.col("k") / 5)
    ring = rows.select(F.col("k").alias("child"), (group * 5 + F.pmod(F.col("k") + 1, F.lit(5))).alias("parent"))
    up = rows.where("k % 5 = 0 and k >= 5").select(F.col("k").alias("child"), (F.floor(group / 2) * 5 + 2).alias("parent"))
    odd = rows.where("k % 7 = 0").select(F.col("k").alias("child"), F.explode(F.array(F.col("k"), -F.col("k") - 1)).alias("parent"))
    return ring.unionByName(up).unionByName(odd).select(*[F.col(c).cast("long").alias(c) for c in ("child", "parent")])


def strong_components(spark, sf_dir):
    return cycles.strong_components(table_references(spark, sf_dir).where("parent >= 0"), "child", "parent").withColumnRenamed("node", "id")


def cyclic_order(spark, sf_dir):
    """The order of tables that refer to each other in rings."""
    return graph.migration_order(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("table")), materialize(table_references(spark, sf_dir), "references"))


QUERIES = {f.__name__: f for f in (strong_components, cyclic_order, edge_validity, undirected_edges, components, community_split, community_reports, graph_stats, kind_histogram, nodes_of_kind, k_hop, local_query, global_query, subgraph_filter, neighbours, migration_order)}

N = """n as (select 'nation:' || n_nationkey id, 'nation' type, n_name label, 'region ' || n_regionkey text, n_nationkey nk from nation
 union all select 'customer:' || c_custkey, 'customer', c_name, c_mktsegment, c_nationkey from customer
 union all select 'supplier:' || s_suppkey, 'supplier', s_name, 'supplier', s_nationkey from supplier
 union all select 'orders:' || o_orderkey, 'orders', o_orderkey::VARCHAR, o_orderpriority || ' ' || o_orderstatus, c_nationkey from orders join customer on c_custkey = o_custkey),
e as (select 'customer:' || c_custkey src, 'nation:' || c_nationkey dst, 'lives_in' type from customer union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'sits_in' from supplier
 union all select 'orders:' || o_orderkey, 'customer:' || o_custkey, 'placed_by' from orders),
own as (select id, type, label, text, min(id) over (partition by nk) root, count(*) over (partition by nk) size from n),
m as (select id, type, label, text, case when size > 50 then root || '/' || type else root end community from own)"""
WORDS = "list_filter(list_transform(regexp_extract_all({}, '[A-Za-z_][A-Za-z0-9_]*|[\\x{{4e00}}-\\x{{9fff}}]'), lambda x: lower(x)), lambda x: x not in ('the','and','or','of','to','in','for','on','is','a','an','的','是','了','和'))"
REPORT = f"""{N}, ty as (select community, type, count(*) c from m group by all),
per as (select community, sum(c)::BIGINT n_nodes, first(type order by c desc, type) main_type, max(c) main_count, string_agg(type || '×' || c, ', ' order by c desc, type) types from ty group by community),
w as (select community, unnest({WORDS.format("label || ' ' || text")}) w from m), wc as (select community, w, count(*) c from w group by all),
kw as (select community, w, row_number() over (partition by community order by c desc, w) r from wc),
k as (select community, list(w order by r) keywords from kw where r <= 12 group by community),
lb as (select community, label, row_number() over (partition by community order by id) r from m),
l as (select community, list(label order by r) labels from lb where r <= 8 group by community),
rep as (select community, n_nodes, main_type, main_count, types, coalesce(keywords, []) keywords, labels from per left join k using (community) join l using (community))"""
QUESTIONS = f"qq as (select n_nationkey q, unnest(list_distinct({WORDS.format(chr(39) + 'what is the region of ' + chr(39) + ' || n_name')})) term, len(list_distinct({WORDS.format(chr(39) + 'what is the region of ' + chr(39) + ' || n_name')})) n from nation)"
REACH = """with recursive c as (select c_custkey k, c_custkey // 5 g from customer),
r as (select k child, g * 5 + (k + 1) % 5 parent from c union select k, g // 2 * 5 + 2 from c where k % 5 = 0 and k >= 5),
n as (select child k from r union select parent from r),
reach(a, b) as (select k, k from n union select a, parent from reach join r on child = b),
scc as (select x.a id, min(x.b) component from reach x join reach y on x.a = y.b and x.b = y.a group by x.a)"""
ORACLES = {
    "strong_components": f"{REACH} select id, component from scc",
    "cyclic_order": f"""{REACH}, ce as (select distinct s.component child, t.component parent from r join scc s on s.id = child join scc t on t.id = parent where s.component <> t.component),
        deep(c, d) as (select component, 0 from scc where component not in (select parent from ce) union select parent, d + 1 from deep join ce on child = c)
        select id "table", max(d)::INT layer from scc join deep on c = component where id in (select c_custkey from customer) group by id""",
    "edge_validity": f"with {N}, k as (select id from n where text <> 'BUILDING') select src, dst, type from e where src in (from k) and dst in (from k)",
    "undirected_edges": f"with {N} select src, dst from e union select dst, src from e",
    "components": f"with {N} select id, root from own",
    "community_split": f"with {N} select id, type, community from m",
    "community_reports": f"""with {REPORT} select community, n_nodes, main_type, main_count, types, array_to_string(keywords, ' ') keywords,
        'nodes: ' || n_nodes || ', types: ' || types || chr(10) || 'words: ' || array_to_string(list_slice(keywords, 1, 10), ', ') || chr(10) || 'examples: ' || array_to_string(labels, ', ') summary from rep""",
    "graph_stats": f"with {N}, s as (select community, count(*) c from m group by 1) select (select count(*) from n) n_nodes, (select count(*) from e) n_edges, count(*) n_communities, max(c) largest_community from s",
    "kind_histogram": f"with {N} select type, count(*) n, type || '=' || count(*) summary from n group by type",
    "nodes_of_kind": f"with {N} select id, label from n where type = 'customer'",
    "k_hop": f"""with {N}, o as (select 'orders:' || o_orderkey seed, o_custkey c from orders) select seed, seed id, 0 distance from o union all select seed, 'customer:' || c, 1 from o
        union all select seed, 'nation:' || c_nationkey, 2 from o join customer on c_custkey = c union all select a.seed, b.seed, 2 from o a join o b on a.c = b.c and a.seed <> b.seed""",
    "local_query": f"""with {N}, {QUESTIONS}, t as (select id, unnest(list_distinct({WORDS.format("label || ' ' || text")})) term from n),
        s as (select q, id, round(count(*) / any_value(qq.n), 6) s from qq join t using (term) group by q, id),
        h as (select q, id from (select *, row_number() over (partition by q order by s desc, id) r from s) where r <= 3),
        b as (select src, dst from e union select dst, src from e), x as (select distinct q, dst id from h join b on src = h.id where (q, dst) not in (select (q, id) from h))
        select q, id, 0 distance, '[HIT] ' || type || ':' || label || ' — ' || substr(text, 1, 200) line from h join n using (id)
        union all select q, id, 1, '[NB]  ' || type || ':' || label || ' — ' || substr(text, 1, 120) from x join n using (id)""",
    "global_query": f"""with {REPORT}, {QUESTIONS}, t as (select community, unnest(keywords) term from rep), s as (select q, community, round(count(*) / any_value(qq.n), 6) score from qq join t using (term) group by q, community)
        select q, community, score, r::INT rank from (select *, row_number() over (partition by q order by score desc, community) r from s) where r <= 3""",
    "subgraph_filter": f"with {N}, k as (select id from n where type in ('customer', 'nation') and contains(lower(label), 't')) select type, count(*) n_edges, (select count(*) from k) n_nodes from e where src in (from k) and dst in (from k) group by type",
    "neighbours": f"with {N} select dst id, count(*) n from e where type = 'placed_by' group by dst",
    "migration_order": "select distinct 'orders' \"table\", 0 layer from orders union all select distinct 'supplier', 0 from supplier union all select distinct 'customer', 1 from customer union all select distinct 'nation', 2 from nation",
}
