"""Operators against small fixtures and direct statements of their rules."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import chunking, graph, grading, projects, reconcile, search, tasks
from siltstone.sources import files

NODES = [("f1", "File", "OrderService.java"), ("c1", "Class", "OrderService"), ("m1", "Method", "OrderService.queryByDate"), ("m2", "Method", "OrderService.create"), ("t1", "Table", "t_order"), ("col1", "Column", "t_order.create_time"), ("col2", "Column", "t_order.amount"), ("f2", "File", "PaymentService.java"), ("c2", "Class", "PaymentService"), ("m3", "Method", "PaymentService.refund"), ("m4", "Method", "PaymentService.pay"), ("t2", "Table", "t_payment"), ("col3", "Column", "t_payment.status"), ("f3", "File", "Utils.java"), ("c3", "Class", "DateUtils")]
EDGES = [("f1", "c1"), ("c1", "m1"), ("c1", "m2"), ("m1", "t1"), ("m2", "t1"), ("t1", "col1"), ("t1", "col2"), ("m1", "col1"), ("f2", "c2"), ("c2", "m3"), ("c2", "m4"), ("m3", "t2"), ("m4", "t2"), ("t2", "col3"), ("f3", "c3"), ("m1", "m1"), ("m99", "m1"), ("m4", "col3")]


@pytest.fixture(scope="module")
def project(spark):
    nodes = graph.valid_nodes(spark.createDataFrame([(*n, None) for n in NODES], "id string, type string, label string, text string"))
    return nodes, graph.valid_edges(nodes, spark.createDataFrame([(*e, "x") for e in EDGES], "src string, dst string, type string"))


def test_graph_fixture(spark, project):
    nodes, edges = project
    assert edges.count() == 16
    sizes = sorted(r["count"] for r in graph.communities(nodes, edges).groupBy("community").count().collect())
    assert sizes == [2, 6, 7]
    assert graph.communities(nodes, edges, largest=5).select("community").distinct().count() == 11
    ask = spark.createDataFrame([(1, "OrderService queryByDate"), (2, "quantum chromodynamics nonsense"), (3, "")], "q int, question string")
    got = graph.local_query(nodes, edges, ask, "q").collect()
    assert {r.q for r in got} == {1} and {r.id for r in got if r.distance == 0} >= {"m1"} and any(r.distance == 1 for r in got)
    report = graph.reports(nodes, graph.communities(nodes, edges))
    assert {r.q for r in graph.global_query(report, ask, "q").collect()} == {1}


def test_windows(spark):
    row = spark.range(1).select(chunking.windows(F.lit(1300)).alias("w"), chunking.windows(F.lit(600)).alias("v")).first()
    assert [(w.start, w.end) for w in row.w] == [(0, 600), (520, 1120), (1040, 1300)] and len(row.v) == 1


def split(text, least=6):
    out = []
    for s in (" ".join(p.split()) for p in re.split(r"(?<=[。！？；])|(?<=[.!?;])(?=\s|$)|\n{2,}", text)):
        if s and len(s) < least and out:
            out[-1] += " " + s
        elif s:
            out.append(s)
    return out


def chunks(text):
    sents = split(text)
    if len(sents) <= 1 or len(text) <= 1200:
        return [" ".join(sents)] if sents else []
    vec = lambda s: [b / 255 for b in hashlib.sha256(s.encode()).digest()]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out, now, size = [], [sents[0]], len(sents[0])
    for a, b in zip(sents, sents[1:]):
        u, v = vec(a), vec(b)
        sim = dot(u, v) / (dot(u, u) ** 0.5 * dot(v, v) ** 0.5)
        if (size + len(b) > 1200 or sim < 0.62) and size >= 80:
            out.append(" ".join(now))
            now, size = [], 0
        now.append(b)
        size += len(b)
    return [*out, " ".join(now)]


def test_sentences_and_semantic_chunks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.s for r in docs.select("doc_id", tx.sentences(F.col("text")).alias("s")).collect()}
    assert got == {k: split(t) for k, t in texts.items()}
    made: dict = {}
    for r in chunking.semantic_chunks(docs, "doc_id", "text").orderBy("doc_id", "chunk_index").collect():
        made.setdefault(r.doc_id, []).append(r.text)
    assert made == {k: chunks(t) for k, t in texts.items() if chunks(t)}


def test_point_values(spark):
    row = spark.range(1).select(grading.route(F.lit(0.5)).alias("a"), grading.route(F.lit(0.15)).alias("b"), grading.route(F.lit(0.3)).alias("c"), tasks.percent(F.lit(4)).alias("p")).first()
    assert tuple(row) == ("correct", "incorrect", "ambiguous", 67)
    hits = spark.createDataFrame([(1, 0.36, "a#x"), (1, 0.30, "b#y")], "q int, score double, source string")
    got = grading.critique(hits, "q").first()
    assert (got.score, got.verdict) == (0.306, "INSUFFICIENT")
    lists = {n: spark.createDataFrame([(1, 7, 1)], "q int, d int, rank int") for n in "ab"}
    assert search.rrf(lists, "q", "d").first().score == 0.032787


def test_rules(spark):
    sql = spark.createDataFrame([("SELECT NVL(a,0) FROM DUAL",), ("SELECT TOP 5 [a] FROM t",), ("SELECT NVL(a,0), SYSDATE FROM t WHERE ROWNUM <= 10",)], "s string")
    rows = sql.select(projects.features(F.col("s")).alias("f"), projects.dialect(projects.features(F.col("s"))).alias("d"), projects.rewrite_sql(F.col("s"))[0].alias("r")).collect()
    assert rows[0].f == ["ORACLE:DUAL", "ORACLE:NVL"] and rows[0].d == "ORACLE"
    assert rows[1].f == ["MSSQL:BRACKET_IDENT", "MSSQL:TOP_N"] and rows[1].d == "MSSQL"
    assert rows[2].r == "SELECT COALESCE(a,0), CURRENT_TIMESTAMP FROM t WHERE LIMIT 10"


def test_merge_is_idempotent(spark):
    start = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "id int, seq int, v string")
    change = spark.createDataFrame([(1, 1, "A", False, 5), (2, 2, None, True, None), (3, 3, "c", False, 6), (3, 2, "x", False, 7)], "id int, seq int, v string, deleted boolean, extra int")
    once = reconcile.merge(start, change, "id", "seq", "deleted")
    assert sorted(map(tuple, reconcile.present(once).collect())) == [(1, 1, "A", 5), (3, 3, "c", 6)]
    assert sorted(map(str, reconcile.merge(once, change, "id", "seq", "deleted").collect())) == sorted(map(str, once.collect()))


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "pom.xml").write_text("<project><dependencies><dependency><groupId>g</groupId><artifactId>x</artifactId><version>1</version></dependency></dependencies></project>")
    (tmp_path / "application-x.properties").write_text("# note\nspring.datasource.password=ENC(x)\nb: 2\n")
    (tmp_path / "g.jsonl").write_text('# head\n\n{"id": "q1", "kind": "qa"}\n{"id": "q2", "kind": "retrieve"}\n')
    assert [tuple(r) for r in files.dependencies(spark, str(tmp_path)).collect()] == [("g:x", "1")]
    keys = files.properties(files.whole_files(spark, str(tmp_path), "application*")).select("key", "value", projects.sensitive(F.col("key")), projects.encrypted(F.col("key"), F.col("value"))).collect()
    assert sorted(map(tuple, keys)) == [("b", "2", False, False), ("spring.datasource.password", "ENC(x)", True, True)]
    assert [r.id for r in files.json_lines(spark, str(tmp_path / "g.jsonl"), kind="qa").collect()] == ["q1"]
    (tmp_path / "set.json").write_text('{"taskId": 4, "results": [{"unitId": "u1", "confidence": 0.8}, {"unitId": "u2", "confidence": 0.9}]}')
    assert files.patch_sets(spark, str(tmp_path / "set.json")).count() == 2


def test_dispatch_takes_the_first_handler_and_reports_errors(spark):
    col = F.col
    handlers = [
        tasks.Handler("a", col("n") > 5, F.upper("t"), F.lit("big"), F.lit(0.9), F.lit(False), F.when(col("t").isNull(), F.lit("no text"))),
        tasks.Handler("b", col("n") > 2, col("t"), F.lit("small"), F.lit(0.5), F.lit(True), F.lit(None).cast("string")),
    ]
    units = spark.createDataFrame([(1, "x"), (3, "x"), (3, None), (6, "y"), (7, None), (None, "z")], "n int, t string")
    got = sorted((r.n, r.handler, r.patched or "", r.rationale, r.confidence, r.needs_review) for r in tasks.dispatch(units, handlers, ["n"]).collect())
    assert got == [(3, "b", "", "small", 0.5, True), (3, "b", "x", "small", 0.5, True), (6, "a", "Y", "big", 0.9, False), (7, "a", "", "handler error: no text", 0.0, True)]
    assert sorted(str(r.n) for r in tasks.unhandled(units, handlers).collect()) == ["1", "None"]


def test_a_late_change_does_not_bring_a_deleted_row_back(spark):
    rows = lambda *x: spark.createDataFrame(x, "id long, seq long, deleted boolean, v string")
    one = reconcile.merge(rows().limit(0), rows((1, 1, False, "a"), (2, 1, False, "b")), "id", "seq", "deleted")
    two = reconcile.merge(one, rows((1, 5, True, None)), "id", "seq", "deleted")
    three = reconcile.merge(two, rows((1, 3, False, "late"), (2, 1, False, "again")).withColumn("w", F.lit(7)), "id", "seq", "deleted")
    assert [tuple(r) for r in reconcile.present(three).collect()] == [(2, 1, "b", None)]
    assert [r.v for r in reconcile.present(reconcile.merge(three, rows((1, 6, False, "new")), "id", "seq", "deleted")).orderBy("id").collect()] == ["new", "b"]


def test_zero_scores_fill_up(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "blue fox", "green hat", "old tree", "tall tree"])], "d long, text string")
    ask = spark.createDataFrame([(1, "red"), (2, "nothing"), (3, "")], "q long, text string")
    got = [(r.q, r.d, r.score > 0) for r in search.bm25_with_zero(docs, ask, 3, "d", "q").orderBy("q", "rank").collect()]
    assert got == [(1, 0, True), (1, 1, False), (1, 2, False), (2, 0, False), (2, 1, False), (2, 2, False), (3, 0, False), (3, 1, False), (3, 2, False)]


def test_json_leaves(spark):
    doc = '{"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": 1}}}}}}}, "p": "{cipher}x", "q": "[x] y", "r": [], "s": null, "t": "plain"}'
    got = {r.path: r.value for r in files.flat_json(spark.createDataFrame([(1, doc), (2, None), (3, "{")], "i int, j string"), ["i"], "j").collect() if r.i == 1}
    assert got == {"a.b.c.d.e.f.g.h": "1", "p": "{cipher}x", "q": "[x] y", "s": "", "t": "plain"}


def test_marks_in_texts_are_blanks(spark):
    row = spark.createDataFrame([("One sentence here\u0001 goes on. Another one there.",)], "t string").select(tx.sentences(F.col("t")).alias("s"), tx.strips(F.col("t")).alias("p")).first()
    assert row.s == row.p == ["One sentence here goes on.", "Another one there."]


def test_migration_order_gives_a_cycle_one_layer(spark):
    tables = spark.createDataFrame([(t,) for t in "abcdxy"], "table string")
    refs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("x", "y"), ("y", "x"), ("x", "d")], "child string, parent string")
    assert {r.table: r.layer for r in graph.migration_order(tables, refs).collect()} == {"a": 0, "b": 1, "c": 2, "d": 1, "x": 0, "y": 0}


def test_self_rag_history(spark):
    ask = spark.createDataFrame([(1, "red fox"), (2, "zz blue hat"), (3, "zz yy xx")], "q long, question string")
    docs = spark.createDataFrame([(10, "the red fox runs"), (11, "a blue hat"), (12, "old tree")], "d long, text string")

    def retrieve(left):
        return search.bm25(docs, left, 50, "d", "q", query_text="question").join(docs, "d")

    rerank = lambda hits: search.rerank(hits, "q", top_n=1).select("q", F.col("d").alias("id"), F.col("rerank_rank").alias("rank"), "text")
    rewrite = lambda q: F.regexp_replace(q, r"^\S+\s+", "")
    got = [(r.q, r.loop, r.question, r.sufficient, r.last, r.fallback, r.chunks) for r in grading.self_rag(ask, retrieve, rerank, rewrite, "q", least=0.9).orderBy("q", "loop").collect()]
    assert got == [
        (1, 0, "red fox", True, True, False, [10]), (2, 0, "zz blue hat", False, False, False, [11]), (2, 1, "blue hat", True, True, False, [11]),
        (3, 0, "zz yy xx", False, False, False, []), (3, 1, "yy xx", False, False, False, []), (3, 2, "xx", False, True, True, []),
    ]


def test_strategies(spark):
    docs = spark.createDataFrame([(1, "Short text."), (2, "x" * 700), (3, None)], "d long, text string")
    count = lambda name: chunking.by_strategy(docs, "d", "text", name).groupBy("d").count().orderBy("d").collect()
    assert [tuple(r) for r in count("late")] == [(1, 1), (2, 2)] and [tuple(r) for r in count("none")] == [(1, 1), (2, 1), (3, 1)]
    assert count("Semantic") == count("unknown") == count(None) == count("")


def test_linked_reaches_documents_without_a_term_of_the_question(spark):
    rows = [(1, "alpha common"), (2, "alpha beta common"), (3, "beta gamma common"), (4, "gamma common"), (5, "common"), (6, None)] + [(10 + i, "common") for i in range(20)]
    index = search.Index.of(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    ask = spark.createDataFrame([(1, "alpha"), (2, "common"), (3, None)], "q long, text string")
    got = {r.doc_id: (r.score, r["rank"]) for r in search.linked(index, ask, 9, "doc_id", "q").where("q = 1").collect()}
    # by hand: alpha is worth 1/2 to documents 1 and 2; 1 hands 1/2 * 1/2 to 2; of 2's two terms alpha hands 1/8 to 1, beta 1/8 to 3
    assert got == {2: (0.75, 1), 1: (0.625, 2), 3: (0.125, 3)}
    assert search.linked(index, ask, 9, "doc_id", "q").where("q > 1").isEmpty()  # a term of most documents is no node


def test_refined_ranks_follow_the_best_strip(spark):
    ask = spark.createDataFrame([(1, "red green blue"), (2, "nothing")], "q long, question string")
    hits = spark.createDataFrame([(1, 7, 1, "Only red here now. Nothing of it."), (1, 8, 2, "All red green blue words. And red again."), (1, 9, 3, "No colour whatever."), (2, 7, 1, "Something else.")], "q long, doc_id long, rank int, text string")
    got = grading.refined_ranks(ask, hits, "q", "doc_id", 5).collect()
    assert sorted((r.q, r.doc_id, r.score, r["rank"]) for r in got) == [(1, 7, 0.333333, 2), (1, 8, 1.0, 1)]
