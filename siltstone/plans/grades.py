"""Grading queries: benchmark passages are questions, BM25 hits over documents are graded; pages serve as found pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from siltstone.functions import text as tx
from siltstone.operators import grading, search
from siltstone.plans import retrieval as rt
from siltstone.session import materialize, table

TOP, PAGES = 5, 3


def hits(spark, sf_dir):
    """The hits with their texts, written once: grading, refining and answers all read them."""
    return materialize(rt.bm25_channel(spark, sf_dir, TOP).join(rt.corpus(spark, sf_dir), "doc_id"), "hits")


def asked(spark, sf_dir):
    return rt.questions(spark, sf_dir).withColumnRenamed("text", "question")


def found_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.substring("html", 1, 1500).alias("text"))
    return search.bm25(pages, rt.questions(spark, sf_dir), PAGES, "page_id", "item_id").join(pages, "page_id").select("item_id", "rank", "text")


def critique(spark, sf_dir):
    return grading.critique(hits(spark, sf_dir), "item_id")


def crag_confidence(spark, sf_dir):
    return grading.confidence(asked(spark, sf_dir), hits(spark, sf_dir), "item_id")


def crag_route(spark, sf_dir):
    graded = crag_confidence(spark, sf_dir)
    return graded.select("item_id", "confidence", grading.route(F.col("confidence")).alias("route"))


def refine_strips(spark, sf_dir):
    return grading.refine(asked(spark, sf_dir), hits(spark, sf_dir), "item_id")


def crag_answer(spark, sf_dir):
    """Corrective retrieval end to end, every question in one plan."""
    return grading.corrective(asked(spark, sf_dir), hits(spark, sf_dir), found_pages(spark, sf_dir), "item_id")


def truth(spark, sf_dir, known=None):
    """Documents that contain a passage: those with the passage's rarest inner token, by the index, then the whole passage.

    The first and the last token may go on outside the passage; a passage of no more than these is looked for in all documents.
    """
    docs, ask, known = rt.corpus(spark, sf_dir).select("doc_id", "text"), rt.questions(spark, sf_dir), known or rt.index(spark, sf_dir)
    words = ask.select("item_id", F.col("text").alias("passage"), tx.tokens(F.col("text")).alias("t"))
    inner = words.where(F.size("t") > 2).select("item_id", "passage", F.explode(F.expr("slice(t, 2, size(t) - 2)")).alias("term"))
    rare = inner.join(known.df, "term").groupBy("item_id", "passage").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    long = known.postings.select("doc_id", "term").join(materialize(rare, "rarest"), "term").join(docs, "doc_id").where(F.contains("text", "passage"))
    short = docs.join(F.broadcast(words.where(F.size("t") <= 2)), F.contains("text", "passage"))  # few, as most passages are longer
    return long.select("item_id", "doc_id").unionByName(short.select("item_id", "doc_id"))


def crag_local_only(spark, sf_dir):
    """The same where found pages are not allowed."""
    return grading.corrective(asked(spark, sf_dir), hits(spark, sf_dir), None, "item_id")


def recall_at_k(spark, sf_dir):
    known = rt.index(spark, sf_dir)
    return grading.recall(rt.bm25_channel(spark, sf_dir, TOP, known), truth(spark, sf_dir, known), "item_id", "doc_id", TOP)


def channel_ablation(spark, sf_dir):
    """Recall of seven ways to search: each channel, their fusion, BM25 reranked, corrected by strips, and steps over shared rare terms."""
    ask, index = asked(spark, sf_dir), rt.index(spark, sf_dir)
    found = {n: materialize(c.select("item_id", "doc_id", "score", "rank"), n) for n, c in rt.channels(spark, sf_dir, index).items()}
    known, texts = materialize(truth(spark, sf_dir, index), "truth"), rt.corpus(spark, sf_dir).select("doc_id", "text")
    found |= {
        "fused": search.rrf(found, "item_id", "doc_id", top_n=TOP),
        "reranked": rt.rerank_scored(spark, sf_dir, found["bm25"]).select("item_id", "doc_id", F.col("rerank_rank").alias("rank")),
        "corrected": grading.refined_ranks(ask, found["bm25"].join(texts, "doc_id"), "item_id", "doc_id", TOP),
        "linked": search.linked(index, rt.questions(spark, sf_dir), TOP, "doc_id", "item_id"),
    }
    rows = [grading.recall(ranked, known, "item_id", "doc_id", TOP).withColumn("variant", F.lit(name)) for name, ranked in found.items()]
    return reduce(DataFrame.unionByName, rows)


def keyword_faithfulness(spark, sf_dir):
    """Does the answer hold two of the five first distinct terms in order of its question?"""
    ask = asked(spark, sf_dir)
    strips = grading.refine(ask, hits(spark, sf_dir), "item_id").where("place <= 5").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("strip")), " ").alias("answer"))
    rows = ask.join(strips, "item_id", "left")
    return rows.select("item_id", F.coalesce(grading.keyword_facts(F.col("answer"), F.slice(F.array_sort(tx.term_set(F.col("question"))), 1, 5), 2), F.lit(False)).alias("faithful"))


def self_rag_loop(spark, sf_dir):
    known = rt.index(spark, sf_dir)

    def retrieve(ask):
        docs = rt.corpus(spark, sf_dir)
        return search.bm25(known, ask, TOP, "doc_id", "item_id", query_text="question").join(docs, "doc_id").select("item_id", "rank", "text")

    rewrite = lambda q: F.regexp_replace(q, r"^\S+\s+", "")  # noqa: E731  leaves out the first word
    return grading.self_correct(asked(spark, sf_dir), retrieve, rewrite, "item_id", least=0.9)


def self_rag_history(spark, sf_dir):
    """All passes: 50 candidates by BM25 from one index, 5 by term overlap, questions that lose their first word."""
    docs, known = rt.corpus(spark, sf_dir).select("doc_id", "text"), rt.index(spark, sf_dir)

    def retrieve(ask):
        return search.bm25(known, ask, 50, "doc_id", "item_id", query_text="question").join(ask, "item_id").join(docs, "doc_id")

    def rerank(hits):
        scored = hits.withColumn("rerank_score", F.round(tx.overlap(tx.term_set(F.col("question")), tx.term_set(F.col("text"))), 6))
        best = search.rerank(scored, "item_id", scorer=lambda h: h, top_n=TOP)
        return best.select("item_id", F.col("doc_id").alias("id"), F.col("rerank_rank").alias("rank"), "text")

    rewrite = lambda q: F.regexp_replace(q, r"^\S+\s+", "")
    found = grading.self_rag(asked(spark, sf_dir), retrieve, rerank, rewrite, "item_id", least=0.9)
    return found.select("item_id", "loop", "score", "sufficient", "last", "fallback", F.array_join("chunks", ",").alias("chunks"))


QUERIES = {f.__name__: f for f in (critique, crag_confidence, crag_route, refine_strips, crag_answer, crag_local_only, recall_at_k, channel_ablation, keyword_faithfulness, self_rag_loop, self_rag_history)}


SET = rt.term_set_sql
OVER = lambda q, d: f"case when len({q}) > 0 then len(list_intersect({q}, {d})) / len({q}) else 0.0 end"
FLAT = "trim(regexp_replace(coalesce(text, ''), '[\\t-\\r ]+', ' ', 'g'))"
STRIPS = f"list_filter(list_transform(string_split(regexp_replace({FLAT}, '([\\x{{3002}}\\x{{ff01}}\\x{{ff1f}}.!?]) *', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
HITS = f"""{rt.BASE}, h as (select item_id, doc_id, score, rank, text, source from bm25 join documents using (doc_id) where rank <= {TOP}),
q as (select item_id, text question, {SET('text')} q from benchmark),
ov as (select item_id, rank, {OVER('q', SET('text'))} o from h join q using (item_id) where rank <= 3),
conf as (select item_id, coalesce(round(sum(case rank when 1 then 1.0 when 2 then 0.7 else 0.5 end * o) / sum(case rank when 1 then 1.0 when 2 then 0.7 else 0.5 end), 4), 0.0)::DOUBLE confidence from q left join ov using (item_id) group by all),
routed as (select item_id, confidence, case when confidence >= 0.5 then 'correct' when confidence <= 0.15 then 'incorrect' else 'ambiguous' end route from conf)"""


def refine_sql(source: str, name: str) -> str:
    return f"""{name}_s as (select item_id, rank, {STRIPS} s from {source}),
{name}_e as (select item_id, rank, unnest(s) strip, generate_subscripts(s, 1) nth from {name}_s),
{name}_o as (select item_id, rank, nth, strip, {OVER('q', SET('strip'))} o from {name}_e join q using (item_id) where length(strip) >= 8),
{name} as (select * from (select item_id, rank, strip, o, row_number() over (partition by item_id order by o desc, rank, nth) place from {name}_o where o >= 0.1) where place <= 20)"""


SHORTER = "regexp_replace({}, '^\\S+\\s+', '')"
#: The questions of all three passes, whichever are asked: four times the id, and the pass.
PASSES = "benchmark as (" + " union all ".join(f"select item_id * 4 + {n} item_id, {t} text from benchmark" for n, t in enumerate(("text", SHORTER.format("text"), SHORTER.format(SHORTER.format("text"))))) + ")"
GRADED = """graded as (select item_id // 4 item_id, (item_id % 4)::INT loop, question, confidence, confidence >= 0.9 sufficient, item_id p from q join conf using (item_id)),
run as (select *, sufficient or loop = 2 "last" from graded g where not exists (select 1 from graded e where e.item_id = g.item_id and e.loop < g.loop and e.sufficient))"""
WEIGHT = "case rank when 1 then 1.0 when 2 then 0.7 else 0.5 end"

CONTAINED = "tr as (select item_id, doc_id from benchmark b, documents d where contains(d.text, b.text))"


def recall_sql(ranked: str) -> str:
    return f"""(select count(*) questions, round(avg(coalesce(hit, 0)), 6) recall, round((sum(n) / sum(al))::DOUBLE, 6) "precision" from (select distinct item_id from tr) left join
      (select item_id, max(t) hit, count(t) n, count(*) al from (select r.item_id, r.doc_id, case when tr.doc_id is not null then 1 end t from {ranked} r left join tr on tr.item_id = r.item_id and tr.doc_id = r.doc_id where rank <= {TOP}) group by item_id) using (item_id))"""


PAGED = f"""{HITS}, pg as (select page_id, substr(html, 1, 1500) text from pages), {rt.bm25_ctes("pg", "page_id", "p_", PAGES)},
src as (select item_id, rank, text from h union all select item_id, rank + 1000000, text from p_bm25 join pg using (page_id) where item_id in (select item_id from routed where route <> 'correct'))"""

ORACLES = {
    "critique": f"""with {HITS}, s as (select item_id, count(*) n, avg(score) a, max(score) - min(score) sp, count(distinct split_part(source, '#', 1)) c from h group by item_id),
        r as (select *, 0.6 * least(1.0, a / 5.0) + 0.4 * least(1.0, c / 3.0) rel from s)
        select item_id, round(rel, 3) score, case when rel >= 0.7 then 'SUPPORTED' when rel >= 0.4 then 'PARTIAL' else 'INSUFFICIENT' end verdict,
        coalesce(nullif(concat_ws('; ', case when a < 1.0 then 'low mean score' end, case when c <= 1 then 'single source' end, case when sp > 4.0 then 'wide spread' end), ''), 'good') reasons,
        rel < 0.4 suggest_rewrite, n chunk_count, round(a, 3) avg_score, c source_coverage from r""",
    "crag_confidence": f"with {HITS} select * from conf",
    "crag_route": f"with {HITS} select * from routed",
    "refine_strips": f"with {HITS}, {refine_sql('h', 'f')} select item_id, place::INT place, round(o, 6)::DOUBLE overlap, strip from f",
    "crag_answer": f"""with {PAGED}, {refine_sql('src', 'f')}, a as (select item_id, count(*) n, string_agg(strip, chr(10) || '- ' order by place) filter (place <= 5) s from f group by item_id)
        select item_id, confidence, route, coalesce(n, 0) n_strips, coalesce('Points found for ''' || coalesce(question, '') || ''':' || chr(10) || '- ' || s, 'Nothing conclusive in the context.') answer
        from routed join q using (item_id) left join a using (item_id)""",
    "crag_local_only": f"""with {HITS}, {refine_sql('h', 'f')}, a as (select item_id, count(*) n, string_agg(strip, chr(10) || '- ' order by place) filter (place <= 5) s from f group by item_id)
        select item_id, confidence, route, coalesce(n, 0) n_strips, coalesce('Points found for ''' || coalesce(question, '') || ''':' || chr(10) || '- ' || s, 'Nothing conclusive in the context.') answer
        from routed join q using (item_id) left join a using (item_id)""",
    "recall_at_k": f"with {rt.BASE}, {CONTAINED} select * from {recall_sql('bm25')}",
    "channel_ablation": f"""with {HITS}, {CONTAINED}, {rt.LINKED}, {rt.RERANKED}, h25 as (select item_id, doc_id, rank, text from bm25 join documents using (doc_id)), {refine_sql('h25', 'f')},
        corrected as (select item_id, doc_id, row_number() over (partition by item_id order by min(place)) rank from f join bm25 using (item_id, rank) group by item_id, doc_id) """
    + " union all ".join(f"select *, '{n}' variant from {recall_sql(t)}" for n, t in (("bm25", "bm25"), ("dense", "dense"), ("sparse", "sparse"), ("fused", "best"), ("reranked", "reranked"), ("corrected", "corrected"), ("linked", "linked"))),
    "keyword_faithfulness": f"""with {HITS}, {refine_sql('h', 'f')}, a as (select item_id, string_agg(strip, ' ') answer from f where place <= 5 group by item_id)
        select item_id, coalesce(len(list_filter(list_slice(list_sort(q), 1, 5), lambda k: contains(upper(answer), upper(k)))) >= 2, false) faithful from q left join a using (item_id)""",
    "self_rag_loop": f"""with {PASSES}, {HITS}, {GRADED} select item_id, loop, confidence, sufficient, question from run where "last\"""",
    "self_rag_history": f"""with {PASSES}, {rt.bm25_ctes(k=50)}, {rt.RERANKED}, q as (select item_id, text question from benchmark),
        ov as (select item_id, reranked.rank rank, {OVER('q', 'd')} o from reranked join rs using (item_id, doc_id) where reranked.rank <= 3),
        conf as (select item_id, coalesce(round(sum({WEIGHT} * o) / sum({WEIGHT}), 4), 0.0)::DOUBLE confidence from q left join ov using (item_id) group by all), {GRADED},
        ch as (select item_id p, string_agg(doc_id::VARCHAR, ',' order by rank) chunks from reranked group by item_id)
        select item_id, loop, confidence score, sufficient, "last", "last" and not sufficient fallback, coalesce(chunks, '') chunks from run left join ch using (p)""",
}
