"""Retrieval queries: documents are the corpus, benchmark passages the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siltstone.functions import ann, text as tx, vectors as vec
from siltstone.operators import search
from siltstone.operators.segments import Segments
from siltstone.session import table

#: Candidates of a channel before fusion, and results after it.
COARSE, TOP = 25, 5

#: Lists that a query asks of the approximate index.
PROBES = 44


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


def corpus_stats(spark, sf_dir):
    return search.corpus_stats(corpus(spark, sf_dir), "text").select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def term_df(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    idf = search.inverse_frequency(search.document_frequency(docs, "text"), search.corpus_stats(docs, "text"))
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


def index(spark: SparkSession, sf_dir: str) -> search.Index:
    return search.Index.of(corpus(spark, sf_dir), "doc_id")


def bm25_channel(spark, sf_dir, k=COARSE, known=None):
    return search.bm25(known or index(spark, sf_dir), questions(spark, sf_dir), k, "doc_id", "item_id")


def sparse_channel(spark, sf_dir, k=COARSE, known=None):
    return search.sparse(known or index(spark, sf_dir), questions(spark, sf_dir), k, "doc_id", "item_id")


def dense_channel(spark, sf_dir, k=COARSE, metric="cosine"):
    docs = corpus(spark, sf_dir).select("doc_id", tx.hash_vector(F.col("text")).alias("embedding"))
    asked = questions(spark, sf_dir).select("item_id", tx.hash_vector(F.col("text")).alias("embedding"))
    return vec.top_k(asked, docs, k, "item_id", "doc_id", metric=metric)


def bm25_topk(spark, sf_dir):
    return bm25_channel(spark, sf_dir)


def grown_index(spark, sf_dir):
    """The corpus in three batches, the first of half the documents, merged two at a time."""
    docs, known = corpus(spark, sf_dir), Segments(spark, block=16, tier=2)
    for batch in ("doc_id % 4 < 2", "doc_id % 4 = 2", "doc_id % 4 = 3"):
        known.add(docs.where(batch), "doc_id")
    return known


def bm25_grown(spark, sf_dir):
    """From the stored index that grew, the same as from a fresh one."""
    return grown_index(spark, sf_dir).top_k(questions(spark, sf_dir), COARSE, "item_id", "doc_id")


def bm25_postings_read(spark, sf_dir):
    """Postings of the questions' terms, and whether fewer had to be scored for the best five."""
    told = grown_index(spark, sf_dir).searched(questions(spark, sf_dir), TOP, "item_id", "doc_id")[1]
    return told.agg(F.count_distinct("item_id").alias("questions"), F.sum("hits").alias("postings"), (F.sum(F.when(F.col("scored"), F.col("hits"))) < F.sum("hits")).alias("fewer"))


def sparse_topk(spark, sf_dir):
    return sparse_channel(spark, sf_dir)


def dense_topk(spark, sf_dir):
    """Every vector whose id is divisible by 20 asks all vectors."""
    known = table(spark, sf_dir, "embeddings")
    asked = known.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vec.top_k(asked, known, COARSE, "query_id", "vec_id")


def ann_index(spark, sf_dir):
    """Centroids fitted on two thirds of the vectors, the others added later. Vectors without any structure, as these, need most of the lists."""
    known = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = ann.Lists.of(known.where("vec_id % 3 <> 1"), "vec_id")
    index.add(known.where("vec_id % 3 = 1"), "vec_id")
    return index, known.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def ann_topk(spark, sf_dir):
    index, asked = ann_index(spark, sf_dir)
    return index.top_k(asked, COARSE, PROBES, "query_id", "vec_id")


def ann_recall(spark, sf_dir):
    """What the index finds of the exact answers."""
    row = ann.recall(ann_topk(spark, sf_dir), dense_topk(spark, sf_dir), "query_id", "vec_id")
    return row.select("queries", (F.col("recall") >= 0.9).alias("enough"))


def channels(spark, sf_dir, known=None):
    known = known or index(spark, sf_dir)  # both channels of terms read the same postings
    return {"bm25": bm25_channel(spark, sf_dir, known=known), "dense": dense_channel(spark, sf_dir), "sparse": sparse_channel(spark, sf_dir, known=known)}


def bm25_zero_scores(spark, sf_dir):
    """The short documents as a corpus: where few have a question's terms, others fill the list with scores of 0."""
    docs = corpus(spark, sf_dir).where("char_length(text) < 60")
    asked = questions(spark, sf_dir).select("item_id", F.regexp_extract("text", r"(\S+\s+\S+)\s*$", 1).alias("text"))
    return search.bm25_with_zero(docs, asked, TOP, "doc_id", "item_id")


def rrf_fusion(spark, sf_dir):
    fused = search.rrf(channels(spark, sf_dir), "item_id", "doc_id", top_n=COARSE)
    rank_in = lambda c: F.col("channels")[c].cast("int").alias(f"{c}_rank")
    return fused.select("item_id", "doc_id", "score", "rank", rank_in("bm25"), rank_in("dense"), rank_in("sparse"))


def weighted_fusion(spark, sf_dir):
    dense = dense_channel(spark, sf_dir, metric="l2").select("item_id", "doc_id", (-F.col("score")).alias("distance"))
    return search.weighted(dense, bm25_channel(spark, sf_dir), "item_id", "doc_id", TOP)


def attached(spark, sf_dir):
    fused = search.rrf(channels(spark, sf_dir), "item_id", "doc_id").drop("channels")
    return fused.join(corpus(spark, sf_dir), "doc_id")


def hybrid_search(spark, sf_dir):
    hits = search.ranked(attached(spark, sf_dir), "item_id", "doc_id", COARSE)
    best = search.rerank(hits, "item_id", top_n=TOP)
    return best.select("item_id", "doc_id", "score", "rank", "rerank_score", "source", tx.preview(F.col("text")).alias("preview"))


def hybrid_filtered(spark, sf_dir):
    """The filter comes after fusion, so a question may get fewer than TOP."""
    hits = search.ranked(attached(spark, sf_dir), "item_id", "doc_id", COARSE).where(search.matches([(F.col("lang"), "en")]))
    return search.ranked(hits.drop("rank"), "item_id", "doc_id", TOP).select("item_id", "doc_id", "score", "rank", "lang")


def rerank_fallback(spark, sf_dir):
    best = search.rerank(bm25_channel(spark, sf_dir), "item_id", top_n=TOP)
    return best.select("item_id", "doc_id", "score", "rerank_score", "rerank_rank")


def linked_topk(spark, sf_dir):
    """Documents by two steps over shared rare terms."""
    return search.linked(index(spark, sf_dir), questions(spark, sf_dir), COARSE, "doc_id", "item_id")


def rerank_scored(spark, sf_dir, hits=None):
    """A scorer in columns: share of the question's terms in the document."""
    ask, docs = questions(spark, sf_dir), corpus(spark, sf_dir)

    def scorer(hits):
        full = hits.join(ask.withColumnRenamed("text", "question"), "item_id").join(docs.select("doc_id", "text"), "doc_id")
        return full.withColumn("rerank_score", F.round(tx.overlap(tx.term_set(F.col("question")), tx.term_set(F.col("text"))), 6))

    best = search.rerank(bm25_channel(spark, sf_dir) if hits is None else hits, "item_id", scorer=scorer, top_n=TOP)
    return best.select("item_id", "doc_id", "rank", "rerank_score", "rerank_rank")


def query_rewrite(spark, sf_dir):
    hints = [("(?i)the", "THE"), ("(?i)tion", "Tion"), ("que", "que")]
    return questions(spark, sf_dir).select("item_id", tx.rewrite_question(F.col("text"), hints).alias("rewritten"))


def web_union(spark, sf_dir):
    """Raw pages as found documents beside the corpus: texts cut to 1500 characters, scores 1.00, 0.95, ... within a site."""
    site = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    order = Window.partitionBy("source").orderBy("page_id")
    found = table(spark, sf_dir, "pages").select("page_id", site.alias("source"), F.substring("html", 1, 1500).alias("text"))
    found = found.select(F.concat(F.lit("web-"), F.col("page_id").cast("string")).alias("id"), "source", "text", F.round(1.0 - 0.05 * (F.row_number().over(order) - 1), 2).alias("score"))
    local = corpus(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "source", "text", F.lit(1.0).alias("score"))
    return local.unionByName(found).select("id", "source", "score", F.md5(F.col("text").cast("binary")).alias("text_md5"))


QUERIES = {f.__name__: f for f in (ann_topk, ann_recall, corpus_stats, term_df, bm25_topk, bm25_grown, bm25_postings_read, bm25_zero_scores, sparse_topk, dense_topk, rrf_fusion, weighted_fusion, hybrid_search, hybrid_filtered, linked_topk, rerank_fallback, rerank_scored, query_rewrite, web_union)}

SEP = tx.SEPARATORS.replace("'", "''")
TOKENS = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{SEP}'), lambda x: x <> '')"
TERM = tx.TERM


def term_set_sql(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(coalesce({text}, ''), '{TERM}'), lambda x: lower(x)))"


HASHED = "list_transform(range(0, 32), lambda i: (('0x' || substr(sha256(coalesce(text, '')), 2 * i + 1, 2))::INT)::DOUBLE / 255.0)"
TOP_BY = "row_number() over (partition by item_id order by score desc, doc_id)"


def bm25_ctes(docs: str = "documents", key: str = "doc_id", p: str = "", k: int = COARSE) -> str:
    """The BM25 twin over a table with ``text``; ``p`` prefixes the names of the parts."""
    return f"""
{p}tok as (select {key}, {TOKENS} t from {docs}),
{p}post as (select {key}, term, count(*) tf, any_value(dl) dl from (select {key}, len(t) dl, unnest(t) term from {p}tok) group by all),
{p}st as (select count(*) n, avg(len(t)) avgdl from {p}tok),
{p}df as (select term, count(*) df from {p}post group by term),
{p}raw as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) r from {p}df, {p}st),
{p}idf as (select term, df, case when r < 0 then {search.EPSILON} * (select avg(r) from {p}raw) else r end idf from {p}raw),
{p}qt as (select item_id, term, count(*) qtf, any_value(ql) ql from (select item_id, len({TOKENS}) ql, unnest({TOKENS}) term from benchmark) group by all),
{p}bm as (select item_id, {key}, round(sum(qtf * idf * tf * {search.K1 + 1} / (tf + {search.K1} * (1 - {search.B} + {search.B} * dl / avgdl))), 6) score
  from {p}qt join {p}idf using (term) join {p}post using (term), {p}st group by all),
{p}bm25 as (select * from (select *, row_number() over (partition by item_id order by score desc, {key}) rank from {p}bm) where rank <= {k})"""


BASE = f"""{bm25_ctes()},
sp as (select item_id, doc_id, round(sum((ln(1 + tf) / sqrt(dl)) * (ln(1 + qtf) / sqrt(ql))), 6) score from qt join post using (term) group by all),
sparse as (select * from (select *, {TOP_BY} rank from sp) where rank <= {COARSE}),
hd as (select doc_id, {HASHED} v from documents), hq as (select item_id, {HASHED} w from benchmark),
de as (select item_id, doc_id, round(list_cosine_similarity(w, v), 6) score from hq, hd),
dense as (select * from (select *, {TOP_BY} rank from de) where rank <= {COARSE}),
allc as (select item_id, doc_id, rank, 'bm25' c from bm25 union all select item_id, doc_id, rank, 'dense' from dense union all select item_id, doc_id, rank, 'sparse' from sparse),
fused as (select item_id, doc_id, round(sum(1.0 / ({search.RRF_K} + rank)), 6) score, max(rank) filter (c = 'bm25') bm25_rank, max(rank) filter (c = 'dense') dense_rank, max(rank) filter (c = 'sparse') sparse_rank from allc group by all),
best as (select *, {TOP_BY} rank from fused)
"""

LINKED = f"""ge as (select doc_id, term, 1.0::DOUBLE / df w from post join df using (term) where df between {search.LINK[0]} and {search.LINK[1]}),
gn as (select item_id, doc_id, round(sum(w), 6) near from ge join (select distinct item_id, term from qt) using (term) group by all),
gs as (select item_id, doc_id seed, near from (select *, row_number() over (partition by item_id order by near desc, doc_id) r from gn) where r <= {search.SEEDS}),
ga as (select item_id, seed, near, term, w, sum(w) over (partition by item_id, seed) al from gs join ge on ge.doc_id = seed),
gf as (select item_id, ge.doc_id, sum(near * ga.w / al) far from ga join ge on ge.term = ga.term and ge.doc_id <> seed group by all),
gt as (select item_id, doc_id, round(coalesce(near, 0) + {search.DECAY} * coalesce(far, 0), 6) score from gn full join gf using (item_id, doc_id)),
linked as (select * from (select *, {TOP_BY} rank from gt) where rank <= {COARSE})"""

RERANKED = f"""rs as (select item_id, doc_id, rank, {term_set_sql("b.text")} q, {term_set_sql("d.text")} d from bm25 join benchmark b using (item_id) join documents d using (doc_id)),
ro as (select item_id, doc_id, rank, case when len(q) > 0 then round(len(list_intersect(q, d)) / len(q), 6) else 0.0 end rerank_score from rs),
reranked as (select item_id, doc_id, rank old, rerank_score, rerank_rank rank from (select *, row_number() over (partition by item_id order by rerank_score desc, rank) rerank_rank from ro) where rerank_rank <= {TOP})"""

PREVIEW = "case when length(text) > 200 then substr(text, 1, 200) || '...' else text end"

ORACLES = {
    "ann_recall": "select count(*) queries, true enough from embeddings where vec_id % 20 = 0",
    "corpus_stats": f"with {BASE} select n n_docs, round(avgdl, 6) avgdl from st",
    "term_df": f"""with word as (select distinct doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '{SEP}')) term from documents), df as (select term, count(*) df from word where term <> '' group by term),
        raw as (select term, df, ln((select count(*) from documents) - df + 0.5) - ln(df + 0.5) r from df) select term, df, round(case when r < 0 then {search.EPSILON} * (select avg(r) from raw) else r end, 6) idf from raw""",
    "bm25_zero_scores": f"""with sd as (select doc_id, text from documents where length(text) < 60), benchmark as (select item_id, regexp_extract(text, '(\\S+\\s+\\S+)\\s*$', 1) text from benchmark), {bm25_ctes("sd", "doc_id", "", 1000000000)},
        every as (select item_id, doc_id, coalesce(score, 0.0) score from benchmark cross join sd left join bm using (item_id, doc_id))
        select item_id, doc_id, score, rank::INT rank from (select *, {TOP_BY} rank from every) where rank <= {TOP}""",
    "bm25_topk": f"with {BASE} select item_id, doc_id, score, rank::INT rank from bm25",
    "bm25_grown": f"with {BASE} select item_id, doc_id, score, rank::INT rank from bm25",
    "bm25_postings_read": f"with {BASE} select count(distinct item_id) questions, sum(df)::BIGINT postings, true fewer from qt join df using (term)",
    "sparse_topk": f"with {BASE} select item_id, doc_id, score, rank::INT rank from sparse",
    "dense_topk": f"""select query_id, vec_id, score, rank::INT rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from (
        select q.vec_id query_id, v.vec_id vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) score from embeddings q, embeddings v where q.vec_id % 20 = 0)) where rank <= {COARSE}""",
    "rrf_fusion": f"with {BASE} select item_id, doc_id, score, rank::INT rank, bm25_rank::INT bm25_rank, dense_rank::INT dense_rank, sparse_rank::INT sparse_rank from best where rank <= {COARSE}",
    "weighted_fusion": f"""with {BASE}, l2 as (select item_id, doc_id, round(list_sum(list_transform(range(1, 33), lambda i: (w[i] - v[i]) ** 2)), 6) distance from hq, hd),
        l2k as (select * from (select *, row_number() over (partition by item_id order by distance, doc_id) r from l2) where r <= {COARSE}),
        u as (select item_id, doc_id, round(0.6 * coalesce(1 - distance, 0) + 0.4 * coalesce(score, 0), 6) score from l2k full join bm25 using (item_id, doc_id))
        select item_id, doc_id, score, rank::INT rank from (select *, {TOP_BY} rank from u) where rank <= {TOP}""",
    "hybrid_search": f"with {BASE} select item_id, doc_id, score, rank::INT rank, round(1.0 - 0.01 * (rank - 1), 2)::DOUBLE rerank_score, source, {PREVIEW} preview from best join documents using (doc_id) where rank <= {TOP}",
    "hybrid_filtered": f"""with {BASE}, f as (select item_id, doc_id, score, lang from best join documents using (doc_id) where rank <= {COARSE} and lang = 'en')
        select item_id, doc_id, score, rank::INT rank, lang from (select *, {TOP_BY} rank from f) where rank <= {TOP}""",
    "rerank_fallback": f"with {BASE} select item_id, doc_id, score, round(1.0 - 0.01 * (rank - 1), 2)::DOUBLE rerank_score, rank::INT rerank_rank from bm25 where rank <= {TOP}",
    "rerank_scored": f"with {BASE}, {RERANKED} select item_id, doc_id, old::INT rank, rerank_score, rank::INT rerank_rank from reranked",
    "linked_topk": f"with {BASE}, {LINKED} select item_id, doc_id, score, rank::INT rank from linked",
    "query_rewrite": """with q as (select item_id, trim(regexp_replace(coalesce(text, ''), '[\\t-\\r ]+', ' ', 'g')) q from benchmark)
        select item_id, case when q = '' then q else concat_ws(' ', q, case when regexp_matches(q, '(?i)the') and not contains(q, 'THE') then 'THE' end, case when regexp_matches(q, '(?i)tion') and not contains(q, 'Tion') then 'Tion' end, case when regexp_matches(q, 'que') and not contains(q, 'que') then 'que' end) end rewritten from q""",
    "web_union": """select doc_id::VARCHAR id, source, 1.0::DOUBLE score, md5(text) text_md5 from documents union all
        select 'web-' || page_id, source, round(1.0 - 0.05 * (row_number() over (partition by source order by page_id) - 1), 2)::DOUBLE, md5(text) from
        (select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) source, substr(html, 1, 1500) text from pages)""",
}
