"""Grading and correction of retrieval results, for all questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.functions import text as tx
from siltstone.session import materialize

SUPPORTED, PARTIAL = 0.7, 0.4
CORRECT, INCORRECT = 0.5, 0.15
WEIGHTS = (1.0, 0.7, 0.5)
STRIP_CHARS, STRIP_OVERLAP, STRIPS = 8, 0.1, 20


def critique(hits: DataFrame, query_id: str, score_scale: float = 5.0) -> DataFrame:
    """Score, verdict and reasons from mean score, spread and number of source files; ``hits`` has ``score`` and ``source``."""
    stats = hits.groupBy(query_id).agg(
        F.count(F.lit(1)).alias("chunk_count"), F.avg("score").alias("avg"), (F.max("score") - F.min("score")).alias("spread"), F.countDistinct(F.substring_index("source", "#", 1)).alias("source_coverage"),
    )
    relevance = 0.6 * F.least(F.lit(1.0), F.col("avg") / score_scale) + 0.4 * F.least(F.lit(1.0), F.col("source_coverage") / 3.0)
    verdict = F.when(relevance >= SUPPORTED, "SUPPORTED").when(relevance >= PARTIAL, "PARTIAL").otherwise("INSUFFICIENT")
    reasons = F.array_compact(F.array(F.when(F.col("avg") < 1.0, F.lit("low mean score")), F.when(F.col("source_coverage") <= 1, F.lit("single source")), F.when(F.col("spread") > 4.0, F.lit("wide spread"))))
    return stats.select(
        query_id, F.round(relevance, 3).alias("score"), verdict.alias("verdict"), F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("good").alias("reasons"),
        (verdict == "INSUFFICIENT").alias("suggest_rewrite"), "chunk_count", F.round("avg", 3).alias("avg_score"), "source_coverage",
    )


def confidence(questions: DataFrame, hits: DataFrame, query_id: str, question: str = "question", rank: str = "rank", text: str = "text") -> DataFrame:
    """Weighted overlap of the first three hits with the question, 4 digits; 0 without hits or terms."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col(rank).cast("int"))
    top = hits.where(F.col(rank) <= len(WEIGHTS)).join(questions, query_id)
    parts = top.groupBy(query_id).agg(F.sum(weight * tx.overlap(tx.term_set(F.col(question)), tx.term_set(F.col(text)))).alias("got"), F.sum(weight).alias("all"))
    return questions.select(query_id).join(parts, query_id, "left").select(query_id, F.coalesce(F.round(F.col("got") / F.col("all"), 4), F.lit(0.0)).alias("confidence"))


def route(score: Column) -> Column:
    return F.when(score >= CORRECT, "correct").when(score <= INCORRECT, "incorrect").otherwise("ambiguous")


def refine(questions: DataFrame, hits: DataFrame, query_id: str, question: str = "question", rank: str = "rank", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``(query, place, overlap, strip)``: the sentences of the hits that share most with the question, STRIPS at most.

    ``also`` names columns of the hits that stay beside the strip. Ties keep the order of hits and sentences. A question without terms gets the first 500 characters of its first 5 hits.
    """
    asked = questions.select(query_id, tx.term_set(F.col(question)).alias("_q"))
    known = asked.join(hits.select(query_id, rank, text, *also), query_id)
    cut = known.where(F.size("_q") > 0).select(query_id, "_q", rank, *also, F.posexplode(tx.strips(F.col(text))).alias("_at", "strip"))
    cut = cut.where(F.char_length("strip") >= STRIP_CHARS).withColumn("_o", tx.overlap(F.col("_q"), tx.term_set(F.col("strip")))).where(F.col("_o") >= STRIP_OVERLAP)
    first = F.row_number().over(Window.partitionBy(query_id).orderBy(rank))
    plain = known.where(F.size("_q") == 0).withColumn("_n", first).where("_n <= 5").select(query_id, rank, *also, F.lit(0).alias("_at"), F.lit(0.0).alias("_o"), F.substring(text, 1, 500).alias("strip"))
    every = cut.select(query_id, rank, *also, "_at", "_o", "strip").unionByName(plain)
    best = Window.partitionBy(query_id).orderBy(F.desc("_o"), rank, "_at")
    return every.withColumn("place", F.row_number().over(best)).where(F.col("place") <= STRIPS).select(query_id, "place", F.round("_o", 6).alias("overlap"), "strip", *also)


def refined_ranks(questions: DataFrame, hits: DataFrame, query_id: str, doc_id: str, k: int) -> DataFrame:
    """``(query, doc, score, rank)``: what corrective retrieval keeps of the hits: documents by the place of their best strip.

    The score is that strip's overlap with the question; documents none of whose strips is kept are out.
    """
    kept = refine(questions, hits, query_id, also=(doc_id,)).groupBy(query_id, doc_id).agg(F.min("place").alias("place"), F.max("overlap").alias("score"))
    best = Window.partitionBy(query_id).orderBy("place")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(query_id, doc_id, "score", "rank")


def answers(questions: DataFrame, strips: DataFrame, query_id: str, question: str = "question") -> DataFrame:
    """The first five strips as bullets below the question, or a fixed text."""
    some = strips.where("place <= 5").groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("place", "strip"))).alias("s"))
    text = F.concat(F.lit("Points found for '"), F.coalesce(question, F.lit("")), F.lit("':\n- "), F.array_join(F.transform("s", lambda x: x["strip"]), "\n- "))
    return questions.join(some, query_id, "left").select(query_id, F.coalesce(text, F.lit("Nothing conclusive in the context.")).alias("answer"))


def corrective(questions: DataFrame, local: DataFrame, web: DataFrame | None, query_id: str) -> DataFrame:
    """One row a question: confidence, route, number of strips and answer.

    Found pages join the local hits wherever the route is not correct; local hits stay in any case. ``local`` and ``web``
    have ``rank`` and ``text``; without ``web`` none is allowed, and local hits are all there is.
    """
    graded = confidence(questions, local, query_id).withColumn("route", route(F.col("confidence")))
    graded = materialize(graded, "graded")
    web = local.limit(0) if web is None else web
    extra = web.join(graded.where("route <> 'correct'").select(query_id), query_id, "left_semi")
    # pages come behind all local hits
    place = lambda part: F.struct(F.lit(part).alias("part"), F.col("rank").cast("long").alias("rank")).alias("rank")
    strips = materialize(refine(questions, local.select(query_id, place(0), "text").unionByName(extra.select(query_id, place(1), "text")), query_id), "strips")
    counts = strips.groupBy(query_id).agg(F.count(F.lit(1)).alias("n_strips"))
    return graded.join(counts, query_id, "left").join(answers(questions, strips, query_id), query_id).select(query_id, "confidence", "route", F.coalesce("n_strips", F.lit(0)).alias("n_strips"), "answer")


def recall(hits: DataFrame, truth: DataFrame, query_id: str, doc_id: str, k: int) -> DataFrame:
    """Share of questions with a true document among the first k, and the share of true ones among all first k."""
    top = hits.where(F.col("rank") <= k).join(truth.withColumn("_true", F.lit(1)), [query_id, doc_id], "left")
    each = top.groupBy(query_id).agg(F.max("_true").alias("hit"), F.count("_true").alias("n"), F.count(F.lit(1)).alias("all"))
    asked = truth.select(query_id).distinct().join(each, query_id, "left")
    return asked.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"), F.round(F.sum("n") / F.sum("all"), 6).alias("precision"))


def keyword_facts(answer: Column, keywords: Column, least: int) -> Column:
    """Whether the answer has at least ``least`` of the keywords, in any case."""
    return F.size(F.filter(keywords, lambda k: F.contains(F.upper(answer), F.upper(k)))) >= least


def self_correct(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], rewrite: Callable[[Column], Column], query_id: str, loops: int = 2, least: float = CORRECT) -> DataFrame:
    """Retrieve, grade and rewrite: only questions that are still insufficient go into the next of at most loops + 1 passes.

    ``(query, loop, confidence, sufficient, question)``, the last pass of each question. ``retrieve`` gives hits with
    ``rank`` and ``text``.
    """
    left, done = questions, None
    for loop in range(loops + 1):
        graded = left.join(confidence(left, retrieve(left), query_id), query_id).withColumn("sufficient", F.col("confidence") >= least)
        graded = materialize(graded.select(query_id, F.lit(loop).alias("loop"), "confidence", "sufficient", "question"), "self-rag")
        stop = graded if loop == loops else graded.where("sufficient")
        done = stop if done is None else done.unionByName(stop)
        left = graded.where("not sufficient").select(query_id, rewrite(F.col("question")).alias("question"))
    return done


def self_rag(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], rerank: Callable[[DataFrame], DataFrame], rewrite: Callable[[Column], Column], query_id: str, loops: int = 2, least: float = CORRECT) -> DataFrame:
    """``(query, loop, question, score, sufficient, last, fallback, chunks)``: the history of every question, a row a pass.

    A pass takes many candidates (``retrieve``), keeps the few that ``rerank`` puts first (with ``rank`` and ``text``, and an
    ``id``), grades those, and rewrites the question if they do not suffice. ``last`` marks the row with the answer's chunks,
    ids in order of rank; ``fallback`` those that never sufficed.
    """
    left, done = questions, None
    for loop in range(loops + 1):
        top = materialize(rerank(retrieve(left)), "self-rag-top")
        chunks = top.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("c")).select(query_id, F.transform("c", lambda x: x["id"]).alias("chunks"))
        graded = left.join(confidence(left, top, query_id), query_id).join(chunks, query_id, "left").withColumn("sufficient", F.col("confidence") >= least)
        last = F.col("sufficient") | F.lit(loop == loops)
        graded = graded.select(query_id, F.lit(loop).alias("loop"), "question", F.col("confidence").alias("score"), "sufficient", last.alias("last"), (last & ~F.col("sufficient")).alias("fallback"), F.coalesce("chunks", F.array().cast("array<long>")).alias("chunks"))
        graded = materialize(graded, "self-rag")
        done = graded if done is None else done.unionByName(graded)
        left = graded.where("not sufficient").select(query_id, rewrite(F.col("question")).alias("question"))
    return done
