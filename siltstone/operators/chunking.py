"""Chunking: semantic chunks of sentences, and sliding windows with pooled vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions import text as tx, vectors as vec
from siltstone.functions.embedder import Embedder

MAX_CHARS, LEAST_CHARS, SAME_TOPIC = 1200, 80, 0.62
WINDOW, OVERLAP = 600, 80


def windows(n: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Array of ``(index, start, end)``: windows of ``size`` that start ``size - overlap`` apart; one for a short text."""
    step = max(size - overlap, 1)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("index"), (i * step).alias("start"), F.least(i * step + size, n).cast("int").alias("end")))


def late_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """``(id, chunk_index, char_start, char_end, chunk_id, text)``; empty and null texts have no chunk."""
    full = docs.where(F.char_length(text_col) > 0).select(id_col, F.col(text_col).alias("_t"), F.explode(windows(F.char_length(text_col), size, overlap)).alias("w"))
    return full.select(
        id_col, F.col("w.index").alias("chunk_index"), F.col("w.start").alias("char_start"), F.col("w.end").alias("char_end"),
        F.concat_ws("::lc-", F.col(id_col).cast("string"), F.col("w.index").cast("string")).alias("chunk_id"), F.expr("substring(_t, w.start + 1, w.end - w.start)").alias("text"),
    )


def pooled_chunks(docs: DataFrame, id_col: str, n_chars: Column, token_vectors: Column, width: int, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Windows with the mean of their token vectors: tokens from floor(start * r) to ceil(end * r), r tokens a character, one at least."""
    rows = docs.select(id_col, n_chars.alias("n"), token_vectors.alias("v")).where((F.col("n") > 0) & (F.size("v") > 0))
    rows = rows.select(id_col, "v", (F.size("v") / F.col("n")).alias("r"), F.explode(windows(F.col("n"), size, overlap)).alias("w"))
    low = F.least(F.floor(F.col("w.start") * F.col("r")), F.size("v") - 1).cast("int")
    high = F.greatest(F.least(F.ceil(F.col("w.end") * F.col("r")), F.size("v")), low + 1).cast("int")
    part = rows.select(id_col, "w", F.slice("v", low + 1, high - low).alias("p"))
    mean = lambda k: F.aggregate("p", F.lit(0.0), lambda s, x: s + x[k]) / F.size("p")
    means = [mean(k) for k in range(width)]
    return part.select(id_col, F.col("w.index").alias("chunk_index"), F.size("p").alias("n_tokens"), F.array(*means).alias("embedding"))


def by_strategy(docs: DataFrame, id_col: str, text_col: str, strategy: str | None, embed: Callable[[Column], Column] = tx.hash_vector, model: Embedder | None = None) -> DataFrame:
    """``(id, chunk_id, text)`` by strategy: late windows, none (whole documents), or semantic chunks, also for any other name.

    Late and semantic leave out documents without text; with none every document is a chunk.
    """
    name = (strategy or "").lower()
    if name == "late":
        return late_chunks(docs, id_col, text_col).select(id_col, "chunk_id", "text")
    if name == "none":
        return docs.select(id_col, F.col(id_col).cast("string").alias("chunk_id"), F.col(text_col).alias("text"))
    chunks = semantic_chunks(docs, id_col, text_col, embed, model=model)
    return chunks.select(id_col, F.concat_ws("::sc-", F.col(id_col).cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text")


def semantic_chunks(docs: DataFrame, id_col: str, text_col: str, embed: Callable[[Column], Column] = tx.hash_vector, max_chars: int = MAX_CHARS, same: float = SAME_TOPIC, least: int = LEAST_CHARS, model: Embedder | None = None) -> DataFrame:
    """``(id, chunk_index, n_sentences, sim_to_next, text)``.

    Sentences are embedded by ``embed``, an expression, or in batches by ``model`` where one is given.
    A text of one sentence or at most ``max_chars`` is one chunk. Else a chunk ends before the next sentence if that would
    make it too long or is about something else, and the chunk has ``least`` characters; lengths leave out joining spaces.
    ``sim_to_next`` is the similarity at the break behind a chunk. The fold keeps break positions only.
    """
    rows = docs.select(id_col, tx.sentences(F.col(text_col)).alias("s"), F.char_length(text_col).alias("n")).where(F.size("s") > 0)
    cut = (F.size("s") > 1) & (F.col("n") > max_chars)
    rows = rows.withColumn("v", F.when(cut, F.transform("s", embed)) if model is None else model.many(F.when(cut, F.col("s"))))
    rows = rows.withColumn("sim", F.when(cut, F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: vec.cosine(F.get("v", i - 1), F.get("v", i)))))
    # similarities and lengths are arrays of one, so that they are worked out once and not for every sentence
    fold = """transform(array(named_struct('sim', sim, 'n', transform(s, x -> char_length(x)))), q -> aggregate(sequence(1, size(s) - 1), named_struct('len', q.n[0], 'at', array(0)),
        (a, i) -> if((a.len + q.n[i] > {m} or q.sim[i - 1] < {t}) and a.len >= {k},
            named_struct('len', q.n[i], 'at', concat(a.at, array(i))), named_struct('len', a.len + q.n[i], 'at', a.at)), a -> a.at))[0]"""
    rows = rows.withColumn("at", F.when(cut, F.expr(fold.format(m=max_chars, t=same, k=least))).otherwise(F.array(F.lit(0))))
    rows = rows.select(id_col, "s", "sim", "at", F.posexplode_outer("at").alias("chunk_index", "first"))  # outer: no filter on the fold is inferred and pushed below it
    end = F.coalesce(F.get("at", F.col("chunk_index") + 1), F.size("s"))
    return rows.select(id_col, "chunk_index", (end - F.col("first")).alias("n_sentences"), F.round(F.get("sim", end - 1), 6).alias("sim_to_next"), F.array_join(F.slice("s", F.col("first") + 1, end - F.col("first")), " ").alias("text"))
