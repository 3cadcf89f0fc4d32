from pyspark.sql import functions as F

from siltstone.operators import search
from siltstone.operators.segments import Segments
from siltstone.session import drop_path, fresh_path

SCHEMA = "doc_id long, text string"


def corpus(n=1200):
    """Texts of common words, every one with a few of its own; ``w0`` stands in all of them."""
    rows = []
    for i in range(n):
        words = ["w0"] + [f"w{(i * j) % (7 * j + 3)}" for j in range(1, 3 + i % 40)] + [f"rare{i // 3}"] * (1 + i % 3)
        rows.append((i, " ".join(words)))
    return rows


ASKED = [(1, "rare17 w5"), (2, "w0 w3 w3 w9 rare200"), (3, "w0"), (4, "nowhere"), (5, ""), (6, None), (7, "rare399 rare1 w11"), (8, "W7, w8; rare50")]


def found(df):
    return sorted((r.q, r.doc_id, r.score, r["rank"]) for r in df.collect())


def fresh(spark, rows, asked, k):
    return found(search.bm25(spark.createDataFrame(rows, SCHEMA), asked, k, "doc_id", "q"))


def test_grown_index_equals_a_fresh_one(spark):
    asked = spark.createDataFrame(ASKED, "q long, text string")
    rows, index = corpus(300), Segments(spark, block=8, tier=2)
    cuts = [0, 120, 200, 201, 300]
    for a, b in zip(cuts, cuts[1:]):
        index.add(spark.createDataFrame(rows[a:b], SCHEMA), "doc_id")
        if b in (201, 300):  # segments of two tiers, then all in one
            assert found(index.top_k(asked, 4, "q", "doc_id")) == fresh(spark, rows[:b], asked, 4)
    known = index.segments()
    assert sum(s.n_docs for s in known) == 300 and [s.tier for s in known] == [2]  # four batches that are not empty


def test_blocks_that_cannot_reach_the_best_are_left_alone(spark):
    asked = spark.createDataFrame(ASKED, "q long, text string")
    rows, index = corpus(), Segments(spark, block=16)
    index.add(spark.createDataFrame(rows, SCHEMA), "doc_id")
    hits, told = index.searched(asked, 3, "q", "doc_id")
    assert found(hits) == fresh(spark, rows, asked, 3)
    work = {r.q: (r.n, r.s) for r in told.groupBy("q").agg(F.sum("hits").alias("n"), F.sum(F.col("hits") * F.col("scored").cast("int")).alias("s")).collect()}
    assert set(work) == {1, 2, 3, 7, 8}
    assert all(work[q][1] * 4 < work[q][0] for q in (1, 2, 7, 8)), work


def test_a_job_that_stops_leaves_the_old_or_the_new(spark):
    asked = spark.createDataFrame(ASKED, "q long, text string")
    rows, path = corpus(60), fresh_path(spark, "stopped")
    index = Segments(spark, path, block=8, tier=2)
    index.add(spark.createDataFrame(rows[:30], SCHEMA), "doc_id")
    # a segment without statistics was not finished
    index.add(spark.createDataFrame(rows[:20], SCHEMA).withColumn("doc_id", F.col("doc_id") + 1000), "doc_id") if False else None
    spark.read.parquet(f"{path}/docs/segment=0").write.parquet(f"{path}/docs/segment=1")
    assert found(index.top_k(asked, 3, "q", "doc_id")) == fresh(spark, rows[:30], asked, 3)
    # a merge that stopped before the old segments were deleted
    index._clean = lambda: None
    index.add(spark.createDataFrame(rows[30:], SCHEMA), "doc_id")
    again = Segments(spark, path, block=8, tier=2)
    assert len(again._complete()) == 3 and [s.number for s in again.segments()] == [2]
    assert found(again.top_k(asked, 3, "q", "doc_id")) == fresh(spark, rows, asked, 3)
    drop_path(spark, f"{path}/postings/segment=0")
    again.add(spark.createDataFrame([(9000, "w5 w5 rare17")], SCHEMA), "doc_id")
    assert found(again.top_k(asked, 3, "q", "doc_id")) == fresh(spark, rows + [(9000, "w5 w5 rare17")], asked, 3)


def test_odd_batches(spark):
    asked = spark.createDataFrame([(1, "a b"), (2, "zz")], "q long, text string")
    index = Segments(spark)
    assert found(index.top_k(asked, 3, "q", "doc_id")) == []
    index.add(spark.createDataFrame([], SCHEMA), "doc_id")
    assert index.segments() == []
    rows = [(1, None), (2, ""), (3, "a"), (4, "a a b"), (5, "a"), (6, "b " * 5000)]
    index.add(spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("clash")), "doc_id")
    assert found(index.top_k(asked, 3, "q", "doc_id")) == fresh(spark, rows, asked, 3)
    only = Segments(spark)
    only.add(spark.createDataFrame([(1, None), (2, ".")], SCHEMA), "doc_id")  # documents, but no token at all
    assert found(only.top_k(asked, 3, "q", "doc_id")) == []
