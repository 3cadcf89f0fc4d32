import numpy as np
from pyspark.sql import functions as F

from siltstone.functions import ann, vectors as vec
from siltstone.session import fresh_path

SCHEMA = "vec_id long, embedding array<double>"


def clustered(n=1500, width=16, seed=3):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(30, width)) * 3
    return [(i, (at[i % 30] + rng.normal(size=width)).tolist()) for i in range(n)]


def test_clustered_vectors_need_few_lists(spark):
    rows = spark.createDataFrame(clustered(), SCHEMA)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")
    index = ann.Lists.of(rows.where("vec_id < 900"), "vec_id", lists=24, sample=500)
    index.add(rows.where("vec_id >= 900"), "vec_id")
    exact = vec.top_k(asked, rows, 10, "q", "vec_id")
    found = index.top_k(asked, 10, 4, "q", "vec_id")
    got = ann.recall(found, exact, "q", "vec_id").first()
    assert got.queries == 75 and got.recall >= 0.9
    scores = {(r.q, r.vec_id): r.score for r in exact.collect()}
    assert all(abs(scores[r.q, r.vec_id] - r.score) < 1e-6 for r in found.collect() if (r.q, r.vec_id) in scores)
    assert ann.recall(index.top_k(asked, 10, 24, "q", "vec_id"), exact, "q", "vec_id").first().recall == 1.0


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, 0.0, 0.0]), (7, [0.0, 2.0])], SCHEMA)
    index = ann.Lists.of(rows, "vec_id", lists=3)
    got = {}
    for r in index.top_k(rows.withColumnRenamed("vec_id", "q"), 2, 3, "q", "vec_id").collect():
        got.setdefault(r.q, []).append(r.vec_id)
    assert set(got) == {1, 2, 5, 6, 7} and got[1][0] == 1 and got[2] == [2, 7] and got[6] == [6]


def test_one_list_with_most_rows_is_dealt_out(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.001 * (i % 7)]) for i in range(3000)] + [(9000 + i, [-1.0, 0.1 * i]) for i in range(5)], SCHEMA)
    index = ann.Lists.of(rows, "vec_id", lists=2, path=fresh_path(spark, "lists"))
    sizes = [r.n for r in spark.read.parquet(index.path).select(F.size("v_ids").alias("n")).collect()]
    assert sum(sizes) == 3005 and max(sizes) < 1500
