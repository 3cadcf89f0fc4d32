import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import embedder, text as tx
from siltstone.operators import chunking


def test_model_loads_once_a_task_and_gets_batches(spark):
    loads, sizes = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def make():
        loads.add(1)

        def model(texts):
            sizes.add(1 if len(texts) <= 8 else 10**6)
            return np.array([[len(t), ord(t[0]) if t else 0] for t in texts])

        return model

    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"t{i % 5}" * (i % 3)) for i in range(500)], "id long, t string").repartition(2)
    got = rows.select("t", embedder.Embedder(make, batch=8).one(F.col("t")).alias("v")).collect()
    assert all(r.v is None if r.t is None else r.v == [len(r.t), ord(r.t[0]) if r.t else 0] for r in got) and len(got) == 500
    assert 1 <= loads.value <= 2 and 0 < sizes.value < 10**6


def test_lists_of_texts(spark):
    rows = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,)], "s array<string>")
    got = [r.v for r in rows.coalesce(1).select(embedder.Embedder(embedder.digest_model).many(F.col("s")).alias("v")).collect()]
    assert len(got[0]) == 3 and got[0][0] == got[0][2] != got[0][1] and got[1] == [] and got[2] is None
    want = rows.select(F.transform("s", tx.hash_vector).alias("v")).collect()[0].v
    assert np.allclose(got[0], want)


@pytest.mark.parametrize("strategy", ["semantic", "late", "none"])
def test_strategies_take_a_model(spark, strategy):
    docs = spark.createDataFrame([(1, "One sentence here. " * 60 + "Something else entirely! " * 40), (2, None), (3, "short")], "id long, text string")
    rows = lambda **k: sorted(map(tuple, chunking.by_strategy(docs, "id", "text", strategy, **k).collect()), key=str)
    assert rows(model=embedder.Embedder(embedder.digest_model)) == rows()
