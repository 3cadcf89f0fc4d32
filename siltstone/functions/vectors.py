"""Vector functions, and exact top-k search in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Vectors of a block; queries of a block.
BLOCK, QUERIES = 1024, 256


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays over their common length; 0 if one has no length."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n).cast("array<double>"), F.slice(b, F.lit(1), n).cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def mean_vector(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean of the vectors of each group, element by element."""
    spread = df.select(*keys, F.posexplode(vector).alias("at", "x"))
    means = spread.groupBy(*keys, "at").agg(F.avg("x").alias("x"))
    return means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select(*keys, F.transform("v", lambda s: s["x"]).alias("mean"))


def blocks(df: DataFrame, id_col: str, vector: str, size: int, prefix: str) -> DataFrame:
    """Rows of up to ``size`` vectors: ids, width and the matrix. Null vectors are left out."""
    schema = T.StructType([T.StructField(f"{prefix}_ids", T.ArrayType(T.LongType())), T.StructField(f"{prefix}_width", T.IntegerType()), T.StructField(f"{prefix}_matrix", T.BinaryType())])

    def run(batches):
        out = to_arrow_schema(schema)
        for batch in batches:
            by_width: dict = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if v:
                    by_width.setdefault(len(v), []).append((i, v))
            for width, rows in by_width.items():
                for k in range(0, len(rows), size):
                    some = rows[k : k + size]
                    m = np.array([v for _, v in some], np.float64)
                    yield pa.RecordBatch.from_pylist([{f"{prefix}_ids": [i for i, _ in some], f"{prefix}_width": width, f"{prefix}_matrix": m.tobytes()}], schema=out)

    return df.select(F.col(id_col).cast("long"), F.col(vector)).mapInArrow(run, schema)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, query_id: str, vector_id: str, query_vector: str = "embedding", vector: str = "embedding", digits: int = 6, metric: str = "cosine") -> DataFrame:
    """``(query id, vector id, score, rank)``: the ``k`` best of all vectors for every query, exactly.

    Every block of vectors falls into one of as many buckets as there are shuffle partitions, and blocks of queries, the few,
    go to each bucket (or are broadcast, if Spark finds them small enough); blocks of the same width meet, each pair is one
    matrix product, and only the best k of a block go on. Scores are rounded before ranking, ties go to the smaller id. metric: cosine, or l2 for the negative
    squared distance.
    """
    asked, known = blocks(queries, query_id, query_vector, QUERIES, "q"), blocks(vectors, vector_id, vector, BLOCK, "v")
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = known.withColumn("v_bucket", F.pmod(F.xxhash64("v_ids"), F.lit(n)))
    asked = asked.withColumn("q_bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    pairs = known.join(asked, (F.col("v_bucket") == F.col("q_bucket")) & (F.col("v_width") == F.col("q_width")))
    return best_of(pairs, k, query_id, vector_id, digits, metric)


def best_of(pairs: DataFrame, k: int, query_id: str, vector_id: str, digits: int = 6, metric: str = "cosine") -> DataFrame:
    """``(query id, vector id, score, rank)``: the ``k`` best for every query among the pairs of blocks; a pair of blocks is one product."""
    schema = T.StructType([T.StructField(query_id, T.LongType()), T.StructField(vector_id, T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        out = to_arrow_schema(schema)
        for batch in batches:
            for row in batch.to_pylist():
                q, v = (np.frombuffer(row[f"{s}_matrix"], np.float64).reshape(-1, row[f"{s}_width"]) for s in "qv")
                if metric == "cosine":
                    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
                    s = np.divide(q @ v.T, norms, out=np.zeros((len(q), len(v))), where=norms > 0)
                else:
                    s = -((q[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)
                s, ids = np.round(s, digits) + 0.0, np.array(row["v_ids"])
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row["q_ids"], order.shape[1])), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], schema=out)

    best = Window.partitionBy(query_id).orderBy(F.desc("score"), vector_id)
    return pairs.mapInArrow(run, schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
