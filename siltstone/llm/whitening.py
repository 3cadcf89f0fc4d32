"""Embedding whitening by the polarisation covariance.

Vectors become integers, so every sum is exact. Once the number of distinct vectors and the sums of their dimensions are known,
each task adds up the squared centred values of every dimension and of the sum of every two dimensions; as
``var(a + b) = var(a) + var(b) + 2 cov(a, b)``, differences of these variances are the covariances. Only they, whose number
depends on the width alone, reach the driver, which assembles the matrix for ``eigh``. Squares are added as whole numbers of any
size and are divided once, so the matrix is right to the last bit whatever the mean and the number of vectors.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.llm.common import limit_batches, release
from siltstone.session import materialize

SCALE, COMPONENTS = 256, 4
#: A component whose eigenvalue is at most this share of the trace has no variance to divide by.
NO_VARIANCE = 1e-12
#: Bits of a digit of a long sum: four digits hold what 2^40 vectors of whole longs can add up to.
DIGIT_BITS, DIGITS = 63, 4
#: Bits of a limb, three of which hold a value below 2^62 whose square does not fit into a long.
LIMB = 21
SAFE = 1 << 62


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * value)`` as longs; what is beyond a long is its largest or least."""
    scaled = np.floor(values * float(scale))
    inside = (scaled >= -(2.0**63)) & (scaled < 2.0**63)
    out = np.where(scaled > 0, np.iinfo(np.int64).max, np.iinfo(np.int64).min)
    out[inside] = scaled[inside].astype(np.int64)
    return out


def packed(vector: np.ndarray) -> bytes:
    """The one shortest form of a vector: bytes of an item, then the items up to the last that is not zero."""
    used = np.flatnonzero(vector)
    vector = vector[: used[-1] + 1] if len(used) else vector[:0]
    low, high = (int(vector.min()), int(vector.max())) if len(vector) else (0, 0)
    size = next(b for b in (1, 2, 4, 8) if -(1 << 8 * b - 1) <= low and high < 1 << 8 * b - 1)
    return bytes([size]) + vector.astype(f"<i{size}").tobytes()


def unpacked(vectors: list[bytes], width: int) -> np.ndarray:
    """Packed vectors as rows of longs, with zeros behind their last item."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        items = np.frombuffer(v, f"<i{v[0]}", offset=1)
        out[i, : len(items)] = items
    return out


def batch_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """The vectors of a batch as doubles; None for those that are null or hold null or non-finite entries."""
    flat = column.flatten()  # without the items of null lists
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries are NaN here
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends, there = np.cumsum(sizes), column.is_valid().to_numpy(zero_copy_only=False)
    bad = np.zeros(len(values) + 1, np.int64)
    np.cumsum(~np.isfinite(values), out=bad[1:])
    return [values[e - n : e] if ok and bad[e] == bad[e - n] else None for e, n, ok in zip(ends, sizes, there)]


def square_sums(p: np.ndarray) -> np.ndarray | list[int]:
    """The exact sum of squares of every column, as longs where they must fit and as integers of any size where not."""
    if not p.size:
        return [0] * p.shape[1]
    if p.dtype == object:
        return [int(v) for v in (p * p).sum(axis=0)]
    top = max(int(p.max()), -int(p.min()))
    if top * top * len(p) < SAFE:
        return np.einsum("ij,ij->j", p, p)
    mask = (1 << LIMB) - 1
    a, b, c = p >> 2 * LIMB, (p >> LIMB) & mask, p & mask  # a signed; at most 2^42 a product
    dot = lambda x, y: np.einsum("ij,ij->j", x, y).tolist()
    parts = zip(dot(a, a), dot(a, b), dot(a, c), dot(b, b), dot(b, c), dot(c, c))
    return [(aa << 4 * LIMB) + (ab << 3 * LIMB + 1) + ((2 * ac + bb) << 2 * LIMB) + (bc << LIMB + 1) + cc for aa, ab, ac, bb, bc, cc in parts]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exactly: longs, or integers of any size where a sum of two could pass a long."""
    top = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0)
    if n * top + max(map(abs, sums), default=0) < SAFE >> 1:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def pair_sums(d: np.ndarray, totals: list[list[int]]) -> None:
    """Add the squares of each dimension (first in its list) and of its sum with every later one."""
    for i in range(d.shape[1]):
        p = d[:, i:] + d[:, i : i + 1]
        p[:, 0] = d[:, i]
        mine = totals[i]
        for j, v in enumerate(square_sums(p)):
            mine[j] += int(v)


def coded(df: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``(_id, x, w)``: id, packed integer vector and its length, for every row whose vector is there and finite."""
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector}`").cast("array<double>").alias("_v"))
    schema = T.StructType([rows.schema["_id"], T.StructField("x", T.BinaryType()), T.StructField("w", T.IntegerType())])

    def run(batches):
        out = to_arrow_schema(schema)
        for batch in batches:
            vectors = batch_vectors(batch.column(1))
            keep = pa.array([i for i, v in enumerate(vectors) if v is not None], pa.int64())
            xs = [packed(whole(v, scale)) for v in vectors if v is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), pa.array(xs, pa.binary()), pa.array([len(v) for v in vectors if v is not None], pa.int32())], schema=out)

    limit_batches(df.sparkSession)
    return rows.mapInArrow(run, schema)


def _totals(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of fit vectors and the exact sum of each dimension."""
    schema = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("s", T.DecimalType(38, 0))])

    def run(batches):
        n, sums = 0, [0] * width
        for batch in batches:
            x = unpacked(batch.column(0).to_pylist(), width)
            n += len(x)
            top = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
            found = x.sum(axis=0) if top * max(len(x), 1) < SAFE else x.astype(object).sum(axis=0)
            sums = [s + int(v) for s, v in zip(sums, found)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(width)], pa.int32()), pa.array([Decimal(v) for v in (n, *sums)], pa.decimal128(38, 0))], schema=to_arrow_schema(schema))

    rows = {r.at: int(r.s) for r in fit.select("x").mapInArrow(run, schema).groupBy("at").agg(F.sum("s").alias("s")).collect()}  # one row a dimension
    return rows.get(-1, 0), [rows.get(i, 0) for i in range(width)]


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance matrix of the packed vectors ``x``, divisor ``n``, from variances of dimensions and of sums of two of them."""
    width = len(sums)
    digits = [f"d{k}" for k in range(DIGITS)]
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("i", "j")] + [T.StructField(c, T.LongType()) for c in digits])

    def run(batches):
        totals = [[0] * (width - i) for i in range(width)]
        for batch in batches:
            pair_sums(centred(unpacked(batch.column(0).to_pylist(), width), n, sums), totals)
        out, mask = to_arrow_schema(schema), (1 << DIGIT_BITS) - 1
        for i, mine in enumerate(totals):
            cut = [[v >> DIGIT_BITS * k & mask for v in mine] for k in range(DIGITS)]
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(mine), pa.int32()), pa.array(range(i, width), pa.int32()), *[pa.array(c, pa.int64()) for c in cut]], schema=out)
        release()

    # a task gives each pair once, so what is added up here are as many rows a pair as there are tasks
    added = fit.select("x").mapInArrow(run, schema).groupBy("i", "j").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in digits])
    squares = {(r.i, r.j): sum(int(r[c] or 0) << DIGIT_BITS * k for k, c in enumerate(digits)) for r in added.collect()}  # width * (width + 1) / 2 rows
    out = np.zeros((width, width))
    for (i, j), v in squares.items():
        both = 2 * v if i == j else v - squares[i, i] - squares[j, j]
        out[i, j] = out[j, i] = both / (2 * n**3)  # integers, rounded once
    return out


def projected(x: np.ndarray, n: int, sums: list[int], to: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Whitened coordinates of integer vectors, and the exact sum of their squared centred values."""
    d = centred(x, n, sums)
    return np.einsum("ij,jk->ik", (d / n).astype(np.float64), to), [int(v) for v in square_sums(d.T)]


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` for every row and each of the first components.

    Rows whose vector is null, or holds a null or non-finite entry, have no result; entries beyond a long count as the
    largest or least long. Vectors shorter than the longest count as having zeros behind, so an empty one is all zeros. Each
    distinct vector counts once in the fit, however many rows repeat it; repeated rows, null ids and ties are rows as any
    others. A component without variance (one distinct vector, or fewer independent dimensions than components) has a null
    ``whitened`` and is left out of ``identity_error``, which is null if there is no other; ``explained`` is then 0, or null
    where nothing varies at all. There are no more components than dimensions; without rows the result is empty.
    ``deviation`` is a decimal, null beyond 38 digits. Further columns are left out, whatever their names.
    """
    rows = coded(df, id_col, vector, scale)
    fit = materialize(rows.groupBy("x").agg(F.max("w").alias("w")), "whiten-fit")
    width = fit.agg(F.max("w")).first()[0] or 0
    n, sums = _totals(fit, width)
    matrix = covariance(fit, n, sums) if n else np.zeros((0, 0))
    values, vectors = np.linalg.eigh(matrix) if width else (np.zeros(0), np.zeros((0, 0)))
    top = np.argsort(values)[::-1][:components]
    trace, held = float(np.trace(matrix)), values[top] > NO_VARIANCE * np.trace(matrix)
    to = np.where(held, vectors[:, top], 0.0) / np.sqrt(np.where(held, values[top], 1.0))
    names = [f"w{k}" for k in range(len(top))]
    plain = T.StructType([T.StructField(c, T.DoubleType()) for c in names])

    def run_fit(batches):
        out = to_arrow_schema(plain)
        for batch in batches:
            w, _ = projected(unpacked(batch.column(0).to_pylist(), width), n, sums, to)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in range(w.shape[1])], schema=out)

    error = None
    if held.any():
        used = [c for c, ok in zip(names, held) if ok]
        pairs = [(a, b) for i, a in enumerate(used) for b in used[i:]]
        found = fit.select("x").mapInArrow(run_fit, plain).agg(*[F.covar_pop(a, b).alias(f"{a}{b}") for a, b in pairs]).first()
        error = max(abs(found[f"{a}{b}"] - (a == b)) for a, b in pairs)

    schema = T.StructType([rows.schema["_id"], T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("ws", T.ArrayType(T.DoubleType()))])

    def run(batches):
        out = to_arrow_schema(schema)
        for batch in batches:
            w, squares = projected(unpacked(batch.column(1).to_pylist(), width), n, sums, to)
            items = pa.array(np.where(np.isfinite(w), w, 0.0).ravel(), mask=np.tile(~held, len(w)))
            starts = pa.array(np.arange(len(w) + 1) * len(top), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Decimal(v) if v < 10**38 else None for v in squares], pa.decimal128(38, 0)), pa.ListArray.from_arrays(starts, items)], schema=out)

    share = [float(v / trace) if ok else 0.0 if trace > 0 else None for v, ok in zip(values[top], held)]
    shares: Column = F.array(*[F.lit(s).cast("double") for s in share]) if share else F.array().cast("array<double>")
    each = rows.mapInArrow(run, schema).select("_id", "deviation", F.posexplode("ws").alias("k", "whitened"))
    return each.select(
        F.col("_id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op11(embeddings: DataFrame) -> DataFrame:
    """The query's digest: ``deviation`` as a long, null beyond it."""
    return whiten(embeddings).withColumn("deviation", F.col("deviation").try_cast("long"))
