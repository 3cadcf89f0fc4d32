import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from siltstone.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n int, component string, x int"


def whole(c):
    return max(-(1 << 63), min((1 << 63) - 1, math.floor(Fraction(c) * 256)))


def brute(rows):
    """rows: (id, vector). By the definition, in fractions: integer rows, fit list, sums, covariance."""
    kept = [(i, [whole(c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    kept = [(i, tuple(v + [0] * (width - len(v)))) for i, v in kept]
    fit = sorted({v for _, v in kept})
    n, sums = len(fit), [sum(v[j] for v in fit) for j in range(width)]
    cov = np.array([[float(sum(Fraction(n * v[a] - sums[a], n) * Fraction(n * v[b] - sums[b], n) for v in fit) / n) for b in range(width)] for a in range(width)]).reshape(width, width)
    return kept, fit, n, sums, cov


def check(spark, rows, close=1e-9):
    df = spark.createDataFrame([(i, v, 7, "c", 1) for i, v in rows], SCHEMA)
    got = whitening.whiten(df).collect()
    kept, fit, n, sums, cov = brute(rows)
    width = len(sums)
    deviations = Counter()
    for i, v in kept:
        for k in range(min(4, width)):
            deviations[i, k + 1, n, sum((n * v[j] - sums[j]) ** 2 for j in range(width))] += 1
    assert Counter((r[0], r.component, r.n, int(r.deviation)) for r in got) == deviations
    if not width:
        return got
    values, vectors = np.linalg.eigh(cov)
    trace = np.trace(cov)
    for k in range(min(4, width)):
        e, u = values[-1 - k], vectors[:, -1 - k]
        mine = [r for r in got if r.component == k + 1]
        if e <= 1e-12 * trace or trace == 0:
            assert all(r.whitened is None and r.explained == (0.0 if trace else None) for r in mine)
            continue
        assert all(abs(r.explained - e / trace) <= 1e-4 * e / trace for r in mine)
        by_id = {}
        for i, v in kept:
            by_id.setdefault(i, []).append(float(sum((Fraction(n * v[j] - sums[j], n) * Fraction(float(u[j])) for j in range(width)), Fraction(0))) / math.sqrt(e))
        want, have = {i: sorted(x) for i, x in by_id.items()}, {}
        for r in mine:
            have.setdefault(r[0], []).append(r.whitened)
        flipped = {i: sorted(-y for y in x) for i, x in have.items()}
        have = {i: sorted(x) for i, x in have.items()}
        far = lambda a: max(abs(p - q) for i in want for p, q in zip(a[i], want[i]))
        assert min(far(have), far(flipped)) < close
    if trace > 0:
        assert all(r.identity_error is not None and r.identity_error < 1e-6 for r in got)
    return got


def made(n, width, seed=1, shift=0.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width)) * np.linspace(2, 0.3, width) + rng.normal(size=(n, 1)) * np.linspace(0, 1, width) + shift
    return [(i, v.tolist()) for i, v in enumerate(base)]


def test_matches_fractions(spark):
    check(spark, made(300, 6))


def test_mean_far_from_zero_loses_nothing(spark):
    check(spark, made(200, 5, shift=3e9), close=1e-6)  # squares of three limbs


def test_values_beyond_a_long(spark):
    rows = [(i, [1e300 * (i % 3 - 1), 2.0**62 * i, -1e25 * (i % 2), i * 1.0]) for i in range(9)]
    df = spark.createDataFrame([(i, v, 7, "c", 1) for i, v in rows], SCHEMA)
    kept, fit, n, sums, cov = brute(rows)
    got = whitening.whiten(df).collect()
    exact = {i: sum((n * v[j] - sums[j]) ** 2 for j in range(4)) for i, v in kept}
    assert all((None if r.deviation is None else int(r.deviation)) == (exact[r.vec_id] if exact[r.vec_id] < 10**38 else None) for r in got)
    assert np.allclose(sorted({r.explained for r in got}), sorted(np.linalg.eigvalsh(cov)[::-1][:4] / np.trace(cov)), rtol=1e-4, atol=1e-12)


def test_covariance_is_exact_to_the_last_bit(spark):
    rows = made(120, 4, seed=5, shift=1e6)
    kept, fit, n, sums, cov = brute(rows)
    x = spark.createDataFrame([(bytearray(whitening.packed(np.array(v, np.int64))),) for v in fit], "x binary").repartition(7)
    assert (whitening.covariance(x, n, sums) == cov).all()


@pytest.mark.parametrize("top", [1, 1 << 20, 1 << 31, 1 << 45, (1 << 61) + 12345])
def test_square_sums(top):
    rng = np.random.default_rng(top & 0xFFFF)
    p = rng.integers(-top, top + 1, size=(500, 3))
    assert [int(v) for v in whitening.square_sums(p)] == [sum(int(v) ** 2 for v in p[:, j]) for j in range(3)]
    assert [int(v) for v in whitening.square_sums(p.astype(object))] == [sum(int(v) ** 2 for v in p[:, j]) for j in range(3)]


@pytest.mark.parametrize("v", [[], [0, 0], [1, -128, 0], [127, 128], [-(1 << 31), 0, 5], [(1 << 63) - 1, -(1 << 63)], [0, 0, -129, 0, 0]])
def test_packed_form_is_one_for_one(v):
    v = np.array(v, np.int64)
    code = whitening.packed(v)
    assert whitening.unpacked([code], len(v) + 2)[0].tolist() == v.tolist() + [0, 0]
    assert code == whitening.packed(np.r_[v, [0, 0, 0]].astype(np.int64))


@pytest.mark.parametrize("rows", [
    [],
    [(1, None), (2, [1.0, None]), (3, [math.nan, 1.0]), (4, [math.inf])],
    [(1, [0.5, 0.25])],
    [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25])],
    [(1, []), (2, [])],
    [(None, [1.0, 2.0, 3.0]), (None, [1.5, 2.0]), (3, []), (3, [0.0]), (4, [1.0, 2.0, None]), (5, [-0.001, 0.0, 8.0, 1.0, 1.0]), (5, [7.0, 1.0, 8.0, 1.0, 1.0])],
])
def test_odd_rows(spark, rows):
    got = check(spark, rows)
    assert len(got) == len(brute(rows)[0]) * min(4, len(brute(rows)[3]))


def test_query_over_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = whitening.op11(rows).collect()
    vectors = {r.vec_id: r.embedding for r in rows.collect()}
    x = np.array([[whole(c) for c in v] for v in vectors.values()], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    d = n * x - sums
    assert {(r.vec_id, r.n, r.deviation) for r in got} == {(i, n, int(v)) for i, v in zip(vectors, (d * d).sum(axis=1))}
    assert max(r.identity_error for r in got) < 1e-8 and len(got) == 4 * len(vectors)
