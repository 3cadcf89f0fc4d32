"""Two large tables compared by digests of key ranges; only ranges whose digests differ are opened, down to their rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.operators import reconcile

#: Parts that a range is cut into on each level, ranges that are followed further, and keys of a range that is not cut any more.
FAN, MOST, LEAF = 64, 512, 16


@dataclass
class Narrowed:
    """What of both sides has to be looked at, the rows of each side in all, and how many digests were compared."""

    source: DataFrame
    target: DataFrame
    source_rows: int
    target_rows: int
    ranges: list[tuple[int, int]]
    compared: int


def within(key: str, ranges: list[tuple[int, int]]) -> Column:
    """Keys from the start of a range to below its end; plain comparisons, which reach the scan. Null keys are always within."""
    tests = [(F.col(key) >= a) & (F.col(key) < b) for a, b in ranges]
    return reduce(lambda x, y: x | y, tests, F.col(key).isNull())


def digests(df: DataFrame, key: str, width: int, name: str) -> DataFrame:
    """``(at, n, s, x)`` of each step of ``width`` keys: rows, and two sums of row hashes that do not depend on order. Aggregated before it moves."""
    rest = sorted(c for c in df.columns if c != key)
    rows = df.select(F.floor(F.col(key) / width).alias("at"), F.xxhash64(F.col(key), *rest).alias("h"), F.xxhash64(F.lit(1), F.col(key), *rest).alias("g"))
    return rows.groupBy("at").agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("g").alias("x")).alias(name))


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def narrow(source: DataFrame, target: DataFrame, key: str, fan: int = FAN, most: int = MOST, leaf: int = LEAF) -> Narrowed:
    """Find the key ranges in which two tables with the same columns differ; ``key`` is a whole number and need not be unique.

    The first level reads both tables once and moves ``fan`` digests; each further one reads the ranges that differed before
    (a filter on the key, so files and row groups without them are skipped) and cuts them by ``fan`` again. Cutting ends at
    ``leaf`` keys, or where more than ``most`` ranges differ, when going on would not spare much; so what reaches the driver
    is bounded. Equal digests are taken for equal rows: they hold the count and 128 bits of row hashes. Rows with a null key are
    always opened.
    """
    if sorted(source.columns) != sorted(target.columns):
        raise ValueError("both tables need the same columns; see schema_diff")
    target = target.select(*source.columns)
    ends = [df.agg(F.min(key).alias("a"), F.max(key).alias("b"), F.count(F.lit(1)).alias("n")).first() for df in (source, target)]
    keys = [e[c] for e in ends for c in "ab" if e[c] is not None]
    ranges, compared = [(min(keys), max(keys) + 1)] if keys else [], 0
    width = ranges[0][1] - ranges[0][0] if keys else 0
    while ranges and width > leaf:
        width = max(leaf, -(-width // fan))
        sides = [digests(df.where(within(key, ranges) & F.col(key).isNotNull()), key, width, n) for df, n in ((source, "a"), (target, "b"))]
        both = sides[0].join(sides[1], "at", "full")
        row = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("d")).first()
        compared += row["n"]
        if row["d"] > most:
            break
        found = both.where(~F.col("a").eqNullSafe(F.col("b"))).select("at").collect()  # ``most`` at most
        low, high = min(a for a, _ in ranges), max(b for _, b in ranges)
        ranges = joined([(max(low, r["at"] * width), min(high, (r["at"] + 1) * width)) for r in found])
    open_ = [df.where(within(key, ranges)) for df in (source, target)]
    return Narrowed(*open_, ends[0]["n"], ends[1]["n"], ranges, compared)


def except_diff(target: DataFrame, source: DataFrame, key: str, order: list[str], limit: int = 100) -> DataFrame:
    """As ``reconcile.except_diff``, but only ranges that differ are compared row by row."""
    found = narrow(source, target, key)
    return reconcile.except_diff(found.target, found.source, order, limit)


def difference(source: DataFrame, target: DataFrame, key: str, tolerance: float = 0.05) -> DataFrame:
    """As ``reconcile.difference`` for a unique key, but only ranges that differ are joined."""
    found = narrow(source, target, key)
    row = reconcile.difference(found.source, found.target.select(*found.source.columns), key, tolerance)
    delta = abs(found.source_rows - found.target_rows) / max(found.source_rows, 1)
    return row.withColumns({
        "source_rows": F.lit(found.source_rows).cast("long"), "target_rows": F.lit(found.target_rows).cast("long"), "row_delta": F.round(F.lit(float(delta)), 6), "within": F.lit(delta < tolerance),
    })
