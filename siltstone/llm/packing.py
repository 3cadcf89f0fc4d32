"""Bulk-synchronous best-fit packing of token pieces into sequences of a fixed length.

Unplaced pieces and gaps (open sequences with room) are two Spark tables. In a round both are range-sorted together by size,
and every range is swept from the largest size down: a piece takes its successor, the smallest gap that holds it, and the
gap, updated, goes on in the same sweep where it can still serve. Pieces that found no gap in their range look for one in
the ranges above: the driver matches the ranges' counts of such pieces and gaps like brackets, and rank decides which piece
gets which gap, so no two get the same. Of the pieces without a gap the largest open sequences, as many as are needed for
pieces that no gap is wide enough for and for tokens beyond the room of all gaps. The updated gaps are written, and the round repeats. Only bounds and counts of ranges reach the driver.

Rounds are few, as a gap takes many pieces in one sweep: a gap stands in the order at the length of the piece it last took,
so that it meets the next ones in the same range. When what is left fits one task, or after ROUNDS, sweeps open sequences
themselves, which ends the packing.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.llm.common import map_texts
from siltstone.llm.wordtok import with_end, word_encoder
from siltstone.session import materialize

SIZE = 2048
#: Rounds after which every range opens sequences by itself; rows of the last sweep, in one task.
ROUNDS, LAST = 16, 10_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: tokens of each document with ``end_id``; only longer ones than ``size`` are cut."""

    def make():
        encoder = word_encoder(tokenizer)

        def call(texts):
            flat, counts = with_end(*encoder.encode(texts), end_id)
            raw, at = flat.astype("<u4").tobytes(), 0
            out = {"n": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for count in counts.tolist():
                starts = range(0, count, size)
                out["n"].append(len(starts))
                out["piece"] += range(len(starts))
                out["start"] += starts
                for s in starts:
                    n = min(size, count - s)
                    out["length"].append(n)
                    out["ids_crc32"].append(zlib.crc32(raw[4 * (at + s) : 4 * (at + s + n)]))
                at += count
            return out

        return call

    long = T.LongType()
    added = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", long), T.StructField("length", long), T.StructField("ids_crc32", long)])
    return map_texts(docs, [id_col], text_col, make, added, multi="n")


def sweep(sizes: list[int], sequences: list[int | None], size: int, fresh: int | None):
    """One range from its largest size down; a row with a sequence is a gap, one without a piece.

    Returns for each piece its ``(sequence, gap before)``, or None, and the gaps left: ``(gap, sequence, smallest piece it
    took)``, those that hold every piece behind this range first, smallest first, and their number. With ``fresh`` pieces
    without a gap open sequences, numbered from there.
    """
    free: list[tuple[int, int, int]] = []  # gaps that hold every piece to come, smallest first
    small: list[tuple[int, int, int]] = []  # gaps that only hold later ones, largest first
    placed: list[tuple[int, int] | None] = []
    for n, sequence in zip(sizes, sequences):
        if sequence is not None:
            heapq.heappush(free, (n, sequence, n))
            continue
        while small and -small[0][0] >= n:
            gap, sequence, last = heapq.heappop(small)
            heapq.heappush(free, (-gap, sequence, last))
        if free:
            gap, sequence, _ = heapq.heappop(free)
        elif fresh is not None:
            gap, sequence, fresh = size, fresh, fresh + 1
        else:
            placed.append(None)
            continue
        placed.append((sequence, gap))
        if gap - n >= n:
            heapq.heappush(free, (gap - n, sequence, n))
        elif gap > n:
            heapq.heappush(small, (n - gap, sequence, n))
    return placed, sorted(free) + [(-gap, sequence, last) for gap, sequence, last in small], len(free)


def brackets(ranges: list[tuple[int, int, int]]):
    """Match pieces without a gap to gaps of the ranges above, nearest first: ``(range, pieces without, gaps left)`` from the top.

    Returns runs ``(range of pieces, first rank, number, range of gaps or -1, first rank there)`` and how many gaps of each range are taken.
    """
    runs, open_, taken = [], [], {}
    for part, pieces, gaps in ranges:
        rank = 0
        while rank < pieces and open_:
            above, first, many = open_.pop()
            n = min(many, pieces - rank)
            runs.append((part, rank, n, above, first))
            rank, taken[above] = rank + n, first + n
            if many > n:
                open_.append((above, first + n, many - n))
        if rank < pieces:
            runs.append((part, rank, pieces - rank, -1, 0))
        if gaps:
            open_.append((part, 0, gaps))
    return runs, taken


def pack(cut: DataFrame, order: list[str], size: int = SIZE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``size``; ``order`` breaks ties of length.

    Pieces with equal order columns may change places with each other. An empty table gives an empty result. Kept columns
    of the names ``sequence_id`` and ``offset`` give way.
    """
    spark, long = cut.sparkSession, T.LongType()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in cut.columns if c.lower() not in ("sequence_id", "offset")]
    facts = cut.agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("low"), F.max("length").alias("high")).first()
    if facts["n"] and not 1 <= facts["low"] <= facts["high"] <= size:
        raise ValueError(f"lengths must be 1 to {size}")
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    tie = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in order])
    # key: place in the order, largest first; equal keys are spread by a hash, so that gaps and pieces mix
    unplaced = cut.select(row, F.col("length").cast("long").alias("size"), F.col("length").cast("long").alias("key"), tie.alias("tie"), F.lit(None).cast("long").alias("sequence"))
    row_type = unplaced.schema["row"]
    swept_schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in unplaced.schema.fields), T.StructField("gap", long), T.StructField("part", long), T.StructField("rank", long)])
    done_schema = T.StructType([row_type, T.StructField("sequence_id", long), T.StructField("offset", long)])
    gaps = spark.createDataFrame([], T.StructType(swept_schema.fields[:5]))
    placed, opened, left = [], 0, facts["n"]
    for turn in range(ROUNDS + 1):
        if not left:
            break
        rows = unplaced.unionByName(gaps)
        alone = turn > 0 and rows.count() <= LAST
        last = alone or turn == ROUNDS
        parts = 1 if alone else n

        def match(batches, last=last, opened=opened):
            """Pieces that are placed have a sequence and the gap before; all others a part and a rank there, or -1 if it can't be matched yet."""
            out, part = to_arrow_schema(swept_schema), TaskContext.get().partitionId()
            table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
            if table is None:
                return
            sequences, sizes = table.column("sequence").to_pylist(), table.column("size").to_pylist()
            got, free, ready = sweep(sizes, sequences, size, opened + part * (1 << 40) if last else None)
            pieces = table.filter(pa.array([s is None for s in sequences])).combine_chunks()
            ranks, k = [], 0
            for g in got:
                ranks.append(-1 if g else k)
                k += not g
            columns = {c: pieces.column(c) for c in ("row", "size", "key", "tie")} | {
                "sequence": pa.array([g and g[0] for g in got], pa.int64()), "gap": pa.array([g and g[1] for g in got], pa.int64()),
                "part": pa.array([part] * len(got), pa.int64()), "rank": pa.array(ranks, pa.int64()),
            }
            yield from pa.table([columns[f.name] for f in out], schema=out).to_batches(1 << 16)
            if not last:
                nothing = pa.nulls(len(free), out.field("row").type)
                gap = [x[0] for x in free]
                columns = {
                    "row": nothing, "size": pa.array(gap, pa.int64()), "key": pa.array([min(x[0], x[2]) for x in free], pa.int64()), "tie": pa.array([hash((x[1], 7)) for x in free], pa.int64()),
                    "sequence": pa.array([x[1] for x in free], pa.int64()), "gap": pa.nulls(len(free), pa.int64()), "part": pa.array([part] * len(free), pa.int64()), "rank": pa.array([i if i < ready else -1 for i in range(len(free))], pa.int64()),
                }
                yield from pa.table([columns[f.name] for f in out], schema=out).to_batches(1 << 16)

        dealt = rows.repartitionByRange(parts, F.desc("key"), "tie").sortWithinPartitions(F.desc("key"), "tie")
        swept = materialize(dealt.mapInArrow(match, swept_schema), "pack-swept")
        is_piece, done = F.isnotnull("row"), F.isnotnull("gap")
        placed.append(swept.where(is_piece & done).select("row", F.col("sequence").alias("sequence_id"), (F.lit(size) - F.col("gap")).alias("offset")))
        if last:
            break
        waiting = is_piece & ~done
        counts = swept.groupBy("part").agg(
            F.count(F.when(waiting, 1)).alias("pieces"), F.count(F.when(~is_piece & (F.col("rank") >= 0), 1)).alias("gaps"), F.sum(F.when(waiting, F.col("size"))).alias("tokens"),
            F.min(F.when(waiting, F.col("size"))).alias("least"), F.sum(F.when(~is_piece, F.col("size"))).alias("room"), F.max(F.when(~is_piece, F.col("size"))).alias("widest"),
        ).orderBy("part").collect()
        before, left = left, sum(r["pieces"] for r in counts)
        if not left:
            break
        runs, taken = brackets([(r["part"], r["pieces"], r["gaps"]) for r in counts])
        without = [r for r in runs if r[3] < 0]
        homeless = sum(r[2] for r in without)
        # sequences to open: for pieces wider than every gap, for tokens beyond the room of all gaps, and one where nothing moves
        widest, room, tokens = max(r["widest"] or 0 for r in counts), sum(r["room"] or 0 for r in counts), sum(r["tokens"] or 0 for r in counts)
        over = swept.where(waiting & (F.col("size") > widest)).agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.when(F.col("size") * 2 > size, 1))).first()
        opening = min(homeless, max(-(-over[0] // size), over[1], -(-(tokens - room) // size), int(homeless == left == before)))
        numbered, k = {}, 0
        for r in without:
            numbered[r[:2]] = k
            k += r[2]
        table = np.array([(p, a, m, q, b, numbered.get((p, a), -1)) for p, a, m, q, b in runs], np.int64).reshape(-1, 6)
        used = np.zeros(parts + 1, np.int64)
        for part, m in taken.items():
            used[part] = m
        width = max(left, 1) + 1
        told_schema = T.StructType([*swept_schema.fields, T.StructField("to_part", long), T.StructField("to_rank", long)])

        def tell(batches, table=table, used=used, width=width, opening=opening, opened=opened):
            """Where waiting pieces find their gap: its part and rank; the sequence they open has part -1; pieces that wait on and gaps that stay have part -2."""
            out, keys = to_arrow_schema(told_schema), table[:, 0] * width + table[:, 1]
            for batch in batches:
                if not batch.num_rows:
                    continue
                piece = ~np.array(batch.column("row").is_null())
                part, rank = (batch.column(c).to_numpy() for c in ("part", "rank"))
                to_part, to_rank = np.full(len(part), -2), np.full(len(part), -1)
                at = np.flatnonzero(piece)
                run = table[np.searchsorted(keys, part[at] * width + rank[at], side="right") - 1]
                k = rank[at] - run[:, 1]
                to_part[at] = np.where(run[:, 3] >= 0, run[:, 3], np.where(run[:, 5] + k < opening, -1, -2))
                to_rank[at] = np.where(run[:, 3] >= 0, run[:, 4] + k, opened + run[:, 5] + k)
                at = np.flatnonzero(~piece & (rank >= 0))
                mine = rank[at] < used[part[at]]
                to_part[at], to_rank[at] = np.where(mine, part[at], -2), rank[at]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to_part), pa.array(to_rank)], schema=out)

        told = swept.where(~(is_piece & done)).mapInArrow(tell, told_schema)
        plain = [f.name for f in unplaced.schema.fields]
        told = materialize(told.select(*plain, "to_part", "to_rank"), "pack-told")
        matched = F.col("to_part") >= 0
        holes = told.where(~is_piece & matched).select("to_part", "to_rank", F.col("sequence").alias("into"), F.col("size").alias("gap"))
        fits = told.where(is_piece & matched).select("row", "size", "tie", "to_part", "to_rank").join(holes, ["to_part", "to_rank"])
        starts = told.where(is_piece & (F.col("to_part") == -1)).select("row", "size", "tie", F.col("to_rank").alias("into"), F.lit(size).cast("long").alias("gap"))
        new = materialize(fits.select("row", "size", "tie", "into", "gap").unionByName(starts), "pack-placed")
        placed.append(new.select("row", F.col("into").alias("sequence_id"), (F.lit(size) - F.col("gap")).alias("offset")))
        rest = F.col("gap") - F.col("size")
        updated = new.select(F.lit(None).cast(row_type.dataType).alias("row"), rest.alias("size"), F.least(rest, "size").alias("key"), "tie", F.col("into").alias("sequence"))
        stay = told.where(F.col("to_part") == -2).select(*plain)
        least = min(r["least"] for r in counts if r["pieces"])
        gaps = stay.where(F.isnull("row")).unionByName(updated).where(F.col("size") >= least)  # others are full
        unplaced = stay.where(F.isnotnull("row"))
        opened, left = opened + opening, left - sum(r[2] for r in runs if r[3] >= 0) - opening
    out = placed[0] if placed else spark.createDataFrame([], done_schema)
    for more in placed[1:]:
        out = out.unionByName(more)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "sequence_id", "offset") if placed else cut.select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def best_fit(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Pack all documents: ``(id, piece, start, length, ids_crc32, sequence_id, offset)`` for each piece.

    A null or empty text is its end id alone. Repeated rows are packed as often as they stand there; a null id is an id.
    """
    return pack(materialize(pieces(docs, tokenizer, end_id, id_col, text_col, size), "pack-pieces"), [id_col, "piece"], size)


def op9(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return best_fit(docs.select(F.col("doc_id"), "text"), public_tokenizers.path("word_bpe_49k.json"), 0)
