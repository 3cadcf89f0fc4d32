"""Exact line dedup across documents: range-partitioned hashes, first occurrences streamed, bitmaps in place of texts.

Every line goes as 128 bits of hash with its document and position. These rows are range-partitioned and sorted by hash, document
and position, so that all places of a line stand in a row, its first document in front; one pass over a partition tells first
occurrences from later ones. A line that is everywhere is cut into many ranges like any other rows: what a partition can't tell
by itself are the places of its first line, which may have begun in the partition before. Those it passes on, with the least
document of its first and last line (two rows a partition), and they are told once the least over all partitions is known.
Only the places of dropped lines come back to the documents, one compressed bitmap each; texts are read again and never sorted.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.llm.common import limit_batches, map_texts, release
from siltstone.session import materialize

LEAST_CHARS = 10
DROPPED, OPEN, LEAST = 0, 1, 2


def line_key(line: bytes, least: int = LEAST_CHARS) -> bytes | None:
    """What makes two lines equal: ASCII blanks stripped, A-Z lower-cased; None for fewer than ``least`` code points."""
    key = line.strip().lower()  # of bytes: exactly blank, tab to carriage return, and A-Z
    if len(key) >= 4 * least or len(key) >= least and len(key.decode()) >= least:
        return key
    return None


def hashed_lines(text: str | None, least: int) -> tuple[bytes, list[int]]:
    """Hashes of the lines that count, one behind the other, and their places."""
    hashes, places = [], []
    for i, line in enumerate((text or "").encode().split(b"\n")):
        key = line_key(line, least)
        if key is not None:
            hashes.append(xxhash.xxh3_128_digest(key))
            places.append(i)
    return b"".join(hashes), places


def with_row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, _r1, _r2, _text)``: 128 bits over id and text tell rows apart; rows equal in both have the same lines anyway."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    key = lambda *salt: F.xxhash64(*salt, F.col("_id").isNull(), "_id", F.col("_text").isNull(), "_text")
    return rows.withColumns({"_r1": key(), "_r2": key(F.lit(7), F.lit("line"))})


def lines_of(rows: DataFrame, least: int) -> DataFrame:
    """``(_id, _r1, _r2, h1, h2, pos)`` of every line that counts."""
    added = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("pos", T.IntegerType())])

    def make():
        def call(texts):
            found = [hashed_lines(t, least) for t in texts]
            h = np.frombuffer(b"".join(x for x, _ in found), "<i8").reshape(-1, 2)
            return {"h1": pa.array(h[:, 0]), "h2": pa.array(h[:, 1]), "pos": [p for _, at in found for p in at], "n": [len(at) for _, at in found]}

        return call

    return map_texts(rows, ["_id", "_r1", "_r2"], "_text", make, added, multi="n")


def later_lines(lines: DataFrame) -> DataFrame:
    """``(_r1, _r2, pos)`` of each line of ``lines`` that a document with a smaller id has too."""
    order = [F.col("h1"), F.col("h2"), F.asc_nulls_last("_id"), F.col("pos"), F.col("part")]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    id_type = lines.schema["_id"].dataType
    schema = T.StructType([T.StructField("kind", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("h1", "h2")] + [T.StructField("_id", id_type)] + [T.StructField(c, T.LongType()) for c in ("_r1", "_r2")] + [T.StructField("pos", T.IntegerType())])

    def run(batches):
        out, kinds = to_arrow_schema(schema), pa.int32()
        head = key = first = None  # first key of the partition, key of the last row, first document of that key
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            ids = batch.column("_id")
            codes = pc.dictionary_encode(ids, null_encoding="encode")
            at = codes.indices.to_numpy(zero_copy_only=False)
            begins = np.ones(n, bool)
            begins[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            if key == (h1[0], h2[0]):  # goes on from the batch before
                begins[0] = False
            else:
                key = (h1[0], h2[0])
                first = ids[0]
                if head is None:
                    head, head_first = key, first
            start = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
            known = codes.dictionary.index(first).as_py() if first.is_valid else codes.dictionary.is_null().index(True).as_py()
            later = at != np.where(start < 0, known, at[start])
            at_head = (h1 == head[0]) & (h2 == head[1])
            for kind, which in ((DROPPED, later & ~at_head), (OPEN, at_head)):
                some = batch.filter(pa.array(which))
                m, none = some.num_rows, pa.nulls(some.num_rows, pa.int64())
                if m:
                    keys = [some.column("h1"), some.column("h2"), some.column("_id")] if kind == OPEN else [none, none, pa.nulls(m, ids.type)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32), kinds), *keys, some.column("_r1"), some.column("_r2"), some.column("pos")], schema=out)
            if start[-1] >= 0:
                key, first = (h1[-1], h2[-1]), ids[int(start[-1])]
        if head is not None:
            ends = [(head, head_first)] + ([(key, first)] if key != head else [])
            none = pa.nulls(len(ends), pa.int64())
            firsts = pa.array([f.as_py() for _, f in ends], out.field("_id").type)
            yield pa.RecordBatch.from_arrays([pa.array([LEAST] * len(ends), kinds), pa.array([int(k[0]) for k, _ in ends], pa.int64()), pa.array([int(k[1]) for k, _ in ends], pa.int64()), firsts, none, none, pa.nulls(len(ends), pa.int32())], schema=out)

    told = materialize(dealt.select("h1", "h2", "_id", "_r1", "_r2", "pos").mapInArrow(run, schema), "lines-later")
    # at most two rows a partition, whatever the number of lines
    owners = told.where(F.col("kind") == LEAST).groupBy("h1", "h2").agg(F.min("_id").alias("_least"))
    still_open = told.where(F.col("kind") == OPEN).join(F.broadcast(owners), ["h1", "h2"]).where(~F.col("_id").eqNullSafe(F.col("_least")))
    return told.where(F.col("kind") == DROPPED).select("_r1", "_r2", "pos").unionByName(still_open.select("_r1", "_r2", "pos"))


def to_bitmap(n_lines: int, dropped: np.ndarray) -> bytes:
    """Compressed bits of the lines, 1 for those that stay."""
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def from_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """``(id, _r1, _r2, n_lines, n_dropped, keep)``: a compressed bitmap for each distinct pair of id and text.

    A line of at least ``least`` code points, blanks at its ends and the case of A-Z aside, stays in the document with the
    smallest id that holds it, there wherever it stands, and is dropped in all others. Rows of one id are one document, those
    with a null id too, which come last. A null or empty text is one empty line, which stays. Texts count whole; one document's
    dropped places are one list. An empty table gives an empty result; further columns are left out, whatever their names.
    """
    rows = with_row_keys(docs, id_col, text_col)
    lines = materialize(lines_of(rows, least).withColumn("part", F.spark_partition_id()), "lines")
    places = later_lines(lines).groupBy("_r1", "_r2").agg(F.collect_set("pos").alias("at"))  # sets merge before they move
    counted = rows.select("_id", "_r1", "_r2", (F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1).alias("n"))
    each = counted.select("_id", "_r1", "_r2", F.coalesce("n", F.lit(1)).cast("long").alias("n_lines")).distinct().join(places, ["_r1", "_r2"], "left")
    schema = T.StructType([each.schema["_id"], *[T.StructField(c, T.LongType()) for c in ("_r1", "_r2", "n_lines", "n_dropped")], T.StructField("keep", T.BinaryType())])

    def run(batches):
        out = to_arrow_schema(schema)
        for batch in batches:
            ns, at = batch.column("n_lines").to_pylist(), batch.column("at")
            found = [np.array(x.as_py() or [], np.int64) for x in at]
            kept = [batch.column(c) for c in ("_id", "_r1", "_r2", "n_lines")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([len(x) for x in found], pa.int64()), pa.array([to_bitmap(n, x) for n, x in zip(ns, found)], pa.binary())], schema=out)
        release()

    limit_batches(docs.sparkSession)
    return each.select("_id", "_r1", "_r2", "n_lines", "at").mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def kept_text(text: str | None, n_dropped: int, n_lines: int, keep: bytes) -> str | None:
    """The lines that stay, joined; a text that loses none stays as it is, so null stays null."""
    if not n_dropped:
        return text
    return "\n".join(line for line, stays in zip(text.split("\n"), from_bitmap(keep, n_lines)) if stays)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``(id, n_lines, n_dropped, text)`` for every row of ``docs``, by the bitmaps of ``keep_bitmaps``.

    ``digest`` returns the SHA-256 of the kept text (null: empty) instead of it, so that texts do not leave the tasks.
    """
    rows = with_row_keys(docs, id_col, text_col).join(bitmaps.select("_r1", "_r2", "n_lines", "n_dropped", "keep"), ["_r1", "_r2"])
    schema = T.StructType([rows.schema["_id"], *[T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped")], T.StructField("_kept", T.StringType())])

    def run(batches):
        out = to_arrow_schema(schema)
        for batch in batches:
            kept = [kept_text(t.as_py(), d.as_py(), n.as_py(), k.as_py()) for t, d, n, k in zip(*(batch.column(c) for c in ("_text", "n_dropped", "n_lines", "keep")))]
            if digest:
                kept = [hashlib.sha256((t or "").encode()).hexdigest() for t in kept]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_id", "n_lines", "n_dropped")], pa.array(kept, pa.string())], schema=out)
        release()

    limit_batches(docs.sparkSession)
    done = rows.select("_id", "n_lines", "n_dropped", "keep", "_text").mapInArrow(run, schema)
    last: Column = F.col("_kept").alias("kept_sha256" if digest else text_col)
    return done.select(F.col("_id").alias(id_col), "n_lines", "n_dropped", last)


def op12(docs: DataFrame) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs), digest=True)
