"""Token files: ids of documents in ascending id order, entropy-coded in segments.

A file holds the segments of one range of ids. A segment is one row: the ids and token counts of its documents and their
compressed tokens (see ``rans``). The rows go through Spark's Parquet writer, so files are committed whole, can be in any
store that Spark reaches, and a lost task is simply run again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.llm import rans
from siltstone.llm.common import BATCH_ROWS, slices
from siltstone.llm.wordtok import with_end, word_encoder
from siltstone.session import fresh_path

#: A segment closes with the document that brings it to this many tokens.
SEGMENT = 16 * rans.BLOCK
SCHEMA = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("start_in_part", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("doc_tokens", T.ArrayType(T.LongType())),
    T.StructField("symbols", T.BinaryType()), T.StructField("freqs", T.BinaryType()), T.StructField("stream", T.BinaryType()),
    T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("first_token", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("states", T.BinaryType()), T.StructField("crc32", T.LongType())]))),
])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, put ``end_id`` behind it and write token files below ``path``, in ascending id order.

    Null texts count as empty; rows with equal ids stand next to each other, by text length and hash; null ids come
    first. Every text is encoded once; a task holds one segment and the words it remembers.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.char_length("text"), F.xxhash64("text"))

    def run(batches):
        encoder, schema, part = word_encoder(tokenizer), to_arrow_schema(SCHEMA), TaskContext.get().partitionId()
        ids, doc_ids, doc_tokens, size, segment, start = [], [], [], 0, 0, 0

        def close():
            made = rans.compress(np.concatenate(ids))
            row = {"part": part, "segment": segment, "start_in_part": start, "n_tokens": size, "doc_ids": doc_ids, "doc_tokens": doc_tokens} | made
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                flat, counts = with_end(*encoder.encode(texts[a:b]), end_id)
                at = 0
                for name, count in zip(names[a:b], counts.tolist()):
                    ids.append(flat[at : at + count])
                    doc_ids.append(name)
                    doc_tokens.append(count)
                    at, size = at + count, size + count
                    if size >= SEGMENT:
                        yield close()
                        ids, doc_ids, doc_tokens, start, size, segment = [], [], [], start + size, 0, segment + 1
        if doc_ids:
            yield close()

    rows.mapInArrow(run, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32[, ids])`` for each document, decoded from the files and checked by block.

    ``start`` is the number of tokens of all documents before it; only one sum for each file reaches the driver.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, at = {}, 0
    for r in sums:
        base[r["part"]], at = at, at + r["n"]
    fields = [T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))

    def run(batches):
        out = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                ids = rans.decompress(row["symbols"], row["freqs"], row["stream"], row["blocks"])
                counts = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(counts)
                parts = [ids[e - c : e] for e, c in zip(ends, counts)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(base[row["part"]] + row["start_in_part"] + ends - counts), pa.array(counts), pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                table = pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)
                yield from table.to_batches()

    return files.mapInArrow(run, schema)


def op1(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = fresh_path(docs.sparkSession, "token-files")
    write(docs, path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read(docs.sparkSession, path, with_ids=False)
