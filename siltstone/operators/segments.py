"""A stored BM25 index that grows: segments of postings in blocks of documents, merged by tiers, read by block maxima.

A segment holds the documents of one batch. They are sorted by length and cut into blocks of a few dozen, and a row of postings is
one term in one block: ids, frequencies and lengths as arrays, beside the largest frequency and the smallest length, which bound
what the term can add to any document of the block whatever the mean length becomes. All rows of a block are in one file, sorted by
a hash of the term, so building moves whole documents only, and a term that stands everywhere spreads over all files. The documents
are kept with their counted terms too, a row a block, from which segments are merged. A question first adds up the bounds of its terms by block, from columns that
leave the arrays unread; the blocks with the largest sums are scored in full, which gives a score that the rest has to reach, and of
the other blocks only those whose bound reaches it are scored. The result is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltstone.operators import search
from siltstone.session import drop_path, fresh_path, materialize

#: Documents of a block, parts that terms are dealt to by hash (a power of 2), segments of one tier that are merged into one of the next.
BLOCK, PARTS, TIER = 64, 32, 4
#: Rows of blocks to score, each of up to 64 questions, that may go to all tasks.
MARKS = 1_000_000

DOCS = "block long, ids array<long>, dls array<long>, sizes array<long>, terms string, tfs binary"
ROWS = "term string, block long, n int, tf_max long, dl_min long, ids array<long>, tfs array<long>, dls array<long>"
POSTINGS = f"{ROWS}, part int"
STATS = "number int, tier int, n_docs long, tokens long, replaces array<int>"
LONGS = pa.list_(pa.int64())
DOCS_ARROW = pa.schema([("block", pa.int64()), ("ids", LONGS), ("dls", LONGS), ("sizes", LONGS), ("terms", pa.string()), ("tfs", pa.binary())])
ROWS_ARROW = pa.schema([("term", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("tf_max", pa.int64()), ("dl_min", pa.int64()), ("ids", LONGS), ("tfs", LONGS), ("dls", LONGS)])


def part_of(term: str = "term") -> Column:
    """The first bits of the hash by which rows are sorted."""
    return (F.shiftright(F.xxhash64(term), 64 - (PARTS - 1).bit_length()) + PARTS // 2).cast("int").alias("part")


def impact(tf: Column, dl: Column) -> Column:
    """What a term of weight 1 adds to a score; grows with ``tf``, falls with ``dl``."""
    return tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * dl / F.col("avgdl")))


def packed(docs: DataFrame) -> DataFrame:
    """Rows as in DOCS from ``(id, dl, terms, tfs, block)``, which come block by block in each partition."""
    size, out = search.SLICE, DOCS_ARROW

    def rows_of(some: pa.Table) -> pa.RecordBatch:
        some = some.combine_chunks()
        column = {c: some[c].combine_chunks() for c in some.column_names}
        blocks = column["block"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
        ends = pa.array(np.append(starts, len(blocks)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, c) for c in (column["id"], column["dl"], pc.cast(pc.divide(pc.binary_length(column["tfs"]), 4), pa.int64()))]
        joined = [pc.binary_join(pa.ListArray.from_arrays(ends, column[c].cast(kind)), sep) for c, kind, sep in (("terms", pa.string(), " "), ("tfs", pa.binary(), b""))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([pa.array(blocks[starts]), *lists, *joined], out)], schema=out)

    def run(batches):
        rest = None  # the last block may go on in the next batch
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                some = pa.Table.from_batches([batch.slice(at, size)])
                some = some if rest is None else pa.concat_tables([rest, some])
                blocks = some["block"].to_numpy()
                last = int(np.searchsorted(blocks, blocks[-1]))
                rest = some.slice(last)
                if last:
                    yield rows_of(some.slice(0, last))
        if rest is not None:
            yield rows_of(rest)

    return docs.select("id", "dl", "terms", "tfs", "block").mapInArrow(run, DOCS)


def unpacked(docs: DataFrame, block: int) -> DataFrame:
    """``(id, dl, terms, tfs)`` from rows as in DOCS."""
    size = max(1, search.SLICE // block)
    schema, out = "id long, dl long, terms string, tfs binary", pa.schema([("id", pa.int64()), ("dl", pa.int64()), ("terms", pa.string()), ("tfs", pa.binary())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size)
                column = {c: some.column(c) for c in some.schema.names}
                ids, dls, sizes = (pc.list_flatten(column[c]) for c in ("ids", "dls", "sizes"))
                ends = np.concatenate([[0], np.cumsum(sizes.to_numpy())])
                terms = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.list_flatten(pc.split_pattern(column["terms"], " "))), " ")
                tfs = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(b"".join(column["tfs"].to_pylist()))])
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([ids, dls, terms, tfs], out)], schema=out)

    return docs.select("ids", "dls", "sizes", "terms", "tfs").mapInArrow(run, schema)


def inverted(docs: DataFrame, block: int) -> DataFrame:
    """Rows as in ROWS from rows as in DOCS, of which one is a whole block."""
    size, out = max(1, search.SLICE // block), ROWS_ARROW

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size)
                column = {c: some.column(c) for c in some.schema.names}
                of = np.repeat(np.arange(len(pc.list_flatten(column["ids"]))), pc.list_flatten(column["sizes"]).to_numpy())
                where = {c: pc.list_flatten(column[c]).take(pa.array(of)) for c in ("ids", "dls")}
                words = pc.split_pattern(column["terms"], " ")
                tfs = pa.array(np.frombuffer(b"".join(column["tfs"].to_pylist()), np.int32).astype(np.int64))
                flat = pa.table({"block": column["block"].take(pc.list_parent_indices(words)), "term": pc.list_flatten(words), "id": where["ids"], "tf": tfs, "dl": where["dls"]})
                known = flat.group_by(["block", "term"], use_threads=False).aggregate([([], "count_all"), ("tf", "max"), ("dl", "min"), ("id", "list"), ("tf", "list"), ("dl", "list")])
                columns = known.select(["term", "block", "count_all", "tf_max", "dl_min", "id_list", "tf_list", "dl_list"]).columns
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks).cast(f.type) for c, f in zip(columns, out)], schema=out)

    return docs.mapInArrow(run, ROWS)


@dataclass(frozen=True)
class Segment:
    number: int
    tier: int
    n_docs: int
    tokens: int
    replaces: tuple[int, ...]


class Segments:
    """The index below ``path``; ids are whole numbers, unique and not null over all batches.

    A segment counts once its row of statistics is written, which comes last, and a merged one names those it replaces. So a job
    that stops anywhere leaves either the old segments or the new one, and what it left half done is written over.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, block: int = BLOCK, tier: int = TIER):
        self.spark, self.path, self.block, self.tier = spark, path or fresh_path(spark, "segments"), block, tier

    def _folder(self, number: int, name: str) -> str:
        return f"{self.path}/{name}/segment={number}"

    def _numbers(self) -> list[int]:
        base = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/stats")
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
        return sorted(int(n.removeprefix("segment=")) for n in names if n.startswith("segment="))

    def _complete(self) -> list[Segment]:
        path_of = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path_of(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        whole = [self._folder(n, "stats") for n in self._numbers() if fs.exists(path_of(f"{self._folder(n, 'stats')}/_SUCCESS"))]
        rows = self.spark.read.schema(STATS).option("basePath", f"{self.path}/stats").parquet(*whole).collect() if whole else []
        return sorted((Segment(r.number, r.tier, r.n_docs, r.tokens, tuple(r.replaces)) for r in rows), key=lambda s: s.number)

    def segments(self) -> list[Segment]:
        """The complete segments that no other one replaces, a row each; as many as the tiers can hold."""
        found = self._complete()
        gone = {n for s in found for n in s.replaces}
        return [s for s in found if s.number not in gone]

    def _clean(self) -> None:
        """Delete replaced segments; statistics last, so one that is half deleted is still known as replaced."""
        found = self._complete()
        for number in {s.number for s in found} & {n for s in found for n in s.replaces}:
            for name in ("postings", "terms", "docs", "stats"):
                drop_path(self.spark, self._folder(number, name))

    def add(self, docs: DataFrame, id_col: str, text_col: str = "text") -> None:
        """Index a batch as a segment of its own, then merge tiers that are full. An empty batch adds nothing."""
        self._clean()
        path = fresh_path(self.spark, "segment-words")
        rows = materialize(search.counted(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", packed=True), "segment-words", path)
        n_docs = rows.count()
        if n_docs:
            self._write(rows, n_docs, 0, ())
        drop_path(self.spark, path)
        while self._merge():
            self._clean()

    def _write(self, rows: DataFrame, n_docs: int, tier: int, replaces: tuple[int, ...]) -> None:
        """``rows`` are ``(id, dl, terms, tfs)``, written before and read twice; of texts without tokens nothing is kept but their number."""
        number = max((s.number for s in self._complete()), default=-1) + 1
        # ids are unique, so the order in a partition is fixed and a task that runs again numbers as before
        placed = rows.where("dl > 0").repartitionByRange("dl", "id").sortWithinPartitions("dl", "id").withColumn("at", F.monotonically_increasing_id())
        # above 33 bits the number names the partition, and a block never spans two: 20 bits of segments, 18 of partitions, 25 of blocks
        place = F.shiftleft(F.shiftright("at", 33), 25) + F.floor(F.col("at") % (1 << 33) / self.block)
        block = (F.lit(number << 43) + place).cast("long")
        packed(placed.withColumn("block", block)).write.mode("overwrite").parquet(self._folder(number, "docs"))
        known = self._docs([number])
        rows = inverted(known.repartition("block"), self.block).withColumn("part", part_of())  # dealt anew, as long documents stand together
        rows.sortWithinPartitions(F.xxhash64("term")).write.mode("overwrite").parquet(self._folder(number, "postings"))
        self._postings([number]).groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(self._folder(number, "terms"))
        tokens = known.agg(F.coalesce(F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("tokens"))
        row = tokens.select(F.lit(number).alias("number"), F.lit(tier).alias("tier"), F.lit(n_docs).cast("long").alias("n_docs"), "tokens", F.array(*map(F.lit, replaces)).cast("array<int>").alias("replaces"))
        row.write.mode("overwrite").parquet(self._folder(number, "stats"))

    def _merge(self) -> bool:
        """Merge the segments of the lowest full tier; whether there was one. Each posting is rewritten once a tier."""
        tiers: dict[int, list[Segment]] = {}
        for s in self.segments():
            tiers.setdefault(s.tier, []).append(s)
        full = [t for t, some in sorted(tiers.items()) if len(some) >= self.tier]
        if not full:
            return False
        some = tiers[full[0]]
        self._write(unpacked(self._docs([s.number for s in some]), self.block), sum(s.n_docs for s in some), full[0] + 1, tuple(s.number for s in some))
        return True

    def _docs(self, numbers: list[int]) -> DataFrame:
        return self.spark.read.schema(DOCS).option("basePath", f"{self.path}/docs").parquet(*[self._folder(n, "docs") for n in numbers])

    def _postings(self, numbers: list[int]) -> DataFrame:
        return self.spark.read.schema(POSTINGS).option("basePath", f"{self.path}/postings").parquet(*[self._folder(n, "postings") for n in numbers])

    def weighed(self, queries: DataFrame, query_id: str, query_text: str = "text") -> DataFrame:
        """``(query, term, w, avgdl, part, word, bit)`` of the questions' terms that the index has, with weights over all segments; written.

        ``word`` names up to 64 questions, of which ``bit`` is one.
        """
        known = self.segments()
        n_docs, tokens = sum(s.n_docs for s in known), sum(s.tokens for s in known)
        terms = self.spark.read.schema("term string, df long").parquet(*[self._folder(s.number, "terms") for s in known])
        df = terms.groupBy("term").agg(F.sum("df").alias("df"))
        stats = self.spark.range(1).select(F.lit(n_docs).cast("long").alias("n_docs"), F.lit(tokens / n_docs).alias("avgdl"))
        asked = queries.select(query_id, F.explode(search.tx.tokens(F.col(query_text))).alias("term")).groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qtf"))
        weight = asked.join(search.inverse_frequency(df, stats), "term").select(query_id, "term", (F.col("qtf") * F.col("idf")).alias("w"), "avgdl", part_of())
        numbers = materialize(queries.select(query_id).distinct().withColumn("at", F.monotonically_increasing_id()), "segment-questions")
        word, bit = F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, int(at & 63))").alias("bit")
        return materialize(weight.join(numbers, query_id).select(query_id, "term", "w", "avgdl", "part", word, bit), "segment-weights")

    def top_k(self, queries: DataFrame, k: int, query_id: str, doc_id: str, query_text: str = "text", digits: int = 6) -> DataFrame:
        """``(query, doc, score, rank)``, the same as ``search.bm25`` over all documents that were added."""
        return self.searched(queries, k, query_id, doc_id, query_text, digits)[0]

    def searched(self, queries: DataFrame, k: int, query_id: str, doc_id: str, query_text: str = "text", digits: int = 6) -> tuple[DataFrame, DataFrame]:
        """What ``top_k`` gives, and ``(query, block, hits, scored)``: postings of a question's terms in a block, and whether they were scored."""
        known = self.segments()
        if not known:
            kept = queries.select(query_id).limit(0)
            return kept.withColumns({doc_id: F.lit(0).cast("long"), "score": F.lit(0.0), "rank": F.lit(0)}), kept.withColumns({"block": F.lit(0).cast("long"), "hits": F.lit(0).cast("long"), "scored": F.lit(True)})
        weights = self.weighed(queries, query_id, query_text)
        parts = [r.part for r in weights.select("part").distinct().collect()]  # PARTS rows at most
        rows = self._postings([s.number for s in known]).where(F.col("part").isin(parts)).drop("part")
        weights = weights.drop("part")
        bound = F.greatest(F.col("w"), F.lit(0.0)) * impact(F.col("tf_max"), F.col("dl_min"))  # a term of negative weight may be absent
        sums = rows.select("term", "block", "n", "tf_max", "dl_min").join(weights, "term").groupBy(query_id, "word", "bit", "block").agg(F.sum(bound).alias("bound"), F.sum("n").alias("hits"))
        live = materialize(sums, "segment-bounds")
        # every such block has a document with one of the terms, so k blocks give k scores
        first = materialize(search.ranked(live.withColumnRenamed("bound", "score"), query_id, "block", k).select(query_id, "word", "bit", "block"), "segment-first")

        def scored(blocks: DataFrame) -> DataFrame:
            # 64 questions a row, so that what says which blocks are wanted is small beside the postings
            wanted = materialize(blocks.groupBy("block", "word").agg(F.bit_or("bit").alias("bits")), "segment-wanted")
            wanted = F.broadcast(wanted) if wanted.count() <= MARKS else wanted
            some = rows.join(wanted.select("block").distinct(), "block", "left_semi")
            met = some.join(weights, "term").join(wanted, ["block", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
            hits = met.select(query_id, "w", "avgdl", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
            total = F.sum(F.col("w") * impact(F.col("p.tfs"), F.col("p.dls")))
            all_scores = hits.groupBy(query_id, F.col("p.ids").alias(doc_id)).agg(F.round(total, digits).alias("score"))
            return search.ranked(all_scores, query_id, doc_id, k).drop("rank")

        best = materialize(scored(first), "segment-scores")
        least = best.groupBy(query_id).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found")).where(F.col("found") == k)
        far = live.join(first.select(query_id, "block").withColumn("first", F.lit(True)), [query_id, "block"], "left").join(least, query_id, "left")
        reach = F.col("least").isNull() | (F.col("bound") + 10.0**-digits >= F.col("least"))  # both scores and sums are rounded
        told = far.select(query_id, "word", "bit", "block", "hits", F.col("first").isNotNull().alias("early"), (F.col("first").isNotNull() | reach).alias("scored"))
        late = scored(told.where("scored and not early"))
        return search.ranked(best.unionByName(late), query_id, doc_id, k), told.drop("word", "bit", "early")
