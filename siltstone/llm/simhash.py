"""SimHash near-duplicates by multi-index hashing.

For pairs up to 3 bits fingerprints are cut into two 32-bit segments. Two fingerprints that differ in at most 3 bits agree in
one segment up to one bit, so every fingerprint asks the segment table for its own value and for the values one bit below it
(a pair that differs in one bit is found from the side that has the bit set); matches are verified on all 64 bits. Only
distinct fingerprints take part, so copies never meet in a join, and classes come from contraction of the links. Texts that
are alike by their shingles lie further apart; for them fingerprints have 256 bits in twelve segments (see ``alike``).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from siltstone.llm.common import map_texts
from siltstone.operators.components import connected_components
from siltstone.session import materialize

#: Two segments and radius 1 find every pair up to 3 bits; a larger distance would need more segments or a wider ball.
MAX_BITS = 3
#: Least Jaccard similarity of near copies for the pipeline's stage, which takes fingerprints of four longs.
LIKE, LONGS = 0.8, 4
#: Segments of a long and their bits; flips of a ball (the bits of a segment that were decided by least); largest distance of candidates.
PER_LONG, SEGMENT, FLIPS, RADIUS = 3, 21, 4, 45
#: A class of several members goes on if one of them is within this distance; texts that have nothing in common are 128 bits apart, give or take 8.
FAR = 96
#: Rounds that link the members of large buckets to neighbours in random orders, members of one order, and of a bucket that is large.
RINGS, RING, LARGE = 2, 1024, 4
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def fingerprints_of(texts: list[str | None], width: int = 3) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text; null, empty and blank texts have 0."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = (text or "").encode().lower().split()
        joined, ends = b" ".join(words), [0]
        for word in words:
            ends.append(ends[-1] + len(word) + 1)
        if len(words) <= width:
            found = [digest(joined, 42)] if words else []
        else:
            found = [digest(joined[a : b - 1], 42) for a, b in zip(ends, ends[width:])]
        hashes += found
        counts.append(len(found))
    out = np.zeros(len(texts), np.uint64)
    sizes = np.array(counts, np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        values = np.array(hashes, np.uint64)
        for i, k in enumerate(full):  # one text at a time keeps the bit matrix small
            part = values[starts[i] : starts[i] + sizes[k]]
            total = np.zeros(64, np.int64)
            for j in range(0, len(part), 1 << 14):
                total += np.unpackbits(part[j : j + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[k] = np.packbits(total * 2 > sizes[k], bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)`` with the fingerprint as a signed long, for every row."""

    def make():
        return lambda texts: {"fp": fingerprints_of(texts, width).view(np.int64)}

    return map_texts(docs, [id_col], text_col, make, T.StructType([T.StructField("fp", T.LongType(), False)]))


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)``: pairs of distinct fingerprints (column ``fp``, distinct) that differ in at most ``bits`` bits."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"bits must be 0 to {MAX_BITS}")
    halves = F.array(
        F.struct(F.lit(0).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("val")),
        F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned("fp", 32).alias("val")),
    )
    table = fps.select("fp", F.explode(halves).alias("s")).select("fp", "s.seg", "s.val")
    below = F.expr("transform(filter(sequence(0, 31), i -> getbit(val, i) = 1), i -> val ^ shiftleft(1L, i))")
    probes = table.select(F.col("fp").alias("ask"), "seg", F.explode(F.concat(F.array("val"), below)).alias("probe"), "val")
    pairs = probes.join(table.select("fp", "seg", F.col("val").alias("probe")), ["seg", "probe"]).where(
        (F.bit_count(F.col("ask").bitwiseXOR(F.col("fp"))) <= bits) & ((F.col("val") != F.col("probe")) | (F.col("ask") < F.col("fp")))
    )
    return pairs.select(F.least("ask", "fp").alias("a"), F.greatest("ask", "fp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = MAX_BITS) -> DataFrame:
    """``(id, fp, component_id, class_size)`` for every row of ``docs``.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Repeated rows stay, in one class. A
    null id keeps its row; it never names a class unless all ids of the class are null. An empty table gives an empty
    result. Other columns are ignored.
    """
    known = materialize(fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text", width), "simhash-fp")
    nodes = known.groupBy("fp").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = connected_components(links(nodes.select("fp"), bits), "a", "b").withColumnRenamed("node", "fp")
    labelled = nodes.join(classes, "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("label"))
    labelled = materialize(labelled, "simhash-class")
    groups = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("n").alias("class_size"))
    of_fp = labelled.join(groups, "label").select("fp", "component_id", "class_size")
    return known.join(of_fp, "fp").select(F.col("_id").alias(id_col), "fp", "component_id", "class_size")


def rows_with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, h, text, row)``: id and text hash tell rows apart; ``row`` holds all columns, whatever their names."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def only(docs: DataFrame, rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key ``(id, h)`` is in ``heads``; of rows with equal id and text one."""
    # one key for both, of one type down to what may be null, so that rows are dealt once
    key = F.struct(F.isnull("id").alias("none"), "id", F.coalesce("h", F.lit(0).cast("long")).alias("h")).alias("key")
    kept = rows.select(key, "row").join(heads.select(key), "key", "left_semi").dropDuplicates(["key"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class of near fingerprints the row with the smallest id (null last).

    Of several rows with that id the one with the smallest text hash stays, if they are of one class; rows with one id and
    other texts are other rows. Nulls, empty texts and an empty table as in ``near_duplicates``; other columns stay as they
    are, whatever their names.
    """
    rows = rows_with_key(docs, id_col, text_col)
    key = F.struct(F.isnull("id").alias("none"), "id", "h").alias("key")
    classes = near_duplicates(rows.select(key, "text"), "key", "text")
    heads = materialize(classes.where(F.col("key") == F.col("component_id")).select("key.id", "key.h").distinct(), "simhash-heads")
    return only(docs, rows, heads)


def shingles_of(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words, unsigned; a text of fewer words has one run, without words none."""
    digest, words = xxhash.xxh64_intdigest, (text or "").encode().lower().split()
    found = {digest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))} if words else ()
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def mixed(hashes: np.ndarray, odd: int) -> np.ndarray:
    """Other 64 bits of hash for each of the given ones."""
    x = hashes * np.uint64(odd)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def long_fingerprint(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four longs of SimHash bits of distinct shingles, and for each segment the places of its FLIPS least sure bits, five bits each."""
    bits, sure = np.zeros((LONGS, 64), bool), np.zeros((LONGS, 64), np.int64)
    for w in range(LONGS):
        total = np.zeros(64, np.int64)
        for j in range(0, len(hashes), 1 << 14):
            total += np.unpackbits(mixed(hashes[j : j + (1 << 14)], MIX[w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits[w], sure[w] = total * 2 > len(hashes), np.abs(total * 2 - len(hashes))
    least = np.argsort(sure[:, : PER_LONG * SEGMENT].reshape(-1, SEGMENT), axis=1, kind="stable")[:, :FLIPS]
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)[:, 0], (least << 5 * np.arange(FLIPS)).sum(axis=1)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Four longs: for each of 256 parts of the shingles whether their number is odd.

    Two sets differ in at least as many shingles as their sketches in bits.
    """
    return np.packbits(np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256) & 1, bitorder="little").view(np.int64)


def own_keys() -> list[str]:
    """SQL of the number and value of each segment of a fingerprint ``f0`` to ``f3``."""
    return [f"((shiftrightunsigned(f{w}, {SEGMENT * j}) & {(1 << SEGMENT) - 1}L) + {(w * PER_LONG + j) << SEGMENT}L)" for w in range(LONGS) for j in range(PER_LONG)]


def ball_keys() -> list[str]:
    """SQL of all probes: each segment as it is, and with one of its unsure bits flipped."""
    flip = "({} ^ shiftleft(1L, cast(shiftright(unsure[{}], {}) & 31 as int)))"
    return [x for i, key in enumerate(own_keys()) for x in (key, *(flip.format(key, i, 5 * t) for t in range(FLIPS)))]


def distance(a: str, b: str, of: str = "f") -> Column:
    """Bits in which two fingerprints, or sketches, differ, whose columns begin with ``a`` and ``b``."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{of}{w}").bitwiseXOR(F.col(f"{b}{of}{w}"))) for w in range(LONGS)])


def may_be_alike(a: str, b: str, like: float) -> Column:
    """False only for sets below ``like``: these differ in more shingles than their sizes allow, by the sizes alone or by the sketches."""
    x, y = F.col(f"{a}n"), F.col(f"{b}n")
    return (F.least(x, y) >= F.greatest(x, y) * like - 1e-3) & (distance(a, b, "g") <= (x + y) * ((1 - like) / (1 + like)) + 1e-3)


def asked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose hash ``h`` may be in ``wanted``: all that are and few others, told by a bitmap of 4 MB at most, so the rest is not shuffled."""
    place = F.pmod("h", F.lit(1 << 25))
    maps = wanted.select(F.bitmap_bucket_number(place).alias("_b"), F.bitmap_bit_position(place).alias("_p")).groupBy("_b").agg(F.bitmap_construct_agg("_p").alias("_map"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = texts.withColumn("_b", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "_b")
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*texts.columns)


def alike(docs: DataFrame, text_col: str = "text", width: int = 5, like: float = LIKE) -> tuple[DataFrame, DataFrame]:
    """``(h, set)`` of each row's text hash, and links ``(a, b)`` between sets of Jaccard similarity ``like`` or more.

    Only distinct sets of shingles take part. Each has a fingerprint of 256 bits in 12 segments; the table holds every set
    under the values of its segments, and a set asks for its own values and for those with one of the bits flipped that were
    decided by the smallest margins, as these are the ones in which a near copy differs. What is met within RADIUS bits is
    compared in full, so no link is false; a pair at a similarity just over 0.8 is found with a chance of about 0.8, at 0.86 of 0.96, at 0.9 of
    0.99. Sets are told apart by 64 bits. Before the texts are read again, sizes and sketches of 256 bits take off pairs that can't be alike.

    Members of a bucket are first linked to neighbours in random orders, which makes one class of a group of copies; then only
    sets of different classes meet, a class once in a bucket with all its members there as one. Sizes, and sketches of the sets
    of large buckets, go along, so that single sets which can't be alike don't meet in a large group of near copies either.
    """
    names, odd = ([f"{c}{w}" for w in range(LONGS)] for c in "fg")

    def measure():
        def call(texts):
            out = {c: [] for c in ("set", "n", *names, *odd, "unsure")}
            for text in texts:
                sigs = shingles_of(text, width)
                fp, unsure = long_fingerprint(sigs)
                out["set"].append(xxhash.xxh3_64_intdigest(sigs.tobytes()) - (1 << 63))
                out["n"].append(len(sigs))
                out["unsure"].append(unsure.astype(np.int32))
                for c, v in zip(names + odd, [*fp, *odd_sketch(sigs)]):
                    out[c].append(int(v))
            return out

        return call

    fields = [T.StructField("set", T.LongType()), T.StructField("n", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in names + odd], T.StructField("unsure", T.ArrayType(T.IntegerType()))]
    texts = docs.select(F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), F.col(text_col).alias("_text"))
    sets = materialize(map_texts(texts, ["h"], "_text", measure, T.StructType(fields)), "alike-sets")
    one = materialize(sets.where("n > 0").drop("h").dropDuplicates(["set"]), "alike-distinct")
    sketch = lambda name, to: one.select(F.col("set").alias(name), *[F.col(c).alias(f"{to}{c}") for c in ("n", *odd)])
    own, ball = (F.explode(F.array(*map(F.expr, keys))).alias("key") for keys in (own_keys(), ball_keys()))

    def linked(pairs: DataFrame) -> DataFrame:
        """Of candidate pairs those that are alike, by their whole sets."""
        pairs = pairs.join(sketch("a", "x_"), "a").join(sketch("b", "y_"), "b").where(may_be_alike("x_", "y_", like)).select("a", "b")
        pairs = materialize(pairs, "alike-pairs")

        def whole():
            return lambda texts: {"sigs": [shingles_of(t, width).view(np.int64) for t in texts]}

        wanted = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
        wanted = materialize(sets.select("h", "set").dropDuplicates(["set"]).join(wanted, "set"), "alike-wanted")
        full = asked(texts, wanted).join(wanted, "h").dropDuplicates(["set"])
        full = materialize(map_texts(full, ["set"], "_text", whole, T.StructType([T.StructField("sigs", T.ArrayType(T.LongType()))])), "alike-full")
        return materialize(alike_pairs(pairs, full, like), "alike-links")

    table = one.select("set", *names, own)
    large = materialize(table.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > LARGE), "alike-buckets")
    table = materialize(table.join(large, "key"), "alike-large")
    # many: whether others are in its class
    comp, links_of = one.select("set", F.col("set").alias("comp"), F.lit(False).alias("many")), None
    for turn in range(RINGS):
        dealt = table.join(comp.drop("many"), "set").withColumn("x", F.xxhash64("set", "key", F.lit(turn))).withColumn("part", F.pmod("x", F.ceil(F.col("k") / RING)))
        order = Window.partitionBy("key", "part").orderBy("x", "set")
        near = dealt.withColumns({f"o_{c}": F.lead(c).over(order) for c in ("set", "comp", *names)}).where((F.col("comp") != F.col("o_comp")) & (distance("", "o_") <= RADIUS))
        found = linked(near.select(F.least("set", "o_set").alias("a"), F.greatest("set", "o_set").alias("b")).distinct())
        links_of = found if links_of is None else links_of.unionByName(found)
        if found.isEmpty():
            break
        classes = connected_components(links_of, "a", "b").withColumnRenamed("node", "set")
        comp = materialize(one.select("set").join(classes, "set", "left").select("set", F.coalesce("component", "set").alias("comp"), F.isnotnull("component").alias("many")), "alike-comp")
    # a class is met once in a bucket: by its only member, or by any one if it has several there; only sets of large buckets send sketches
    crowd = table.select("set").distinct().withColumn("crowd", F.lit(True))
    known = materialize(one.join(comp, "set").join(crowd, "set", "left"), "alike-known")
    told = ("n", *names, *odd)
    sent = known.select("set", "comp", "many", "unsure", "n", *names, *[F.when(F.col("crowd"), F.col(c)).alias(c) for c in odd])
    asks = sent.select(ball, F.col("comp").alias("comp_x"), F.col("set").alias("set_x"), *[F.col(c).alias(f"x_{c}") for c in told])
    held = known.where("many").select(own, "comp", "set", *told)
    classes = held.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"), *[F.min_by(c, "set").alias(c) for c in told], F.min("set").alias("set"))
    classes = classes.unionByName(sent.where("not many").select(own, "comp", F.lit(1).cast("long").alias("k"), *told, "set"))
    classes = classes.select("key", F.col("comp").alias("comp_y"), F.col("set").alias("set_y"), "k", *[F.col(c).alias(f"y_{c}") for c in told])
    single = (distance("x_", "y_") <= RADIUS) & F.coalesce(may_be_alike("x_", "y_", like), F.lit(True))
    met = asks.join(classes, "key").where((F.col("comp_x") != F.col("comp_y")) & F.when(F.col("k") == 1, single).otherwise(distance("x_", "y_") <= FAR))
    met = materialize(met.select("key", "k", "comp_y", "set_x", "set_y", *[f"x_{c}" for c in names]), "alike-met")
    pairs = met.where("k = 1").select(F.col("set_x").alias("p"), F.col("set_y").alias("q"))
    members = held.select("key", F.col("comp").alias("comp_y"), F.col("set").alias("q"), *[F.col(c).alias(f"y_{c}") for c in ("n", *names, *odd)])
    across = met.where("k > 1").join(sketch("set_x", "x_"), "set_x").join(members, ["key", "comp_y"])
    across = across.where((distance("x_", "y_") <= RADIUS) & may_be_alike("x_", "y_", like)).select(F.col("set_x").alias("p"), "q")
    pairs = pairs.unionByName(across).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    return sets.select("h", "set"), links_of.unionByName(linked(pairs))


def alike_pairs(pairs: DataFrame, full: DataFrame, like: float) -> DataFrame:
    """Of pairs ``(a, b)`` of sets those of likeness ``like`` or more; ``full`` has ``(set, sigs)``."""
    x, y = (full.select(F.col("set").alias(s), F.col("sigs").alias(f"sigs_{s}")) for s in "ab")
    both = F.size(F.array_intersect("sigs_a", "sigs_b"))
    met = pairs.join(x, "a").join(y, "b").where(F.least(F.size("sigs_a"), F.size("sigs_b")) >= F.greatest(F.size("sigs_a"), F.size("sigs_b")) * like - 1e-6)
    return met.withColumn("both", both).where(F.col("both") >= (F.size("sigs_a") + F.size("sigs_b") - F.col("both")) * like - 1e-6).select("a", "b")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, like: float = LIKE) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class of texts linked by a Jaccard similarity of ``like`` or more.

    The row with the smallest id stays (null last), of several the one with the smallest text hash. Null, empty and blank
    texts have no words and are one class; texts of any length count whole; of repeated rows one stays; an empty table
    gives an empty result. Other columns stay as they are, whatever their names.
    """
    rows = rows_with_key(docs, id_col, text_col)
    sets, links_of = alike(rows.select("text"), "text", width, like)
    classes = connected_components(links_of, "a", "b").withColumnRenamed("node", "set")
    labelled = sets.distinct().join(classes, "set", "left").select("h", F.coalesce("component", "set").alias("label"))
    labelled = rows.select("id", "h").distinct().join(labelled, "h")
    heads = labelled.groupBy("label").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "h")).alias("r"))
    return only(docs, rows, materialize(heads.select("r.id", "r.h"), "alike-heads"))


def op2(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size")
