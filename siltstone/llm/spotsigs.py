"""SpotSigs document fingerprints, in DataFrame functions only.

A signature is a spot: a run of common words (anchors) and the chain of content words behind it. The first word of a text
counts as a spot too, so every text has a signature, and so does every word with a few words and no anchor before it: a text
in which anchors are rare or missing is told by all its words, one with many by its spots, and an anchor changes no more than
the words around it. The set of a text's signatures is its fingerprint; likeness is the Jaccard similarity of two sets. Near copies are found within partitions by set length: sets can only be alike if their
lengths are, so a set meets its own partition and the next, through the rarest of its signatures, and the pairs left are
compared in full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.operators.components import connected_components
from siltstone.session import materialize

#: Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = (
    "the a an is are was be to of and in that it for on with as by at from this "
    "le la les de des du et un une est que qui dans pour sur au par pas "
    "der die das und ist von den mit ein eine im für auf nicht als "
    "el los las y en es por con para del al no se"
).split()
#: Content words in a chain, least likeness of near copies, content words behind an anchor after which each is a spot.
CHAIN, LIKE, ALONE = 2, 0.8, 8
BEFORE, AFTER = "\u0001", "\u0002"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it: functions of arrays evaluate their arguments each for itself."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signatures(text: Column, anchors: list[str] | None = None) -> Column:
    """Sorted distinct hashes of the spots of a text; null counts as empty, and texts without words share one signature.

    Words are runs of letters and digits in lower case. The text is cut in front of every run of anchors, and functions of
    arrays go over these few pieces; only words far from any anchor are taken one by one.
    """
    words = "|".join(sorted(set(anchors or ANCHORS)))
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    each = F.regexp_replace(plain, f"(?<![^ ])({words}) (?=[^ ])", f"{BEFORE}$1 {AFTER}")
    marked = F.concat(F.lit(AFTER), F.replace(each, F.lit(AFTER + BEFORE), F.lit("")))  # anchors in a row are one run
    def spot(x: Column, y: Column) -> Column:
        """The run with the two content words behind it; the second may stand behind the next run."""
        two = F.substring_index(F.substring_index(x, AFTER, -1), " ", CHAIN)
        follower = F.coalesce(F.substring_index(F.substring_index(y, AFTER, -1), " ", 1), F.lit(""))
        whole = F.contains(F.rtrim(two), F.lit(" "))
        return F.xxhash64(F.substring_index(x, AFTER, 1), F.when(whole, two).otherwise(F.concat(F.rtrim(two), F.lit(" "), follower)))

    def spots(pieces: Column) -> Column:
        return F.zip_with(pieces, F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1))), spot)

    def pairs(lone: Column) -> Column:
        return F.zip_with(lone, F.slice(lone, F.lit(2), F.greatest(F.size(lone), F.lit(1))), lambda x, y: F.when((x != BEFORE) & (x != "") & F.coalesce(y != BEFORE, F.lit(False)), F.xxhash64(x, y)))

    def both(pieces: Column) -> Column:
        # of pieces with more than ALONE words those behind, with a mark between pieces
        far = F.filter(F.transform(pieces, lambda x: F.rtrim(F.regexp_extract(x, f"{AFTER}(?:[^ ]++ ){{{ALONE}}}(.+)", 1))), lambda x: x != "")
        return F.concat(spots(pieces), F.array_compact(let(F.split(F.array_join(far, f" {BEFORE} "), " "), pairs)))

    # each piece: a run of anchors (none in the first), then content words up to the next run
    return F.array_sort(F.array_distinct(let(F.split(marked, BEFORE), both)))


def digest(sigs: Column) -> Column:
    """A fingerprint as a string: equal for equal sets."""
    return F.sha2(sigs.cast("string").cast("binary"), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: float = LIKE) -> DataFrame:
    """``(id, fingerprint, class_id, class_size)``: classes of texts whose signature sets are linked by likeness of ``like`` or more.

    Texts with equal sets take part once, with their smallest id; the class id is the smallest id of the class. A set is
    indexed under its ``n - ceil(like * n) + 1`` rarest signatures: two sets that are alike share one of those. Pairs
    meet only where their lengths allow the likeness; those that meet are compared in full, none is left out.
    """
    sets = docs.select(F.col(id_col).alias("_id"), signatures(F.col(text_col)).alias("sigs")).withColumn("fp", F.xxhash64(F.col("sigs").cast("string")))
    sets = materialize(sets, "spots-sets")
    one = sets.groupBy("fp").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("sigs").alias("sigs"))
    one = materialize(one, "spots-distinct").withColumn("len", F.size("sigs"))
    long = one.select("fp", "len", F.explode("sigs").alias("sig"))
    rare = long.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("fp").orderBy("df", "sig")
    head = long.join(rare.where("df > 1"), "sig", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("r", F.row_number().over(order))
    head = head.where((F.col("r") <= F.col("len") - F.ceil(F.lit(like) * F.col("len")) + 1) & (F.col("df") > 1))
    # partitions by length, each a factor 1 / like wide: alike sets lie in one or in neighbours
    head = head.withColumn("bucket", F.floor(F.log(F.col("len").cast("double")) / F.lit(-math.log(like) if like < 1 else 1e-9)))
    head = materialize(head.select("fp", "len", "sig", "bucket"), "spots-index")
    ask = head.select(F.col("fp").alias("fp_a"), F.col("len").alias("len_a"), "sig", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    own = head.select(F.col("fp").alias("fp_b"), F.col("len").alias("len_b"), "sig", "bucket")
    shorter = (F.col("len_a") < F.col("len_b")) | ((F.col("len_a") == F.col("len_b")) & (F.col("fp_a") < F.col("fp_b")))
    pairs = ask.join(own, ["sig", "bucket"]).where(shorter & (F.col("len_a") >= F.lit(like) * F.col("len_b"))).select("fp_a", "fp_b").distinct()
    a, b = (one.select(F.col("fp").alias(f"fp_{s}"), F.col("sigs").alias(f"sigs_{s}")) for s in "ab")
    links = pairs.join(a, "fp_a").join(b, "fp_b").where(likeness(F.col("sigs_a"), F.col("sigs_b")) >= like).select("fp_a", "fp_b")
    classes = connected_components(links, "fp_a", "fp_b").withColumnRenamed("node", "fp")
    labelled = one.select("fp", "least", "n").join(classes, "fp", "left").withColumn("label", F.coalesce("component", "fp"))
    labelled = materialize(labelled.select("fp", "least", "n", "label"), "spots-class")
    groups = labelled.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    return sets.select("_id", "fp", digest(F.col("sigs")).alias("fingerprint")).join(labelled.select("fp", "label").join(groups, "label"), "fp").select(F.col("_id").alias(id_col), "fingerprint", "class_id", "class_size")


KEY = ["null_id", "k", "n", "h"]


def next_rows(rows: DataFrame) -> DataFrame:
    """Key columns, ``copies`` and the key of the next row: by id descending (null last), length and hash; the first after the last.

    Rows are range-sorted; only the first row of each range goes into one small window.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select(*KEY).groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col("null_id"), F.col("k").desc(), F.col("n"), F.col("h")]
    ranges = materialize(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "spots-order")
    me, upward = F.struct(*KEY), F.struct(F.col("null_id"), (-F.col("k")).alias("m"), F.col("n"), F.col("h"))
    firsts = ranges.groupBy("part").agg(F.min_by(me, upward).alias("first"))
    bounds = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("after"), F.first("first").over(Window.orderBy("part")).alias("very_first"))
    linked = ranges.withColumn("next", F.lead(me).over(Window.partitionBy("part").orderBy(*order)))
    linked = linked.join(bounds, "part").withColumn("next", F.coalesce("next", "after", "very_first"))
    return linked.select(*KEY, "copies", *[F.col(f"next.{c}").alias(f"next_{c}") for c in KEY])


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likeness; and the likeness to the next document.

    The edited text has its last third replaced by the start of the next document, by descending id. Rows that are equal
    in id and text count once in that order and get equal results, each its own row. Null texts count as empty; null ids
    come last. The only document of a table is its own next one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.isnull("id").alias("null_id"), F.coalesce("id", F.lit(0)).alias("k"), F.char_length("text").cast("long").alias("n"), F.xxhash64("text").alias("h"), "text")
    links = materialize(next_rows(rows), "spots-next")
    # one row for each distinct (id, text); whole texts move once, and both joins below read that exchange
    once = rows.withColumn("again", F.row_number().over(Window.partitionBy(*KEY).orderBy("n"))).where("again = 1").drop("again")
    wanted = links.select(*[F.col(f"next_{c}").alias(c) for c in KEY], *[F.col(c).alias(f"to_{c}") for c in KEY])
    given = once.join(wanted, KEY).select(*[F.col(f"to_{c}").alias(c) for c in KEY], F.expr("substring(text, 1, cast(floor(to_n / 3) as int))").alias("head"), signatures(F.col("text")).alias("next_sigs"))
    got = once.join(given, KEY).join(links.select(*KEY, "copies"), KEY)
    edited = F.concat(F.expr("substring(text, 1, cast(n - floor(n / 3) as int))"), F.col("head"))
    got = got.select("null_id", "k", "n", "copies", "next_sigs", "text", edited.alias("edited"))
    got = got.select("null_id", "k", "n", "copies", "next_sigs", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signatures(F.col("text")).alias("sigs"), signatures(F.col("edited")).alias("edited_sigs"))
    got = got.select(
        F.when(~F.col("null_id"), F.col("k")).alias(id_col), F.col("n").alias("n_chars"), "edited_sha256", digest(F.col("sigs")).alias("fingerprint"), digest(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"), F.size("sigs").alias("n_signatures"), "copies",
    )
    return got.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def op7(docs: DataFrame) -> DataFrame:
    return compare_with_next(docs)
