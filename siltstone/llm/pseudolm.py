"""Masked pseudo-likelihood scores.

A small network predicts every token of a text from a window on both sides with the token itself left out; a document's
score is the sum of the conditional log-probabilities of all its tokens. The network's softmax is over classes of words of
like frequency, with a class of its own for each of the most frequent; a word has its class's probability times its share
of the class's count. Every distinct word of the corpus has its own share: those of up to KNOWN frequent words are a list,
all others a Spark table that grows with the corpus. Such a rare word may also be remembered: where it stands elsewhere in
the corpus between the same two neighbours, these other places predict it.

The network is trained in numpy inside Spark tasks, once on every token of every document: a hash of the text deals
documents to rounds, and a hash of id and text to parts of about PART tokens. Each part starts from the shared weights; a
tree of sums averages them after each round. The number of parts depends on the corpus alone, so what is learned does not
depend on the cluster.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.llm.common import limit_batches, release, slices
from siltstone.session import drop_path, fresh_path, materialize

#: Words with a number of their own at most; classes of one word, of several known words, and of all other words by their hash.
KNOWN, SINGLE, BINS, OTHER = 1 << 18, 24, 32, 8
CLASSES = SINGLE + BINS + OTHER
#: Window to each side, width of the vectors, and how many vectors there are: words beyond share them.
SIDE, WIDTH, VECTORS = 2, 16, 1 << 15
#: Where the rounds end, as shares of all documents: short ones first, so that the parts agree early. Tokens of a part and of a step, learning rate.
ROUNDS, PART, STEP, RATE = (1 / 8, 1), 4_000_000, 1 << 14, 0.1
#: Blocks that weights are cut into on their way, and how many sums become one in a step of the tree.
BLOCKS, FAN = 8, 64
#: Words that a task counts before it hands them on; tokens scored at once.
COUNTED, AT_ONCE = 200_000, 1 << 13
#: What other places with the same neighbours count for in the probability of a rare word.
MEMORY = 0.25
#: Log-probabilities are added as whole numbers of this size, so that sums do not depend on the order of rows.
UNIT = 2.0**-24


def words_in(texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """Words of all texts one after the other, split at ASCII white space and lower-cased in ASCII, and how many each text has."""
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(plain)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    counts[pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)] = 0
    flat = lists.flatten()
    return flat.filter(pc.greater(pc.binary_length(flat), 0)).cast(pa.binary()), counts


class Vocabulary:
    """The known words by falling count, with their counts, and the counts of the classes of all other words."""

    def __init__(self, words: list[bytes], counts: list[int], others: list[int]):
        self.words, self.n = pa.array(words, pa.binary()), len(words)
        wide = max(0, self.n - SINGLE)
        # bins grow with the rank, so that a bin of frequent words has few
        edges = SINGLE + np.unique(np.rint((1 + wide) ** (np.arange(1, BINS) / BINS) - 1).astype(np.int64))
        rank = np.arange(self.n)
        self.class_of = np.concatenate((np.where(rank < SINGLE, rank, SINGLE + np.searchsorted(edges, rank, side="right")), SINGLE + BINS + np.arange(OTHER), [0])).astype(np.int32)
        self.vector_of = np.concatenate((np.where(rank < VECTORS - 4096, rank, VECTORS - 4096 + rank % 4087), VECTORS - 9 + np.arange(OTHER), [VECTORS - 1])).astype(np.uint16)
        known = np.array(counts, np.float64).reshape(-1)
        sizes = np.bincount(self.class_of[: self.n], known, CLASSES)
        self.share = np.concatenate((np.log(known) - np.log(sizes[self.class_of[: self.n]]), -np.log(np.array(others) + 1.0), [0.0]))
        self.blank = self.n + OTHER

    def tokens(self, words: pa.BinaryArray) -> np.ndarray:
        """Number of each word: its rank, or behind all ranks the class of others it falls into by its hash."""
        found = pc.index_in(words, value_set=self.words)
        out = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int32)
        other = np.flatnonzero(out < 0)
        if len(other):
            rare = words.filter(pc.is_null(found)).dictionary_encode()
            classes = np.array([zlib.crc32(w) % OTHER for w in rare.dictionary.to_pylist()], np.int32)
            out[other] = self.n + classes[rare.indices.to_numpy()]
        return out

    def padded(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens with SIDE blanks around each text, and where each token stands then."""
        out, at = np.full(len(tokens) + SIDE * (len(counts) + 1), self.blank, np.int32), positions(counts)
        out[at] = tokens
        return out, at


OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]
SHAPES = {"embed": (VECTORS, WIDTH), "place": (len(OFFSETS), WIDTH), "bias": (WIDTH,), "out": (CLASSES, WIDTH), "out_bias": (CLASSES,)}


def sharp(x: np.ndarray) -> np.ndarray:
    """x in steps of 2**-20, so that products of two such arrays and sums of 32 of these are exact in 64 bits, whatever their order."""
    return np.rint(x.astype(np.float64) * 2**20) * 2.0**-20


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    x /= 1 + np.abs(x)
    return x


class Network:
    """Window vectors weighted by place, one layer squashed to -1 .. 1, and a softmax over the classes."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w, self.placed = weights, None

    @staticmethod
    def fresh(seed: int = 11) -> "Network":
        rng = np.random.default_rng(seed)
        w = {n: (rng.standard_normal(s) * (0.3 if n == "embed" else 0.1)).astype(np.float32) for n, s in SHAPES.items()}
        w["place"] += 0.5
        for n in ("bias", "out_bias"):
            w[n][:] = 0
        return Network(w)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[n].ravel() for n in SHAPES])

    @staticmethod
    def of(flat: np.ndarray) -> "Network":
        at, w = 0, {}
        for n, s in SHAPES.items():
            size = int(np.prod(s))
            w[n] = flat[at : at + size].reshape(s).astype(np.float32)
            at += size
        return Network(w)

    def hidden(self, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.tile(self.w["bias"], (len(at), 1))
        for k, o in enumerate(OFFSETS):
            total += self.w["embed"][vectors[at + o]] * self.w["place"][k]
        return squash(total)

    def log_probabilities(self, vectors: np.ndarray, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log p(class | both sides) at the given positions; no position sees its own token."""
        got, out = np.zeros(len(at), np.float64), sharp(self.w["out"]).T
        if self.placed is None:
            self.placed = [self.w["embed"] * place for place in self.w["place"]]
        for k in range(0, len(at), AT_ONCE):
            some = at[k : k + AT_ONCE]
            total, more = np.tile(self.w["bias"], (len(some), 1)), np.empty((len(some), WIDTH), np.float32)
            for table, o in zip(self.placed, OFFSETS):
                total += np.take(table, vectors[some + o], axis=0, out=more, mode="clip")
            z = (sharp(squash(total)) @ out).astype(np.float32)  # a row's result does not depend on the rows around it
            z += self.w["out_bias"]
            right = z[np.arange(len(some)), classes[some]]
            got[k : k + AT_ONCE] = right - np.log(np.exp(np.minimum(z, 80, out=z), out=z).sum(axis=1))
        return got

    def train(self, vectors: np.ndarray, classes: np.ndarray, at: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        """One Adagrad step on the given positions; only vectors that had a part in it are touched."""
        w, n = self.w, len(at)

        def move(name, where, g):
            s = squares[name][where] + g * g
            squares[name][where] = s
            w[name][where] -= RATE * g / (np.sqrt(s) + 1e-6)

        seen = [vectors[at + o] for o in OFFSETS]
        side = [np.take(w["embed"], v, axis=0, mode="clip") for v in seen]
        h = np.tile(w["bias"], (n, 1))
        for x, place in zip(side, w["place"]):
            h += x * place
        squash(h)
        d = h @ w["out"].T
        d += w["out_bias"]
        np.exp(np.minimum(d, 80, out=d), out=d)
        d /= d.sum(axis=1, keepdims=True)
        d[np.arange(n), classes[at]] -= 1
        d *= np.float32(1 / n)
        dh = d @ w["out"]
        move("out", slice(None), d.T @ h)
        move("out_bias", slice(None), d.sum(axis=0))
        dh *= (1 - np.abs(h)) ** 2
        place = np.stack([np.einsum("ij,ij->j", dh, x) for x in side])
        there = np.zeros(VECTORS, bool)
        for v in seen:
            there[v] = True
        touched = np.flatnonzero(there)
        number = np.zeros(VECTORS, np.int64)
        number[touched] = np.arange(len(touched))
        turned, g = np.ascontiguousarray(dh.T, np.float64), np.zeros((WIDTH, len(touched)))
        for v, weight in zip(seen, w["place"]):
            rows = number[v]
            for j in range(WIDTH):
                g[j] += np.bincount(rows, turned[j], len(touched)) * weight[j]
        move("embed", touched, g.T.astype(dh.dtype))
        move("place", slice(None), place)
        move("bias", slice(None), dh.sum(axis=0))


def positions(counts: np.ndarray) -> np.ndarray:
    """Where the tokens of each text stand when SIDE blanks come before every text."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(SIDE * np.arange(1, len(counts) + 1), counts)


def sums_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's values, each text on its own."""
    out, full = np.zeros(len(counts), values.dtype), np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)`` of all words of all documents; tasks count before the shuffle."""
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])

    def count(batches):
        # counts of batches wait until they are COUNTED more than what is merged; then they become one table, which is handed on if it is large
        out, waiting, size, most = to_arrow_schema(schema), [], 0, COUNTED

        def merged():
            sums = pa.concat_tables(waiting).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return pa.table([sums.column("word"), sums.column("n_sum")], schema=out)

        for batch in batches:
            found = words_in(batch.column(0))[0].value_counts()
            waiting.append(pa.table([found.field("values"), found.field("counts")], schema=out))
            size += len(found)
            if size > most:
                table = merged()
                if table.num_rows > COUNTED:
                    yield from table.to_batches()
                    waiting, size, most = [], 0, COUNTED
                else:
                    waiting, size, most = [table], table.num_rows, table.num_rows + COUNTED
        if waiting:
            yield from merged().to_batches()

    limit_batches(docs.sparkSession)
    return docs.select(text_col).mapInArrow(count, schema).groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The words from some count on, so that they are KNOWN at most; only this list, of a bounded length, reaches the driver."""
    # counts from 1,000 on in steps of three digits, so that there are few
    digits = F.pow(F.lit(10), F.greatest(F.lit(0), F.length(F.col("n").cast("string")) - 3)).cast("long")
    sizes, room, least = counts.groupBy((F.floor(F.col("n") / digits) * digits).alias("step")).count().collect(), KNOWN, None
    for r in sorted(sizes, key=lambda r: -r["step"]):
        if r["count"] > room:
            break
        room, least = room - r["count"], r["step"]
    is_known = F.lit(False) if least is None else F.col("n") >= least
    known = sorted(((-r["n"], bytes(r["word"])) for r in counts.where(is_known).collect()))
    others = [0] * OTHER
    for r in counts.where(~is_known).groupBy((F.crc32("word") % OTHER).alias("k")).agg(F.sum("n").alias("n")).collect():
        others[r["k"]] = r["n"]
    return Vocabulary([w for _, w in known], [-n for n, _ in known], others)


def averaged(local: DataFrame, parts: int) -> np.ndarray | None:
    """Mean of all parts' weights by tokens, in steps of FAN sums, each block on its own; only the last sums reach the driver."""
    schema = local.schema

    def add(batches):
        def row():
            return pa.RecordBatch.from_pylist([{"block": key[0], "part": key[1], "n": n, "weights": total.tobytes()}], schema=to_arrow_schema(schema))

        key, total, n = None, None, 0
        for batch in batches:
            for r in batch.to_pylist():
                # sums, of 64 bits, have a negative count; weights of one part, of 32 bits, a positive one
                x = np.frombuffer(r["weights"], np.float64) if r["n"] < 0 else np.frombuffer(r["weights"], np.float32).astype(np.float64) * r["n"]
                if key != (r["block"], r["part"] // FAN):
                    if key:
                        yield row()
                    key, total, n = (r["block"], r["part"] // FAN), 0.0, 0
                total, n = total + x, n - abs(r["n"])
        if key:
            yield row()

    while True:
        parts = -(-parts // FAN)
        local = local.repartition(min(BLOCKS * parts, 4096), "block", F.floor(F.col("part") / FAN)).sortWithinPartitions("block", "part").mapInArrow(add, schema)
        if parts == 1:
            break
    rows = sorted(local.collect(), key=lambda r: r["block"])
    return np.concatenate([np.frombuffer(bytes(r["weights"]), np.float64) / -r["n"] for r in rows]) if rows else None


def fit(docs: DataFrame, words: Vocabulary, tokens: int, id_col: str = "doc_id", text_col: str = "text", rounds: tuple = ROUNDS, part: int = PART) -> Network:
    """Train on every token once; ``tokens`` is how many there are. No text: fresh weights.

    Copies of a text are in one round, and lie in several parts as their ids differ.
    """
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("weights", T.BinaryType())])
    text, net, before = F.col(text_col), Network.fresh(), 0.0
    limit_batches(docs.sparkSession)
    rows = docs.where(text.isNotNull()).select(text, F.xxhash64(text).alias("_h"), F.col(id_col).cast("string").alias("_id"))
    dice = F.pmod("_h", F.lit(1 << 20)) / F.lit(float(1 << 20))
    for end in rounds:
        start = net.flat()

        def learn(batches, start=start):
            local, trained = Network.of(start), 0
            squares = {n: np.full(s, 1e-4, np.float32) for n, s in SHAPES.items()}
            for batch in batches:
                found, counts = words_in(batch.column(0))
                tokens, at = words.padded(words.tokens(found), counts)
                vectors, classes = words.vector_of[tokens], words.class_of[tokens]
                at = np.random.default_rng(len(at)).permutation(at)
                while len(at):
                    n = min(STEP, max(STEP // 16, trained // 16))  # steps grow with what is known
                    local.train(vectors, classes, at[:n], squares)
                    trained, at = trained + len(at[:n]), at[n:]
            if trained:
                for k, block in enumerate(np.array_split(local.flat(), BLOCKS)):
                    yield pa.RecordBatch.from_pylist([{"block": k, "part": TaskContext.get().partitionId(), "n": trained, "weights": block.tobytes()}], schema=to_arrow_schema(schema))
            squares.clear()
            release()

        parts = max(1, round(tokens * (end - before) / part))
        dealt = rows.where((dice >= before) & (dice < end)).select(text, F.xxhash64("_id", "_h").alias("_order"))
        dealt = dealt.repartitionById(parts, F.pmod("_order", F.lit(parts)).cast("int")).sortWithinPartitions("_order").select(text_col)
        mean = averaged(dealt.mapInArrow(learn, schema), parts)
        net, before = net if mean is None else Network.of(mean), end
    return net


def score(docs: DataFrame, net: Network, words: Vocabulary, counts: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``log_likelihood`` (sum over all tokens) and ``mean_log_likelihood`` (null without tokens).

    A known word has its class's probability times its share of it. For any other word the share is its count in ``counts``,
    one for all unseen words together; where it stands c times in ``docs`` between the same two words, the other places
    predict it with MEMORY * (c - 1) / C instead, C being all such repeated places of these two neighbours. Both are joined
    by 64 bits of hash. Words counted once, and unseen ones, add log 1 and need no partner.

    Null, empty and blank texts have no token and a sum of 0. Whole texts of any length are scored; each text is summed on
    its own, so repeated rows get equal scores. An empty table gives an empty result. A kept column with the name of an
    added one gives way to it.
    """
    long, weights = T.LongType(), net.flat()
    kept = [c for c in keep if c.lower() not in ("n_tokens", "log_likelihood", "mean_log_likelihood")]
    own = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("own")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), own, F.col(f"`{text_col}`").alias("text"))
    place_type = T.ArrayType(T.StructType([T.StructField("p", long), T.StructField("pair", long), T.StructField("w", long), T.StructField("b", long)]))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("n_tokens", long), T.StructField("base", long), T.StructField("at", place_type)])

    def run(batches):
        local, out, digest = Network.of(weights), to_arrow_schema(schema), xxhash.xxh64_intdigest
        item = out.field("at").type.value_type
        for batch in batches:
            for a, b in slices(pc.utf8_length(batch.column(2)).to_pylist()):
                found, counts = words_in(batch.column(2).slice(a, b - a))
                tokens, at = words.padded(words.tokens(found), counts)
                logs = np.rint((local.log_probabilities(words.vector_of[tokens], words.class_of[tokens], at) + words.share[tokens[at]]) / UNIT).astype(np.int64)
                mine = np.flatnonzero(tokens[at] >= words.n)
                # neighbours within the text; none is an empty word
                ends = np.cumsum(counts)
                owner = np.searchsorted(ends, mine, side="right")
                near = [pa.array(np.where(there, mine + step, -1), mask=~there) for step, there in ((-1, mine > (ends - counts)[owner]), (1, mine + 1 < ends[owner]))]
                left, right = (pc.fill_null(found.take(x), b"").to_pylist() for x in near)
                rare = found.take(pa.array(mine)).dictionary_encode()
                names = rare.dictionary.to_pylist()
                hashes = np.array([digest(w, 42) for w in names], np.uint64)
                pairs = [digest(x + b" " + y, 43) for x, y in zip(left, right)]
                spots = [digest(names[i], pair) for i, pair in zip(rare.indices.to_pylist(), pairs)]
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                items = pa.StructArray.from_arrays([signed(spots), signed(pairs), signed(hashes[rare.indices.to_numpy()]), pa.array(logs[mine])], fields=list(item))
                cuts = pa.array(np.searchsorted(mine, np.concatenate(([0], ends))).astype(np.int32))
                made = [pa.array(counts), pa.array(sums_of(logs, counts)), pa.ListArray.from_arrays(cuts, items, type=out.field("at").type)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1)), *made], schema=out)
        release()

    limit_batches(docs.sparkSession)
    rows = materialize(rows.mapInArrow(run, schema), "lm-rows")
    spark, paths = docs.sparkSession, []

    def write(df: DataFrame, name: str) -> DataFrame:
        paths.append(fresh_path(spark, name))
        return materialize(df, name, paths[-1])

    whole = lambda x: F.round(x / F.lit(UNIT)).cast("long")
    logs = write(rare_counts(counts, words), "lm-logs")
    places = rows.select("row", F.explode("at").alias("a")).select("row", "a.*")
    often = write(places.groupBy("p").agg(F.count(F.lit(1)).alias("c"), F.first("pair").alias("pair"), F.first("w").alias("w")).where("c > 1"), "lm-places")
    around = write(often.groupBy("pair").agg(F.sum("c").alias("all")), "lm-pairs")
    told = often.join(around, "pair").join(logs, "w", "left")
    told = told.select(F.col("p").alias("key"), (whole(F.log(F.lit(MEMORY) * (F.col("c") - 1) / F.col("all"))) - F.coalesce("log_n", F.lit(0)) - whole(F.log(F.lit(1 - MEMORY)))).alias("log"))
    values = write(logs.where("log_n > 0").select(F.col("w").alias("key"), F.col("log_n").alias("log")).unionByName(told), "lm-values")
    # each rare token asks for its word's count, and for its place; what a place adds replaces what the word had
    asks = places.select("row", F.col("w").alias("key"), F.lit(1).cast("long").alias("k"), F.lit(0).cast("long").alias("less"))
    asks = asks.unionByName(places.select("row", F.col("p").alias("key"), F.lit(1).cast("long").alias("k"), F.col("b").alias("less")))
    more = asks.join(values, "key").groupBy("row").agg(F.sum(F.col("k") * F.col("log") - F.col("less")).alias("more"))
    more = materialize(more, "lm-more")
    for path in paths:
        drop_path(spark, path)
    forgotten = F.size("at") * whole(F.log(F.lit(1 - MEMORY)))
    total = (F.col("base") + forgotten + F.coalesce("more", F.lit(0))) * F.lit(UNIT)
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    return rows.join(more, "row", "left").select(*[F.col(f"own.`{c}`").alias(c) for c in kept], "n_tokens", total.alias("log_likelihood"), mean.alias("mean_log_likelihood"))


def rare_counts(counts: DataFrame, words: Vocabulary) -> DataFrame:
    """``(w, log_n)``: hashes of the words that are not known and log of their counts, in units."""
    schema = T.StructType([T.StructField("w", T.LongType()), T.StructField("log_n", T.LongType())])

    def run(batches):
        out, known = to_arrow_schema(schema), set(words.words.to_pylist())
        for batch in batches:
            pairs = [(xxhash.xxh64_intdigest(w, 42), n) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()) if w not in known]
            hashes, logs = np.array([w for w, _ in pairs], np.uint64).view(np.int64), np.log(np.array([n for _, n in pairs], np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.rint(logs / UNIT).astype(np.int64))], schema=out)

    return counts.where("n > 1").mapInArrow(run, schema)


def op4(docs: DataFrame) -> DataFrame:
    path = fresh_path(docs.sparkSession, "lm-words")
    counts = materialize(word_counts(docs), "lm-words", path)
    words, tokens = vocabulary(counts), counts.agg(F.sum("n")).first()[0] or 0
    out = score(docs.select("doc_id", "text"), fit(docs, words, tokens), words, counts, ["doc_id"])
    drop_path(docs.sparkSession, path)  # what the scores still read is written
    return out
