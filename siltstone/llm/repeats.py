"""Repeated passages by common-prefix intervals of an enhanced suffix array.

Every byte covered by a string of LEAST bytes that also starts elsewhere is removed. Content-chosen anchors (winnowed 64-byte
grams; every string of LEAST bytes has one, and equal strings have the same at the same distance) bring together the places
that can share such a string. The suffix array is sparse: it holds the suffixes that start at anchors, one array for each
anchor gram. Each suffix has a context, the bytes around its anchor that such strings can reach, and how often that context
occurs. A stack scan of the common prefixes gives the interval tree; where intervals close, the left extensions of their
suffixes are tested: two suffixes of different children are a maximal repeat, as long as their right and left extension
together. A context that occurs more than once is a leaf with several occurrences, a repeat from end to end, and its places
follow without its text; only anchors with differing contexts are gathered. Anchors with more than GROUP differing contexts
are split by the next bytes: two places that share a string share the bytes common to a window of distances from its start
to the anchor, so each window is a smaller group for the same tree; a window of one distance is one string, which needs
only a count.

Whether two contexts are equal is judged by 128 bits of hashes, 64 of the gram and 64 of the context; whether strings of
differing contexts are equal, by their bytes (by 64 bits of hash in groups that are split).
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.llm.common import map_texts, release
from siltstone.session import drop_path, fresh_path, materialize

LEAST, GRAM = 200, 64
#: Contexts of one group that a task may hold; distances in a window, from split to split; rows of a task handed on at once.
GROUP, WINDOWS, ROWS = 1 << 16, (18, 3, 1), 1024
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_table(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of BASE and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        _POWERS[:] = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64)))) for x in (BASE, INVERSE)]
    return _POWERS


class Hashes:
    """64-bit hashes of any substring of some bytes, from one pass of prefix sums."""

    def __init__(self, data: np.ndarray):
        powers, self.inverses = power_table(len(data) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[data] * powers[: len(data)])))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverses[starts])


def slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every window of ``width`` values."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, least: int = LEAST, gram: int = GRAM):
    """Positions, gram hashes and context hashes of the anchors of one text of at least ``least`` bytes."""
    n, width = len(data), least - gram + 1
    hashes = Hashes(data)
    at = np.arange(n - gram + 1)
    h = hashes.of(at, at + gram)
    low = slide(h, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(slide(np.concatenate((edge, low, edge)), width, np.maximum) == h)
    left, right = np.maximum(chosen - (least - gram), 0), np.minimum(chosen + least, n)
    shape = (chosen - left).astype(np.uint64) * np.uint64(4 * least) + (right - chosen).astype(np.uint64)
    return chosen, h[chosen], mix(hashes.of(left, right) + shape * BASE)


def reaches(lefts: list[bytes], rights: list[bytes], least: int):
    """``(x, y, l, r)`` for contexts x and y that share the ``l`` bytes before and the ``r`` bytes from the anchor on, ``l + r >= least``.

    ``lefts`` end and ``rights`` start at the anchor. The right parts are sorted, and a stack scan of their common prefixes
    builds the interval tree bottom-up. Where intervals become one, its suffixes are kept in the order of their left parts
    read backwards; each suffix of the smaller child meets its neighbours there. No other pair can share more: a neighbour
    from the same child shares as much to the left and more to the right. So for every suffix the longest strings that
    it shares with any other are among the pairs given.
    """
    k, wide, high = len(lefts), max(map(len, lefts), default=0), max(map(len, rights), default=0)
    n_left, n_right = list(map(len, lefts)), list(map(len, rights))
    left = [int.from_bytes(x.rjust(wide, b"\0"), "little") for x in lefts]  # the byte next to the anchor weighs most
    right = [int.from_bytes(x.ljust(high, b"\0"), "big") for x in rights]
    order = sorted(range(k), key=lambda i: (right[i], n_right[i]))
    by_left = sorted(range(k), key=lambda i: (left[i], n_left[i]))
    rank = [0] * k
    for r, i in enumerate(by_left):
        rank[i] = r
    stack: list[tuple[int, list[int]]] = []
    for at, i in enumerate(order):
        ahead = 0
        if at + 1 < k:
            j = order[at + 1]
            ahead = min(high - ((right[i] ^ right[j]).bit_length() + 7 >> 3), n_right[i], n_right[j])
            if ahead + wide < least:
                ahead = 0
        mine = [rank[i]]
        while stack and stack[-1][0] >= ahead:
            r, other = stack.pop()
            big, small = (other, mine) if len(other) >= len(mine) else (mine, other)
            need = least - r
            for x in small:
                p = bisect.bisect(big, x)
                u = by_left[x]
                for q in (p - 1, p):
                    if 0 <= q < len(big):
                        v = by_left[big[q]]
                        l = min(wide - ((left[u] ^ left[v]).bit_length() + 7 >> 3), n_left[u], n_left[v])
                        if l >= need:
                            yield u, v, l, r
                big.insert(p, x)
            mine = big
        if ahead:
            stack.append((ahead, mine))


def reach(lefts: list[bytes], rights: list[bytes], least: int) -> list[tuple[int, int]]:
    """For each context how far the strings of ``least`` bytes or more that it shares reach to the left and right of the anchor."""
    far_left, far_right = [0] * len(lefts), [0] * len(lefts)
    for x, y, l, r in reaches(lefts, rights, least):
        for i in (x, y):
            if l > far_left[i]:
                far_left[i] = l
            if r > far_right[i]:
                far_right[i] = r
    return list(zip(far_left, far_right))


def maximal(lefts: list[bytes], rights: list[bytes], least: int, times: list[int]):
    """Groups ``(l, r, members)`` of the maximal repeats around an anchor, all members included; ``times`` says how often each context occurs.

    A pair is a maximal repeat if its right extension ends where the two differ (they come from different children of the
    interval) and so does the left one. A context that occurs more than once is a group of its own.
    """
    wanted: dict[tuple[int, int], set] = {}
    for x, y, l, r in reaches(lefts, rights, least):
        if lefts[x][: len(lefts[x]) - l][-1:] == lefts[y][: len(lefts[y]) - l][-1:] != b"" or rights[x][r : r + 1] == rights[y][r : r + 1] != b"":
            continue
        wanted.setdefault((l, r), set()).add((lefts[x][len(lefts[x]) - l :], rights[x][:r]))
    for i, n in enumerate(times):
        if n > 1 and len(lefts[i]) + len(rights[i]) >= least:
            wanted.setdefault((len(lefts[i]), len(rights[i])), set()).add((lefts[i], rights[i]))
    for (l, r), strings in sorted(wanted.items()):
        groups: dict[tuple, list[int]] = {}
        for i, (a, b) in enumerate(zip(lefts, rights)):
            if len(a) >= l and len(b) >= r and (key := (a[len(a) - l :], b[:r])) in strings:
                groups.setdefault(key, []).append(i)
        for _, members in sorted(groups.items()):
            yield l, r, members


def merged(starts, ends) -> list[tuple[int, int]]:
    """Overlapping or touching stretches as one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(map(int, starts), map(int, ends))):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


LONG, INT, BIN = T.LongType(), T.IntegerType(), T.BinaryType()
FOUND = T.StructType([T.StructField("h", LONG), T.StructField("c", LONG), T.StructField("pos", INT)])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(k, t, text, row)``: ``k`` and ``t`` tell rows apart; ``row`` holds the other columns and the id, whatever their names.

    ``t`` is 64 bits of hash of the text, ``k`` the id; of a null id, or one that is no whole number, 64 bits of another hash of
    the id and the text. Repeated rows have one key and equal results.
    """
    number = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    other = F.xxhash64(F.lit(11), f"`{text_col}`", f"`{id_col}`")
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), other) if number else other
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")
    text = F.col(f"`{text_col}`")
    return docs.select(key.alias("k"), F.xxhash64(text, F.isnull(f"`{id_col}`")).alias("t"), text.alias("text"), row)


def same_key(a: DataFrame, b: DataFrame):
    return a["k"].eqNullSafe(b["k"]) & (a["t"] == b["t"])


class Anchors:
    """Written tables of one run: places of anchors that repeat, their contexts, and those to be gathered.

    These are the contexts of anchors where they differ and one of them occurs once; with ``every`` all contexts.
    """

    def __init__(self, texts: DataFrame, least: int, every: bool = False):
        self.spark, self.texts, self.least, self.reach = texts.sparkSession, texts, least, least - GRAM
        if self.reach < 1:
            raise ValueError(f"least must be over {GRAM}")

        def find():
            def call(some):
                out = {"n": [], "h": [], "c": [], "pos": []}
                for text in some:
                    data = np.frombuffer((text or "").encode(), np.uint8)
                    if len(data) < least:
                        out["n"].append(0)
                        continue
                    pos, h, c = anchors(data, least)
                    out["n"].append(len(pos))
                    for name, x in (("h", h.view(np.int64)), ("c", c.view(np.int64)), ("pos", pos)):
                        out[name].append(x)
                for name in ("h", "c", "pos"):
                    out[name] = np.concatenate([np.zeros(0, np.int64), *out[name]])
                out["pos"] = out["pos"].astype(np.int32)
                return out

            return call

        self.paths: list[str] = []
        found = self.write(map_texts(texts, ["k", "t"], "text", find, FOUND, multi="n"), "repeat-anchors")
        # every aggregate is written before it is joined: both sides of the joins are plain exchanges then, which Spark splits where a key is hot
        again = self.write(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeat-again")
        self.places = self.write(found.join(again, "h", "left_semi"), "repeat-places")
        self.drop(2)  # only anchors that repeat are read from here on
        one = [F.first(c).alias(c) for c in ("k", "t", "pos")]  # of equal contexts any one stands for all
        self.contexts = self.write(self.places.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), *one), "repeat-contexts")
        counts = self.contexts.groupBy("h").agg(F.count(F.lit(1)).alias("differing"), F.min("n").alias("fewest"))
        self.mixed = self.write(counts.where("true" if every else "differing > 1 and fewest = 1").select("h", "differing"), "repeat-mixed")
        self.open = self.write(self.contexts.join(self.mixed, "h"), "repeat-open")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(fresh_path(self.spark, name))
        return materialize(df, name, self.paths[-1])

    def drop(self, n: int) -> None:
        """Delete the first ``n`` of the written tables."""
        for path in self.paths[:n]:
            drop_path(self.spark, path)
        del self.paths[:n]

    def cut(self) -> DataFrame:
        """``(g, differing, h, c, n, k, t, pos, left, right)``: the bytes on both sides of the anchors in ``open``."""
        reach, least, names = self.reach, self.least, ("h", "c", "n", "differing", "pos")
        asked = self.open.groupBy("k", "t").agg(F.collect_list(F.struct(*names)).alias("asked"))  # as many as a text has anchors at most
        fields = {f.name: f for f in self.open.schema.fields}
        schema = T.StructType([T.StructField("g", LONG), *[fields[c] for c in ("differing", "h", "c", "n", "k", "t", "pos")], T.StructField("left", BIN), T.StructField("right", BIN)])

        def run(batches):
            out, last = to_arrow_schema(schema), None
            for batch in batches:
                keys = list(zip(batch.column("k").to_pylist(), batch.column("t").to_pylist()))
                fresh = [i for i, key in enumerate(keys) if key != (keys[i - 1] if i else last)]  # repeated rows stand together, one of them is enough
                last = keys[-1] if keys else last
                batch = batch.take(pa.array(fresh, pa.int64()))
                if not batch.num_rows:
                    continue
                asked = batch.column("asked")
                owner = pc.list_parent_indices(asked)
                parts = dict(zip((f.name for f in asked.type.value_type), asked.flatten().flatten()))
                raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
                at = list(zip(owner.to_pylist(), parts["pos"].to_pylist()))
                parts |= {"left": pa.array([raw[i][max(0, p - reach) : p] for i, p in at], pa.binary()), "right": pa.array([raw[i][p : p + least] for i, p in at], pa.binary())}
                parts |= {c: batch.column(c).take(owner) for c in ("k", "t")} | {"g": parts["h"]}
                yield pa.RecordBatch.from_arrays([parts[f.name].cast(f.type) for f in out], schema=out)

        texts = self.texts
        return texts.join(asked, same_key(texts, asked)).select(texts["k"], texts["t"], "text", "asked").mapInArrow(run, schema)


def by_group(rows: DataFrame, schema: T.StructType, call) -> DataFrame:
    """``call`` on the distinct contexts of each ``g``, each at most GROUP; it returns rows of ``schema``."""
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ("k", "t", "pos", "h", "c", "n", "left", "right")

    def run(batches):
        out, held, last, made = to_arrow_schema(schema), {}, None, []

        def hand_on():
            columns = list(zip(*made)) or [[]] * len(out)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)
            made.clear()
            return batch

        for batch in batches:
            for g, row in zip(batch.column("g").to_pylist(), zip(*(batch.column(c).to_pylist() for c in names))):
                if g != last and held:
                    made += call(list(held.values()))
                    held = {}
                    if len(made) >= ROWS:
                        yield hand_on()
                last = g
                held[row[:3]] = row
        if held:
            made += call(list(held.values()))
        yield hand_on()
        held.clear()
        release()

    return rows.repartition(n_parts, "g").sortWithinPartitions("g").mapInArrow(run, schema)


def own_distances(left: bytes, right: bytes, least: int) -> tuple[int, int]:
    """From and below which distance to the start of a string its least gram is this anchor; other strings have another anchor."""
    data = np.frombuffer(left + right, np.uint8)
    at = np.arange(len(data) - GRAM + 1)
    h = Hashes(data).of(at, at + GRAM)
    p, reach = len(left), least - GRAM
    lower = np.flatnonzero(h < h[p])
    before, after = lower[lower < p], lower[lower > p]
    from_ = max(0, reach - (int(after[0]) - p - 1)) if len(after) else 0
    return from_, min(reach, p - int(before[-1]) - 1 if len(before) else reach) + 1


def narrower(rows: DataFrame, window: int, before: int, least: int) -> DataFrame:
    """Rows dealt to windows of distances: ``d`` is the first distance of the window they were in, ``g`` the bytes all its strings share."""
    names = [f.name for f in rows.schema.fields]
    schema = T.StructType([*rows.schema.fields, *([] if "d" in names else [T.StructField("d", INT)])])

    def run(batches):
        out = to_arrow_schema(schema)
        for batch in batches:
            lists = {c: batch.column(c).to_pylist() for c in ("h", "left", "right")} | {"d": batch.column("d").to_pylist() if "d" in names else [0] * batch.num_rows}
            index, keys, first = [], [], []
            for i, (h, left, right, d) in enumerate(zip(*lists.values())):
                own, end = own_distances(left, right, least)
                for lo in range(d, min(d + before, end), window):
                    hi = min(lo + window, d + before, least - GRAM + 1)
                    if hi > own and len(left) >= lo and len(right) >= least - hi + 1:
                        index.append(i)
                        keys.append(xxhash.xxh3_64_intdigest(left[len(left) - lo :] + right[: least - hi + 1], (h ^ lo * 0x9E3779B1) & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                        first.append(lo)
            if index:
                part = batch.take(pa.array(index))
                columns = {c: part.column(c) for c in part.schema.names} | {"g": pa.array(keys, pa.int64()), "d": pa.array(first, pa.int32())}
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in out], schema=out)

    return rows.mapInArrow(run, schema)


def in_groups(found: Anchors, schema: T.StructType, call) -> tuple[list[DataFrame], DataFrame | None]:
    """``call`` over all groups of differing contexts, large ones split; and the rows of single strings that occur twice, if any were split so far."""
    rows = found.cut()
    made = [by_group(rows.where(F.col("differing") <= GROUP), schema, call)]
    if found.mixed.where(F.col("differing") > GROUP).isEmpty():
        return made, None
    rows, before = rows.where(F.col("differing") > GROUP).drop("differing"), found.reach + 1
    for window in WINDOWS:
        rows = found.write(narrower(rows, window, before, found.least), "repeat-windows")
        size = rows.groupBy("g").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("times"))
        if window == 1:
            twice = found.write(size.where("times > 1").select("g"), "repeat-strings")
            return made, rows.join(twice, "g", "left_semi")
        size = found.write(size.where("many > 1"), "repeat-sizes")
        made.append(by_group(rows.join(size.where(F.col("many") <= GROUP), "g", "left_semi"), schema, call))
        rows, before = rows.join(size.where(F.col("many") > GROUP), "g", "left_semi"), window
    return made, None


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(k, t, spans)``: byte stretches of each document (see ``keyed``) covered by strings of ``least`` bytes that start elsewhere too.

    Null and empty texts have none; texts of any length count whole; repeated rows have one entry, which holds for each of
    them; an empty table gives an empty result. Other columns are ignored. No result depends on the order of rows.
    """
    texts = keyed(docs.select(id_col, text_col), id_col, text_col).select("k", "t", "text")
    found = Anchors(texts, least)
    back = found.reach
    schema = T.StructType([*[f for f in texts.schema.fields if f.name in ("k", "t")], T.StructField("s", INT), T.StructField("e", INT)])

    def single(rows):
        """What a context that occurs once shares with others; those that occur more often are covered from end to end."""
        far = reach([r[6] for r in rows], [r[7] for r in rows], least)
        return [(r[0], r[1], r[2] - a, r[2] + b) for r, (a, b) in zip(rows, far) if r[5] == 1 and b]

    made, strings = in_groups(found, schema, single)
    # leaves with several occurrences; their ends are cut to the text later
    whole = found.places.join(found.contexts.where("n > 1").select("h", "c"), ["h", "c"], "left_semi").select("k", "t", (F.col("pos") - back).alias("s"), (F.col("pos") + least).alias("e"))
    for part in made:
        whole = whole.unionByName(part)
    if strings is not None:
        whole = whole.unionByName(strings.where("n = 1").select("k", "t", (F.col("pos") - F.col("d")).alias("s"), (F.col("pos") - F.col("d") + least).alias("e")))
    spans = materialize(whole.groupBy("k", "t").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "repeat-spans")  # a set: repeated rows add nothing
    found.drop(len(found.paths))
    return spans


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(anchor, string, length, id, start)``: maximal repeats with all their occurrences, one row each; bytes, starts from 0.

    A repeat that is longer than the context of an anchor (``2 * least - 64`` bytes) is given in overlapping groups, one for
    each of its anchors. In anchors with over GROUP differing contexts groups are those of the windows, and single strings
    of ``least`` bytes where these are large as well. Nulls, empty and repeated rows: as in ``repeated_spans``; each
    repeated row is an occurrence. The largest groups are only ever rows of a table.
    """
    texts = keyed(docs.select(id_col, text_col), id_col, text_col).select("k", "t", "text")
    found = Anchors(texts, least, every=True)
    schema = T.StructType([T.StructField("h", LONG), T.StructField("c", LONG), T.StructField("string", LONG), T.StructField("l", INT), T.StructField("length", INT)])

    def groups(rows):
        lefts, rights = [r[6] for r in rows], [r[7] for r in rows]
        for l, r, members in maximal(lefts, rights, least, [x[5] for x in rows]):
            text = lefts[members[0]][len(lefts[members[0]]) - l :] + rights[members[0]][:r]
            if l not in anchors(np.frombuffer(text, np.uint8), least)[0]:  # chosen for bytes outside the repeat, so other occurrences may lack this anchor
                continue
            string = xxhash.xxh3_64_intdigest(text, l) - (1 << 63)
            yield from ((rows[i][3], rows[i][4], string, l, l + r) for i in members)

    made, strings = in_groups(found, schema, lambda rows: list(groups(rows)))
    whole = made[0]
    for part in made[1:]:
        whole = whole.unionByName(part)
    if strings is not None:
        whole = whole.unionByName(strings.select("h", "c", F.col("g").alias("string"), F.col("d").alias("l"), F.lit(least).alias("length")))
    whole = materialize(whole.distinct(), "repeat-groups")
    ids = keyed(docs.select(id_col, text_col), id_col, text_col).select("k", "t", F.col(f"row.`{id_col}`").alias("_id")).distinct()
    return found.places.join(whole, ["h", "c"]).join(ids, ["k", "t"]).select(F.col("h").alias("anchor"), "string", "length", F.col("_id").alias(id_col), (F.col("pos") - F.col("l")).alias("start"))


def cut_out(raw: bytes, spans: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and its removed runs."""
    runs = [(max(0, a), min(len(raw), b)) for a, b in merged([s["s"] for s in spans or ()], [s["e"] for s in spans or ()])]
    left, at = [], 0
    for a, b in runs:
        left.append(raw[at:a])
        at = b
    return b"".join([*left, raw[at:]]), runs


def with_spans(docs: DataFrame, id_col: str, text_col: str, least: int, added: T.StructType, make) -> DataFrame:
    """``row`` and the columns that ``make(text, spans)`` returns, for every row."""
    spans = repeated_spans(docs, id_col, text_col, least)
    rows = keyed(docs, id_col, text_col)
    joined = rows.join(spans, same_key(rows, spans), "left").select("row", "text", "spans")
    schema = T.StructType([joined.schema["row"], *added.fields])

    def run(batches):
        out = to_arrow_schema(schema)
        for batch in batches:
            made = [make(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            columns = list(zip(*made)) or [[] for _ in added.fields]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, out.field(i + 1).type) for i, c in enumerate(columns))], schema=out)

    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", least: int = LEAST) -> DataFrame:
    """``docs`` with repeated bytes taken out of the texts; a character that loses some of its bytes goes whole.

    Null texts stay null, and a text that is repeated through and through becomes empty. Rows are never dropped; the length
    column, if there, follows the text. All other columns stay as they are, whatever their names. Repeated rows repeat each
    other, so their texts go. An empty table gives an empty result.
    """
    made = with_spans(docs, id_col, text_col, least, T.StructType([T.StructField("left", T.StringType())]), lambda t, s: (None if t is None else cut_out(t.encode(), s)[0].decode("utf-8", "ignore"),))
    fresh = {text_col: F.col("left"), length_col: F.char_length("left")}
    return made.select(*[fresh[c].cast(docs.schema[c].dataType).alias(c) if c in fresh else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6(docs: DataFrame) -> DataFrame:
    def make(text, spans):
        raw = (text or "").encode()
        left, runs = cut_out(raw, spans)
        return len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest()

    added = T.StructType([T.StructField(c, LONG) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])
    made = with_spans(docs.select("doc_id", "text"), "doc_id", "text", LEAST, added, make)
    return made.select("row.doc_id", *added.names)
