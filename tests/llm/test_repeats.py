import hashlib
import random
from collections import Counter

import pytest

from siltstone.llm import repeats


def brute_covered(texts, least):
    count = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if count[t[i : i + least]] > 1:
                mark[i : i + least] = b"\1" * least
        out.append(mark)
    return out


def contexts_of_one_anchor(seed):
    """Contexts that differ, all around the same anchor bytes."""
    rnd = random.Random(seed)
    some = lambda n: bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(0, n)))
    return sorted({(some(4), b"xyx" + some(5)) for _ in range(rnd.randint(1, 40))})


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(40))
def test_reach_and_maximal_repeats_match_all_pairs(seed):
    contexts, least = contexts_of_one_anchor(seed), 5
    lefts, rights = [a for a, _ in contexts], [b for _, b in contexts]
    want, groups = [(0, 0)] * len(contexts), set()
    for i in range(len(contexts)):
        for j in range(len(contexts)):
            l, r = shared(lefts[i][::-1], lefts[j][::-1]), shared(rights[i], rights[j])
            if i != j and l + r >= least:
                want[i] = (max(want[i][0], l), max(want[i][1], r))
                groups.add((l, r, tuple(k for k in range(len(contexts)) if lefts[k].endswith(lefts[i][len(lefts[i]) - l :]) and rights[k].startswith(rights[i][:r]))))
    assert repeats.reach(lefts, rights, least) == want
    got = {(l, r, tuple(m)) for l, r, m in repeats.maximal(lefts, rights, least, [1] * len(contexts))}
    # every longest repeat of a context is among the groups, every group is a maximal repeat with all its occurrences
    assert got <= groups
    for i, (l, r) in enumerate(want):
        assert not r or max(g[0] for g in got if i in g[2]) == l and max(g[1] for g in got if i in g[2]) == r


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh é") for _ in range(rnd.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rnd.randint(20, 90)) for _ in range(6)]
    docs = []
    for _ in range(120):
        parts = [text(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) // 2)
            parts += [s[a : a + rnd.randint(20, len(s))], text(rnd.randint(0, 30))]
        docs.append(" ".join(parts))
    docs += [docs[3]] * 5 + [docs[4][:300] + "X" + docs[4][300:]] + ["ab" * 500, "ab" * 400, "=" * 900, "q" * 199, "r" * 200, "s" * 201, "", None]
    return docs


@pytest.mark.parametrize("group", [repeats.GROUP, 2])
def test_query_matches_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    texts = corpus(1)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[9]), (7, texts[7]), (8, texts[11] + "!")]
    raw = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (doc_id, _), data, mark in zip(rows, raw, brute_covered(raw, 200)):
        left = bytes(b for b, m in zip(data, mark) if not m)
        runs = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        want[doc_id, len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest()] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in repeats.op6(docs).collect())
    assert got == want
    assert sum(r[2] > 0 for r in want) > 20


@pytest.mark.parametrize("group", [repeats.GROUP, 5])
def test_groups_list_all_occurrences(spark, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    texts = [t for t in dict.fromkeys(corpus(2)) if t]
    rows = repeats.repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    raw, groups = [t.encode() for t in texts], {}
    for r in rows:
        groups.setdefault((r.anchor, r.string, r.length), set()).add((r.doc_id, r.start))
    marks = [bytearray(len(t)) for t in raw]
    for (_, _, length), places in groups.items():
        strings = {raw[i][a : a + length] for i, a in places}
        assert len(strings) == 1 and length >= 200 and len(places) > 1
        s = strings.pop()
        assert places == {(i, a) for i, t in enumerate(raw) for a in range(len(t) - length + 1) if t.startswith(s, a)}
        for i, a in places:
            marks[i][a : a + length] = b"\1" * length
    assert marks == brute_covered(raw, 200)


def test_hot_keys_repeated_rows_and_clashing_names(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(400))
    rows = [(None, text, 1, 2, 3, "x")] * 40 + [(1, text, 1, 2, 3, "y"), (2, text[:260] + "!" * 30, 4, 5, 6, "z"), (3, "short", 7, 8, 9, None), (4, None, 0, 0, 0, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int, t int, row int, spans string")
    got = repeats.remove_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    assert {(r.doc_id, r.k, r.t, r.row, r.spans): r.text for r in got.collect()} == {(None, 1, 2, 3, "x"): "", (1, 1, 2, 3, "y"): "", (2, 4, 5, 6, "z"): "!" * 30, (3, 7, 8, 9, None): "short", (4, 0, 0, 0, "n"): None}


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    raw = [(r.text or "").encode() for r in rows]
    want = {r.doc_id: sum(m) for r, m in zip(rows, brute_covered(raw, 200))}
    assert {r.doc_id: r.n_removed for r in repeats.op6(docs).collect()} == want


def test_texts_keep_their_columns(spark):
    long = "The quick brown fox jumps over the lazy dog and runs. " * 3 + "".join(chr(200 + i % 50) for i in range(150))
    docs = spark.createDataFrame([(1, long + " one", "x", 5), (2, "two " + long, None, 5), (3, None, "y", 5), (3, "", "z", 5)], "doc_id long, text string, s string, n_chars long")
    got = {(r.doc_id, r.s): r for r in repeats.remove_repeats(docs).collect()}
    assert len(got[1, "x"].text) < 10 and got[2, None].text == "two " and got[3, "y"].text is None and got[3, "z"].n_chars == 0
    assert repeats.op6(docs.limit(0)).collect() == []


def test_rows_of_null_ids_are_told_apart(spark):
    """Rows without id whose texts have one 32-bit hash and a passage in common, at different places: only the passage goes."""
    from pyspark.sql import functions as F

    passage = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(900))
    made = spark.range(300_000).select(F.concat(F.repeat(F.lit("y"), (F.col("id") % 64).cast("int")), F.sha2(F.col("id").cast("string"), 256), F.lit(passage)).alias("text"))
    same = made.groupBy(F.hash("text", F.lit(True)).alias("x")).agg(F.min("text").alias("a"), F.max("text").alias("b")).where("length(a) <> length(b)").limit(2).collect()
    assert same
    texts = [t for r in same for t in (r.a, r.b)]
    want = Counter((len(t), sum(mark)) for t, mark in zip(texts, brute_covered([t.encode() for t in texts], 200)))
    got = repeats.op6(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")).collect()
    assert Counter((r.n_bytes, r.n_removed) for r in got) == want and max(r.n_removed for r in got) < 910
