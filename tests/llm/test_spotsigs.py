import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import spotsigs


def brute_signatures(text):
    words = re.sub(r"[^\w]+|_+", " ", (text or "").lower()).split()
    pieces = [([], [])]  # run of anchors, content words up to the next run
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS and i < len(words) - 1:
            if pieces[-1][1] or len(pieces) == 1:
                pieces.append(([], []))
            pieces[-1][0].append(w)
        else:
            pieces[-1][1].append(w)
    out = set()
    for i, (run, content) in enumerate(pieces):
        follower = pieces[i + 1][1][0] if i + 1 < len(pieces) else ""
        two = " ".join(content[:2]) if len(content) > 1 else f"{content[0] if content else ''} {follower}"
        out.add(xxhash.xxh64_intdigest(two.encode(), xxhash.xxh64_intdigest("".join(r + " " for r in run).encode(), 42)))
        far = content[spotsigs.ALONE :]
        out |= {xxhash.xxh64_intdigest(y.encode(), xxhash.xxh64_intdigest(x.encode(), 42)) for x, y in zip(far, far[1:])}
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute(rows):
    seen = sorted(set((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), len(r[1]), xxhash.xxh64_intdigest(r[1].encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(r[1].encode(), 42) >> 63)))
    count, out = Counter((k, t or "") for k, t in rows), []
    for i, (k, t) in enumerate(seen):
        nxt = seen[(i + 1) % len(seen)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        a, b, c = map(brute_signatures, (t, edited, nxt))
        out += [(k, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(a, b), 9), round(jaccard(a, c), 9), len(a))] * count[k, t]
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9), r.n_signatures) for r in df.collect())


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = spotsigs.op7(docs)
    assert result(got) == brute([(r.doc_id, r.text) for r in docs.collect()])
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("rows", [
    [(5, None), (3, ""), (9, "The quick é brown"), (9, "The quick é brown"), (9, "of the"), (None, "und der Hund"), (-2, "word " * 30_000), (0, "!!! ???"), (21, "the of " * 30_000), (22, "the of " * 20_000 + "x" * 100_000 + " y the")],
    [(1, "a single one of the rows")],
    [],
])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, h string, n int")
    assert result(spotsigs.op7(docs)) == brute(rows)


def test_near_copies_match_all_pairs(spark):
    rnd = random.Random(2)
    base = [" ".join(rnd.choice(["the", "of", "und", "la", "stone", "river", "hill", "tree", "bird", f"w{rnd.randint(0, 400)}"]) for _ in range(rnd.choice([12, 60, 150]))) for _ in range(40)]
    texts = base + [" ".join(w if rnd.random() > 0.03 else "changed" for w in t.split()) for t in base * 2] + base[:5] + ["", None, "?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [brute_signatures(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            a, b = sorted((root(i), root(j)))
            label[b] = a
    got = {r.doc_id: r.class_id for r in spotsigs.near_copies(docs).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    assert spotsigs.near_copies(docs.limit(0)).collect() == []


def test_equal_sets_have_equal_fingerprints(spark):
    docs = spark.createDataFrame([(1, "The cat sat on the mat"), (2, "The cat sat on the mat"), (3, "A dog")], "doc_id long, text string")
    got = {r.doc_id: r.f for r in docs.select("doc_id", spotsigs.digest(spotsigs.signatures(F.col("text"))).alias("f")).collect()}
    assert got[1] == got[2] != got[3]


def test_texts_without_anchors_are_compared_whole(spark):
    words = [f"слово{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:2] + [f"другое{i}" for i in range(58)]), " ".join(words[:30] + ["новое"] + words[31:]), "x = y", "x = z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: set(r.s) for r in docs.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    assert len(got[0]) == 52 and jaccard(got[0], got[1]) < 0.1 and 0.9 < jaccard(got[0], got[2]) < 1 and got[3] != got[4]
    classes = {r.doc_id: r.class_id for r in spotsigs.near_copies(docs).collect()}
    assert classes == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}


def test_one_anchor_changes_only_the_words_around_it(spark):
    words = [f"слово{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words[:150] + ["de"] + words[150:]), " ".join(words[:150] + ["de"] + words[150:250] + ["новое"] + words[251:])]
    got = [set(r.s) for r in spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").orderBy("doc_id").select(spotsigs.signatures(F.col("text")).alias("s")).collect()]
    assert all(g == {h - (1 << 64) * (h >> 63) for h in brute_signatures(t)} for g, t in zip(got, texts))
    assert len(got[1]) > 270 and jaccard(got[0], got[1]) > 0.9 and jaccard(got[1], got[2]) > 0.95
