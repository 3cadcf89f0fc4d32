import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import pseudolm as lm


def counted(texts):
    return Counter(w for t in texts for w in (t or "").encode().lower().split())


def a_vocabulary(texts, known):
    """The most frequent words of texts, and the classes of the others, by the definition."""
    counts = counted(texts)
    words = sorted(counts, key=lambda w: (-counts[w], w))[:known]
    others = [sum(n for w, n in counts.items() if w not in words and zlib.crc32(w) % lm.OTHER == k) for k in range(lm.OTHER)]
    return lm.Vocabulary(words, [counts[w] for w in words], others)


def brute_score(text, net, words, counts, places):
    """Sum of log p of all tokens: classes by the network, shares by counts, repeated places by all their other places."""
    known, w, total = words.words.to_pylist(), net.w, 0.0
    tokens = (text or "").encode().lower().split()
    number = [known.index(t) if t in known else words.n + zlib.crc32(t) % lm.OTHER for t in tokens]
    for i, token in enumerate(tokens):
        x = w["bias"].astype(float).copy()
        for k, o in enumerate(lm.OFFSETS):
            j = number[i + o] if 0 <= i + o < len(tokens) else words.blank
            x += w["embed"][words.vector_of[j]] * w["place"][k]
        p = np.exp(w["out"] @ (x / (1 + abs(x))) + w["out_bias"])
        log_p = math.log(p[words.class_of[number[i]]] / p.sum())
        if token in known:
            mates = [v for v in range(words.n) if words.class_of[v] == words.class_of[number[i]]]
            total += log_p + math.log(counts[token] / sum(counts[known[v]] for v in mates))
            continue
        pair = (tokens[i - 1] if i else b"", tokens[i + 1] if i + 1 < len(tokens) else b"")
        c = places[pair, token]
        if c > 1:
            total += math.log(lm.MEMORY * (c - 1) / sum(n for (q, t), n in places.items() if q == pair and n > 1 and t not in known))
        else:
            size = sum(n for t, n in counts.items() if t not in known and zlib.crc32(t) % lm.OTHER == zlib.crc32(token) % lm.OTHER)
            total += math.log(1 - lm.MEMORY) + log_p + math.log(max(counts[token], 1)) - math.log(size + 1)
    return len(tokens), total


@pytest.mark.parametrize("known", [0, 1, 7, 60])
def test_scores_match_brute_force(spark, known):
    rnd = random.Random(known)
    few = lambda n: " ".join(rnd.choices([f"w{i}" for i in range(40)] + ["The"] * 9, k=n))
    texts = ["The cat sat on the mat", "a", "", None, "und DER die\n der  ß x", "the the the", "the dog rare the"] + [few(rnd.randint(1, 30)) for _ in range(20)]
    texts += [texts[-1], "never seen " + texts[-2]]
    words, net, counts = a_vocabulary(texts[:-1], known), lm.Network.fresh(3), counted(texts[:-1])
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    places = Counter()
    for t in texts:
        row = [b"", *(t or "").encode().lower().split(), b""]
        places.update(((row[i - 1], row[i + 1]), row[i]) for i in range(1, len(row) - 1))
    got = {r.doc_id: r for r in lm.score(docs, net, words, lm.word_counts(docs.where(f"doc_id < {len(texts) - 1}")), ["doc_id", "n_tokens"]).collect()}
    for i, text in enumerate(texts):
        n, want = brute_score(text, net, words, counts, places)
        assert got[i].n_tokens == n and got[i].log_likelihood == pytest.approx(want, abs=1e-3)
        assert got[i].mean_log_likelihood == (pytest.approx(want / n, abs=1e-3) if n else None)


def test_gradient():
    rng = np.random.default_rng(0)
    vectors = np.concatenate([[9] * 2, rng.integers(0, 90, 40), [9] * 2]).astype(np.uint16)
    classes, at = np.concatenate([[0] * 2, rng.integers(0, lm.CLASSES, 40), [0] * 2]), np.arange(2, 42)
    net = lm.Network({n: x.astype(np.float64) for n, x in lm.Network.fresh(1).w.items()})
    before = {n: x.copy() for n, x in net.w.items()}
    squares = {n: np.zeros(s) for n, s in lm.SHAPES.items()}
    net.train(vectors, classes, at, squares)

    def loss(w):
        z = lm.Network(w).hidden(vectors, at) @ w["out"].T + w["out_bias"]
        return -(z[np.arange(40), classes[at]] - np.log(np.exp(z).sum(axis=1))).mean()

    for name, index in (("embed", (vectors[5], 3)), ("place", (1, 4)), ("bias", (2,)), ("out", (classes[7], 5)), ("out_bias", (1,))):
        losses = []
        for eps in (1e-5, -1e-5):
            w = {n: x.copy() for n, x in before.items()}
            w[name][index] += eps
            losses.append(loss(w))
        assert squares[name][index] ** 0.5 == pytest.approx(abs(losses[0] - losses[1]) / 2e-5, abs=1e-7)


@pytest.mark.parametrize("known", [1 << 18, 300, 5])
def test_vocabulary_counts_all(spark, sf_dir, monkeypatch, known):
    monkeypatch.setattr(lm, "COUNTED", 50)
    monkeypatch.setattr(lm, "KNOWN", known)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = counted([r.text for r in docs.collect()])
    got = lm.vocabulary(lm.word_counts(docs))
    want = sorted(counts, key=lambda w: (-counts[w], w))
    words = got.words.to_pylist()
    known_words = set(words)
    assert words == want[: got.n] and got.n <= known and (got.n == len(want)) == (known > len(want))
    for k in range(lm.OTHER):
        assert got.share[got.n + k] == pytest.approx(-math.log(1 + sum(n for w, n in counts.items() if w not in known_words and zlib.crc32(w) % lm.OTHER == k)))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "x " * 60_000), (2, "x " * 60_000)], "doc_id long, text string")
    got = lm.op4(docs).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 60_000, 60_000] and len({r.log_likelihood for r in got if r.n_tokens}) == 1
    assert lm.op4(docs.limit(0)).collect() == []
    assert [r.n_tokens for r in lm.op4(docs.limit(1)).collect()] == [0]


def test_junk_scores_below_known_words(spark):
    rnd = random.Random(5)
    known = [f"word{i}" for i in range(3000)]
    texts = [" ".join(rnd.choices(known, k=100)) for _ in range(300)] + [" ".join(f"{rnd.getrandbits(60):x}" for _ in range(100)) for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.mean_log_likelihood for r in lm.op4(docs).collect()}
    assert max(got[i] for i in range(300, 303)) < min(got[i] for i in range(300)) - 1


def test_every_token_is_a_target(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{c}{i % 5}" for c in "abcdefgh")) for i in range(8000)], "doc_id long, text string")
    counts = lm.word_counts(docs)
    words = lm.vocabulary(counts)
    net = lm.fit(docs, words, 64_000)
    found, counts = lm.words_in(pa.array([" ".join(f"{c}{k}" for c in "abcdefgh") for k in range(5)]))
    tokens, at = words.padded(words.tokens(found), counts)
    got = (net.log_probabilities(words.vector_of[tokens], words.class_of[tokens], at) + words.share[tokens[at]]).reshape(5, 8).mean(axis=0)
    assert got.min() > math.log(1 / 40) + 1


def test_production_parameters_beat_word_frequencies_on_held_out_texts(spark):
    rnd = random.Random(1)
    text = lambda: " ".join(f"a{k} b{k} c{k}" for k in (rnd.randint(0, 30) for _ in range(200)))
    docs = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string")
    counts = lm.word_counts(docs)
    words = lm.vocabulary(counts)
    net = lm.fit(docs, words, 360_000)
    held = spark.createDataFrame([(0, text()), (1, " ".join(sorted(text().split())))], "doc_id long, text string")
    good, shuffled = (r.mean_log_likelihood for r in lm.score(held, net, words, counts, ["doc_id"]).orderBy("doc_id").collect())
    assert good > math.log(1 / 93) + 1 and good > shuffled + 1


def test_equal_texts_have_equal_scores_wherever_they_stand(spark):
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choices(["the", "of", "a"] + [f"w{i}" for i in range(5000)], k=n))
    some = [text(rnd.randint(1, 90)) for _ in range(40)]
    docs = spark.createDataFrame([(i, rnd.choice(some) if rnd.random() < 0.5 else text(rnd.randint(0, 300))) for i in range(3000)], "doc_id long, text string").repartition(7)
    scores = {}
    for r in lm.op4(docs).join(docs, "doc_id").collect():
        scores.setdefault(r.text, set()).add(r.log_likelihood)
    assert all(len(x) == 1 for x in scores.values())


def test_sums_of_parts_in_steps(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 3)
    rng = np.random.default_rng(1)
    parts = [(p, n, rng.standard_normal(50).astype(np.float32)) for p, n in enumerate(rng.integers(1, 90, 20).tolist())]
    rows = [(k, p, n, block.tobytes()) for p, n, w in parts for k, block in enumerate(np.array_split(w, lm.BLOCKS))]
    got = lm.averaged(spark.createDataFrame(rows, "block int, part int, n long, weights binary"), 20)
    assert np.allclose(got, sum(n * w.astype(np.float64) for _, n, w in parts) / sum(n for _, n, _ in parts))


def test_documents_that_occur_twice_score_apart(spark):
    rnd = random.Random(6)
    part = lambda: rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"])
    text = lambda: " ".join(rnd.choice(["the", "of", "and"]) if rnd.random() < 0.4 else "".join(part() for _ in range(rnd.randint(3, 6))) for _ in range(80))
    rows = [text() for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(rows + rows[:40])), "doc_id long, text string")
    counts = lm.word_counts(docs)
    lm_known = lm.KNOWN
    lm.KNOWN = 2000
    try:
        words = lm.vocabulary(counts)
    finally:
        lm.KNOWN = lm_known
    got = {r.doc_id: r.mean_log_likelihood for r in lm.score(docs, lm.fit(docs, words, 50_000), words, counts, ["doc_id"]).collect()}
    once = sorted(got[i] for i in range(40, 600))
    assert sum(got[i] > once[504] for i in range(40)) >= 36


def test_words_are_those_of_bytes():
    texts = ["", None, "  ", " a  B\tc\x0bd\x0ce\rf\ng ", "É é\u00a0x\u2003y ÀB", "\x1c\x1d a\x85b", "one", "a" * 5000 + " " + "b" * 70_000]
    found, counts = lm.words_in(pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in want] and found.to_pylist() == [w for ws in want for w in ws]
    assert lm.words_in(pa.array([], pa.string()))[1].tolist() == []


def test_words_are_counted_in_bounded_tables(spark, monkeypatch):
    """Counts are those of all words, however often a task merges and hands on; no words are turned into Python objects for it."""
    texts = [" ".join(f"W{(i * j) % 97} é{j % 5}" for j in range(1, 30)) for i in range(200)] + ["", None, "  "]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    want = Counter(w for t in texts for w in (t or "").lower().encode().split())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        for most in (20, 150, 100_000):
            monkeypatch.setattr(lm, "COUNTED", most)
            assert {bytes(r.word): r.n for r in lm.word_counts(docs).collect()} == want
        assert lm.word_counts(docs.limit(0)).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "Counter" not in vars(lm)
