import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from siltstone.llm import bytebpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(PATH), special_tokens={})


def test_random_texts(library):
    rnd = random.Random(3)
    alphabet = ["a", "the", "ing", "B", "é", "ß", " ", "  ", "\n", "\t", "'s", "'re", "0", "12", "½", "中文", "\U0001f600", "...", "!?", "_", " ", "\x00", "zq", "tion"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", "a" * 511, "ab" * 256, "ab" * 257, "abcde" * 3000, "é" * 2000, " " * 5000, "=" * 700, "q" * 40_001, "".join(rnd.choice("abcdehilnorstu") for _ in range(30_000)), "xyzzy" * 9000 + "a"]
    bpe = bytebpe.coder(PATH, P.PATTERN)
    ids, counts = bpe.encode(texts)
    for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert part.tolist() == library.encode_ordinary(text or ""), repr(text)[:80]
        assert bpe.decode(part).decode() == (text or "")


def test_query_matches_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = np.array(library.encode_ordinary(r.text or ""), "<u4")
        want[r.doc_id] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in bytebpe.op8(docs).collect()} == want


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, "x y", 7), (2, "x y", 7)], "doc_id long, text string, ids int")
    got = bytebpe.encode(docs, PATH, P.PATTERN, ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == [(0, 0), (1, 0), (2, 2), (2, 2)]
    assert bytebpe.op8(docs.limit(0)).collect() == []
    assert bytebpe.encode(docs, PATH, P.PATTERN, ["doc_id", "ids"]).columns == ["doc_id", "ids"]


def test_long_documents_through_spark(spark, library):
    texts = ["the quick brown fox " * 40_000, "abc" * 60_000, "é" * 50_000]
    want = {i: hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest() for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids_sha256 for r in bytebpe.op8(docs).collect()} == want


def test_pairs_of_a_row_of_its_own_merge_in_the_same_order(library):
    bpe, rnd = bytebpe.coder(PATH, P.PATTERN), random.Random(8)
    for _ in range(400):
        piece = "".join(rnd.choice(rnd.choice(["ab", "the", "aeionst", "0 =é"])) for _ in range(rnd.randint(2, 80))).encode()
        ids = bpe.of_byte[np.frombuffer(piece, np.uint8)]
        rows, counts = bpe.merge_rows(ids[None].copy(), np.array([len(piece)]))
        assert bpe.merge_alone(piece).tolist() == rows.tolist()


def small_ranks(rnd, orderly):
    """Ranks of single bytes and of a few dozen merges over two or three letters, in the order of merging or any."""
    known = [bytes([b]) for b in range(256)]
    letters = [bytes([c]) for c in b"abc"[: rnd.randint(2, 3)]]
    while len(known) < 256 + rnd.randint(4, 40):
        token = rnd.choice(letters + known[256:]) + rnd.choice(letters + known[256:])
        if token not in known and len(token) < 20:
            known.append(token)
    more = known[256:]
    if not orderly:
        rnd.shuffle(more)
    return {t: i for i, t in enumerate(known[:256] + more)}


@pytest.mark.parametrize("orderly", [True, False])
def test_any_ranks_file_merges_as_in_the_library(orderly):
    rnd = random.Random(11 + orderly)
    for _ in range(90):
        ranks = small_ranks(rnd, orderly)
        own = tiktoken.Encoding("x", pat_str="[a-z]+", mergeable_ranks=ranks, special_tokens={})
        bpe = bytebpe.ByteBpe(ranks, "[a-z]+")
        for _ in range(12):
            piece = "".join(rnd.choice(rnd.choice(["ab", "aab", "abc", "b"])) for _ in range(rnd.randint(2, 120))).encode()
            want = own.encode_ordinary(piece.decode())
            ids = bpe.of_byte[np.frombuffer(piece, np.uint8)]
            assert bpe.merge_rows(ids[None].copy(), np.array([len(piece)]))[0].tolist() == want or piece in ranks
            assert bpe.merge_alone(piece).tolist() == want or piece in ranks


def test_odd_runs_keep_their_last_pair():
    more = "bb bbb bbbbbb abb abbbbbbbb abbabbbbbbbb abbbbbbbbbbb bbbb abbabbbbbbbbbbb abbb abbabbbbbbbbbbbbbb bbbbbbbbbb bbbbbbbbbbbb aa abbbb abbbbb abbbbbbbbabbbb".split()
    ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + i for i, t in enumerate(more)}
    piece = b"bbbbbbbbbbaaaaaaababaaabaaaabbaaaaabaababbbabbab"
    own = tiktoken.Encoding("x", pat_str="[a-z]+", mergeable_ranks=ranks, special_tokens={})
    assert bytebpe.ByteBpe(ranks, "[a-z]+").merge_alone(piece).tolist() == own.encode_ordinary(piece.decode())
