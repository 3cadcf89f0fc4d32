import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltstone.llm import rans, tokenfiles
from siltstone.llm.wordtok import WordEncoder
from siltstone.session import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, rans.BLOCK - 1, rans.BLOCK, rans.BLOCK * 2 + 777])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint32)
    made = rans.compress(ids)
    assert (rans.decompress(made["symbols"], made["freqs"], made["stream"], made["blocks"]) == ids).all()
    for block in made["blocks"]:  # any block alone
        some = rans.decompress(made["symbols"], made["freqs"], made["stream"], [block])
        assert (some == ids[block["first_token"] :][: block["n_tokens"]]).all()


def test_one_symbol_and_many():
    for ids in (np.full(100_000, 7, np.uint32), np.arange(65_536, dtype=np.uint32), np.repeat(np.arange(60_000, dtype=np.uint32), 2)):
        made = rans.compress(ids)
        assert (rans.decompress(made["symbols"], made["freqs"], made["stream"], made["blocks"]) == ids).all()


def test_near_entropy():
    ids = np.random.default_rng(1).choice(50, 300_000, p=np.arange(1, 51) / 1275).astype(np.uint32)
    p = np.bincount(ids) / len(ids)
    assert len(rans.compress(ids)["stream"]) * 8 / len(ids) < -(p[p > 0] * np.log2(p[p > 0])).sum() * 1.01


def test_damage_is_seen():
    made = rans.compress(np.arange(5000, dtype=np.uint32) % 97)
    bad = bytearray(made["stream"])
    bad[100] ^= 1
    with pytest.raises(ValueError):
        rans.decompress(made["symbols"], made["freqs"], bytes(bad), made["blocks"])


def test_words_are_whole_texts():
    plain = Tokenizer.from_file(PATH)
    rnd = random.Random(5)
    alphabet = ["a", "B", "é", "é", "İ", "Σ", "ς", "|", "||", " | ", " ", "\x1c", "\x85", " ", "\n", "\t", " ", "  ", "'s", "<|endoftext|>", "<|", "9", "½", "中文", "\U0001f600", "don't", "...", "̈", "J\u030c", "Y\u030a", "I\u0307", "E\u0301", "‍", "x" * 300]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(600)] + [None, "", " ", "|"]
    ids, counts = WordEncoder(PATH).encode(texts)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for text, part in zip(texts, parts, strict=True):
        assert part.tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def brute(rows):
    plain, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(tuple(r) for r in tokenfiles.op1(docs).collect())
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 2), (3, "b c", 3), (None, "a", 4), (9, "word " * 70_000, 5), (9, "word " * 70_000, 5), (-4, "|", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    path = fresh_path(spark, "t")
    tokenfiles.write(docs, path, PATH, 2)
    got = tokenfiles.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -4, 3, 3, 5, 9, 9]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert got[0].ids[-1] == 2 and got[2].ids == [2] and got[4].ids == [2] and got[5].ids == got[6].ids
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfiles.op1(empty).collect() == []
