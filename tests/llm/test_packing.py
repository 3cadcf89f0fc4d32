import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltstone.llm import packing, wordtok

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, size):
    """Best-fit decreasing, one piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [(g, i) for i, g in enumerate(gaps) if g >= n]
        if fit:
            gaps[min(fit)[1]] -= n
        else:
            gaps.append(size - n)
    return sorted(gaps)


def layout(got, size):
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return seqs


@pytest.mark.parametrize("seed", range(30))
def test_one_range_is_best_fit(seed):
    rnd = random.Random(seed)
    size = rnd.choice([10, 64, 100])
    lengths = sorted((min(size, max(1, int(rnd.gammavariate(1.2, size / 4)))) for _ in range(rnd.choice([1, 50, 700]))), reverse=True)
    placed, free, ready = packing.sweep(lengths, [None] * len(lengths), size, 0)
    assert sorted(g for g, _, _ in free) == [g for g in one_by_one(lengths, size) if g]
    assert all(gap >= n for n, (_, gap) in zip(lengths, placed)) and all(g >= lengths[-1] for g, _, _ in free[:ready])


@pytest.mark.parametrize("seed", range(30))
def test_brackets_give_each_piece_its_own_gap_from_above(seed):
    rnd = random.Random(seed)
    ranges = [(p, rnd.randint(0, 5), rnd.randint(0, 5)) for p in range(rnd.randint(1, 9))]
    runs, taken = packing.brackets(ranges)
    assert sum(r[2] for r in runs) == sum(r[1] for r in ranges)
    used = [(q, b + k) for _, _, n, q, b in runs if q >= 0 for k in range(n)]
    assert len(used) == len(set(used)) and all(k < taken[q] <= dict((p, g) for p, _, g in ranges)[q] for q, k in used)
    assert all(q < p for p, _, _, q, _ in runs)
    open_, without = 0, 0
    for _, pieces, gaps in ranges:
        without += max(0, pieces - open_)
        open_ = max(0, open_ - pieces) + gaps
    assert sum(r[2] for r in runs if r[3] < 0) == without


@pytest.mark.parametrize(("kind", "size"), [("mixed", 2048), ("short", 2048), ("thirds", 90), ("ones", 64)])
def test_rounds_pack_about_as_well_as_one_by_one(spark, kind, size, monkeypatch):
    monkeypatch.setattr(packing, "LAST", 60)
    rnd = random.Random(kind)
    make = {"mixed": lambda: min(size, max(1, int(rnd.lognormvariate(6, 1.5)))), "short": lambda: rnd.randint(1, 30), "equal": lambda: 10, "thirds": lambda: rnd.randint(26, 34), "large": lambda: rnd.randint(26, 50), "ones": lambda: rnd.choice([1, 64])}[kind]
    lengths = [make() for _ in range(2000)]
    cut = spark.createDataFrame([(i, n, i) for i, n in enumerate(lengths)], "id long, length long, offset long")
    got = packing.pack(cut, ["id"], size).collect()
    assert sorted((r.id, r.length) for r in got) == list(enumerate(lengths))
    assert len(layout(got, size)) <= len(one_by_one(lengths, size)) * 1.01 + 2


def check(rows, got, size=2048):
    plain, want = Tokenizer.from_file(PATH), defaultdict(int)
    for doc_id, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), size)):
            part = np.array(ids[s : s + size], "<u4")
            want[doc_id, p, s, len(part), zlib.crc32(part.tobytes())] += 1
    have = defaultdict(int)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert have == want
    return len(layout(got, size)), sum(r.length for r in got)


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, tokens = check([(r.doc_id, r.text) for r in docs.collect()], packing.op9(docs).collect())
    assert n <= tokens / 2048 + 2


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 9000), (3, "word " * 9000), (4, "x")] + [(5, "same text")] * 300
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, length int, piece int")
    check(rows, packing.op9(docs).collect())
    assert packing.op9(docs.limit(0)).collect() == []


def test_plain_words_skip_the_steps_of_the_file(monkeypatch):
    """Ids as by the library on whole texts, though most words don't go through the file's normalizer and cuts."""
    rnd, library = random.Random(3), Tokenizer.from_file(PATH)
    letters = "abcdefgzABCZ" + "éÉßÿÀÖØøñ"
    words = ["".join(rnd.choices(letters, k=rnd.randint(1, 12))) + "".join(rnd.choices(".,;:!?)#$%&*", k=rnd.choice([0, 0, 1, 3]))) for _ in range(4000)]
    odd = ["it's", "we'll,", "e\u0301a", "É\u0301", "µm", "×", "a×b", "İx", "ŒŒ", "ªº", "a1b2", "a|b", "|", "<|endoftext|>", "a.b", ".a", "ſt", "ﬁn", "жук,", "漢字", "a\u00a0b", "a\u2003b", "x\u0300", "\u200b", "ΣΑΣ"]
    words += odd * 3
    rnd.shuffle(words)
    texts = [" ".join(words[k : k + 40]) for k in range(0, len(words), 40)] + ["", None]
    encoder, long = wordtok.WordEncoder(PATH), []
    encode = encoder.encode_long
    monkeypatch.setattr(encoder, "encode_long", lambda w: long.extend(w) or encode(w))
    ids, counts = encoder.encode(texts)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert 0 < len(long) < 100
