import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, idx string, tree int, leaf string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def fold(level):
    """All levels of a tree, from its leaves to its root."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def proof(levels, at):
    out = []
    for level in levels[:-1]:
        start = at // 8 * 8
        out.append((level[start : start + 8], at - start))
        at //= 8
    return out


def up(steps, node):
    for run, at in steps:
        node = sha("".join(run[:at] + [node] + run[at + 1 :]))
    return node


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    trees = {}
    for r in rows:
        bad = r if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 else (*r[:4], low(r[4]))
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, sha("".join(map(enc, r))), sha("".join(map(enc, bad))), r[0]))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = [fold([leaf for *_, leaf, _, _ in sorted(trees[x])]) for x in names]
    top = fold([m[-1][0] for m in made])
    out = Counter()
    for t, name in enumerate(names):
        for i, (_, _, leaf, bad, doc_id) in enumerate(sorted(trees[name])):
            steps = proof(made[t], i) + proof(top, t)
            siblings = "".join("".join(run[:at] + run[at + 1 :]) for run, at in steps)
            out[doc_id, leaf, made[t][-1][0], top[-1][0], sha(siblings), up(steps, bad), up(steps, bad) == top[-1][0]] += 1
    return out


def result(df):
    return Counter(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()))


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


MANY = [(i * 37 % 1009, f"s{i % 5}", ["en", "de", "fr"][(i % 7 > 4) + (i % 11 == 0)], i, f"Text {i} With CAPS" if i % 2 else f"text {i}") for i in range(1009)]


@pytest.mark.parametrize("rows", [
    [],
    [(1, None, None, None, None)],
    [(None, "", "", 0, ""), (None, None, None, None, None), (3, "a", "en", 5, "Größe"), (3, "a", "en", 5, "Größe"), (3, "b", "en", 5, "Größe"), (-4, "a", "en", 5, "A" * 300_000), (12, "a", "en", 5, "ABC"), (0, "a", "", 1, "Q")],
    [(i, None, "en", None, "Hello") for i in range(8)],
    [(i, None, "en", None, "Hello") for i in range(9)] + [(i, None, None, None, "Hello") for i in range(65)],
    [(i, "s", f"l{i:02d}", 1, f"T{i}") for i in range(75)],
    MANY,
])
def test_matches_brute_force(spark, rows):
    assert result(merkle.op13(docs(spark, rows))) == brute(rows)


def test_parts_and_rounds_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PART", 24)  # parts that are no whole subtrees need nodes of every level
    assert result(merkle.op13(docs(spark, MANY).repartition(5))) == brute(MANY)


def test_proofs_of_some_rows(spark):
    manifest = merkle.Manifest(merkle.leaves_of(docs(spark, MANY)))
    some = manifest.leaves.where(F.col("doc_id") % 13 == 4)
    got = manifest.prove(some, ("doc_id",)).collect()
    want = {k[0]: k for k in brute(MANY)}
    assert len(got) == sum(1 for k in want if k % 13 == 4)
    assert all((r.leaf, r.subroot, r.proof_sha256) == (want[r.doc_id][1], want[r.doc_id][2], want[r.doc_id][4]) and r.folded_root == manifest.root for r in got)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 100, 513, 600])
def test_least_union(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        wanted = np.unique(rng.integers(0, n, rng.integers(1, 1 + min(n, 30))))
        sizes = merkle.sizes_of(n)
        on_path = [{int(w) // 8**level for w in wanted} for level in range(len(sizes))]
        need = {(level, s) for level in range(len(sizes) - 1) for i in on_path[level] for s in range(i // 8 * 8, min(i // 8 * 8 + 8, sizes[level])) if s not in on_path[level]}
        assert {(level, int(i)) for level, some in merkle.missing(wanted, n) for i in some} == need


def test_twin(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    want = Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in con.execute(queries.OP13).to_arrow_table().to_pylist())
    got = result(merkle.op13(spark.read.parquet(path)))
    assert got == want == brute([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(path).collect()])
