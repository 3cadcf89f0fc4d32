import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from siltstone.llm import linededup, queries

SCHEMA = "doc_id long, text string, pos int, keep string, _id int"


def brute(rows, least=10):
    """rows: (id, text). A line stays in the least id that holds its key; null ids are one document and come last."""
    order = lambda i: (i is None, i or 0)
    keys = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r")) for line in (t or "").split("\n")]
    first = {}
    for i, t in rows:
        for k in keys(t):
            first[k] = min(first.get(k, order(i)), order(i))
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t)) if len(k) < least or first[k] == order(i)]
        out[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 3, "k", 5) for r in rows], SCHEMA)


def result(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


ODD = [(1, None), (2, ""), (3, "\n\n"), (4, "  A long enough line \n x"), (5, "a LONG enough line\r\na long enough line\nown line of five"), (5, "a long enough line\nother"), (None, "a long enough line\nnobody else has this"),
       (None, "nobody else has this"), (-7, "\tnobody ELSE has this\x0b"), (6, "ÄÄÄÄÄÄÄÄÄÄ\nääääääääää\nÄÄÄÄÄÄÄÄÄ"), (7, "ÄÄÄÄÄÄÄÄÄÄ\nÄÄÄÄÄÄÄÄÄ"), (8, "0123456789\n012345678"), (9, "0123456789\n012345678"),
       (9, "0123456789\n012345678"), (10, "line with nbsp\xa0\nline with nbsp"), (11, "line with nbsp\xa0"), (12, "word " * 60_000 + "\n" + "short line\n" * 3000), (13, "SHORT LINE\n" + "word " * 60_000)]


@pytest.mark.parametrize("rows", [ODD, [], [(1, "one lonely line\none lonely line")], [(None, None), (None, None)]])
def test_odd_rows(spark, rows):
    assert result(linededup.op12(table(spark, rows))) == brute(rows)


def test_one_line_in_all_documents_spans_partitions(spark):
    rows = [(i * 7 % 4001, f"the line of everyone\nline of {i % 97} and so on\n" + "again and again\n" * (i % 5)) for i in range(4001)]
    df = table(spark, rows).repartition(6)
    assert result(linededup.op12(df)) == brute(rows)
    lines = linededup.lines_of(linededup.with_row_keys(df, "doc_id", "text"), 10)
    from pyspark.sql import functions as F

    dealt = lines.repartitionByRange(8, "h1", "h2", "_id", "pos").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 4 and max(r["count"] for r in dealt) < 0.5 * sum(r["count"] for r in dealt)


def test_same_line_again_and_again_in_one_document(spark):
    rows = [(1, "x\n" + "the very same line\n" * 5000), (0, "the very same line")] + [(2, "the very same line\ny")] * 40
    assert result(linededup.op12(table(spark, rows))) == brute(rows)


def test_bitmaps_are_the_result(spark):
    df = table(spark, ODD)
    maps = linededup.keep_bitmaps(df).collect()
    assert all(linededup.from_bitmap(bytes(r.keep), r.n_lines).sum() == r.n_lines - r.n_dropped for r in maps)
    assert all(len(zlib.decompress(bytes(r.keep))) == (r.n_lines + 7) // 8 for r in maps)
    texts = {r.doc_id: r.text for r in linededup.apply_bitmaps(df, linededup.keep_bitmaps(df)).collect()}
    assert texts[1] is None and texts[4] == "  A long enough line \n x" and texts[10] == "line with nbsp\xa0\nline with nbsp" and texts[11] == "" and texts[8] == "0123456789\n012345678"
    assert linededup.from_bitmap(linededup.to_bitmap(11, np.array([0, 10])), 11).tolist() == [False] + [True] * 9 + [False]


def test_ids_of_another_type(spark):
    rows = [("b", "a line of some length\nx"), ("a", "a line of some length\ny"), (None, "a line of some length")]
    got = linededup.apply_bitmaps(spark.createDataFrame(rows, "name string, body string"), linededup.keep_bitmaps(spark.createDataFrame(rows, "name string, body string"), "name", "body"), "name", "body")
    assert {(r.name, r.body) for r in got.collect()} == {("a", "a line of some length\ny"), ("b", "x"), (None, "")}


def test_twin(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    got = linededup.op12(spark.read.parquet(path))
    want = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in con.execute(queries.OP12).to_arrow_table().to_pylist())
    assert result(got) == want and sum(n_dropped for _, _, n_dropped, _ in want) > 0
