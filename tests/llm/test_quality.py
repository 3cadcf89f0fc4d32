import re
from collections import Counter, defaultdict

import duckdb

from siltstone.llm import quality, queries


def brute(rows, docs_limit, share, least):
    """rows: (id, host, text). The rules by their definition."""
    count, hosts, lines = Counter(), Counter(), []
    for _, host, text in rows:
        host = host or ""
        hosts[host] += 1
        per = defaultdict(int)
        for line in (text or "").split("\n"):
            if n := len(re.findall(r"[^\x20\x09-\x0D]+", line)):
                per[re.sub("[0-9]+", "0", " ".join(line.lower().split()))] += n
        lines.append(per)
        count.update((host, k) for k in per)
    out = Counter()
    for (doc_id, host, text), per in zip(rows, lines):
        text, host = text or "", host or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        gone = sum(n for k, n in per.items() if count[host, k] > docs_limit and count[host, k] > share * hosts[host])
        out[doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(covered), failed, not failed and len(words) - gone >= least * len(words)] += 1
    return out


def columns(rows):
    return Counter(tuple(r)[:8] for r in rows)


def test_rules_match_brute_force(spark):
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "a", f"Share this page {i}\n{body} x{i}\nSubscribe NOW to our list") for i in range(40)]
    rows += [(100 + i, "a", "\n".join(["Share this page 7", "subscribe   now to our list"] * 20)) for i in range(3)]
    rows += [(200, None, None), (201, None, ""), (202, "b", " \n\t\n"), (None, "b", body), (203, "b", body), (203, "b", body), (204, "b", "one two three " * 5000), (205, "c", f"# a | b\n{body}\n{body}\r\n# a | b\x1cnot a blank\xa0here")]
    rows += [(300 + i, "a", "Share this page 9\n" + "alpha beta gamma delta " + f"u{i}") for i in range(5)]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, source string, text string, n_words int, kept boolean")
    assert columns(quality.op10(docs).collect()) == brute(rows, quality.LINE_DOCS, quality.LINE_SHARE, quality.LEAST_KEPT)
    assert columns(quality.judge(docs, line_docs=3, line_share=0.0, least_kept=0.95).collect()) == brute(rows, 3, 0.0, 0.95)
    assert quality.op10(docs.limit(0)).collect() == []


def test_depleted_documents_are_rejected(spark):
    body = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, "a", body) for i in range(30)] + [(50, "a", body + "\n" + " ".join(f"own{i}" for i in range(90)))], "doc_id long, source string, text string")
    assert {r.doc_id for r in quality.op10(docs).collect() if r.kept} == {50}


def test_twin(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    got = quality.op10(spark.read.parquet(path))
    want = con.execute(queries.OP10).to_arrow_table()
    assert Counter(map(tuple, got.select(*sorted(got.columns)).collect())) == Counter(tuple(r[c] for c in sorted(got.columns)) for r in want.to_pylist())
