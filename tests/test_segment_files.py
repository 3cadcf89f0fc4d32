"""How segments lie in files, and what a search hands around."""

from pyspark.sql import functions as F

from siltstone.operators import search, segments
from tests.test_segments import SCHEMA, corpus, found, fresh

ODD = [(5000, None), (5001, " ,. "), (5002, "　中文。x\x00y x\x00y"), (5003, "many " * 3000 + "w0"), (5004, "\U0001f600 w0 W0")]


def test_segments_hold_the_postings_and_blocks_stand_in_one_file(spark):
    rows, index = corpus(400) + ODD, segments.Segments(spark, block=8, tier=2)
    for a, b in ((0, 250), (250, 251), (251, len(rows))):  # a segment merged from two, and one of its own
        index.add(spark.createDataFrame(rows[a:b], SCHEMA), "doc_id")
    kept = index._postings([s.number for s in index.segments()])
    got = sorted(map(tuple, kept.select(F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"), "term").select("p.ids", "term", "p.tfs", "p.dls").collect()))
    want = search.postings(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").select("doc_id", "term", "tf", "dl")
    assert got == sorted(map(tuple, want.collect()))
    assert kept.where("n <> size(ids) or tf_max <> array_max(tfs) or dl_min <> array_min(dls)").isEmpty()
    assert kept.select("block", F.input_file_name().alias("file")).distinct().groupBy("block").count().where("count > 1").isEmpty()


def test_blocks_to_score_go_64_questions_a_row(spark, monkeypatch):
    rows, index, kept = corpus(300), segments.Segments(spark, block=8), []
    index.add(spark.createDataFrame(rows, SCHEMA), "doc_id")
    asked = spark.createDataFrame([(10 * i, f"w{i % 30} w0 rare{i % 100}") for i in range(150)], "q long, text string").coalesce(1)
    write = segments.materialize
    monkeypatch.setattr(segments, "materialize", lambda df, name, *a: kept.append((name, write(df, name, *a))) or kept[-1][1])
    assert found(index.top_k(asked, 4, "q", "doc_id")) == fresh(spark, rows, asked, 4)
    blocks = index._postings([0]).select("block").distinct().count()
    wanted = [df.count() for name, df in kept if name == "segment-wanted"]
    assert len(wanted) == 2 and all(n <= 3 * blocks for n in wanted)  # before, a row a question, block and term
