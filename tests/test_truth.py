"""Which documents contain a passage, against the statement of it in SQL."""

import duckdb

from siltstone.plans import grades

DOCS = [(1, "The big red fox runs."), (2, "fo and more, but no fox"), (3, "a big  red fox"), (4, None), (5, ""), (6, "A big red fort, a foxhole"), (7, "中文字。big red fo!")]
PASSAGES = [(1, "big red fo"), (2, "fox"), (3, "red fo"), (4, ""), (5, None), (6, "ig red fox ru"), (7, "e big red fox"), (8, "nowhere at all"), (9, "."), (10, " red fox runs."), (11, "文字。big re")]


def test_truth_is_whatever_contains_the_passage(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(PASSAGES, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"with {grades.CONTAINED} select item_id, doc_id from tr").fetchall()
    assert sorted(map(tuple, grades.truth(spark, str(tmp_path)).select("item_id", "doc_id").collect())) == sorted(want)
