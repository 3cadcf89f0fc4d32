"""Strips of odd texts against the SQL twin."""

import duckdb
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.plans import catalog

SPACES = " \u00a0\u1680\u2000\u2003\u2009\u200a\u202f\u205f\u3000"
TEXTS = [None, "", " ", "\u00a0", "One.\u00a0 ", "\u3000Two\u3000.\u2003", "three。\u3000 \u3000", "a\u0001b. c", "\u0001", ". \u0001 .", "x\u0085y! ?", "p.\u200b", "\u2028!\u2028"]


def test_counts_as_its_twin_does(spark, tmp_path):
    rows = list(enumerate(TEXTS + [f"One.{c}Two{c}" for c in SPACES] + [f"One.{c} {c}" for c in SPACES]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_strips for r in catalog.QUERIES["strip_count"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(catalog.ORACLES["strip_count"]).fetchall())


def test_ends_lose_spaces_of_any_kind(spark):
    row = spark.createDataFrame([("\u3000Red fox.\u00a0 \u2003Blue hat。\u3000",)], "t string").select(tx.strips(F.col("t")).alias("p")).first()
    assert row.p == ["Red fox.", "Blue hat。"]
