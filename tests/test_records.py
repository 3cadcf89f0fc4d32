from pyspark.sql import functions as F

from siltstone.operators import projects, records
from siltstone.session import fresh_path


def test_bad_records_wait_with_their_errors(spark):
    path, again = fresh_path(spark, "held"), fresh_path(spark, "again")
    rule = projects.errors(a=F.col("a") > 0, b=F.col("b").isNotNull())
    one = spark.createDataFrame([(1, "x"), (-1, None), (0, "y")], "a int, b string")
    two = spark.createDataFrame([(2.5, "z", 1), (-2.0, "q", 2)], "a double, b string, c int")
    for _ in range(2):  # a batch that is done again counts once
        good = [records.quarantine(one, rule, path, 0), records.quarantine(two, rule, path, 1)]
    held = records.held(spark, path)
    assert {(r.record, tuple(r.errors), r.batch) for r in held.collect()} == {('{"a":-1,"b":null}', ("a", "b"), 0), ('{"a":0,"b":"y"}', ("a",), 0), ('{"a":-2.0,"b":"q","c":2}', ("a",), 1)}
    assert {tuple(r) for r in records.summary(held).collect()} == {("a", 3, 0), ("b", 1, 0)}
    assert {tuple(r) for r in records.together(good).collect()} == {(1.0, "x", None), (2.5, "z", 1)}
    later = records.retry(held, "a double, b string, c int", projects.errors(b=F.col("b").isNotNull()), again, 2)
    assert {tuple(r) for r in later.collect()} == {(0.0, "y", None), (-2.0, "q", 2)} and records.held(spark, again).count() == 1


def test_no_rows(spark):
    path = fresh_path(spark, "held")
    empty = spark.createDataFrame([], "a int")
    assert records.quarantine(empty, projects.errors(a=F.col("a") > 0), path).collect() == [] and records.held(spark, path).collect() == []
