import random

import pytest

from siltstone.operators import cycles, graph
from siltstone.session import fresh_path
from siltstone.sources import jdbc


def brute(edges):
    nodes = {x for e in edges for x in e if None not in e}
    near = {n: {b for a, b in edges if a == n and b is not None} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        reach[n] = seen
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    n = rnd.choice([6, 15, 30])
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(int(n * rnd.choice([0.8, 1.3, 2])))]
    got = {r.node: r.component for r in cycles.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == brute(edges)


def test_odd_graphs(spark):
    of = lambda e: {r.node: r.component for r in cycles.strong_components(spark.createDataFrame(e, "src string, dst string")).collect()}
    assert of([]) == {} and of([("a", "a"), (None, "b"), ("b", None)]) == {"a": "a"}
    assert of([("b", "a"), ("a", "b"), ("a", "b"), ("c", "a"), ("b", "d")]) == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_order_of_tables_with_cycles(spark):
    tables = spark.createDataFrame([(x,) for x in "abcdefgh"], "table string")
    refs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("b", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("g", "g"), ("zz", "h"), ("h", None)], "child string, parent string")
    got = {r.table: r.layer for r in graph.migration_order(tables, refs).collect()}
    assert got == {"c": 0, "a": 1, "b": 1, "d": 2, "e": 2, "f": 2, "g": 0, "h": 0}
    assert graph.migration_order(tables.limit(0), refs).collect() == []


def test_ranges_are_even_and_whole(spark):
    rnd = random.Random(3)
    rows = [(k, i, f"v{i}") for i, k in enumerate([5] * 400 + [None] * 30 + [rnd.randrange(1000) for _ in range(600)] + [10**12])]
    home = fresh_path(spark, "db").removeprefix("file:")
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    url = f"jdbc:derby:;databaseName={home};create=true"
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{home}.log")
    spark.createDataFrame(rows, "k long, second long, v string").write.format("jdbc").options(url=url, dbtable="things", **options).save()
    spark.createDataFrame([], "k long, second long").write.format("jdbc").options(url=url, dbtable="nothing", **options).save()
    got, conditions = jdbc.read(spark, url, "things", options, "k", "second", 100)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert len(sizes) == len(conditions) and max(sizes) <= 200 and sum(sizes) == len(rows)
    with pytest.raises(ValueError):
        jdbc.read(spark, url, "things", options, "v")
    copied = jdbc.copy(spark, url, "things", options, fresh_path(spark, "copy"), "k", "second", 100)
    assert copied.count() == len(rows) and copied.select("_range").distinct().count() > 8
    assert jdbc.read(spark, url, "nothing", options, "k", "second", 100)[0].collect() == []


def test_conditions():
    assert jdbc.predicates("k", [1, 5], nulls=True) == ["k < 1", "k >= 1 AND k < 5", "k >= 5", "k IS NULL"]
    assert jdbc.predicates("k", []) == ["k IS NOT NULL"]
