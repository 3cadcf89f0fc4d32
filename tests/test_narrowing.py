import random

from siltstone.operators import narrowing, reconcile
from siltstone.session import fresh_path

SCHEMA = "k long, a string, b double"


def tables(spark, seed, n=4000):
    rnd = random.Random(seed)
    rows = [(k * 3 - 1000, f"a{k % 17}", float(k % 5)) for k in range(n)] + [(None, "n", 1.0)]
    other = list(rows)
    at = rnd.randrange(n - 40)
    for i in sorted(rnd.sample(range(at, at + 40), 12), reverse=True):
        match rnd.randrange(3):
            case 0:
                del other[i]
            case 1:
                other[i] = (other[i][0], "changed", None)
            case _:
                other.append((other[i][0] + 1, "extra", 0.5))
    rnd.shuffle(other)
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(other, SCHEMA).select("b", "k", "a")


def test_same_as_whole_comparison_and_little_is_opened(spark):
    for seed in range(3):
        a, b = tables(spark, seed)
        found = narrowing.narrow(a, b, "k")
        assert 12 <= found.source.count() + found.target.count() < 400 and found.compared < 1000
        rows = lambda df: sorted(map(tuple, df.collect()), key=str)
        assert rows(narrowing.except_diff(b, a, "k", ["k"])) == rows(reconcile.except_diff(b.select(*a.columns), a, ["k"]))
        a, b = a.where("k is not null"), b.where("k is not null")
        assert narrowing.difference(a, b, "k").first().asDict() == reconcile.difference(a, b.select(*a.columns), "k").first().asDict()


def test_equal_empty_and_quite_different_tables(spark):
    a, _ = tables(spark, 1)
    same = narrowing.narrow(a, a.repartition(7), "k")
    assert same.ranges == [] and same.source.where("k is not null").count() == 0
    assert narrowing.narrow(a.limit(0), a.limit(0), "k").ranges == []
    assert narrowing.except_diff(a, a.limit(0), "k", ["k"], 10**6).count() == a.count()
    other = a.selectExpr("k", "a", "b + 1 as b")
    assert narrowing.narrow(a, other, "k", most=20).source.count() == a.count()  # too many ranges: all is compared


def test_ranges_reach_the_scan(spark):
    a, b = tables(spark, 2)
    paths = [fresh_path(spark, "side") for _ in "ab"]
    for df, path in zip((a, b), paths):
        df.write.parquet(path)
    found = narrowing.narrow(spark.read.parquet(paths[0]), spark.read.parquet(paths[1]), "k")
    plan = found.source._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(k,{found.ranges[0][0]})" in plan
