from siltstone.operators.components import connected_components


def test_components(spark):
    rows = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (7, 9), (20, 21), (None, 4), (2, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert {n: got[n] for n in (1, 2, 3, 7, 8, 9, 20, 21)} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}
    assert all(got[100 + i] == 100 for i in range(41)) and 4 not in got


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_rounds_on_a_long_chain(spark, monkeypatch):
    from siltstone.operators import components

    written, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: written.append(name) or write(df, name))
    got = connected_components(spark.range(9_999).selectExpr("id src", "id + 1 dst"))
    assert got.where("component = 0").count() == got.count() == 10_000
    assert written.count("cc-hook") <= 20


def test_star_and_ties(spark):
    edges = spark.range(1, 3_000).selectExpr("'hub' src", "cast(id as string) dst").unionByName(spark.createDataFrame([("x", "y"), ("y", "x")], "src string, dst string"))
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert len(got) == 3_002 and {c for n, c in got.items() if n not in "xy"} == {"1"} and got["x"] == got["y"] == "x"
