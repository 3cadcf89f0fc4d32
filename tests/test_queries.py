"""Every registered query of the library against its SQL twin on the smallest tables."""

import datetime
import math
from collections import Counter

import duckdb
import pytest

from siltstone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def bag(rows, names):
    return Counter(tuple(plain(r[n]) for n in names) for r in rows)


@pytest.fixture(scope="module")
def twin(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_twin(spark, sf_dir, twin, name):
    got = catalog.QUERIES[name](spark, sf_dir).toArrow()
    want = twin.execute(catalog.ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    names = sorted(got.column_names)
    assert bag(got.to_pylist(), names) == bag(want.to_pylist(), names)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_twin(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
