"""Each registered query against its SQL on the smallest tables, and the shape of those without SQL."""

import math

import duckdb
import numpy as np
import pytest

from recollect.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    found = duck.sql(ORACLES[name])
    at = {c: i for i, c in enumerate(found.columns)}
    assert sorted(at) == columns
    expected = [tuple(plain(r[at[c]]) for c in columns) for r in found.fetchall()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
