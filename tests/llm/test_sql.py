"""Each query of the subpackage that SQL can say, against that SQL on the smallest tables."""

import duckdb
import pytest
from test_queries import TABLES, plain

from recollect.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = con.sql(ORACLES[name])
    at = {c: i for i, c in enumerate(found.columns)}
    assert sorted(at) == columns
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted((tuple(plain(r[at[c]]) for c in columns) for r in found.fetchall()), key=repr) and got
