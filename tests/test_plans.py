"""Every registered query with a DuckDB text gives its rows, on the smallest tables; the others run."""

import os

import duckdb
import pytest

from umbel import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return c


def plain(row):
    return repr(tuple(float(x) if isinstance(x, float) else x for x in row))


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(plain(r) for r in df.select(*cols).collect())
    if name in plans.oracle_sql():
        rel = con.sql(plans.oracle_sql()[name])
        assert sorted(rel.columns) == cols
        want = sorted(plain(r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
        assert got == want
    else:
        assert got


def test_oracles_belong_to_queries():
    assert set(plans.oracle_sql()) <= set(plans.queries())
