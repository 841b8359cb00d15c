"""Every query against independent SQL, in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from skein import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql_computes_the_same(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    got = sorted((tuple(map(normal, r)) for r in df.select(*cols).collect()), key=repr)
    assert got == sorted((tuple(map(normal, r)) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
