"""Every query with SQL gives the same rows in DuckDB."""

import duckdb
import numpy as np
import pytest

from parley import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        numeric = str(df[k].dtype).lower().startswith(("int", "uint", "float"))
        df[k] = df[k].astype(float) if numeric else df[k].map(lambda v: list(v) if isinstance(v, np.ndarray) else v).astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = plain(registry.queries()[name](spark, SF).toPandas()), plain(duck.sql(registry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
