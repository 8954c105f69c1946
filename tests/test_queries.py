"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from foldline import queries as q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(q.queries()))
def test_same_rows(spark, duck, name):
    df = q.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    want = duck.sql(q.oracle_sql()[name])
    assert sorted(want.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert sorted(map(repr, (tuple(r) for r in df.select(*(f"`{c}`" for c in cols)).collect()))) == sorted(map(repr, want.select(quoted).fetchall()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
