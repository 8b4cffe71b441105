"""Every query that has SQL is compared with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def normal(rows):
    return sorted(repr([float(v) if isinstance(v, float) else v for v in r]) for r in rows)


def names():
    import __spark_entry__

    return sorted(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, name):
    import __spark_entry__

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert normal(tuple(r) for r in df.select(*columns).collect()) == normal(want)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 10 and "fill" in df.columns
