"""Every query with SQL gives DuckDB's rows on the smallest tables; every other one gives rows."""

import os

import duckdb
import pytest
from polyrank.catalog import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return "~"
    if isinstance(x, bool):
        return str(x)
    return f"{float(x):.9g}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal_to_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.collect(), df.columns) == table(got.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_without_sql(spark, name):
    assert len(QUERIES[name](spark, SF).collect()) > 0
