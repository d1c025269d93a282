import os

import duckdb
import pytest
from polyrank.llm.catalog import ORACLE_SQL, QUERIES

from .cases import clashing, odd_documents, store

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in found)


def compare(spark, name, folder, files):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{files}'")
    got, df = con.execute(ORACLE_SQL[name]), QUERIES[name](spark, folder)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(got.fetchall(), names)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_equal_to_sql(spark, name):
    compare(spark, name, SF, f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", ["op1_substrings", "op8_minhash"])
def test_equal_to_sql_on_odd_documents(spark, name, tmp_path):
    folder = store(clashing(odd_documents(spark)), tmp_path)
    compare(spark, name, folder, f"{folder}/documents.parquet/*.parquet")
