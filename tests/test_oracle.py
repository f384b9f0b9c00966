"""Every query with SQL gives DuckDB's rows on the small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", SQL)
def test_same_rows(spark, name):
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    assert rows(__spark_entry__.queries()[name](spark, SF).toPandas()) == rows(db.sql(SQL[name]).df())
