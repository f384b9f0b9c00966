"""Each operator that SQL can express gives DuckDB's rows on the small tables."""

import glob
import os

import duckdb
import pytest

from docsieve.llm import queries
from tests.test_oracle import SF, rows


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_same_rows(spark, name):
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    found = rows(queries.queries()[name](spark, SF).toPandas())
    assert found == rows(db.sql(queries.oracle_sql()[name]).df()) and found
