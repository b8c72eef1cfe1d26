import duckdb
import pandas as pd
import pytest

from quarrystone.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    own = registry.QUERIES[name](spark, SF)
    columns = sorted(own.columns)
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    theirs = con.execute(registry.ORACLES[name]).fetchdf()
    assert sorted(theirs.columns) == columns
    # pandas may read whole numbers beside nulls as floats
    plain = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float) and x == int(x) else x
    rows = lambda table: sorted(str([plain(x) for x in r]) for r in table[columns].astype(object).values.tolist())
    assert rows(own.toPandas()) == rows(theirs)
