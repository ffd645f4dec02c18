import duckdb
import pytest

import __spark_entry__
from sparktile.plans import catalog


def test_registered(spark, sf_dir):
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["spmv_customer_part", "unary_erf", "binary_divide", "reduce_worker", "tile_layout", "dot_embeddings", "crs", "solve_nations", "permute_021"])
def test_against_sql(spark, sf_dir, name):
    found = catalog.QUERIES[name](spark, sf_dir).toPandas()
    con = duckdb.connect()
    for t in ("part", "customer", "supplier", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    expected = con.execute(catalog.ORACLE[name]).fetchdf()
    cols = sorted(expected.columns)
    assert sorted(found.columns) == cols
    rows = lambda df: sorted(map(repr, df[cols].astype(object).itertuples(index=False, name=None)))
    assert rows(found) == rows(expected)
