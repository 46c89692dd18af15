"""Every query runs at the smallest scale and agrees with its SQL."""

import glob
import os

import duckdb
import pytest

from gridfold.plans import queries as grid

DATA = "/root/testdata/sf0.001"
#: No pixels diverge in the smallest tables.
LARGER = {"first_divergence": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(set(grid.oracle_sql())))
def test_oracle(spark, name):
    c, data = duckdb.connect(), LARGER.get(name, DATA)
    for p in glob.glob(f"{data}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    a, b = grid.queries()[name](spark, data).toPandas(), c.sql(grid.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda x: sorted(map(repr, x[sorted(x.columns)].values.tolist()))
    assert rows(a) == rows(b) and len(a)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
