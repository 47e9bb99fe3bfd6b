"""Every query with SQL against DuckDB on the driver tables, where they are there."""

import os

import duckdb
import pandas as pd
import pytest

from plumbline import catalog

SF = os.environ.get("PLUMBLINE_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def same(got: pd.DataFrame, want: pd.DataFrame, name: str) -> None:
    assert sorted(got.columns) == sorted(want.columns), name
    c = sorted(got.columns)
    order = [k for k in c if got[k].dtype != float] + [k for k in c if got[k].dtype == float]
    got, want = (x[c].sort_values(order, kind="stable").reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=2e-6, obj=name)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, db, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    same(got, db.execute(catalog.oracle_sql()[name]).df(), name)
    assert len(got)


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() == 5
