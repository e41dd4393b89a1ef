"""Driver contract: entry() smoke, and every registered query equals its
DuckDB oracle on the smallest driver tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from fleetlane.plans import catalog
from fleetlane.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _rows(pdf):
    def norm(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "item") and not isinstance(v, (str, bytes)):
            v = v.item()
        return f"{v:.9g}" if isinstance(v, float) else str(v)
    cols = sorted(pdf.columns)
    return sorted((tuple(norm(x) for x in r) for r in pdf[cols].itertuples(index=False)),
                  key=lambda r: tuple("" if x is None else x for x in r))


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["word", "cnt"]
    assert df.count() > 0


def test_every_query_has_oracle():
    assert set(catalog.REGISTRY) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, key):
    sp = E.queries()[key](spark, SF).toPandas()
    dd = con.sql(E.oracle_sql()[key]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    assert len(sp) == len(dd)
    assert _rows(sp) == _rows(dd)
