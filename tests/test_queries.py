"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import pytest

from blockdb.plans import registry
from blockdb.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def rows(frame):
    def plain(v):
        if v is None or isinstance(v, str):
            return v
        if isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6)

    columns = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.SQL:
        want = duck.execute(registry.SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)
    else:
        assert len(found)
