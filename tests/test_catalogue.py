"""Every query of the analytics engine against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tradelens.plans.catalogue import ORACLES, QUERIES
from tradelens.plans.dialect import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    cells = lambda r: tuple("null" if v is None or v != v else f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else str(v) for v in r)
    return sorted(map(cells, frame[sorted(frame.columns)].astype(object).itertuples(index=False)))


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = rows(pd.DataFrame(got)), rows(want)
    assert len(got) == len(want)
    assert sum(a != b for a, b in zip(got, want)) == 0
