"""Every registered query of the library's own against its SQL, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from rillflow.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    tidy = lambda x: round(x, 6) if isinstance(x, float) else str(x)
    return sorted([tuple(tidy(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else tidy(v) for v in r) for r in frame.itertuples(index=False)], key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
