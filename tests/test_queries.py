"""Every registered analytics query against its SQL in DuckDB, at the smallest scale."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from ledgerloom import queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    shown = lambda v: None if v is None or v is pd.NA or v != v else round(v, 3) if isinstance(v, float) else v
    return sorted((tuple(shown(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, str(DATA)).toPandas()
    if name in queries.oracle_sql():
        assert rows(got) == rows(duck.execute(queries.oracle_sql()[name]).df())
    else:
        assert list(got.columns)
