"""Every query with SQL against DuckDB on the same tables, and the rest against what must hold for them."""

import os

import duckdb
import pandas as pd
import pytest

from bagsieve import catalogue_of_queries as catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def _rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]

    def told(v):
        if v is None or (isinstance(v, float) and v != v):
            return "none"
        return f"{v:.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(told, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs_twice_alike(spark, name):
    first, again = (catalogue.queries()[name](spark, SF).toPandas() for _ in range(2))
    assert len(first) > 0
    assert _rows(first.map(str)) == _rows(again.map(str))


def test_selection_sizes(spark):
    chosen = catalogue.queries()["canonical_selection"](spark, SF).toPandas()
    assert len(chosen) == chosen.vec_id.nunique() == 125
    for name in ("swap_refine", "swap_refine_seq"):
        assert catalogue.queries()[name](spark, SF).count() == 125
