"""The driver contract, and a few queries against their SQL at the smallest scale."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["regionid", "hh_end", "energy_mwh", "co2_t"] and df.count() > 0


def test_every_statement_belongs_to_a_query_and_runs(con):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70
    for name, text in sql.items():
        assert con.execute(f"SELECT count(*) FROM ({text})").fetchall()[0][0] >= 0, name


@pytest.mark.parametrize(
    "name",
    ["keep_latest_lineitem", "regional_energy", "oriented_flows", "transition_calendar", "interpolate_hold", "cost_concentration", "wls_cluster", "link_inventory"],
)
def test_query_equals_its_sql(spark, con, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()[list(got.columns)]
    assert sorted(got.columns) == sorted(want.columns)
    order = list(got.columns)

    def tidy(pdf):
        stamps = {c: pd.to_datetime(pdf[c]) for c in order if pdf[c].map(lambda v: hasattr(v, "year")).any()}
        return pdf.assign(**stamps).sort_values(order, key=lambda s: s.astype(str)).reset_index(drop=True)

    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False, rtol=1e-9)
