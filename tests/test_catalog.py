import os

import duckdb
import pytest

import __spark_entry__ as entry
from ferrovia.plans import catalog

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(df):
    return df.apply(lambda c: c.astype("float64").round(6) if c.dtype.kind in "iuf" else c.astype(str))


@pytest.mark.parametrize("name", ["v01_orphan_stops", "v12_trips_without_stop_times", "all_edges", "degree_summary", "weight_summary", "hist_degree", "geo_clusters", "token_sort_ratio", "crosswalk", "node_capacity", "flow_load", "betweenness", "components"])
def test_against_sql(spark, oracle, name):
    want, got = plain(oracle.sql(catalog.ORACLES[name]).df()), plain(catalog.QUERIES[name](spark, SF).toPandas())
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    order = lambda d: d[columns].sort_values(columns).reset_index(drop=True)
    assert order(want).equals(order(got))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
