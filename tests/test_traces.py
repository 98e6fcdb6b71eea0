"""The trace queries cover every order, against their SQL."""

import duckdb
import pytest
from test_catalog import ORACLES, QUERIES, rows

from cuesta.plans.fixtures import tables

SF = "/root/testdata/sf0.01"
TRACES = ("a1_densified", "a2_sampled", "a4_lengths", "a5_simplified", "a11_burned", "h10_monotonicity", "m3_moments")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_order_is_a_vertex(spark):
    assert tables(spark, SF)["fx_vert"].count() == spark.read.parquet(f"{SF}/orders.parquet").count()


@pytest.mark.parametrize("name", [t for t in TRACES if t in ORACLES])
def test_matches_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLES[name]).df())
