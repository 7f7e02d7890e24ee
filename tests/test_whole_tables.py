"""Queries over tables built here, small enough to say what must come out."""

import pytest
from pyspark.sql import functions as F

from proratio.plans.catalog import ORACLES, QUERIES


@pytest.fixture
def orders(spark, tmp_path):
    """75 orders of one customer, one line each."""
    day = F.lit("1999-05-04 00:00:00").cast("timestamp_ntz")
    k = F.col("id")
    tables = {
        "nation": spark.sql("select 0 n_nationkey, 'N' n_name, 0 n_regionkey"),
        "customer": spark.sql("select 1L c_custkey, 'C' c_name, 0 c_nationkey, 1.0D c_acctbal, 'TOOLS' c_mktsegment"),
        "orders": spark.range(75).select(k.alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"), F.lit("F").alias("o_orderstatus"), (k + 100.5).alias("o_totalprice"),
                                         day.alias("o_orderdate"), F.lit("2-HIGH").alias("o_orderpriority")),
        "lineitem": spark.range(75).select(k.alias("l_orderkey"), F.lit(2.0).alias("l_quantity")),
    }
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_the_view_holds_every_unit(spark, orders):
    found = [int(r["apartamento"]) for r in QUERIES["hedonic_view"](spark, orders).collect()]
    assert sorted(found) == list(range(75))
    assert "% 37" not in ORACLES["hedonic_view"]


def test_the_read_leaves_no_unit_out(spark, orders):
    found = [int(r["apartamento"]) for r in QUERIES["hedonic_read"](spark, orders).collect()]
    assert sorted(found) == list(range(75)) and {0, 37, 74} <= set(found)
    assert "% 37" not in ORACLES["hedonic_read"]
