"""The paths taken when nothing may be broadcast, and groups that hold most of the rows."""

from fractions import Fraction

import pytest
from golden import HASH
from pyspark.sql import functions as F
from test_allocation import load
from test_rulegraph import CHAIN, SCHEMA, UNITS, by_fractions

from proratio import session
from proratio.operators import allocation, formulas, profiling, rulegraph, serving


@pytest.fixture
def nothing_fits(monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_attach_is_the_same_join_either_way(spark, monkeypatch):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), "id").repartition(5)
    small = spark.createDataFrame([(k, k * 10) for k in range(5)], "k long, v long")
    for how in ("left", "inner", "left_semi", "left_anti"):
        monkeypatch.setattr(session, "BROADCAST_ROWS", 100)
        a = sorted(map(tuple, session.attach(big, small, "k", small, how).collect()), key=str)
        monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
        joined = session.attach(big, small, "k", small, how)
        assert sorted(map(tuple, joined.collect()), key=str) == a and "_salt" not in joined.columns


def test_hot_key_is_divided(spark, nothing_fits):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        big = spark.range(0, 64000, 1, 64).select((F.col("id") % 1).alias("k"), "id")
        small = spark.createDataFrame([(0, 5)], "k long, v long")
        joined = session.attach(big, small, "k", small, "inner")
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 64000 / 4
        # grouping by the hot key shuffles sums, not rows
        text = plan(joined.groupBy("k").agg(F.sum("v")))
        assert text.count("Exchange hashpartitioning") == 3 and "_salt" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture
def shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_unit_with_a_third_of_all_decisions_fills_no_task(spark, shuffled):
    events = spark.range(0, 48000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 2000).alias("unit_id"), F.lit("1.00").cast("decimal(18,2)").alias("override_delta"), F.col("id").alias("event_id"))
    prices = spark.range(2000).select(F.col("id").alias("unit_id"), F.lit("10.00").cast("decimal(18,2)").alias("system_price"))
    priced = allocation.apply_overrides(prices, events, ["unit_id"])
    sizes = sorted(r["n"] for r in priced.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
    assert sum(sizes) == 48000 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    assert priced.select("event_id").distinct().count() == 48000


def test_only_hot_keys_are_copied(spark, shuffled):
    big = spark.range(0, 30000, 1, 8).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 5 == 0, None).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(30000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert [r["k"] for r in session.hot_keys(big.where("k is not null"), ["k"]).collect()] == [7]
    joined = session.skew_join(big, small, "k", "left")
    assert joined.count() == 30000 and joined.where("v is null").count() == big.where("k is null").count()
    sizes = sorted(r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]
    copied = small.join(session.hot_keys(big, ["k"]), "k").count()
    assert copied == 1
    for how, want in (("left_semi", 30000 - 3000), ("left_anti", 3000)):
        assert session.skew_join(big, small, "k", how).count() == want


def test_allocation_without_broadcast(spark, tmp_path, nothing_fits):
    rows, units, targets, config = load(spark, tmp_path)
    found = allocation.allocate(units, targets, config)
    assert allocation.reconciliation(found).collect()[0]["severity"] == "INFO"
    assert allocation.published_hash(found).collect()[0]["logical_hash"] == HASH


def test_rule_graph_without_broadcast(spark, nothing_fits):
    units = spark.createDataFrame(UNITS, SCHEMA)
    got = {r["unit_id"]: r for r in rulegraph.evaluate(units, rulegraph.Ruleset(CHAIN)).collect()}
    want = by_fractions(UNITS)
    assert all((got[u]["fee"] is None) == (fee is None) and (fee is None or abs(Fraction(got[u]["fee"]) - fee) < Fraction(1, 10 ** 5))
               for u, (*_, fee) in want.items())


def test_runs_and_headers_without_broadcast(spark, nothing_fits):
    rows = [("w", "s", r, 1, "A", f"A{r}", "number", "9" if r in (5, 6) else None, None if r in (5, 6) else "1", None if r in (5, 6) else f"B{r}*2")
            for r in range(1, 40)]
    cells = spark.createDataFrame(rows, "workbook_id string, sheet_name string, row_number int, column_index int, column_letters string,"
                                  " cell_ref string, cell_type string, raw_value string, cached_value string, formula_expression string")
    assert [r["row_range"] for r in formulas.consistency_flags(cells, 10, block_rows=4).collect()] == ["5-6"]
    assert profiling.header_rows(cells, 10).count() == 1


def test_a_document_has_a_line_per_unit(spark):
    units = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("unit"))
    lines = {r["unit"]: r["document"] for r in serving.document_lines(units, ["g", "unit"], ["unit"]).collect()}
    assert len(lines) == 1000 and lines["10"] == '{"unit":"10"}'


def test_filters_and_columns_reach_the_scan(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    from proratio.plans.domain import Domain

    d = Domain(spark, "/root/testdata/sf0.001")
    events = d.override_events._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in events and "props" not in events
    shares = plan(allocation.participation_by(d.allocated, "development_id"))
    assert "order_date" not in shares and "BroadcastHashJoin" in shares and "CartesianProduct" not in shares


def test_plans_of_units_have_no_sorting_aggregate_and_no_trail_join(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    from proratio.plans.catalog import QUERIES

    prices = plan(QUERIES["allocation_prices"](spark, "/root/testdata/sf0.001"))
    assert "SortAggregate" not in prices
    trace = plan(QUERIES["lineage_trace"](spark, "/root/testdata/sf0.001"))
    # Only the overrides join on the unit; runs, checks and towers are broadcast.
    assert trace.count("SortMergeJoin") + trace.count("ShuffledHashJoin") <= 2
