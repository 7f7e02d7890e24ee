from decimal import Decimal

from pyspark.sql import functions as F

from proratio.operators import reproduction, serving


def test_classes_and_causes(spark):
    prices = [("exact", "100.00"), ("cent", "100.004"), ("real", "100.90"), ("share", "200010.000000"), ("far", "130"), ("none", None), ("noref", "5")]
    refs = [("exact", "100.00"), ("cent", "100.00"), ("real", "100.00"), ("share", "200000.00"), ("far", "100.00"), ("none", "1.00")]
    reproduced = spark.createDataFrame([(1, u, Decimal(p) if p else None) for u, p in prices], "development_id int, unit_id string, unit_price decimal(28,10)")
    reference = spark.createDataFrame([(u, Decimal(p), "run") for u, p in refs], "unit_id string, source_reference_price decimal(18,2), imported_run_id string")
    rows = {r["unit_id"]: r for r in reproduction.compare(reproduced, reference).collect()}
    assert {u: r["match_classification"] for u, r in rows.items()} == {
        "exact": "EXACT", "cent": "WITHIN_1_CENT", "real": "WITHIN_1_REAL", "share": "WITHIN_0_01_PERCENT", "far": "DIVERGENT",
        "none": "BLOCKED", "noref": "BLOCKED"}
    assert rows["cent"]["delta_absolute"] == 0
    assert {u: r["divergence_cause"] for u, r in rows.items()} == {
        "exact": None, "cent": None, "real": "UNKNOWN", "share": "UNKNOWN", "far": "UNKNOWN", "none": "MISSING_PARAMETER", "noref": "UNKNOWN"}
    found = reproduction.compare(reproduced, reference)
    m = serving.error_metrics(found).collect()[0]
    assert (m["units_analyzed"], m["exact_matches"], m["within_1_cent"], m["max_absolute_error"]) == (7, 1, 2, Decimal("30.00"))
    s = reproduction.development_summary(found).collect()[0]
    assert (s["units_total"], s["units_calculated"], s["units_blocked"]) == (7, 6, 1)


def test_metrics_of_nothing_are_zero(spark):
    empty = spark.createDataFrame([], "delta_absolute decimal(18,2), match_classification string")
    m = serving.error_metrics(empty).collect()[0]
    assert (m["units_analyzed"], m["mae"], m["max_absolute_error"], m["rmse"]) == (0, 0, 0, 0.0)


def test_latest_run_prefers_newest_then_id(spark):
    scenarios = spark.createDataFrame([("s", "d", "ACTIVE"), ("t", "e", "DRAFT")], "scenario_id string, development_id string, status string")
    runs = spark.createDataFrame(
        [("s", "d", "r1", "COMPLETED", "2026-01-01"), ("s", "d", "r2", "COMPLETED", "2026-01-02"), ("s", "d", "r3", "COMPLETED", "2026-01-02"),
         ("s", "d", "r4", "FAILED", "2026-01-03"), ("t", "e", "r5", "COMPLETED", "2026-01-01")],
        "scenario_id string, development_id string, run_id string, status string, completed_at string",
    ).withColumn("completed_at", F.col("completed_at").cast("timestamp"))
    assert [r["run_id"] for r in serving.latest_runs(scenarios, runs).collect()] == ["r3"]


def test_labels_of_units_without_tower(spark):
    schema = ("development_id int, unit_id int, tower string, unit_code string, typology string, floor int, position string,"
              " private_area_m2 decimal(12,2), uncovered_area_m2 decimal(12,2), weighted_area_m2 decimal(12,2), participation_share decimal(9,6),"
              " system_price decimal(18,2), override_final_price decimal(18,2), current_final_price decimal(18,2), price_per_m2 decimal(18,2)")
    d = Decimal
    rows = [(1, 1, None, "a", None, None, None, d(50), d(0), d(50), None, d(100), None, d(100), None),
            (1, 2, "T", "b", "K", 1, "F", d(0), d(0), d(0), None, d(100), d(90), d(90), None)]
    got = {r["unit_id"]: r for r in serving.units_enriched(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1]["tower"], got[1]["typology"], got[1]["position"], got[1]["status"]) == ("SEM-TORRE", "", "", "VALIDADO")
    assert (got[1]["price_per_m2"], got[2]["price_per_m2"]) == (2, 0)
    assert (got[2]["adjustment"], got[2]["status"]) == (-10, "AJUSTE")
    assert serving.price_by_floor(serving.units_enriched(spark.createDataFrame(rows, schema))).count() == 1
