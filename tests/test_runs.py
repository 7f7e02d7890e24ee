"""Allocation runs as stored tables: the gate reads what was written and lets nothing else be seen."""

from decimal import Decimal

import pytest
from golden import scenario
from pyspark.sql import functions as F
from test_allocation import load

from proratio.operators import allocation, runs
from proratio.sources import scenario as source
from proratio.sources.publish import Manifest

KEYS = ["development_id", "tower", "unit_code"]


def inputs(spark, tmp_path, **changes):
    rows, units, targets, config = load(spark, tmp_path, **changes)
    name = targets.first()["development_id"]
    codes = [("PLAIN", "2026-01-01 00:00:00"), ("DECIDED", "2026-01-02 00:00:00")]
    listed = spark.createDataFrame([(name, f"{name}:{c}", c, t) for c, t in codes], "development_id string, run_id string, code string, completed_at string")
    events = source.overrides(rows).withColumn("event_id", F.lit(1).cast("bigint"))
    return rows, units, targets, config, listed.withColumn("completed_at", F.col("completed_at").cast("timestamp")), events


def stored(spark, tmp_path, manifest, expected=None, batch="b", **changes):
    rows, units, targets, config, listed, events = inputs(spark, tmp_path, **changes)
    return runs.store(manifest, batch, units, targets, config, listed, events, override_code="DECIDED", keys=KEYS, bound=10,
                      towers=source.towers(rows), typologies=source.typologies(rows), expected=expected)


def test_five_tables_are_written_and_seen_together(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "store"))
    assert stored(spark, tmp_path, m) and not stored(spark, tmp_path, m)
    tables = runs.read(m)
    assert {n: t.count() for n, t in tables.items()} == {
        "pricing.runs": 2, "pricing.vgv_targets": 2, "pricing.unit_price_results": 80, "pricing.unit_adjustments": 240, "pricing.validations": 2, "pricing.unit_overrides": 1}
    got = {r["run_id"].split(":")[1]: r for r in runs.summary(tables, 10).collect()}
    assert got["PLAIN"]["total"] == got["DECIDED"]["total"] == Decimal("10000000.00")
    assert got["PLAIN"]["logical_hash"] == got["DECIDED"]["logical_hash"]
    assert (got["PLAIN"]["final_total"], got["DECIDED"]["final_total"]) == (Decimal("10000000.00"), Decimal("9998765.44"))
    # The hash of what is stored is that of what was worked out.
    _, units, targets, config, _, _ = inputs(spark, tmp_path)
    direct = allocation.logical_hash(allocation.allocate(units, targets, config), 10).first()["logical_hash"]
    assert got["PLAIN"]["logical_hash"] == direct
    assert [r["override"] for r in tables["pricing.unit_overrides"].selectExpr("final_price - previous_price as override").collect()] == [Decimal("-1234.56")]


@pytest.mark.parametrize("field, value", [("severity", "ERROR"), ("logical_hash", "00"), ("override_impact", "-1234.55"), ("units", 41), ("total", "1.00")])
def test_a_run_that_differs_from_what_is_expected_stays_invisible(spark, tmp_path, field, value):
    m = Manifest(spark, str(tmp_path / "store"))
    good = Manifest(spark, str(tmp_path / "good"))
    stored(spark, tmp_path, good)
    found = runs.summary(runs.read(good), 10)
    right = found.select("run_id", field)
    kind = dict(found.dtypes)[field]
    wrong = right.withColumn(field, F.when(F.col("run_id").endswith("DECIDED"), F.lit(value).cast(kind)).otherwise(F.col(field)))
    with pytest.raises(runs.RunRefused, match=field):
        stored(spark, tmp_path, m, expected=wrong)
    assert all(t.count() == 0 for t in runs.read(m).values())
    assert m.state().where("batch_id = 'allocation:b' and status = 'FAILED'").count() == 1
    assert stored(spark, tmp_path, m, expected=right)  # the same batch may be tried again
    assert runs.read(m)["pricing.runs"].count() == 2


def test_runs_that_are_missing_or_unexpected_are_refused(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "store"))
    with pytest.raises(runs.RunRefused):
        stored(spark, tmp_path, m, expected=spark.createDataFrame([("other", 40)], "run_id string, units bigint"))
    assert runs.read(m)["pricing.runs"].count() == 0


@pytest.mark.parametrize("changes, message", [
    ({"vgv_target": {"target_value": "-5.00", "origin": "MANUAL"}}, "target_not_positive"),
    ({"towers": [{"business_key": "TOWER-1", "name": "One"}]}, "unknown_tower"),
    ({"floor_bands": {"LOW": [1, 3], "MID": [4, 7]}}, "floor_without_band"),
    ({"override": {**scenario()["override"], "target_unit_code": "9999"}}, "no unit"),
])
def test_invalid_input_is_refused_before_anything_is_written(spark, tmp_path, changes, message):
    m = Manifest(spark, str(tmp_path / "store"))
    with pytest.raises(allocation.ScenarioError, match=message):
        stored(spark, tmp_path, m, **changes)
    assert not (tmp_path / "store" / "pricing.runs").exists()
    assert all(t.count() == 0 for t in runs.read(m).values())


def test_the_gate_sees_written_tables_only(spark, tmp_path, monkeypatch):
    """A writer that loses a cent between working out and writing is caught."""
    real = runs.tables_of

    def lossy(*args):
        found = real(*args)
        name = "pricing.unit_price_results"
        price = F.col("system_calculated_price")
        found[name] = found[name].withColumn("system_calculated_price", F.when(F.col("unit_code") == "0101", price - F.lit("0.01").cast("decimal(3,2)")).otherwise(price).cast("decimal(18,2)"))
        return found

    monkeypatch.setattr(runs, "tables_of", lossy)
    m = Manifest(spark, str(tmp_path / "store"))
    with pytest.raises(runs.RunRefused, match="severity"):
        stored(spark, tmp_path, m)
    assert runs.read(m)["pricing.unit_price_results"].count() == 0
