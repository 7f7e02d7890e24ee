import json
import random
from dataclasses import replace
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal, getcontext

import pytest
from golden import HASH, scenario
from pyspark.sql import functions as F

from proratio.functions.exact import mul_div
from proratio.operators import allocation
from proratio.sources import scenario as source

getcontext().prec = 80


def load(spark, tmp_path, **changes):
    path = tmp_path / f"s{random.random()}.json"
    path.write_text(json.dumps(scenario(**changes)))
    rows = source.read_scenarios(spark, str(path))
    return rows, source.units(rows), source.targets(rows), source.config(rows)


def priced(spark, tmp_path, **changes):
    _, units, targets, config = load(spark, tmp_path, **changes)
    return allocation.allocate(units, targets, config)


def by_unit(df):
    return {(r["tower"], r["unit_code"]): r for r in df.collect()}


def test_golden_scenario(spark, tmp_path):
    rows, units, targets, config = load(spark, tmp_path)
    found = allocation.allocate(units, targets, config)
    got = by_unit(found)
    assert len(got) == 40
    assert got["TOWER-1", "0101"]["system_price"] == Decimal("125066.70")
    assert sum(r["system_price"] for r in got.values()) == Decimal("10000000.00")
    assert [(k, r["residual_applied"]) for k, r in got.items() if r["residual_applied"] is not None] == [
        (("TOWER-1", "0802"), Decimal("0.06"))
    ]
    check = allocation.reconciliation(found).collect()[0]
    assert (check["severity"], check["difference"]) == ("INFO", Decimal("0.00"))
    assert allocation.published_hash(found).collect()[0]["logical_hash"] == HASH


def test_golden_override(spark, tmp_path):
    rows, units, targets, config = load(spark, tmp_path)
    found = allocation.allocate(units, targets, config)
    keys = ["development_id", "tower", "unit_code"]
    events = source.overrides(rows)
    record = allocation.apply_overrides(found, events, keys)
    got = record.collect()[0]
    before = by_unit(found)["TOWER-2", "0502"]["system_price"]
    assert (got["previous_price"], got["final_price"], got["vgv_impact"]) == (before, before - Decimal("1234.56"), Decimal("-1234.56"))
    total = allocation.run_totals(found, record, 1).collect()[0]
    assert (total["system_vgv"], total["final_vgv"], total["vgv_delta_after_override"]) == (
        Decimal("10000000.00"), Decimal("9998765.44"), Decimal("-1234.56"))
    stray = events.withColumn("unit_code", F.lit("9999"))
    assert allocation.override_errors(found, stray, keys).count() == 1
    assert allocation.apply_overrides(found, stray, keys).count() == 0


def test_hash_follows_values_at_any_size(spark, tmp_path):
    found = priced(spark, tmp_path)
    once = allocation.logical_hash(found, 1).collect()[0]["logical_hash"]
    assert allocation.logical_hash(found.repartition(7), 1).collect()[0]["logical_hash"] == once
    assert allocation.logical_hash(found.where("unit_code <> '0101'"), 1).collect()[0]["logical_hash"] != once
    for tower in (F.repeat(F.lit("x"), 3000), F.lit(None).cast("string")):
        other = allocation.logical_hash(found.withColumn("tower", tower), 1).collect()[0]["logical_hash"]
        assert other not in (None, once)


def three_units(spark, positions=("A", "A", "A"), tower=None):
    rows = [("d", tower, f"u{i}", "T", 1, p, Decimal("50.00"), Decimal("0.00")) for i, p in enumerate(positions)]
    units = spark.createDataFrame(rows, "development_id string, tower string, unit_code string, typology string, floor int, position string,"
                                  " private_area_m2 decimal(12,2), uncovered_area_m2 decimal(12,2)")
    return units, spark.createDataFrame([("d", Decimal("100.00"))], "development_id string, target_value decimal(18,2)")


def test_a_unit_without_a_tower_takes_the_residual(spark, tmp_path):
    units, targets = three_units(spark)
    found = allocation.allocate(units, targets, load(spark, tmp_path)[3])
    assert sorted(r["system_price"] for r in found.collect()) == [Decimal("33.33"), Decimal("33.33"), Decimal("33.34")]
    assert allocation.reconciliation(found).collect()[0]["severity"] == "INFO"


def test_an_uncalibrated_unit_blocks_its_development(spark, tmp_path):
    units, targets = three_units(spark, ("A", "nowhere", "A"), "t")
    config = load(spark, tmp_path)[3]
    found = allocation.allocate(units, targets, config)
    assert [r["system_price"] for r in found.collect()] == [None] * 3
    assert allocation.reconciliation(found).collect()[0]["severity"] == "ERROR"
    assert [tuple(r)[2:] for r in allocation.unpriced(allocation.unit_weights(units, config)).collect()] == [("u1", "position_factor")]


def test_double_target_doubles_all_but_the_residual_unit(spark, tmp_path):
    one = by_unit(priced(spark, tmp_path))
    two = by_unit(priced(spark, tmp_path, vgv_target={"target_value": "20000000.00"}))
    for key, row in two.items():
        slack = Decimal("1.00") if row["residual_applied"] or one[key]["residual_applied"] else Decimal("0.01")
        assert abs(row["system_price"] - 2 * one[key]["system_price"]) <= slack
    assert sum(r["system_price"] for r in two.values()) == Decimal("20000000.00")


def test_sensitivity_is_monotonic(spark, tmp_path):
    _, units, targets, config = load(spark, tmp_path)
    high = {**config.floor_factors, "HIGH": Decimal("1.50")}
    even = replace(config, parameters={allocation.UNCOVERED: Decimal("1.00")})
    variants = {"base": (config, Decimal(1)), "high": (replace(config, floor_factors=high), Decimal(1)), "unc": (even, Decimal(1))}
    rows = allocation.sensitivity(units, targets, variants)
    band = {(r["variant"], r["floor_band"]): r["share"] for r in allocation.participation_by(rows, "variant", "floor_band").collect()}
    assert band["high", "HIGH"] > band["base", "HIGH"] and band["high", "LOW"] < band["base", "LOW"]
    kind = {(r["variant"], r["typology"]): r["share"] for r in allocation.participation_by(rows, "variant", "typology").collect()}
    assert kind["unc", "TYPE_D"] > kind["base", "TYPE_D"] and kind["unc", "TYPE_A"] < kind["base", "TYPE_A"]


@pytest.mark.parametrize("changes, rule", [
    ({"units": [{**scenario()["units"][0], "tower_business_key": "X"}]}, "unknown_tower"),
    ({"units": [{**scenario()["units"][0], "typology_business_key": "X"}]}, "unknown_typology"),
    ({"units": [scenario()["units"][0]] * 2}, "duplicate_unit"),
    ({"units": [{**scenario()["units"][0], "floor": 11}]}, "floor_without_band"),
    ({"units": [{**scenario()["units"][0], "position_category": "Z"}]}, "position_without_calibration"),
    ({"vgv_target": {"target_value": "-5.00"}}, "target_not_positive"),
])
def test_invalid_inputs_are_named(spark, tmp_path, changes, rule):
    rows, units, targets, config = load(spark, tmp_path, **changes)
    found = allocation.violations(units, targets, config, source.towers(rows), source.typologies(rows))
    assert rule in {r["rule"] for r in found.collect()}
    with pytest.raises(allocation.ScenarioError):
        allocation.require_valid(units, targets, config, source.towers(rows), source.typologies(rows))


def test_invalid_configuration(spark, tmp_path):
    *_, config = load(spark, tmp_path)
    for wrong in (replace(config, parameters={}), replace(config, floor_factors={}), replace(config, bands={"LOW": (3, 1)})):
        with pytest.raises(allocation.ScenarioError):
            wrong.check()


def test_zero_area_is_a_violation(spark, tmp_path):
    kinds = [{**t, "private_area_m2": "0.00"} for t in scenario()["typologies"]]
    _, units, targets, config = load(spark, tmp_path, typologies=kinds)
    assert allocation.violations(units, targets, config).where("rule = 'area_not_positive'").count() == 40


def test_tables_and_configuration_agree(spark, tmp_path):
    rows, units, targets, config = load(spark, tmp_path)
    weights = allocation.table_weights(units, source.bands(rows), source.calibrations(rows), source.parameters(rows), (2, 2, 2), (10, 7, 1))
    a = by_unit(allocation.allocate_weights(units.columns, weights, targets, (2, 2, 2)))
    b = by_unit(allocation.allocate(units, targets, config))
    assert {k: r["system_price"] for k, r in a.items()} == {k: r["system_price"] for k, r in b.items()}


def test_first_declared_band_wins(spark):
    bands = spark.createDataFrame([(1, "A", 1, 4, 0), (1, "B", 3, 6, 1), (1, "C", 9, 8, 2)], "development_id int, band string, low int, high int, ordinal int")
    got = {r["floor"]: r["floor_band"] for r in allocation.band_table(bands).collect()}
    assert got == {1: "A", 2: "A", 3: "A", 4: "A", 5: "B", 6: "B"}


@pytest.mark.parametrize("digits", [(18, 20, 30), (18, 27, 30), (18, 30, 33), (6, 6, 8)])
@pytest.mark.parametrize("even", [False, True])
def test_exact_division(spark, digits, even):
    rng = random.Random(7)
    rows = []
    for _ in range(200):
        total = rng.randrange(1, 10 ** digits[2])
        w = rng.randrange(0, min(total, 10 ** digits[1] - 1) + 1)
        rows.append((rng.randrange(0, 10 ** digits[0]), w, total))
    rows += [(1, 1, 2), (3, 1, 2), (5, 1, 2), (10 ** digits[0] - 1, 1, 1), (0, 0, 1)]
    schema = ", ".join(f"{n} decimal({d},0)" for n, d in zip("twm", digits))
    df = spark.createDataFrame([tuple(map(Decimal, r)) for r in rows], schema)
    got = df.select(mul_div(F.col("t"), F.col("w"), F.col("m"), digits=digits, even=even).alias("q")).collect()
    mode = ROUND_HALF_EVEN if even else ROUND_HALF_UP
    for (t, w, m), r in zip(rows, got):
        assert r["q"] == int((Decimal(t * w) / m).quantize(Decimal(1), rounding=mode)), (t, w, m)


def test_json_text_is_escaped_like_the_canonical_form(spark):
    from proratio.functions.text import json_string

    texts = ["plain", 'q"b\\', "é\n\t", "🏢 x", "\x01"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(json_string(F.col("t")).alias("j")).collect()
    assert [r["j"] for r in got] == [json.dumps(t) for t in texts]


def test_rounding(spark):
    from proratio.functions.exact import half_even, money

    df = spark.createDataFrame([(Decimal("0.005"),), (Decimal("0.015"),), (Decimal("-0.005"),)], "v decimal(10,3)")
    got = df.select(money(F.col("v")).alias("m"), half_even(F.col("v"), 2, 10).alias("e")).collect()
    assert [(r["m"], r["e"]) for r in got] == [(Decimal("0.01"), 0), (Decimal("0.02"), Decimal("0.02")), (Decimal("-0.01"), 0)]
