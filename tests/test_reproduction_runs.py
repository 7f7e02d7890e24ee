"""Stored reproductions: resumed from the manifest, both variants in one pass, finished developments never read again."""

from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from proratio.operators import reproduction_runs as rr
from proratio.operators import rulegraph
from proratio.sources.publish import FOLDER, Manifest

RULES = rulegraph.Ruleset({
    "inputs": {n: {} for n in ("area", "shelf", "rate")},
    "rules": [
        {"output": "slope", "operation": "lookup_table", "operands": {"key_source_field": "shelf"}},
        {"output": "shaped", "operation": "multiply_factors", "operands": {"base": "area", "factors": ["slope"]}},
        {"output": "all_shaped", "operation": "group_sum", "operands": {"fields": ["shaped"]}},
        {"output": "money", "operation": "multiply_by_parameter", "operands": {"field": "all_shaped", "parameter": "rate"}},
        {"output": "part", "operation": "ratio_to_group_total", "operands": {"numerator_field": "shaped", "group_total_field": "all_shaped"}},
        {"output": "unit_price", "operation": "linear_price", "operands": {"participation_field": "part", "group_value_field": "money"}},
    ],
})
SCHEMA = "development_id bigint, unit_id bigint, ordinal bigint, area decimal(12,2), shelf string, rate decimal(18,6)"
AREAS = {1: (10, 20, 40), 2: (7, 9), 3: (5, 5, 5, 8)}
VARIANTS = ["forced", "plain"]


def tables(spark):
    rows = [(d, k, f) for d in AREAS for k, f in (("low", "-0.10"), ("high", "0.25"))]
    return {"slope": spark.createDataFrame(rows, "group_id bigint, category_key string, factor string").withColumn("factor", F.col("factor").cast("decimal(12,6)"))}


def units(spark):
    rows = [(d, d * 10 + i, i, Decimal(a), "high" if i % 2 else "low", Decimal(100 + d)) for d, areas in AREAS.items() for i, a in enumerate(areas)]
    return spark.createDataFrame(rows, SCHEMA)


def imported(spark):
    rows = [(str(d), d * 10 + i, Decimal("900.00"), f"I{d}") for d, areas in AREAS.items() for i in range(len(areas))]
    return spark.createDataFrame(rows, rr.IMPORTED_SCHEMA)


def run(spark, manifest, version="v1", attempt="", chosen=None):
    return sorted(tuple(r) for r in rr.reproduce(
        manifest, version, RULES, SCHEMA, tables(spark), variants=VARIANTS, forced_output="slope", forced_key="high", forced=F.col("unit_id") % 10 == 0,
        attempt=attempt, chosen=None if chosen is None else spark.createDataFrame([(d,) for d in chosen], "development_id bigint")).collect())


@pytest.fixture
def manifest(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "store"))
    rr.store_inputs(m, units(spark), imported(spark))
    return m


def want(d, variant):
    """Prices by hand: area times slope, which the share of the group's money comes to."""
    slopes = [Decimal("1.25") if i % 2 or (variant == "forced" and i == 0) else Decimal("0.90") for i in range(len(AREAS[d]))]
    return [(a * s * (100 + d)).quantize(Decimal("0.01")) for a, s in zip(AREAS[d], slopes)]


def test_both_variants_are_priced_in_groups_of_their_own(spark, manifest):
    assert run(spark, manifest) == [(f"{rr.COMPARED}:v1:{d}", "COMPLETED") for d in AREAS]
    got = {(r["development_id"], r["variant"], r["unit_id"]): r for r in rr.comparisons(manifest, "v1").collect()}
    assert {k: r["reproduced_price"] for k, r in got.items()} == {
        (str(d), v, d * 10 + i): p for d in AREAS for v in VARIANTS for i, p in enumerate(want(d, v))}
    assert all(r["delta_absolute"] == r["reproduced_price"] - Decimal("900.00") and r["imported_run_id"] == f"I{k[0]}" for k, r in got.items())


def test_finished_developments_are_not_read_again(spark, manifest):
    assert [b[-1] for b, _ in run(spark, manifest, attempt="one", chosen=[2])] == ["2"]
    # Whoever opened a file of the finished development's units would fail.
    paths = {r["path"] for r in manifest.state().where(f"batch_id = '{rr.UNITS}:2' and table_name <> '-'").collect()}
    for path in paths:
        for file in Path(manifest.root, rr.UNITS, f"{FOLDER}={path}").glob("*.parquet"):
            file.write_bytes(b"not a parquet file at all, nor anything like one")
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert {r["development_id"] for r in rr.pending(manifest, "v1").collect()} == {"1", "3"}
    assert [b[-1] for b, _ in run(spark, manifest, attempt="two")] == ["1", "3"]
    assert run(spark, manifest, attempt="three") == []
    assert {(r["development_id"], r["attempt"]) for r in rr.comparisons(manifest, "v1").collect()} == {("1", "two"), ("2", "one"), ("3", "two")}


def test_another_ruleset_version_starts_anew_and_new_developments_are_pending(spark, manifest):
    run(spark, manifest)
    assert {r["development_id"] for r in rr.pending(manifest, "v2").collect()} == {"1", "2", "3"}
    more = units(spark).where("development_id = 3").withColumn("development_id", F.lit(4).cast("bigint"))
    rr.store_inputs(manifest, more, imported(spark))
    assert [r["development_id"] for r in rr.pending(manifest, "v1").collect()] == ["4"]
    # Nothing is known of its slopes and no price was imported: it is kept, blocked.
    assert run(spark, manifest) == [(f"{rr.COMPARED}:v1:4", "COMPLETED")]
    rows = rr.comparisons(manifest, "v1").where("development_id = '4'").collect()
    assert len(rows) == 8 and {r["match_classification"] for r in rows} == {"BLOCKED"}


def test_a_call_that_fails_leaves_its_developments_pending(spark, manifest, monkeypatch):
    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(rr.reproduction, "compare", fails)
    with pytest.raises(RuntimeError):
        run(spark, manifest)
    monkeypatch.undo()
    assert rr.pending(manifest, "v1").count() == 3 and len(run(spark, manifest)) == 3
