"""Allocation as stored runs: written whole, audited from what was written, and only then visible.

A batch holds the runs of any number of developments, each under one or more codes.
It is refused, and stays invisible, if its input is invalid, if what was written does not
add up by itself, or if it differs from what the caller expects of a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proratio.functions.exact import half_even
from proratio.operators import allocation
from proratio.session import attach, stage
from proratio.sources.publish import Manifest

M = "decimal(18,2)"
UNIT = "run_id string, development_id string, tower string, unit_code string"
TABLES = {
    "pricing.runs": "run_id string, development_id string, code string, status string, run_type string, engine_version string, completed_at timestamp",
    "pricing.vgv_targets": "run_id string, development_id string, origin string, target_value decimal(18,2)",
    "pricing.unit_price_results": f"{UNIT}, weighted_area_m2 decimal(16,4), participation_share decimal(9,6), combined_weight_factor decimal(12,6),"
    " system_calculated_price decimal(18,2), system_calculated_price_per_m2 decimal(18,2), result_origin string",
    "pricing.unit_adjustments": f"{UNIT}, sequence_order int, adjustment_type string, input_value decimal(18,6), factor_value decimal(12,6),"
    " result_value decimal(18,6), source_set string, source_key string",
    "pricing.validations": "run_id string, development_id string, check_type string, severity string, expected_value decimal(18,2),"
    " actual_value decimal(18,2), difference decimal(18,2)",
    "pricing.unit_overrides": f"{UNIT}, previous_price decimal(18,2), proposed_price decimal(18,2), final_price decimal(18,2),"
    " vgv_impact decimal(18,2), decided_at timestamp, event_id bigint",
}
#: What is expected of a run may name any of these.
FIELDS = ["units", "target_value", "total", "severity", "logical_hash", "overrides", "override_impact", "final_total"]
STEPS = 3


class RunRefused(ValueError):
    """A run that was written and does not hold; nobody reads it."""


def tables_of(priced: DataFrame, runs: DataFrame, overrides: DataFrame, bound) -> dict[str, DataFrame]:
    """The stored tables of allocated units.

    ``priced`` is a stored allocation; ``runs`` has ``development_id, run_id, code,
    completed_at``, one row per run; ``overrides`` are priced decisions with ``run_id``,
    the unit's keys and prices. ``bound`` proves the number of runs.
    """
    each = attach_runs(priced, runs, bound)
    checks = attach_runs(allocation.reconciliation(priced), runs, bound)
    found = {
        "pricing.runs": runs.select(
            "run_id", "development_id", "code", F.lit("COMPLETED").alias("status"), F.lit("SYSTEM_RUN").alias("run_type"),
            F.lit(allocation.ALGORITHM).alias("engine_version"), "completed_at"),
        "pricing.vgv_targets": checks.select("run_id", "development_id", F.lit("MANUAL").alias("origin"), F.col("expected_value").alias("target_value")),
        "pricing.unit_price_results": each.select(
            "run_id", "development_id", "tower", "unit_code", half_even(F.col("weighted_area_m2"), 4, 16).alias("weighted_area_m2"), "participation_share",
            half_even(F.col("combined_weight_factor"), 6, 12).alias("combined_weight_factor"), F.col("system_price").alias("system_calculated_price"),
            F.col("price_per_m2").alias("system_calculated_price_per_m2"), F.lit("SYSTEM_CALCULATED").alias("result_origin")),
        "pricing.unit_adjustments": each.select("run_id", "development_id", "tower", "unit_code", F.inline(allocation.adjustment_steps())),
        "pricing.validations": checks.select("run_id", "development_id", "check_type", "severity", "expected_value", "actual_value", "difference"),
        "pricing.unit_overrides": overrides,
    }
    return {name: typed(df, TABLES[name]) for name, df in found.items()}


def attach_runs(rows: DataFrame, runs: DataFrame, bound) -> DataFrame:
    """``rows`` of developments, once for each of the development's runs."""
    codes = runs.groupBy("development_id").agg(F.collect_list("run_id").alias("_runs"))  # a few codes each
    return attach(rows, codes, "development_id", bound, "inner").withColumn("run_id", F.explode("_runs")).drop("_runs")


def typed(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema text, in its order and types."""
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in (f.rsplit(" ", 1) for f in schema.split(", "))])


def summary(tables: dict[str, DataFrame], bound) -> DataFrame:
    """Per run what its stored tables amount to; severity and hash are worked out anew from the stored results."""
    results = attach(tables["pricing.unit_price_results"], tables["pricing.vgv_targets"].select("run_id", "target_value"), "run_id", bound)
    zero = F.lit(0).cast(M)
    # Numbers alone are added up where the units are: a text among them would have every unit sorted.
    money = F.col("system_calculated_price")
    owned = results.groupBy("run_id", "development_id").agg(
        F.count(F.lit(1)).alias("units"), F.max("target_value").alias("target_value"), F.sum(money).alias("total"), F.count_if(money.isNull()).alias("unpriced"))
    sums = owned.groupBy("run_id").agg(
        F.max("development_id").alias("development_id"), F.sum("units").alias("units"), F.max("target_value").alias("target_value"),
        F.sum("total").cast(M).alias("total"), F.sum("unpriced").alias("unpriced"))
    units = results.select(
        F.col("run_id").alias("development_id"), "tower", "unit_code", "target_value", F.col("system_calculated_price").alias("system_price"),
        F.col("system_calculated_price_per_m2").alias("price_per_m2"), "weighted_area_m2", "participation_share", "combined_weight_factor")
    hashes = allocation.logical_hash(units, bound).withColumnRenamed("development_id", "run_id")
    steps = tables["pricing.unit_adjustments"].groupBy("run_id").agg(F.count(F.lit(1)).alias("adjustments"))
    decided = tables["pricing.unit_overrides"].groupBy("run_id").agg(
        F.count(F.lit(1)).alias("overrides"), F.sum("vgv_impact").cast(M).alias("override_impact"))
    stored = tables["pricing.validations"].select("run_id", F.col("severity").alias("stored_severity"))
    found = sums
    for part in (hashes, steps, decided, stored):
        found = attach(found, part, "run_id", bound)
    difference = (F.col("total") - F.col("target_value")).cast(M)
    impact = F.coalesce("override_impact", zero)
    return found.select(
        "run_id", "development_id", "units", F.coalesce("adjustments", F.lit(0)).cast("bigint").alias("adjustments"), "target_value", "total",
        difference.alias("difference"), F.when((difference == 0) & (F.col("unpriced") == 0), "INFO").otherwise("ERROR").alias("severity"),
        "stored_severity", "logical_hash", F.coalesce("overrides", F.lit(0)).cast("bigint").alias("overrides"), impact.alias("override_impact"),
        (F.col("total") + impact).cast(M).alias("final_total"))


def problems(found: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(run_id, field, expected, actual): what does not hold of stored runs, by themselves or against ``expected``.

    ``expected`` has run_id and some of ``FIELDS``; a run that only one side has differs in all of them.
    """
    def text(c):
        return c.cast("string")

    inside = F.array_compact(F.array(
        F.when(F.col("severity") != "INFO", F.struct(F.lit("severity").alias("field"), F.lit("INFO").alias("expected"), F.col("severity").alias("actual"))),
        F.when(~F.col("severity").eqNullSafe(F.col("stored_severity")), F.struct(F.lit("stored_severity").alias("field"), F.col("severity").alias("expected"), F.col("stored_severity").alias("actual"))),
        F.when(F.col("adjustments") != F.col("units") * STEPS, F.struct(
            F.lit("adjustments").alias("field"), text(F.col("units") * STEPS).alias("expected"), text(F.col("adjustments")).alias("actual"))),
    ))
    own = found.select("run_id", F.inline(inside))
    if expected is None:
        return own
    fields = [f for f in FIELDS if f in expected.columns]
    return own.unionByName(allocation.verify(expected, found, ["run_id"], fields)).distinct()


def read(manifest: Manifest) -> dict[str, DataFrame]:
    """The visible rows of all run tables."""
    return {name: manifest.read(name, schema) for name, schema in TABLES.items()}


def store(manifest: Manifest, batch: str, units: DataFrame, targets: DataFrame, config: allocation.AllocationConfig, runs: DataFrame,
          events: DataFrame, *, override_code: str, keys: list[str], bound, towers: DataFrame | None = None, typologies: DataFrame | None = None,
          expected: DataFrame | None = None) -> bool:
    """Validate, allocate, write and audit the runs of a batch; True if this call made it visible.

    ``events`` are override decisions by ``keys`` of a unit; they go to the runs of
    ``override_code``. A decision about no unit refuses the batch, as do
    ``expected`` values that a run does not have.
    """
    def tables():
        allocation.require_valid(units, targets, config, towers, typologies)
        priced = stage(allocation.allocate(units, targets, config, bound))
        stray = allocation.override_errors(priced, events, keys).limit(5).collect()
        if stray:
            raise allocation.ScenarioError(f"decisions about no unit: {[tuple(r[k] for k in keys) for r in stray]}")
        decided = runs.where(F.col("code") == override_code).select("development_id", "run_id")
        overrides = allocation.apply_overrides(priced, events, keys, carry=tuple(c for c in ("development_id", "tower", "unit_code") if c not in keys))
        return tables_of(priced, runs, attach(overrides, decided, "development_id", bound, "inner"), bound)

    def check(written):
        # The gate reads what was written, not what was meant to be.
        sample = problems(stage(summary(written, bound)), expected).limit(5).collect()
        if sample:
            raise RunRefused("; ".join(f"{r['run_id']}: {r['field']} {r['actual']}, not {r['expected']}" for r in sample))

    return manifest.publish(f"allocation:{batch}", tables, check)
