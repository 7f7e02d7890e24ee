"""Allocation scenarios from nested JSON files."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proratio.operators.allocation import FLOOR_SET, POSITION_SET, AllocationConfig

SCENARIO = """
development struct<business_key:string,name:string,city:string,state:string,bairro:string,total_floors:int>,
towers array<struct<business_key:string,name:string>>,
typologies array<struct<business_key:string,name:string,bedrooms:int,suites:int,private_area_m2:string,uncovered_area_m2:string>>,
units array<struct<tower_business_key:string,typology_business_key:string,unit_code:string,floor:int,position_category:string>>,
floor_bands map<string,array<int>>,
parameter_set struct<code:string,version:int,parameters:array<struct<key:string,value_type:string,numeric_value:string,unit_of_measure:string,description:string>>>,
calibration_sets array<struct<code:string,dimension:string,entries:array<struct<category_key:string,factor:string>>>>,
vgv_target struct<target_value:string,origin:string,note:string>,
runs map<string,struct<code:string,label:string>>,
override struct<run:string,target_unit_code:string,target_tower_business_key:string,reason:string,override_delta:string,decided_at:string>
"""


def read_scenarios(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per scenario: a file each, or with ``lines`` a line each, so that large files are divided among tasks.

    A development may have several scenarios with a part of its units each.
    """
    found = spark.read.schema(SCENARIO).option("multiLine", not lines).json(path)
    return found.withColumn("development_id", F.col("development.business_key"))


def units(scenarios: DataFrame) -> DataFrame:
    """Units with the areas of their typology; an unknown typology leaves them NULL.

    Scenarios of one development may list a typology again, with the same areas.
    """
    area = "decimal(12,2)"
    kinds = scenarios.select("development_id", F.inline("typologies")).select(
        "development_id", F.col("business_key").alias("typology"), F.col("private_area_m2").cast(area).alias("private_area_m2"),
        F.col("uncovered_area_m2").cast(area).alias("uncovered_area_m2"),
    ).distinct()
    listed = scenarios.select("development_id", F.inline("units")).select(
        "development_id", F.col("tower_business_key").alias("tower"), F.col("typology_business_key").alias("typology"), "unit_code",
        "floor", F.col("position_category").alias("position"),
    )
    return listed.join(kinds, ["development_id", "typology"], "left")


def towers(scenarios: DataFrame) -> DataFrame:
    return scenarios.select("development_id", F.inline("towers")).withColumnRenamed("business_key", "tower")


def typologies(scenarios: DataFrame) -> DataFrame:
    return scenarios.select("development_id", F.inline("typologies")).withColumnRenamed("business_key", "typology")


def targets(scenarios: DataFrame) -> DataFrame:
    return scenarios.where("vgv_target is not null").select("development_id", F.col("vgv_target.target_value").cast("decimal(18,2)").alias("target_value"))


def overrides(scenarios: DataFrame) -> DataFrame:
    return scenarios.where("override is not null").select(
        "development_id", F.col("override.target_tower_business_key").alias("tower"), F.col("override.target_unit_code").alias("unit_code"),
        F.col("override.override_delta").cast("decimal(18,2)").alias("override_delta"), F.col("override.reason").alias("reason"),
        F.col("override.decided_at").cast("timestamp").alias("decided_at"),
    )


def bands(scenarios: DataFrame) -> DataFrame:
    """Floor bands in the order they are declared."""
    return scenarios.select("development_id", F.posexplode(F.map_entries("floor_bands")).alias("ordinal", "e")).select(
        "development_id", F.col("e.key").alias("band"), F.col("e.value")[0].alias("low"), F.col("e.value")[1].alias("high"), "ordinal"
    )


def calibrations(scenarios: DataFrame) -> DataFrame:
    sets = scenarios.select("development_id", F.inline("calibration_sets"))
    return sets.select("development_id", F.col("code").alias("set_code"), F.inline("entries")).withColumn(
        "factor", F.col("factor").cast("decimal(12,6)")
    )


def parameters(scenarios: DataFrame) -> DataFrame:
    return scenarios.select("development_id", F.inline("parameter_set.parameters")).withColumn(
        "numeric_value", F.col("numeric_value").cast("decimal(18,6)")
    )


def config(scenarios: DataFrame) -> AllocationConfig:
    """Configuration of one scenario file, for ``allocation.allocate``."""
    row = scenarios.select("floor_bands", "calibration_sets", "parameter_set.parameters").limit(1).collect()[0]
    sets = {s["code"]: {e["category_key"]: Decimal(e["factor"]) for e in s["entries"]} for s in row["calibration_sets"]}
    return AllocationConfig(
        bands={k: tuple(v) for k, v in row["floor_bands"].items()},
        floor_factors=sets.get(FLOOR_SET, {}), position_factors=sets.get(POSITION_SET, {}),
        parameters={p["key"]: Decimal(p["numeric_value"]) for p in row["parameters"] or [] if p["numeric_value"] is not None},
    )
