"""Sets compared from both sides in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEFT, RIGHT = 1, 2


def membership(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Each key of either side once, with ``sides``: 1 only left, 2 only right, 3 both.

    Rows are tagged, put together and combined by key where they are, so repeated keys
    cost nothing and neither side is joined or broadcast. NULL is a key like others.
    """
    tagged = left.select(*keys, F.lit(LEFT).alias("side")).unionByName(right.select(*keys, F.lit(RIGHT).alias("side")))
    return tagged.groupBy(*keys).agg(F.bit_or("side").alias("sides"))


def differences(left: DataFrame, right: DataFrame, keys: list[str], left_only: str = "left", right_only: str = "right") -> DataFrame:
    """Keys that one side alone has, and ``only``, which one; no row means that the sets are equal."""
    found = membership(left, right, keys).where(F.col("sides") != (LEFT | RIGHT))
    return found.select(*keys, F.when(F.col("sides") == LEFT, left_only).otherwise(right_only).alias("only"))


def required_columns(df: DataFrame, required: list[str]) -> tuple[list[str], list[str]]:
    """(missing, surplus) columns of a table, against those it must have."""
    return [c for c in required if c not in df.columns], [c for c in df.columns if c not in required]


def equal(left: DataFrame, right: DataFrame, keys: list[str]) -> bool:
    return not differences(left, right, keys).limit(1).collect()

