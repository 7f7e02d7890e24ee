"""Helpers the operators share: a stored table that cuts lineage, exact ranks, whole texts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session (tests) that names none gets a folder of its own; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="proratio-llm-"))
    return _own_folder[0]


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from where the driver did.

    On a cluster it is installed on the machines, or given with ``--py-files``.
    """
    context, root = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = context.environment.get("PYTHONPATH", "")
    if context.master.startswith("local[") and root not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [known])])


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and read it back.

    What reads it afterwards depends on files in the shared folder alone: a lost
    executor costs a second read, and row ids given before stay as they are.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ranked(df: DataFrame, order: list, group: list[str] = (), name: str = "rank") -> DataFrame:
    """``df`` with the place of each row (a long from 0) in the order of ``order`` within ``group``.

    A range sort deals the rows out, so a group of any size spreads over many tasks;
    each task numbers its rows, and the rows before it in the group are added from a
    table with one row per task and group it has, which is broadcast: ranges do not
    overlap, so there are fewer rows than tasks and groups together. Rows that tie get
    places in any order. Null is a group of its own, and sorts first.
    """
    keys = [F.col(g) for g in group]
    sort = [*keys, *[F.col(o) if isinstance(o, str) else o for o in order]]
    placed = stored(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_llm_at", F.monotonically_increasing_id()), "ranked"
    ).withColumn("_llm_part", F.shiftright("_llm_at", 33))
    counts = placed.groupBy("_llm_part", *keys).agg(F.min("_llm_at").alias("_llm_first"), F.count(F.lit(1)).alias("_llm_n"))
    before = Window.partitionBy(*keys).orderBy("_llm_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_llm_before", F.coalesce(F.sum("_llm_n").over(before), F.lit(0)))
    shift = counts.select(
        F.col("_llm_part").alias("_llm_p"), *[F.col(g).alias(f"_llm_g{i}") for i, g in enumerate(group)],
        (F.col("_llm_before") - F.col("_llm_first")).alias("_llm_shift"),
    )
    same = F.col("_llm_part") == F.col("_llm_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_llm_g{i}"))
    return placed.join(F.broadcast(shift), same).withColumn(name, F.col("_llm_at") + F.col("_llm_shift")).drop(
        "_llm_at", "_llm_part", "_llm_p", "_llm_shift", *[f"_llm_g{i}" for i in range(len(group))])
