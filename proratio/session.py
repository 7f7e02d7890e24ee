"""Session settings and the three physical helpers every operator shares.

``stage``   cuts lineage by writing a table to the shared checkpoint folder.
``attach``  joins a small keyed table onto a large one; it broadcasts only when a
            counted bound proves the small side is small.
``skew_join`` joins two large tables; it measures which keys are hot, and divides those alone.
``rows_within`` is that bounded count.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a broadcast side may have. The sides are keys plus a few fixed-width
# columns, so this is at most some tens of megabytes per executor.
BROADCAST_ROWS = 200_000

# Tasks the rows of a hot key are divided among where a broadcast is not allowed.
SALTS = 32
# A key is hot if it has more than one in so many of the rows; so there are fewer hot keys than this.
HOT = 256

# Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_root: list[str] = []

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("proratio")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        # Local tables are small: without these one core would do all the work.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.files.openCostInBytes", "128k")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local session may use its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="proratio-"))
    return _local_root[0]


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a derived table is read several times: one pass over the source
    instead of one per reader, and lost executors cost a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/proratio/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    # Nobody reads the shuffles of this write again; else they stay until the driver happens to collect its garbage.
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, dealt out to all of them.

    For work that multiplies rows; a table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # The length of the list alone: df.inputFiles() would bring every name to Python.
    files = len(df._jdf.inputFiles())
    return df if files >= cores else df.repartition(cores)


def counted(df: DataFrame) -> int:
    """Row count, or BROADCAST_ROWS + 1 when there are more: a bound to pass to ``attach``."""
    return df.select(F.lit(1)).limit(BROADCAST_ROWS + 1).count()


def rows_within(df: DataFrame) -> bool:
    """Whether ``df`` has at most BROADCAST_ROWS rows; stops counting just past it."""
    return counted(df) <= BROADCAST_ROWS


def fits(bound) -> bool:
    """Whether a bound (a number, or a table to count) allows a broadcast."""
    return bound <= BROADCAST_ROWS if isinstance(bound, int) else rows_within(bound)


def attach(big: DataFrame, small: DataFrame, on, bound, how: str = "left") -> DataFrame:
    """Join ``small`` (one row per key) onto ``big``: left, inner, left_semi or left_anti.

    ``bound`` proves how many rows ``small`` can have: a number known on the
    driver, or a table with at least as many rows (``small`` itself, or the
    dimension its keys come from). Within BROADCAST_ROWS the small side is
    broadcast, so ``big`` is not shuffled.

    Beyond it the join is a ``skew_join``.
    """
    if fits(bound):
        return big.join(F.broadcast(small), on, how)
    return skew_join(big, small, on, how)


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one in ``HOT`` rows of ``df`` have, stored; counted where the rows are."""
    total = df.count()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return stage(counts.where(F.col("_n") > max(total // HOT, SALTS)).select(*keys))


def skew_join(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Shuffled join (inner, left, left_semi or left_anti) in which a key of ``big`` may hold any share of its rows.

    The hot keys are measured first, and only their rows get a salt and only their rows
    of ``small`` are copied, once per salt; all else joins as it is. Rows of ``big``
    with a NULL key match nothing and are dealt out as well. Salts follow from a
    row's values and partition, so a repeated task gives them again.
    """
    keys = [on] if isinstance(on, str) else list(on)
    hot = hot_keys(big, keys)
    values = [F.col(c) for c, kind in big.dtypes if not kind.startswith(("map", "variant", "interval"))]
    salt = F.pmod(F.xxhash64(*values) + F.spark_partition_id(), F.lit(SALTS)).cast("int")
    none = F.lit(False)
    for k in keys:
        none = none | F.col(k).isNull()
    marked = big.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    salted = marked.withColumn("_salt", F.when(F.col("_hot") | none, salt).otherwise(0)).drop("_hot")
    copies = small.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
