"""Appending without repeating, and publishing all or nothing.

A batch is written to folders of its own first. It becomes visible only when the
manifest has a COMPLETED entry for it. The manifest is a log of numbered versions;
a version is a file that is created exclusively, so of two writers that try the same
number one wins, and the other looks again at what the first one did before it tries the
next. Every ``SNAPSHOT`` versions the state is written as a table, so a reader
lists and reads few files however long the log is.

Data of a table lie under one folder, partitioned by batch folder. Readers join it with
the completed entries, so other partitions are pruned and no path passes the driver.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proratio.session import attach

ENTRY = "batch_id string, table_name string, path string, status string, recorded_at timestamp, note string"
MANIFEST = f"{ENTRY}, version bigint"
#: Versions between two snapshots of the state.
SNAPSHOT = 16
#: The partition column of stored tables.
FOLDER = "batch_folder"


def not_stored(incoming: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is new, one per key: the first by ``order``."""
    others = [c for c in incoming.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("r")).select(*keys, "r.*")
    return first.join(stored.select(*keys), keys, "left_anti").select(*incoming.columns)


class Folder:
    """A folder of whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = path
        self.fs = self._at(path).getFileSystem(self.conf)

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self) -> list[str]:
        here = self._at(self.path)
        return [s.getPath().getName() for s in self.fs.listStatus(here)] if self.fs.exists(here) else []

    def has(self, name: str) -> bool:
        return self.fs.exists(self._at(f"{self.path}/{name}"))

    def put_if_absent(self, name: str, text: str) -> bool:
        """Create a file with its whole content, unless there is one; of several callers one is told True.

        It is written aside and renamed without overwriting, which HDFS and the stores
        that keep its contract do in one step.
        """
        target, aside = self._at(f"{self.path}/{name}"), self._at(f"{self.path}/.{uuid.uuid4().hex}")
        out = self.fs.create(aside)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(target).toUri(), self.conf)
            none = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getDeclaringClass(), 0)
            context.rename(self.fs.makeQualified(aside), self.fs.makeQualified(target), none)
            return True
        except Py4JJavaError:
            if not self.fs.exists(target):
                raise
            self.fs.delete(aside, False)
            return False


class Manifest:
    """Log of batches under one shared folder; a batch's newest entry is its state."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Folder(spark, f"{self.root}/_log")

    # --- the log ---

    def _versions(self) -> tuple[int, list[int], str | None]:
        """The newest version, those after the newest snapshot, and that snapshot's folder."""
        names = self.log.names()
        numbers = sorted(int(n[:-5]) for n in names if n.endswith(".json"))
        snapshots = [n for n in names if n.startswith("snapshot-") and self.log.has(f"{n}/_SUCCESS")]
        newest = max(snapshots, default=None)
        base = int(newest.split("-")[1]) if newest else 0
        return max(numbers, default=0), [n for n in numbers if n > base], newest

    def rows(self) -> DataFrame:
        """The newest snapshot's entries and all later ones."""
        _, numbers, snapshot = self._versions()
        found = self.spark.createDataFrame([], MANIFEST)
        if snapshot:
            found = found.union(self.spark.read.schema(MANIFEST).parquet(f"{self.log.path}/{snapshot}"))
        if numbers:
            files = [f"{self.log.path}/{n:020d}.json" for n in numbers]
            lines = self.spark.read.schema(f"{ENTRY}, entries string").json(files).withColumn(
                "version", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).cast("bigint"))
            found = found.union(lines.where("entries is null").drop("entries"))
            # A version of very many batches keeps its entries as a table beside it.
            for row in lines.where("entries is not null").select("entries", "version").collect():
                more = self.spark.read.schema(ENTRY).json(f"{self.log.path}/{row['entries']}")
                found = found.union(more.withColumn("version", F.lit(row["version"]).cast("bigint")))
        return found

    def state(self) -> DataFrame:
        newest = F.max_by(F.struct("path", "status", "note", "recorded_at", "version"), F.col("version")).alias("r")
        return self.rows().groupBy("batch_id", "table_name").agg(newest).select("batch_id", "table_name", "r.*")

    def completed(self, batch_id: str) -> bool:
        found = self.state().where((F.col("batch_id") == batch_id) & (F.col("status") == "COMPLETED"))
        return bool(found.limit(1).collect())

    def _commit(self, lines: Callable[[], list[dict] | None]) -> bool:
        """Append a version with what ``lines`` gives; it is asked again whenever another writer was first."""
        while True:
            last = self._versions()[0]
            entries = lines()  # judged by all versions up to the last one, at least
            if entries is None:
                return False
            version = last + 1
            if self.log.put_if_absent(f"{version:020d}.json", "".join(json.dumps(e) + "\n" for e in entries)):
                break
        if version % SNAPSHOT == 0:
            self.compact()
        return True

    def compact(self) -> None:
        """Write the state as a snapshot; versions stay for whoever wants the history."""
        version, numbers, _ = self._versions()
        if numbers:
            columns = [c.split()[0] for c in MANIFEST.split(", ")]
            self.state().select(*columns).where(F.col("version") <= version).coalesce(1).write.parquet(
                f"{self.log.path}/snapshot-{version:020d}-{uuid.uuid4().hex}")

    @staticmethod
    def _entries(batch_id: str, paths: dict[str, str], status: str, note: str = "") -> list[dict]:
        now = datetime.datetime.now(datetime.timezone.utc).isoformat()
        return [{"batch_id": batch_id, "table_name": t, "path": p, "status": status, "recorded_at": now, "note": note} for t, p in paths.items()]

    # --- writing ---

    def publish(self, batch_id: str, tables: Callable[[], dict[str, DataFrame]], check: Callable[[dict[str, DataFrame]], None] | None = None) -> bool:
        """Write all tables of one batch; True if this call published it.

        A batch already COMPLETED is left alone. Its RUNNING entry is written before
        the data, so a failure can be marked FAILED and tried again. ``check`` sees
        what was written and may refuse it. Of two calls that write the same batch at
        the same time one is published; the other's folders are never read.
        """
        if self.completed(batch_id):
            return False
        folder = f"{hashlib.sha256(batch_id.encode()).hexdigest()[:16]}-{uuid.uuid4().hex[:12]}"
        self._commit(lambda: self._entries(batch_id, {"-": folder}, "RUNNING"))
        try:
            found = tables()
            for table, rows in found.items():
                rows.write.parquet(f"{self.root}/{table}/{FOLDER}={folder}")
            if check is not None:
                check({t: self.spark.read.schema(df.schema).parquet(f"{self.root}/{t}/{FOLDER}={folder}") for t, df in found.items()})
        except Exception as error:
            note = str(error)
            self._commit(lambda: None if self.completed(batch_id) else self._entries(batch_id, {"-": folder}, "FAILED", note))
            raise
        done = {"-": folder, **{t: folder for t in found}}
        return self._commit(lambda: None if self.completed(batch_id) else self._entries(batch_id, done, "COMPLETED"))

    def publish_each(self, table: str, rows: DataFrame, batch: Column, refused: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Publish many batches of one table in one write and one version; (batch_id, status) of each.

        ``batch`` names the batch of a row. ``refused`` is given what was written,
        with its ``batch_id``, and returns (batch_id, note) of those to mark FAILED.
        Batches already COMPLETED are left alone.
        """
        def open_(df: DataFrame) -> DataFrame:
            done = self.state().where((F.col("status") == "COMPLETED") & (F.col("table_name") == table))
            return df.join(done.select("batch_id"), "batch_id", "left_anti")

        attempt = uuid.uuid4().hex[:12]
        folder = F.concat(F.substring(F.sha2("batch_id", 256), 1, 16), F.lit(f"-{attempt}"))
        incoming = open_(rows.withColumn("batch_id", batch.cast("string"))).withColumn(FOLDER, folder)
        # Rebalanced: few files for a small batch, several tasks for a large one.
        incoming.hint("rebalance", F.col(FOLDER)).write.partitionBy(FOLDER).mode("append").parquet(f"{self.root}/{table}")
        everything = self.spark.read.schema(f"{rows_ddl(rows)}, batch_id string, {FOLDER} string").parquet(f"{self.root}/{table}")
        written = everything.where(F.col(FOLDER).endswith(f"-{attempt}"))
        names = written.groupBy("batch_id", FOLDER).agg(F.count(F.lit(1)).alias("rows"))
        bad = refused(written) if refused else self.spark.createDataFrame([], "batch_id string, note string")
        judged = names.join(bad, "batch_id", "left").select(
            "batch_id", F.lit(table).alias("table_name"), F.col(FOLDER).alias("path"),
            F.when(F.col("note").isNull(), "COMPLETED").otherwise("FAILED").alias("status"), F.current_timestamp().alias("recorded_at"),
            F.coalesce("note", F.lit("")).alias("note"))
        kept: list[str] = []

        def lines():
            kept.append(f"entries-{uuid.uuid4().hex}")
            open_(judged).write.json(f"{self.log.path}/{kept[-1]}")
            return [{"entries": kept[-1]}]

        self._commit(lines)
        return self.spark.read.schema(ENTRY).json(f"{self.log.path}/{kept[-1]}").select("batch_id", "status")

    # --- reading ---

    def read(self, table: str, schema: str, batches: DataFrame | None = None) -> DataFrame:
        """Rows of all COMPLETED batches of a table, or of those in ``batches`` (batch_id)."""
        if not self.log.fs.exists(self.log._at(f"{self.root}/{table}")):
            return self.spark.createDataFrame([], schema)
        done = self.state().where((F.col("table_name") == table) & (F.col("status") == "COMPLETED"))
        if batches is not None:
            done = done.join(batches.select("batch_id"), "batch_id", "left_semi")
        rows = self.spark.read.schema(f"{schema}, {FOLDER} string").parquet(f"{self.root}/{table}")
        done = done.select(F.col("path").alias(FOLDER))
        # Broadcast within the bound, so that other partitions are pruned; the rows of a large batch never meet by its name.
        return attach(rows, done, FOLDER, done, "left_semi").drop(FOLDER)


def rows_ddl(rows: DataFrame) -> str:
    """The columns of a table as a schema text."""
    return ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
