"""CSV in, reports and documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str, schema: str, embedded_newlines: bool = False) -> DataFrame:
    """CSV with a header: quotes, doubled quotes, either line end.

    Rows wider or narrower than the schema are left out, whatever columns are asked
    for; ``csv_misfits`` lists them. A field that is no value of its type is null.
    Files are divided among tasks; fields with line breaks need
    ``embedded_newlines=True``, which gives each whole file to one task.
    """
    wanted = StructType.fromDDL(schema)
    rows = _csv_rows(spark, path, wanted, embedded_newlines).where("fits")
    return rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted])


def csv_misfits(spark: SparkSession, path: str, schema: str, embedded_newlines: bool = False) -> DataFrame:
    """The rows that ``read_csv`` leaves out, as they are in the file."""
    return _csv_rows(spark, path, StructType.fromDDL(schema), embedded_newlines).where("not fits").select("row")


def _csv_rows(spark: SparkSession, path: str, wanted: StructType, embedded_newlines: bool) -> DataFrame:
    """All columns as text, with whether the row has as many fields as the schema."""
    text = StructType([StructField(f.name, StringType()) for f in wanted] + [StructField("_row", StringType())])
    rows = (
        spark.read.schema(text).option("header", True).option("quote", '"').option("escape", '"').option("enforceSchema", True)
        .option("multiLine", embedded_newlines).option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", "_row").csv(path)
    )
    # The test names every column, so that a row is judged by all its fields, whatever is selected.
    read = F.length(F.concat_ws("", *[f.name for f in wanted])) >= 0
    return rows.select(*[f.name for f in wanted], F.col("_row").alias("row"), (F.col("_row").isNull() & read).alias("fits"))


def write_reports(reports: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder with a header per report."""
    for name, df in reports.items():
        df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{name}")


def write_documents(documents: DataFrame, folder: str) -> None:
    """One JSON document per line; all columns but ``document`` become folders."""
    keys = [c for c in documents.columns if c != "document"]
    writer = documents.write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).text(folder)
