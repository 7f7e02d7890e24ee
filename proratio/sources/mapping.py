"""Mapping entries: which cells hold which concept, read from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = (
    "workbook_id string, sheet_name string, confidence string, category string, extraction string, cell_ref string,"
    " columns map<string,string>, start_row int, anchor_field string, development_ref string,"
    " parameter_key_guess string, value_type_guess string, dimension_guess string, category_key_guess string,"
    " field_label string, canonical_concept string, source_row int, source_cell_ref string, notes string"
)


def read_mapping(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of entries, or with ``lines`` an entry per line. ``workbook_sha256`` names the workbook."""
    schema = ENTRY.replace("workbook_id", "workbook_sha256", 1)
    found = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return with_ids(found.withColumnRenamed("workbook_sha256", "workbook_id"))


def with_ids(entries: DataFrame) -> DataFrame:
    """Entries with the default extraction and an id made from their content."""
    filled = entries.withColumn("extraction", F.coalesce("extraction", F.lit("single_cell")))
    return filled.withColumn("entry_id", F.sha2(F.to_json(F.struct(*[
        F.map_entries(c).alias(c) if t.startswith("map") else F.col(c) for c, t in filled.dtypes
    ])), 256))


def mapping_version(spark: SparkSession, path: str) -> str:
    """``sha256:`` and sixteen digits of the mapping file's content."""
    from proratio.functions.text import content_tag

    return spark.read.format("binaryFile").load(path).select(content_tag(F.col("content"))).first()[0]
