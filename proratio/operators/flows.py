"""Whole steps over stored tables: files to raw, raw to staged, staged to canonical.

Each step is one batch of the manifest: published whole or not at all, and left
alone when its identity is already complete.
"""

from __future__ import annotations

import hashlib


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proratio.operators import promotion, references, staging
from proratio.session import counted, stage
from proratio.sources import mapping as mapping_source
from proratio.sources import workbook
from proratio.sources.publish import Manifest
from proratio.sources.tables import SCHEMAS

# Stored columns of canonical rows: what promotion makes, with where it came from.
PLACE = "workbook_id string, sheet_name string, source_row int"
CANONICAL = {
    "core.developments": "id string, business_key string, data_source_id string, scenario_id string, parameter_set_id string",
    "core.towers": "id string, development_id string, business_key string",
    "core.unit_typologies": "id string, development_id string, business_key string, classification string",
    "core.units": "id string, development_id string, tower_id string, unit_typology_id string, unit_code string,"
    f" position_code string, closed_area_m2 decimal(9,2), open_terrace_area_m2 decimal(9,2), {PLACE}",
    "pricing.parameters": "id string, parameter_set_id string, key string, value_type string, numeric_value decimal(18,6),"
    " text_value string, boolean_value boolean, date_value date, development_id string",
    "pricing.calibration_entries": "id string, calibration_set_id string, dimension string, category_key string,"
    " factor decimal(12,6), development_id string",
    "pricing.unit_price_results": "id string, run_id string, unit_id string, system_calculated_price decimal(18,2),"
    " system_calculated_price_per_m2 decimal(12,2), result_origin string, development_id string",
    "audit.data_sources": "id string, code string, name string, origin_type string, development_id string",
    "pricing.scenarios": "id string, development_id string, code string, status string",
    "pricing.parameter_sets": "id string, scenario_id string, code string, version int, status string, development_id string",
    "pricing.calibration_sets": "id string, scenario_id string, code string, dimension string, version int, status string, development_id string",
    "pricing.runs": "id string, scenario_id string, parameter_set_id string, code string, status string, run_type string, development_id string",
    "pricing.run_calibration_sets": "id string, run_id string, calibration_set_id string, development_id string",
    "audit.candidate_entities": "id string, workbook_id string, sheet_name string, source_row int, entity_table string, entity_id string,"
    " development_id string",
    "audit.data_lineage": "entity_schema string, entity_table string, entity_id string, development_id string, derived_from string,"
    " data_source_id string",
}
CANONICAL["staging.rejects"] = staging.REJECTS
STAGING = ["unit_candidates", "parameter_candidates", "calibration_candidates", "price_output_candidates", "mapping_review"]


def stored(manifest: Manifest, table: str) -> DataFrame:
    """Published rows of a table."""
    return manifest.read(table, CANONICAL.get(table) or SCHEMAS[table])


def ingest(spark: SparkSession, folder: str, manifest: Manifest) -> str | None:
    """Store the workbooks of a folder whose content is new; the batch id, or None if there are none.

    The same content twice in one call is stored once.
    """
    known = stored(manifest, "raw.workbooks")
    fresh = workbook.new_files(workbook.workbook_files(spark, folder), known)
    first = fresh.groupBy("workbook_id").agg(F.min("path").alias("path"))
    # Digests only: the files themselves stay where they are until they are parsed.
    chosen = stage(first)
    if not chosen.limit(1).collect():
        return None
    # The batch is named by its files, in whatever order they are found.
    total = chosen.agg(F.count("*"), F.min("workbook_id"), F.sum(F.xxhash64("workbook_id").cast("decimal(20,0)"))).first()
    batch = "ingest:" + hashlib.sha256("|".join(map(str, total)).encode()).hexdigest()[:16]
    files = workbook.workbook_files(spark, folder).join(chosen.select("path"), "path", "left_semi")

    def tables():
        records = stage(workbook.read_records(spark, folder, files))
        books = workbook.workbooks(records).select(
            "workbook_id", F.lit(batch).alias("ingest_batch_id"), "source_filename", F.col("workbook_id").alias("source_sha256"),
            "source_size_bytes", "sheet_count",
        )
        sheets = workbook.sheets(records).select("workbook_id", "sheet_name", "sheet_index", "visibility", "dimension_ref")
        cells = workbook.raw_cells(records)
        order = [f.split()[0] for f in SCHEMAS["raw.cells"].split(", ")]
        return {"raw.workbooks": books, "raw.sheets": sheets, "raw.cells": cells.select(*order)}

    manifest.publish(batch, tables)
    return batch


#: Share of rejects among what a mapping yields beyond which its batch is refused.
MAX_REJECTS = 0.5


def stage_mapping(spark: SparkSession, path: str, manifest: Manifest, max_rejects: float = MAX_REJECTS) -> bool:
    """Stage all candidates of a mapping file; its content is the batch identity, so staging again adds nothing.

    What could not be staged is written with the batch, as ``staging.rejects``. If that
    is more than ``max_rejects`` of all it yields, the batch is refused.
    """
    version = mapping_source.mapping_version(spark, path)
    entries = stage(mapping_source.read_mapping(spark, path))
    bound = counted(entries.select(F.explode_outer("columns")))

    def tables():
        cells = stored(manifest, "raw.cells")
        found = staging.stage_candidates(cells, entries, bound)
        tables = {f"staging.{name}": df.select(*[f.split()[0] for f in SCHEMAS[f"staging.{name}"].split(", ")]) for name, df in found.items()}
        rows = staging.extract_rows(cells, entries, bound)
        return tables | {"staging.rejects": staging.rejects(cells, entries, rows, stored(manifest, "raw.sheets"), bound)}

    def check(written):
        sheets = stored(manifest, "raw.sheets")
        if staging.orphans(written["staging.unit_candidates"], sheets).limit(1).collect():
            raise staging.MappingError("staged units of a sheet that is not stored")
        lost = written["staging.rejects"].count()
        kept = sum(df.count() for name, df in written.items() if name != "staging.rejects")
        if lost > max_rejects * (lost + kept):
            reasons = written["staging.rejects"].groupBy("reason").count().orderBy("reason").collect()  # as many as there are reasons
            raise staging.MappingError(f"{lost} of {lost + kept} rejected: " + ", ".join(f"{r['reason']} {r['count']}" for r in reasons))

    return manifest.publish(f"stage:{version}", tables, check)


def promote(manifest: Manifest, batch: str, mapping_version: str) -> bool:
    """Promote the staged candidates of an ingest batch; (batch, mapping version) is the identity."""
    def tables():
        books = stored(manifest, "raw.workbooks").where(F.col("ingest_batch_id") == batch)
        mine = {t: stored(manifest, f"staging.{t}").join(books.select("workbook_id"), "workbook_id", "left_semi") for t in STAGING[:4]}
        existing = {name: stored(manifest, name) for name in CANONICAL if name != "audit.data_lineage"}
        return promotion.promote(mine, books, existing)

    def check(written):
        # References lead to what is stored or in the batch; deferred ones are judged now that it is whole.
        references.require(written, {name: stored(manifest, name) for name in CANONICAL})

    return manifest.publish(f"promote:{batch}:{mapping_version}", tables, check)
