"""Table schemas (sources of typed reads, and the rules ``quality`` checks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


_schemas: dict[str, StructType] = {}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table. Columns and filters reach the parquet scan.

    The schema is read from a file footer once per session, not once per query.
    """
    path = f"{folder}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


# One declaration per entity: names, types and order of the stored columns.
SCHEMAS: dict[str, str] = {
    "core.developments": "id string, business_key string, name string, city string, state string, bairro string,"
    " launch_date date, completion_date date, total_floors int, latitude decimal(9,6), longitude decimal(9,6),"
    " data_source_id string",
    "core.towers": "id string, development_id string, business_key string, name string",
    "core.unit_typologies": "id string, development_id string, business_key string, name string, bedrooms int,"
    " suites int, classification string",
    "core.units": "id string, development_id string, tower_id string, unit_typology_id string, unit_code string,"
    " floor int, position_code string, closed_area_m2 decimal(9,2), balcony_area_m2 decimal(9,2),"
    " ancillary_area_m2 decimal(9,2), open_terrace_area_m2 decimal(9,2), total_area_m2 decimal(9,2),"
    " parking_spaces int, view_type string, orientation string, position_type string, is_penthouse boolean,"
    " data_source_id string",
    "pricing.scenarios": "id string, development_id string, code string, name string, description string,"
    " status string, reference_date date, created_by string",
    "pricing.parameter_sets": "id string, scenario_id string, code string, version int, status string,"
    " valid_from timestamp, valid_to timestamp",
    "pricing.parameters": "id string, parameter_set_id string, key string, value_type string,"
    " numeric_value decimal(18,6), text_value string, boolean_value boolean, date_value date,"
    " unit_of_measure string, description string, data_source_id string, is_active boolean",
    "pricing.calibration_sets": "id string, scenario_id string, code string, dimension string, version int,"
    " status string, valid_from timestamp, valid_to timestamp",
    "pricing.calibration_entries": "id string, calibration_set_id string, category_key string,"
    " factor decimal(12,6), notes string",
    "pricing.runs": "id string, scenario_id string, parameter_set_id string, code string, status string,"
    " run_type string, engine_version string, started_at timestamp, completed_at timestamp, notes string",
    "pricing.run_calibration_sets": "run_id string, calibration_set_id string",
    "pricing.vgv_targets": "id string, scenario_id string, run_id string, origin string,"
    " target_value decimal(18,2), reference_area_m2 decimal(12,2), price_per_m2_basis decimal(12,2),"
    " market_prediction_id string, status string",
    "pricing.unit_adjustments": "id string, run_id string, unit_id string, adjustment_type string,"
    " input_value decimal(18,6), factor_value decimal(12,6), calibration_entry_id string, parameter_id string,"
    " result_value decimal(18,6), sequence_order int, explanation string",
    "pricing.unit_price_results": "id string, run_id string, unit_id string, weighted_area_m2 decimal(12,4),"
    " participation_share decimal(9,6), combined_weight_factor decimal(12,6),"
    " system_calculated_price decimal(18,2), system_calculated_price_per_m2 decimal(12,2), result_origin string",
    "pricing.unit_overrides": "id string, run_id string, unit_id string, previous_price decimal(18,2),"
    " proposed_price decimal(18,2), final_price decimal(18,2), vgv_impact decimal(18,2), reason string,"
    " author_ref string, decided_at timestamp",
    "pricing.validations": "id string, run_id string, check_type string, severity string,"
    " expected_value decimal(18,2), actual_value decimal(18,2), difference decimal(18,2), message string,"
    " checked_at timestamp",
    "pricing.reproduction_comparisons": "id string, reproduction_run_id string, imported_run_id string,"
    " unit_id string, source_reference_price decimal(18,2), reproduced_price decimal(18,2),"
    " delta_absolute decimal(18,2), delta_percent decimal(12,6), match_classification string,"
    " divergence_cause string",
    "audit.data_sources": "id string, code string, name string, source_url string, origin_type string,"
    " methodology_note string, accessed_at timestamp",
    "audit.data_lineage": "entity_schema string, entity_table string, entity_id string, data_source_id string,"
    " field_name string, derived_from string, recorded_at timestamp",
    "audit.promotion_runs": "id string, ingest_batch_id string, mapping_version string, status string,"
    " started_at timestamp, completed_at timestamp, notes string",
    "audit.reproduction_runs": "id string, development_id string, ruleset_version string, mapping_version string,"
    " pricing_run_id string, status string, started_at timestamp, completed_at timestamp, notes string",
    "raw.ingest_batches": "id string, status string, source_count int, tool_version string, started_at timestamp,"
    " completed_at timestamp, notes string",
    "raw.workbooks": "workbook_id string, ingest_batch_id string, source_filename string, source_sha256 string,"
    " source_size_bytes bigint, sheet_count int",
    "raw.sheets": "workbook_id string, sheet_name string, sheet_index int, visibility string, dimension_ref string",
    "raw.cells": "workbook_id string, sheet_name string, cell_ref string, row_number int, column_index int,"
    " column_letters string, cell_type string, raw_value string, cached_value string, formula_expression string,"
    " is_shared_formula boolean, style_index int",
    "staging.unit_candidates": "workbook_id string, sheet_name string, source_row int, development_ref string,"
    " tower_ref string, unit_ref string, typology_ref string, private_area decimal(12,4),"
    " uncovered_area decimal(12,4), floor_ref string, position_ref string, mapping_confidence string,"
    " mapping_status string",
    "staging.parameter_candidates": "workbook_id string, sheet_name string, source_cell_ref string,"
    " parameter_key_guess string, value_text string, value_type_guess string, mapping_confidence string,"
    " mapping_status string, notes string",
    "staging.calibration_candidates": "workbook_id string, sheet_name string, source_cell_ref string,"
    " source_row int, dimension_guess string, category_key_guess string, factor_value decimal(18,6),"
    " mapping_confidence string, mapping_status string",
    "staging.price_output_candidates": "workbook_id string, sheet_name string, source_row int,"
    " unit_ref_guess string, price_value decimal(18,2), price_per_m2_value decimal(18,2),"
    " mapping_confidence string, mapping_status string",
    "staging.mapping_review": "workbook_id string, sheet_name string, source_row int, source_cell_ref string,"
    " field_label string, suspected_concept string, confidence string, status string",
    "hedonic.observations": "empreendimento string, apartamento string, bairro string, torre string, andar int,"
    " area decimal(9,2), quartos int, vagas int, suite int, varanda_m2 decimal(8,2), cobertura boolean,"
    " vista string, orientacao string, posicao string, padrao_score decimal(3,1), lazer_score decimal(3,1),"
    " localizacao_score decimal(3,1), fase_obra string, meses_lancamento int, desconto_pct decimal(6,2),"
    " preco_m2 decimal(12,2)",
}
