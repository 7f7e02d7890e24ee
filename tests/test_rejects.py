"""What staging cannot give is written with the batch, and too much of it refuses the batch."""

import json

import pytest

from proratio.operators import flows, staging
from proratio.sources.publish import Manifest


def store(spark, tmp_path, areas):
    m = Manifest(spark, str(tmp_path / "store"))
    rows = []
    for i, area in enumerate(areas):
        rows += [("wb", "s", f"A{i + 2}", i + 2, 1, "A", "string", f"u{i}", None), ("wb", "s", f"B{i + 2}", i + 2, 2, "B", "string", area, None)]
    rows += [("wb", "s", "K1", 1, 11, "K", "number", None, "0.7"), ("wb", "s", "K2", 2, 11, "K", "string", "seven", None)]
    schema = "workbook_id string, sheet_name string, cell_ref string, row_number int, column_index int, column_letters string, cell_type string, raw_value string, cached_value string"
    cells = spark.createDataFrame(rows, schema).selectExpr("*", "cast(null as string) as formula_expression", "false as is_shared_formula", "0 as style_index")
    sheets = spark.createDataFrame([("wb", "s", 0, "visible", None)], "workbook_id string, sheet_name string, sheet_index int, visibility string, dimension_ref string")
    m.publish("raw", lambda: {"raw.cells": cells, "raw.sheets": sheets})
    return m


def mapping(tmp_path):
    row = dict(workbook_sha256="wb", sheet_name="s", confidence="HIGH", extraction="row_range", start_row=2)
    cell = dict(workbook_sha256="wb", sheet_name="s", confidence="HIGH", extraction="single_cell")
    entries = [
        {**row, "category": "unit", "anchor_field": "unit_ref", "columns": {"unit_ref": "A", "private_area": "B"}, "development_ref": "D"},
        {**row, "category": "garage", "anchor_field": "x", "columns": {"x": "A"}},
        {**row, "sheet_name": "gone", "category": "unit", "anchor_field": "unit_ref", "columns": {"unit_ref": "A"}},
        {**cell, "category": "calibration", "cell_ref": "K1", "dimension_guess": "F", "category_key_guess": "one"},
        {**cell, "category": "parameter", "cell_ref": "K2", "parameter_key_guess": "P", "value_type_guess": "NUMERIC"},
        {**cell, "category": "parameter", "cell_ref": "Z9", "parameter_key_guess": "Q"},
    ]
    path = tmp_path / "mapping.json"
    path.write_text(json.dumps(entries))
    return str(path)


def test_rejects_are_stored_with_their_reasons(spark, tmp_path):
    m = store(spark, tmp_path, ["10", "ten", "", "12.5"])
    assert flows.stage_mapping(spark, mapping(tmp_path), m, max_rejects=0.7)
    got = {(r["sheet_name"], r["source_row"], r["source_cell_ref"], r["category"], r["field"], r["text"], r["reason"]) for r in flows.stored(m, "staging.rejects").collect()}
    assert got == {
        ("s", 3, None, "unit", "private_area", "ten", "not_a_number"), ("s", None, None, "garage", None, "garage", "unknown_category"),
        ("gone", None, None, "unit", None, None, "no_sheet"), ("s", None, "K1", "calibration", "one", "0.7", "only_a_cached_value"),
        ("s", None, "K2", "parameter", "P", "seven", "not_a_number"), ("s", None, "Z9", "parameter", "Q", None, "no_cell")}
    assert flows.stored(m, "staging.unit_candidates").count() == 4


def test_too_many_rejects_refuse_the_batch(spark, tmp_path):
    m = store(spark, tmp_path, ["ten", "eleven", "n/d"])
    with pytest.raises(staging.MappingError, match="not_a_number 4"):
        flows.stage_mapping(spark, mapping(tmp_path), m)
    assert flows.stored(m, "staging.unit_candidates").count() == 0 and flows.stored(m, "staging.rejects").count() == 0
