from decimal import Decimal

import pytest
import xlsx
from pyspark.sql import functions as F

from proratio.operators import formulas, profiling, promotion, similarity, staging
from proratio.session import stage
from proratio.sources import files, mapping, publish, workbook


@pytest.fixture(scope="module")
def audit(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("audit")
    xlsx.audited(folder / "a.xlsx", "hidden")
    xlsx.audited(folder / "b.xlsx")
    records = stage(workbook.read_records(spark, str(folder)))
    names = {r["source_filename"]: r["workbook_id"] for r in workbook.workbooks(records).collect()}
    return records, names


def test_parsed_cells(spark, audit):
    records, names = audit
    cells = {r["cell_ref"]: r for r in workbook.all_cells(records).where((F.col("workbook_id") == names["a.xlsx"]) & (F.col("sheet_name") == "Dados")).collect()}
    assert (cells["A1"]["cell_type"], cells["A1"]["raw_value"]) == ("string", "codigo")
    assert (cells["B2"]["raw_value"], cells["B2"]["cell_type"], cells["B2"]["column_index"]) == ("10.0", "number", 2)
    assert (cells["C3"]["formula_expression"], cells["C3"]["cached_value"], cells["C3"]["raw_value"]) == ("A2*B2", "40.0", None)
    assert cells["C3"]["is_shared_formula"] and not cells["C5"]["is_shared_formula"]
    assert (cells["B5"]["cell_type"], cells["B5"]["raw_value"]) == ("error", "#DIV/0!")


def test_sheets_and_hidden_content(spark, audit):
    records, names = audit
    sheets = workbook.sheets(records)
    assert sheets.count() == 4
    hidden = profiling.hidden_content(workbook.workbooks(records), sheets).collect()
    assert [(r["workbook_id"], r["type"], r["location"]) for r in hidden] == [(names["a.xlsx"], "hidden_sheet", "Auxiliar")]


def test_profile_and_formulas(spark, audit):
    records, names = audit
    cells = stage(workbook.all_cells(records).where(F.col("workbook_id") == names["a.xlsx"]))
    headers = profiling.header_rows(cells, 4)
    fields = {r["field_name"]: r for r in profiling.field_profile(cells, headers, 2).collect()}
    assert fields["codigo"]["candidate_key_flag"] and fields["codigo"]["header_row"] == 1
    assert fields["codigo"]["mean"] == 2.5 and fields["quantidade"]["error_count"] == 1
    # the error counts as filled, not as a value
    assert (fields["quantidade"]["filled_count"], fields["quantidade"]["unique_count"]) == (4, 3)
    assert fields["total"]["types_found"] == "error|number" and fields["total"]["candidate_calculated_flag"]
    kinds = {r["issue_type"] for r in profiling.quality_issues(cells, profiling.field_profile(cells, headers, 2)).collect()}
    assert {"celulas_com_erro", "tipos_inconsistentes"} <= kinds
    # a shared formula keeps the text of its first cell
    found = formulas.formula_inventory(cells).collect()
    assert [(r["pattern"], r["occurrences"], r["direction"], r["example_cell"]) for r in found] == [("A#*B#", 4, "vertical", "C2")]
    inventory = {r["sheet_name"]: r for r in profiling.sheet_inventory(cells, headers, 2, workbook.sheets(records).where(F.col("workbook_id") == names["a.xlsx"])).collect()}
    assert (inventory["Dados"]["filled_cells"], inventory["Dados"]["formula_cells"], inventory["Dados"]["error_cells"]) == (15, 4, 2)


def test_equal_sheets_match_fully(spark, audit):
    records, names = audit
    cells = workbook.all_cells(records)
    headers = profiling.header_rows(cells, 4)
    fields = profiling.field_profile(cells, headers, 4).select(
        "workbook_id", "sheet_name", "field_name", F.ascii("column_letters").alias("ordinal"))
    pair = spark.createDataFrame([(names["a.xlsx"], names["b.xlsx"])], "workbook_a string, workbook_b string")
    found = similarity.cross_workbook_mapping(pair, workbook.sheets(records), fields).collect()
    assert {(r["sheet_a"], r["sheet_b"], r["confidence"]) for r in found if r["basis"] == "nome_da_aba"} >= {
        ("Dados", "Dados", "ALTA"), ("Auxiliar", "Auxiliar", "ALTA")}
    same = {(r["field_a"], r["field_b"]) for r in found if r["basis"] == "nome_de_campo" and r["similarity_score"] == 1}
    assert {("codigo", "codigo"), ("quantidade", "quantidade"), ("total", "total")} <= same


def test_workbook_properties(spark, tmp_path):
    styles = (f'<styleSheet {xlsx.MAIN}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="#,##0.00"/></numFmts>'
              '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
    rows = {1: [xlsx.cell("A1", 45000.75, style=1), xlsx.cell("B1", 45000, style=2), xlsx.cell("C1", 1.5, style=3), xlsx.cell("D1", 1, kind="b"),
                '<c r="E1" t="inlineStr"><is><t>x</t></is></c>', xlsx.cell("F1", formula="NOW()")],
            3: [xlsx.cell("A3", 1e16)]}
    xml = xlsx.sheet(rows, hidden_rows=[3], extra_before='<cols><col min="2" max="3" hidden="1"/></cols>',
                     extra_after='<sheetProtection/><autoFilter ref="A1:B2"/><mergeCells><mergeCell ref="A1:B1"/></mergeCells>')
    names = '<definedNames><definedName name="n" hidden="1">Plan!$A$1</definedName><definedName name="m">1</definedName></definedNames>'
    xlsx.write(tmp_path / "w.xlsx", [("Plan", "visible", xml)], styles=styles, names=names, parts={
        "xl/externalLinks/externalLink1.xml": "<x/>", "docProps/core.xml": '<c xmlns:dc="d"><dc:creator>me</dc:creator></c>'})
    (tmp_path / "note.txt").write_text("no workbook")
    records = stage(workbook.read_records(spark, str(tmp_path)))
    cells = {r["cell_ref"]: r for r in workbook.all_cells(records).collect()}
    assert [cells[c]["raw_value"] for c in ("A1", "B1", "C1", "D1", "E1", "A3")] == ["2023-03-15", "2023-03-15", "1.5", "True", "x", "1e+16"]
    assert (cells["F1"]["cell_type"], cells["F1"]["formula_expression"]) == ("empty", "NOW()")
    # a formula without a cached value is kept
    assert workbook.raw_cells(records).count() == 7
    book = workbook.workbooks(records).collect()[0]
    assert (book["creator"], book["has_external_links"], book["has_charts"], book["defined_names_count"]) == ("me", True, False, 2)
    s = workbook.sheets(records).collect()[0]
    assert (s["merged_cells_count"], s["has_autofilter"], s["sheet_protected"], s["hidden_rows"], s["hidden_cols"]) == (1, True, True, [3], [2, 3])
    kinds = {r["type"] for r in profiling.hidden_content(workbook.workbooks(records), workbook.sheets(records)).collect()}
    assert kinds == {"hidden_row", "hidden_col", "hidden_defined_name", "external_link"}


def mapped(spark, key):
    entries = [
        dict(confidence="HIGH", category="parameter", cell_ref="H1", parameter_key_guess="P", value_type_guess="NUMERIC"),
        dict(confidence="HIGH", extraction="row_range", category="unit", start_row=2, anchor_field="unit_ref",
             columns={"unit_ref": "A", "private_area": "B", "typology_ref": "C"}),
        dict(confidence="HIGH", extraction="row_range", category="price_output", start_row=2, anchor_field="unit_ref_guess",
             columns={"unit_ref_guess": "A", "price_value": "D"}),
        dict(confidence="HIGH", extraction="row_range", category="calibration", start_row=2, anchor_field="category_key_guess",
             columns={"category_key_guess": "E", "factor_value": "F"}, dimension_guess="FLOOR"),
        dict(confidence="MEDIUM", field_label="m"), dict(confidence="LOW", field_label="l"),
    ]
    return [{"workbook_sha256": key, "sheet_name": "Plan1", **e} for e in entries]


def test_intake_stage_and_promotion(spark, tmp_path):
    import json

    xlsx.ingested(tmp_path / "w.xlsx")
    records = stage(workbook.read_records(spark, str(tmp_path)))
    counts = workbook.intake_counts(records).collect()[0]
    assert (counts["sheets"], counts["cells"], counts["formulas"]) == (1, 19, 2)
    cells = stage(workbook.raw_cells(records))
    a3 = cells.where("cell_ref = 'A3'").collect()[0]
    assert (a3["raw_value"], a3["cached_value"], a3["formula_expression"]) == (None, "2.0", "A2+1")
    # the same content under another name is not new
    (tmp_path / "copy.xlsx").write_bytes((tmp_path / "w.xlsx").read_bytes())
    assert workbook.new_files(workbook.workbook_files(spark, str(tmp_path)), workbook.workbooks(records)).count() == 0

    path = tmp_path / "mapping.json"
    path.write_text(json.dumps(mapped(spark, counts["workbook_id"])))
    entries = mapping.read_mapping(spark, str(path))
    assert mapping.mapping_version(spark, str(path)).startswith("sha256:") and len(mapping.mapping_version(spark, str(path))) == 23
    tables = staging.stage_candidates(cells, entries, 20)
    found = {r["target"]: r["n"] for r in staging.stage_counts(tables).collect()}
    assert found == {"unit_candidates": 3, "price_output_candidates": 3, "calibration_candidates": 3, "parameter_candidates": 1, "mapping_review": 2}
    assert sorted(r["unit_ref"] for r in tables["unit_candidates"].collect()) == ["1.0", "2.0", "3.0"]
    assert tables["parameter_candidates"].collect()[0]["value_text"] == "0.75"
    assert {(r["confidence"], r["status"]) for r in tables["mapping_review"].collect()} == {("MEDIUM", "REVIEW_REQUIRED"), ("LOW", "UNMAPPED")}
    assert staging.orphans(tables["unit_candidates"], workbook.sheets(records)).count() == 0

    rows = promotion.promote(tables, workbook.workbooks(records))
    assert rows["core.units"].count() == 3 and rows["pricing.unit_price_results"].count() == 3
    assert rows["pricing.calibration_entries"].count() == 3
    again = promotion.promote(tables, workbook.workbooks(records), rows)
    assert all(df.count() == 0 for df in again.values())


def test_unknown_extraction_is_refused(spark):
    rows = spark.createDataFrame([("HIGH", "magic")], "confidence string, extraction string")
    with pytest.raises(staging.MappingError):
        staging.check_mapping(rows)


def candidates(spark, repeated=False):
    unit = "workbook_id string, sheet_name string, source_row int, tower_ref string, unit_ref string, typology_ref string, position_ref string, private_area decimal(12,4), uncovered_area decimal(12,4)"
    d = Decimal
    units = [("wb", "s", 10, "TORRE-A", "101", "T", None, d("50.5"), d("5")), ("wb", "s", 11, "TORRE-A", "102", "T", None, d("55"), None),
             ("wb", "s", 12, "TORRE-B", "201", None, None, d("70"), d("3"))]
    if repeated:
        units += [("wb", "s", 13, "TORRE-X", "999", None, None, d("1"), None)] * 2
    marks = lambda df: staging.with_marks(df)
    parameter = "workbook_id string, sheet_name string, source_cell_ref string, parameter_key_guess string, value_text string, value_type_guess string"
    calibration = "workbook_id string, sheet_name string, source_cell_ref string, source_row int, dimension_guess string, category_key_guess string, factor_value decimal(18,6)"
    price = "workbook_id string, sheet_name string, source_row int, unit_ref_guess string, price_value decimal(18,2), price_per_m2_value decimal(18,2)"
    return {
        "unit_candidates": marks(spark.createDataFrame(units, unit)),
        "parameter_candidates": marks(spark.createDataFrame([("wb", "s", "A1", "OK", "0.85", "NUMERIC"), ("wb", "s", "A2", "EMPTY", " ", "NUMERIC")], parameter)).unionByName(
            marks(spark.createDataFrame([("wb", "s", "A3", "MEDIUM", "1.0", "NUMERIC")], parameter)).withColumn("mapping_confidence", F.lit("MEDIUM"))),
        "calibration_candidates": marks(spark.createDataFrame([("wb", "s", None, 1, "FLOOR", "1", d("0.95")), ("wb", "s", None, 2, "FLOOR", "2", d("1.05")),
                                                              ("wb", "s", None, 3, "FLOOR", "2", d("9"))], calibration)),
        "price_output_candidates": marks(spark.createDataFrame([("wb", "s", r, None, d(p), None) for r, p in ((10, "500000"), (11, "550000"), (12, "700000"), (99, "1"))], price)),
    }


def test_promotion_rules(spark):
    tables = candidates(spark)
    books = spark.createDataFrame([("wb",)], "workbook_id string")
    rows = promotion.promote(tables, books)
    assert rows["core.towers"].count() == 2 and rows["core.units"].count() == 3
    assert [(r["key"], r["numeric_value"]) for r in rows["pricing.parameters"].collect()] == [("OK", Decimal("0.85"))]
    assert {r["category_key"]: r["factor"] for r in rows["pricing.calibration_entries"].collect()} == {"1": Decimal("0.95"), "2": Decimal("1.05")}
    assert {r["system_calculated_price"] for r in rows["pricing.unit_price_results"].collect()} == {500000, 550000, 700000}
    assert rows["audit.data_lineage"].count() == 1 + 3 + 1 + 2 + 3
    assert [r["open_terrace_area_m2"] for r in rows["core.units"].orderBy("unit_code").collect()] == [5, 0, 3]
    s = {r["candidates"]: r for r in promotion.summary(tables, {"price_output_candidates": rows["pricing.unit_price_results"]}).collect()}
    assert (s["price_output_candidates"]["total"], s["price_output_candidates"]["promoted"]) == (4, 3)


def test_duplicate_units_stop_the_promotion(spark):
    with pytest.raises(promotion.PromotionError):
        promotion.promote(candidates(spark, repeated=True), spark.createDataFrame([("wb",)], "workbook_id string"))


def test_prices_on_another_sheet(spark):
    tables = candidates(spark)
    units = promotion.units(tables["unit_candidates"])
    prices = tables["price_output_candidates"].withColumn("sheet_name", F.lit("other"))
    assert promotion.prices(prices, units).count() == 0
    assert promotion.prices(prices, units, ignore_sheet=True).count() == 3


def test_manifest(spark, tmp_path):
    m = publish.Manifest(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "a")], "id int, t string")
    assert m.publish("b1", lambda: {"t": rows, "u": rows}) and not m.publish("b1", lambda: {"t": rows})

    def refuse(_):
        raise ValueError("no")

    with pytest.raises(ValueError):
        m.publish("b2", lambda: {"t": rows}, refuse)
    assert m.read("t", "id int, t string").count() == 1 and m.read("u", "id int, t string").count() == 1
    assert {(r["batch_id"], r["status"]) for r in m.state().where("table_name = '-'").collect()} == {("b1", "COMPLETED"), ("b2", "FAILED")}
    assert m.publish("b2", lambda: {"t": rows}) and m.read("t", "id int, t string").count() == 2
    assert m.read("none", "id int").count() == 0


def test_flow_from_files_to_prices(spark, tmp_path):
    """Files to stored cells, candidates and canonical rows; every step done twice changes nothing."""
    import json

    from proratio.operators import flows

    folder = tmp_path / "in"
    folder.mkdir()
    xlsx.ingested(folder / "w.xlsx")
    m = publish.Manifest(spark, str(tmp_path / "store"))
    batch = flows.ingest(spark, str(folder), m)
    assert batch and flows.ingest(spark, str(folder), m) is None
    cells = flows.stored(m, "raw.cells")
    assert cells.count() == 19
    key = flows.stored(m, "raw.workbooks").collect()[0]["workbook_id"]
    path = tmp_path / "mapping.json"
    path.write_text(json.dumps(mapped(spark, key)))
    assert flows.stage_mapping(spark, str(path), m) and not flows.stage_mapping(spark, str(path), m)
    version = mapping.mapping_version(spark, str(path))
    assert flows.promote(m, batch, version) and not flows.promote(m, batch, version)
    assert flows.stored(m, "core.units").count() == 3 and flows.stored(m, "pricing.unit_price_results").count() == 3
    # the same candidates under another mapping version add nothing
    assert flows.promote(m, batch, "sha256:other") and flows.stored(m, "core.units").count() == 3


def test_failed_promotion_writes_nothing(spark, tmp_path):
    from proratio.operators import flows

    m = publish.Manifest(spark, str(tmp_path / "store"))
    tables = {f"staging.{k}": v for k, v in candidates(spark, repeated=True).items()}
    m.publish("raw", lambda: {"raw.workbooks": spark.createDataFrame([("wb",)], "workbook_id string").withColumn("ingest_batch_id", F.lit("raw"))})
    m.publish("stage", lambda: tables)
    with pytest.raises(promotion.PromotionError):
        flows.promote(m, "raw", "v1")
    assert flows.stored(m, "core.units").count() == 0
    assert m.state().where("batch_id = 'promote:raw:v1' and status = 'FAILED'").count() == 1


def test_reports(spark, audit, tmp_path):
    from proratio.operators import reports

    records, names = audit
    pair = spark.createDataFrame([(names["a.xlsx"], names["b.xlsx"])], "workbook_a string, workbook_b string")
    found = reports.workbook_reports(records, pair)
    assert len(found) == 10
    files.write_reports(found, str(tmp_path))
    sheets = spark.read.option("header", True).csv(str(tmp_path / "sheet_inventory"))
    assert sheets.count() == 4 and "hidden_rows_count" in sheets.columns
    assert spark.read.option("header", True).csv(str(tmp_path / "dependency_inventory")).count() == 0


def test_append_swallows_repeats_within_the_batch(spark):
    incoming = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "d")], "id int, v string")
    stored = spark.createDataFrame([(3, "z")], "id int, v string")
    assert {tuple(r) for r in publish.not_stored(incoming, stored, ["id"], ["v"]).collect()} == {(1, "a"), (2, "c")}


def test_csv_and_documents(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes(b'a,b\r\n1,"x ""q"", y"\r\n2,"line\nbreak"\r\n3\r\n4,u,v\r\n')
    got = {tuple(r) for r in files.read_csv(spark, str(path), "a int, b string", embedded_newlines=True).collect()}
    assert got == {(1, 'x "q", y'), (2, "line\nbreak")}
    path = tmp_path / "odd.csv"
    path.write_text("a,b,c\n1,2,3\n4,5\n6,x,8\n9,10,11,12\n")
    rows = files.read_csv(spark, str(path), "a int, b int, c int")
    assert {tuple(r) for r in rows.collect()} == {(1, 2, 3), (6, None, 8)}
    assert rows.count() == 2 and sorted(r["a"] for r in rows.select("a").collect()) == [1, 6]
    assert {r["row"] for r in files.csv_misfits(spark, str(path), "a int, b int, c int").collect()} == {"4,5", "9,10,11,12"}
    files.write_documents(spark.createDataFrame([("k", '{"a":1}')], "part string, document string"), str(tmp_path / "docs"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "docs")).collect()] == ['{"a":1}']
    files.write_reports({"r": spark.createDataFrame([(1, 'q"')], "a int, b string")}, str(tmp_path / "rep"))
    assert files.read_csv(spark, str(tmp_path / "rep" / "r"), "a int, b string").collect()[0]["b"] == 'q"'
