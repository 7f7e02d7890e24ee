"""Steps that must grow no faster than their input: their plans, and their rows on odd tables."""

import re

import pytest

from proratio import session
from proratio.operators import promotion, quality, references, reproduction, staging

CELL = "workbook_id string, sheet_name string, column_letters string, column_index int, row_number int, raw_value string, cached_value string, formula_expression string, cell_ref string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def nothing_fits(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)


def grid_cells(spark):
    def cell(book, sheet, letters, row, raw, formula=None):
        return (book, sheet, letters, ord(letters) - 64, row, raw, None, formula, f"{letters}{row}")

    look = "HLOOKUP(A2,'G'!$B$3:$C$6,Aux!$B$1,0)"
    rows = []
    for book, index in (("x", "2"), ("y", "1"), ("z", None)):
        rows += [cell(book, "Calc", "F", 2, "1", look), cell(book, "Aux", "B", 1, index)]
        rows += [cell(book, "G", c, r, f"{book}{c}{r}") for c in "ABCD" for r in (2, 3, 4, 5)]
    rows += [cell("x", "G", "B", 4, "xB4"), cell("x", "Calc", "F", 3, "1", look), cell(None, "G", "B", 4, "none")]
    return spark.createDataFrame(rows, CELL)


def test_a_grid_is_read_by_the_rows_it_names(spark, nothing_fits, monkeypatch):
    def refuse(*_):
        raise AssertionError("every cell is counted by key")

    monkeypatch.setattr(session, "hot_keys", refuse)
    formulas = spark.createDataFrame([(b, "Calc", "F2") for b in "xyz"], "workbook_id string, sheet_name string, cell_ref string")
    found = reproduction.grid_from_formula(grid_cells(spark), formulas, formulas)
    assert {(r["workbook_id"], r["column_letters"], r["category_key"], r["factor"]) for r in found.collect()} == {
        ("x", "B", "xB3", "xB4"), ("x", "C", "xC3", "xC4"), ("y", "B", "yB3", "yB3"), ("y", "C", "yC3", "yC3")}
    assert found.count() == 4 and "_salt" not in plan(found)


def mapped_cells(spark):
    rows = [("w", "s", r, c, f"{c}{r}", f"{c}-{r}", None) for r in range(1, 6) for c in "ABCZ"]
    rows += [("w", "s", 3, "A", "A3", "A-4", None), ("w", "s", 4, "B", "B4", None, None), ("w", "t", 2, "A", "A2", "t", None), (None, "s", 2, "A", "A2", "none", None), ("w", "s", None, "A", "A", "none", None)]
    rows = [r for r in rows if r[3:5] != ("A", "A5")] + [("w", "s", 5, "A", "A5", "", None)]
    return spark.createDataFrame(rows, "workbook_id string, sheet_name string, row_number int, column_letters string, cell_ref string, raw_value string, cached_value string")


def test_rows_are_brought_together_once_for_all_entries(spark):
    def entry(name, category, columns, anchor, start=2):
        return (name, "w", "s", "HIGH", "row_range", category, columns, start, anchor, None, None)

    entries = [entry("u", "unit", {"unit_ref": "A", "tower_ref": "B", "private_area": "Q"}, "unit_ref"), entry("p", "price_output", {"price_value": "C", "x": "A"}, "x", 4)]
    mapping = spark.createDataFrame(entries, "entry_id string, workbook_id string, sheet_name string, confidence string, extraction string, category string,"
                                    " columns map<string,string>, start_row int, anchor_field string, development_ref string, dimension_guess string")
    found = staging.extract_rows(mapped_cells(spark), mapping, 10)
    assert {(r["entry_id"], r["source_row"], r["unit_ref"], r["tower_ref"], r["private_area"], r["price_value"], r["category"]) for r in found.collect()} == {
        ("u", 2, "A-2", "B-2", None, None, "unit"), ("u", 3, "A-4", "B-3", None, None, "unit"), ("u", 4, "A-4", "B-4", None, None, "unit"),
        ("p", 4, None, None, None, "C-4", "price_output")}
    assert found.count() == 4 and "hashpartitioning(entry_id" not in plan(found)


@pytest.mark.parametrize("rows", [0, 200_000])
def test_what_is_staged_is_stored_before_entries_have_rows_of_their_own(spark, monkeypatch, rows):
    monkeypatch.setattr(session, "BROADCAST_ROWS", rows)
    entries = [(c, "w", "s", "HIGH", "row_range", c, {f: "A", "tower_ref": "B"}, 2, f, None, "FLOOR") for c, f in (
        ("unit", "unit_ref"), ("price_output", "unit_ref_guess"), ("calibration", "category_key_guess"))]
    mapping = spark.createDataFrame(entries, "entry_id string, workbook_id string, sheet_name string, confidence string, extraction string, category string,"
                                    " columns map<string,string>, start_row int, anchor_field string, development_ref string, dimension_guess string")
    mapping = mapping.selectExpr("*", *[f"string(null) {c}" for c in ("cell_ref", "parameter_key_guess", "category_key_guess", "value_type_guess", "notes", "field_label",
                                                                       "canonical_concept", "source_cell_ref")], "int(null) source_row")
    stored, keep = [], staging.stage
    monkeypatch.setattr(staging, "stage", lambda df: stored.append(keep(df)) or stored[-1])
    tables = staging.stage_candidates(mapped_cells(spark), mapping, 10)
    assert {(r["source_row"], r["unit_ref"], r["tower_ref"]) for r in tables["unit_candidates"].collect()} == {(2, "A-2", "B-2"), (3, "A-4", "B-3"), (4, "A-4", "B-4")}
    assert sorted(r["unit_ref_guess"] for r in tables["price_output_candidates"].collect()) == ["A-2", "A-4", "A-4"]
    assert sorted(r["category_key_guess"] for r in tables["calibration_candidates"].collect()) == ["A-2", "A-4", "A-4"]
    # Rows of the sheet where the entries can be sent to them, else rows of the entries: once either way.
    assert [set(t.columns) >= {"entry_id"} for t in stored] == [rows == 0]


def test_rules_pass_rows_that_keep_them_and_tell_keys_apart_from_behind(spark):
    rows = spark.createDataFrame([("w", "s", "A1", 1, "x"), ("w", "s", "A1", 0, "x"), ("w", "s", "B1", None, None), ("w", "s", "C1", 2, "odd"), ("w", None, "A1", 0, "odd"), ("w", None, "A1", 3, "x")],
                                 "book string, sheet string, ref string, n int, kind string")
    rules = [quality.check("n_positive", "n > 0", "n"), quality.domain("kind", ["x"]), quality.unique("book", "sheet", "ref")]
    found = quality.violations(rows, rules, ["book", "sheet", "ref"])
    assert sorted(tuple(r) for r in found.collect()) == [
        ("book_sheet_ref_unique", "w|s|A1", "2"), ("kind_domain", "w|NULL|A1", "odd"), ("kind_domain", "w|s|C1", "odd"), ("n_positive", "w|NULL|A1", "0"), ("n_positive", "w|s|A1", "0")]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[ref#\d+, sheet#\d+, book#\d+\]", text)
    assert re.search(r"Filter .*n#\d+ <= 0\) OR NOT \(kind#\d+ = x\)", text)


def test_references_read_a_table_once_for_all_its_roles(spark):
    t = {"p": spark.createDataFrame([("1", "o")], "id string, owner string"),
         "c": spark.createDataFrame([("1", "o", "1"), ("2", None, "1"), (None, "o", "9")], "p_id string, owner string, q_id string")}
    rules = {"p": [], "c": [references.to("p_id", "p"), references.Reference(("p_id", "owner"), "p", ("id", "owner")), references.to("q_id", "p")]}
    found = references.orphans(t, rules=rules)
    assert {tuple(r) for r in found.collect()} == {("c.p_id", "2", 1), ("c.q_id", "9", 1)}
    # One leaf a table, not one a reference and one a parent's key.
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2


def test_a_unit_takes_its_first_price(spark):
    units = spark.createDataFrame([("w", "s", r, "u") for r in (2, 3)], "workbook_id string, sheet_name string, source_row int, id string")
    prices = spark.createDataFrame([("w", "s", 3, 5.0, 1.0), ("w", "s", 2, 7.0, None)], "workbook_id string, sheet_name string, source_row int, price_value double, price_per_m2_value double")
    found = promotion.prices(staging.with_marks(prices), units)
    assert [(r["unit_id"], r["source_row"], float(r["system_calculated_price"])) for r in found.collect()] == [("u", 2, 7.0)]
    assert "hashpartitioning(run_id" not in plan(found)
