import random

import pytest
from pyspark.sql import functions as F

from proratio.functions import formulas as fx
from proratio.functions import text as tx
from proratio.operators import formulas


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("formula, expected", [
    ("A2*0.6", ["0.6"]), ("-5+B2", ["-5"]), ("ROUND(A1;2)*1000", ["2", "1000"]), ("'Aba 3'!B2*1.5", ["1.5"]), ("Dados!$A$1", []), ("LOG10(A1)", []),
])
def test_literals(spark, formula, expected):
    assert one(spark, formula, fx.literals) == expected


def test_sheet_references(spark):
    assert one(spark, "'Minha Aba'!A1+Aux!B2+C3+Aux!B3", fx.sheet_references) == ["Minha Aba", "Aux", "Aux"]
    assert one(spark, "$A$12+B3", fx.pattern) == "$A$#+B#"


@pytest.mark.parametrize("literal, formula, role, needs", [
    ("0.6", "A1*0.6", "possivel_percentual_ou_peso", True), ("100", "A1/100", "possivel_conversao_ou_escala", True),
    ("7", "VLOOKUP(A1,B1:C2,7)", "possivel_indice_ou_offset_de_lookup", True), ("2", "hlookup(A1,B1:C2,2)", "possivel_indice_ou_offset_de_lookup", False),
    ("5000", "A1+5000", "possivel_valor_monetario_ou_area_total", True), ("77", "A1+77", "desconhecido", True),
])
def test_roles(spark, literal, formula, role, needs):
    row = spark.createDataFrame([(literal, formula)], "l string, f string").select(
        fx.literal_role(F.col("l"), F.col("f")).alias("r"), fx.needs_explanation(F.col("l"), F.col("f")).alias("n")).collect()[0]
    assert (row["r"], row["n"]) == (role, needs)


def test_keys_and_values(spark):
    assert [one(spark, v, lambda c: tx.magnitude_prefix(c, 1000, 1, 2)) for v in ("101", "1203", "x", "-2500", "999.9")] == ["1", "12", None, "2", "9"]
    assert [one(spark, v, tx.key_component) for v in ("3.0", "2.50", "x", "1", None)] == ["3", "2.50", "x", "1", None]
    assert [one(spark, v, tx.numeric_or_null) for v in ("1.5", " 2 ", "1d", "nan", "", "1e3")] == ["1.5", " 2 ", None, None, None, "1e3"]
    assert [one(spark, v, tx.zero_if_blank) for v in (None, "", "4", "x")] == ["0", "0", "4", None]
    assert [one(spark, v, tx.column_index) for v in ("A", "Z", "AA", "ABC")] == [1, 26, 27, 731]
    assert [one(spark, v, lambda c: formulas.column_letters(c), "int") for v in (1, 26, 27, 702, 703, 731)] == ["A", "Z", "AA", "ZZ", "AAA", "ABC"]
    assert [(one(spark, v, tx.cell_letters), one(spark, v, tx.cell_row)) for v in ("AB12", "x1")] == [("AB", 12), ("", None)]
    assert one(spark, "Área (M²) 1", tx.normalize_name) == "ream1"
    assert [one(spark, v, tx.personal_value) for v in ("123.456.789-09", "(31) 99999-1234", "a@b.com", "plain")] == [True, True, True, False]
    assert str(one(spark, 45000.75, tx.serial_date, "double")) == "2023-03-15"


def test_typed_values(spark):
    rows = [("1,5", "NUMERIC"), ("2.5", "NUMERIC"), ("Sim", "BOOLEAN"), ("no", "BOOLEAN"), ("2026-01-02", "DATE"), ("t", None)]
    got = spark.createDataFrame(rows, "t string, k string").select(tx.typed_value(F.col("t"), F.col("k")).alias("v")).collect()
    assert [r["v"]["numeric_value"] for r in got][:2] == [None, 2.5]
    assert [r["v"]["boolean_value"] for r in got][2:4] == [True, False]
    assert str(got[4]["v"]["date_value"]) == "2026-01-02" and (got[5]["v"]["value_type"], got[5]["v"]["text_value"]) == ("TEXT", "t")


def runs_by_hand(cells):
    """The same runs, one column at a time."""
    counts, first = {}, {}
    for r, s in cells:
        counts[s] = counts.get(s, 0) + 1
        first.setdefault(s, r)
    major = max(counts, key=lambda s: (counts[s], -first[s]))
    if major[0] != "formula" or counts[major] < 5:
        return []
    found, current = [], []
    for r, s in cells + [(None, major)]:
        if s != major:
            current.append((r, s))
        elif current:
            start = current[0][1]
            found.append((f"{current[0][0]}-{current[-1][0]}", sum(1 for _, s in current if s == start), start[0]))
            current = []
    return found


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_runs_over_block_borders(spark, block):
    rng = random.Random(block)
    kinds = [("formula", "A#*2"), ("manual_value", "number"), ("formula", "A#*3"), ("empty", None)]
    rows, expected = [], set()
    for column in range(12):
        cells, r = [], 1
        for _ in range(rng.randrange(4, 60)):
            r += rng.choice([1, 1, 1, 2, 9])
            cells.append((r, rng.choices(kinds, [8, 3, 2, 2] if column % 2 else [3, 2, 1, 1])[0]))
        expected |= {(column, *f) for f in runs_by_hand(cells)}
        rows += [(column, r, *s) for r, s in cells]
    df = spark.createDataFrame(rows, "c int, row_number int, kind string, detail string")
    got = formulas.deviating_runs(df, ["c"], 12, block)
    assert {(r["c"], r["row_range"], r["affected_cells"], r["deviation_kind"]) for r in got.collect()} == expected


def test_manual_value_in_a_formula_column(spark):
    rows = [("w", "s", 1, 2, "B", "B1", "string", "total", None, None)]
    for r in range(2, 8):
        formula = None if r == 4 else f"A{r}*0.6"
        rows.append(("w", "s", r, 2, "B", f"B{r}", "number", "999" if r == 4 else None, None if r == 4 else "1.0", formula))
    cells = spark.createDataFrame(rows, "workbook_id string, sheet_name string, row_number int, column_index int, column_letters string,"
                                  " cell_ref string, cell_type string, raw_value string, cached_value string, formula_expression string")
    flags = {(r["row_range"], r["classification_hint"]) for r in formulas.consistency_flags(cells, 1).collect()}
    assert flags == {("4-4", "POSSIBLE_MANUAL_OVERRIDE"), ("1-1", "POSSIBLE_MANUAL_OVERRIDE")}
    found = formulas.embedded_parameters(cells).collect()
    assert [(r["value_or_expression"], r["location"]) for r in found] == [("0.6", "B2")]


def test_headers_of_early_and_late_sheets(spark):
    """Sheets that start after row 20 use their first twenty rows; later rows never count."""
    from proratio.operators import profiling

    rows = []
    for sheet, first in (("early", 1), ("late", 40)):
        for r in range(first, first + 60):
            for i, c in enumerate("ABC"):
                head = r == first + 2 or r == first + 50
                kind, value = ("string", f"h{c}") if head else ("number", str(r))
                rows.append(("w", sheet, r, i + 1, c, f"{c}{r}", kind, value, None, None))
    cells = spark.createDataFrame(rows, "workbook_id string, sheet_name string, row_number int, column_index int, column_letters string,"
                                  " cell_ref string, cell_type string, raw_value string, cached_value string, formula_expression string")
    for bound in (2, 10**9):
        got = {r["sheet_name"]: (r["header_row"], r["header_confidence"]) for r in profiling.header_rows(cells, bound).collect()}
        assert got == {"early": (3, 1.0), "late": (42, 1.0)}


def test_personal_data_is_found_in_any_row(spark):
    from proratio.operators import profiling

    rows = [("w", "s", r, i, c, f"{c}{r}", "string", ("name" if r == 1 else "a@b.org" if (c, r) == ("B", 150) else f"text {r}"), None, None)
            for r in range(1, 200) for i, c in ((1, "A"), (2, "B"))]
    cells = spark.createDataFrame(rows, "workbook_id string, sheet_name string, row_number int, column_index int, column_letters string,"
                                  " cell_ref string, cell_type string, raw_value string, cached_value string, formula_expression string")
    headers = spark.createDataFrame([("w", "s", 1, 1.0)], "workbook_id string, sheet_name string, header_row int, header_confidence double")
    found = {r["column_letters"]: r["potencial_pii"] for r in profiling.field_profile(cells, headers, 1).collect()}
    assert found == {"A": "NAO", "B": "SIM"}


def test_long_formulas_stay_whole(spark):
    formula = "A1*0.6" + "+A1" * 200
    rows = [("w", "s", r, 2, "B", f"B{r}", "number", None, "1", formula) for r in range(1, 9)]
    rows += [("w", "s", 9, 2, "B", "B9", "number", None, "1", formula + "+7")]
    cells = spark.createDataFrame(rows, "workbook_id string, sheet_name string, row_number int, column_index int, column_letters string,"
                                  " cell_ref string, cell_type string, raw_value string, cached_value string, formula_expression string")
    assert formula in {r["used_by"] for r in formulas.embedded_parameters(cells).collect()}
    assert len(formulas.consistency_flags(cells, 1).collect()[0]["deviation_detail"]) > 600
