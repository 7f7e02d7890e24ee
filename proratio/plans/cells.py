"""Cell queries: staging, promotion, profiles, formula audit.

The cell table is derived from whole ``orders``: one workbook per order status,
one sheet per priority, one row per order, up to eight cells per row.
"""

from __future__ import annotations

import json
import uuid
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proratio.functions.text import effective_value, serial_date
from proratio.operators import formulas, lineage, profiling, promotion, references, staging
from proratio.plans.registry import query
from proratio.session import attach, checkpoint_root, counted, spread, stage
from proratio.sources import mapping as mapping_source
from proratio.sources import files, publish

HEADERS = ["codigo", "area", "tipologia", "preco", "contato", "total", "ref", "data"]

# One sheet's mapping entries; each sheet of the domain has them all.
ENTRIES = [
    dict(confidence="HIGH", extraction="row_range", category="unit", start_row=2, anchor_field="unit_ref",
         columns={"unit_ref": "A", "tower_ref": "C", "typology_ref": "C", "private_area": "B"}, development_ref="DEV"),
    dict(confidence="HIGH", extraction="row_range", category="price_output", start_row=2, anchor_field="unit_ref_guess",
         columns={"unit_ref_guess": "A", "price_value": "D", "price_per_m2_value": "F"}),
    dict(confidence="HIGH", extraction="row_range", category="calibration", start_row=2, anchor_field="category_key_guess",
         columns={"category_key_guess": "C", "factor_value": "G"}, dimension_guess="FLOOR"),
    dict(confidence="HIGH", extraction="row_range", category="other", start_row=2, anchor_field="x", columns={"x": "A"}),
    dict(confidence="HIGH", category="parameter", cell_ref="B12", parameter_key_guess="TARGET", value_type_guess="NUMERIC"),
    dict(confidence="HIGH", category="parameter", cell_ref="H13", parameter_key_guess="LABEL"),
    dict(confidence="HIGH", category="parameter", cell_ref="ZZ9", parameter_key_guess="MISSING", value_type_guess="NUMERIC"),
    dict(confidence="HIGH", category="calibration", cell_ref="B14", dimension_guess="EXTRA", category_key_guess="one"),
    dict(confidence="HIGH", category="note", cell_ref="C2", field_label="nota"),
    dict(confidence="MEDIUM", category="parameter", cell_ref="D2", field_label="meio", canonical_concept="PARAMETER", source_row=2),
    dict(confidence="LOW", field_label="baixo", source_cell_ref="Z1"),
]


class Cells:
    """Cell tables of one data folder."""

    def __init__(self, d):
        self.d, self.spark = d, d.spark

    @cached_property
    def cells(self) -> DataFrame:
        """The tall cell table, stored: every profile reads it several times."""
        k, r = F.col("o_orderkey"), (F.col("o_orderkey") + 2).cast("int")
        text = k.cast("string")
        row = r.cast("string")
        total = F.col("o_totalprice").cast("decimal(18,2)")
        part = (total * F.lit("0.6").cast("decimal(2,1)")).cast("decimal(18,3)").cast("string")
        none = F.lit(None).cast("string")

        def cell(i, letters, present, kind, raw, cached, formula, shared=F.lit(False)):
            return F.when(
                present,
                F.struct(F.lit(letters).alias("column_letters"), F.lit(i).alias("column_index"), kind.alias("cell_type"),
                         raw.alias("raw_value"), cached.alias("cached_value"), formula.alias("formula_expression"),
                         shared.alias("is_shared_formula")),
            )

        always, number, string = F.lit(True), F.lit("number"), F.lit("string")
        code = F.concat(text, F.lit(".0"))
        follows = k % 3 == 1
        odd, varied = (k % 1000).isin(7, 8), k % 1000 == 21
        looked = k % 4 == 0
        items = F.array(
            cell(1, "A", always, F.when(k % 17 == 0, "empty").otherwise("number"),
                 F.when((k % 17 != 0) & ~follows, code), F.when((k % 17 != 0) & follows, code),
                 F.when((k % 17 != 0) & follows, F.concat(F.lit("A"), (r - 1).cast("string"), F.lit("+1"))), follows & (k % 17 != 0)),
            cell(2, "B", always, F.when(k % 29 == 0, "string").otherwise("number"),
                 F.when(k % 29 == 0, "n/d").otherwise(F.concat((k % 200 + 20).cast("string"), F.lit(".5"))), none, none),
            cell(3, "C", always, string, F.concat(F.lit("TIPO"), (k % 4).cast("string")), none, none),
            cell(4, "D", always, F.when(k % 211 == 0, "error").otherwise("number"),
                 F.when(k % 211 == 0, "#DIV/0!").otherwise(total.cast("string")), none, none),
            cell(5, "E", k % 5 == 0, string, F.concat(F.lit("c"), text, F.lit("@mail.example.com")), none, none),
            cell(6, "F", always, number, F.when(odd, "999.0"), F.when(~odd, part),
                 F.when(varied, F.concat(F.lit("D"), row, F.lit("*0.65"))).when(~odd, F.concat(F.lit("D"), row, F.lit("*0.6")))),
            cell(7, "G", (k % 4).isin(0, 1), number, none, F.when(looked, "2.0").otherwise("1.0"),
                 F.when(looked, F.concat(F.lit("VLOOKUP(C"), row, F.lit(",'Tabela'!$A$1:$B$9,2,0)*1000")))
                 .otherwise(F.concat(F.lit("SUM(Aux!B"), row, F.lit(":B"), (r + 1).cast("string"), F.lit(")")))),
            cell(8, "H", always, F.lit("date"), F.date_format("o_orderdate", "yyyy-MM-dd"), none, none),
        )
        orders = spread(self.d.table("orders")).select(
            F.concat(F.lit("WB-"), F.col("o_orderstatus")).alias("workbook_id"), F.col("o_orderpriority").alias("sheet_name"),
            r.alias("row_number"), F.inline(items),
        ).where("column_letters is not null")  # no cell where its condition does not hold
        names = F.array(*[F.struct(F.lit(chr(65 + i)).alias("column_letters"), F.lit(i + 1).alias("column_index"),
                                   F.lit(n).alias("raw_value")) for i, n in enumerate(HEADERS)])
        header = (
            self.d.table("orders").select(F.concat(F.lit("WB-"), F.col("o_orderstatus")).alias("workbook_id"),
                                          F.col("o_orderpriority").alias("sheet_name")).distinct()
            .select("workbook_id", "sheet_name", F.lit(1).alias("row_number"), F.inline(names))
            .withColumn("cell_type", F.lit("string")).withColumn("is_shared_formula", F.lit(False))
        )
        both = orders.unionByName(header, allowMissingColumns=True)
        return stage(both.withColumn("cell_ref", F.concat("column_letters", F.col("row_number").cast("string"))))

    @cached_property
    def sheets(self) -> DataFrame:
        return self.cells.where("row_number = 1").select("workbook_id", "sheet_name").distinct()

    @cached_property
    def sheet_bound(self) -> int:
        return counted(self.sheets)

    @cached_property
    def column_bound(self) -> int:
        return self.sheet_bound * len(HEADERS)

    @cached_property
    def headers(self) -> DataFrame:
        """One row per sheet, stored: the profile reads it several times."""
        return stage(profiling.header_rows(self.cells, self.sheet_bound))

    @cached_property
    def fields(self) -> DataFrame:
        return profiling.field_profile(self.cells, self.headers, self.sheet_bound)

    @cached_property
    def mapping(self) -> DataFrame:
        """The entries, stored: they are read by every step of staging."""
        fields = mapping_source.ENTRY.replace("workbook_id string, sheet_name string, ", "")
        listed = F.from_json(F.lit(json.dumps(ENTRIES)), f"array<struct<{fields.replace(' string', ':string').replace(' int', ':int').replace(' map', ':map')}>>")
        return stage(mapping_source.with_ids(self.sheets.select("workbook_id", "sheet_name", F.inline(listed))))

    @cached_property
    def map_bound(self) -> int:
        return self.sheet_bound * sum(len(e.get("columns", "x")) for e in ENTRIES)

    @cached_property
    def staged(self) -> dict[str, DataFrame]:
        return staging.stage_candidates(self.cells, self.mapping, self.map_bound)

    @cached_property
    def workbooks(self) -> DataFrame:
        return self.sheets.select("workbook_id").distinct()


CELLS = """
o AS (SELECT 'WB-' || o_orderstatus AS workbook_id, o_orderpriority AS sheet_name, o_orderkey AS k,
    CAST(o_orderkey + 2 AS INTEGER) AS r, CAST(o_totalprice AS DECIMAL(18,2)) AS total, o_orderdate FROM orders),
sheets AS (SELECT DISTINCT workbook_id, sheet_name FROM o),
cells AS (
  SELECT workbook_id, sheet_name, r AS row_number, 'A' AS column_letters, 1 AS column_index,
    CASE WHEN k % 17 = 0 THEN 'empty' ELSE 'number' END AS cell_type,
    CASE WHEN k % 17 <> 0 AND k % 3 <> 1 THEN k || '.0' END AS raw_value,
    CASE WHEN k % 17 <> 0 AND k % 3 = 1 THEN k || '.0' END AS cached_value,
    CASE WHEN k % 17 <> 0 AND k % 3 = 1 THEN 'A' || (r - 1) || '+1' END AS formula_expression FROM o
  UNION ALL SELECT workbook_id, sheet_name, r, 'B', 2, CASE WHEN k % 29 = 0 THEN 'string' ELSE 'number' END,
    CASE WHEN k % 29 = 0 THEN 'n/d' ELSE (k % 200 + 20) || '.5' END, NULL, NULL FROM o
  UNION ALL SELECT workbook_id, sheet_name, r, 'C', 3, 'string', 'TIPO' || (k % 4), NULL, NULL FROM o
  UNION ALL SELECT workbook_id, sheet_name, r, 'D', 4, CASE WHEN k % 211 = 0 THEN 'error' ELSE 'number' END,
    CASE WHEN k % 211 = 0 THEN '#DIV/0!' ELSE CAST(total AS VARCHAR) END, NULL, NULL FROM o
  UNION ALL SELECT workbook_id, sheet_name, r, 'E', 5, 'string', 'c' || k || '@mail.example.com', NULL, NULL FROM o WHERE k % 5 = 0
  UNION ALL SELECT workbook_id, sheet_name, r, 'F', 6, 'number', CASE WHEN k % 1000 IN (7, 8) THEN '999.0' END,
    CASE WHEN k % 1000 NOT IN (7, 8) THEN CAST(CAST(total * CAST(0.6 AS DECIMAL(2,1)) AS DECIMAL(18,3)) AS VARCHAR) END,
    CASE WHEN k % 1000 IN (7, 8) THEN NULL WHEN k % 1000 = 21 THEN 'D' || r || '*0.65' ELSE 'D' || r || '*0.6' END FROM o
  UNION ALL SELECT workbook_id, sheet_name, r, 'G', 7, 'number', NULL, CASE WHEN k % 4 = 0 THEN '2.0' ELSE '1.0' END,
    CASE WHEN k % 4 = 0 THEN 'VLOOKUP(C' || r || ',''Tabela''!$A$1:$B$9,2,0)*1000' ELSE 'SUM(Aux!B' || r || ':B' || (r + 1) || ')' END
    FROM o WHERE k % 4 IN (0, 1)
  UNION ALL SELECT workbook_id, sheet_name, r, 'H', 8, 'date', strftime(o_orderdate, '%Y-%m-%d'), NULL, NULL FROM o
  UNION ALL SELECT workbook_id, sheet_name, 1, chr(CAST(64 + i AS INTEGER)), CAST(i AS INTEGER), 'string',
    ['codigo','area','tipologia','preco','contato','total','ref','data'][i], NULL, NULL FROM sheets, range(1, 9) t(i)),
c AS (SELECT *, coalesce(raw_value, cached_value) AS value, column_letters || row_number AS cell_ref FROM cells)"""

# Row 1 is text throughout and each later row is not, so it is every sheet's header.
PROFILE = CELLS + """,
extent AS (SELECT workbook_id, sheet_name, max(row_number) AS max_row FROM c GROUP BY 1, 2),
header AS (SELECT workbook_id, sheet_name, column_letters, value AS field_name FROM c WHERE row_number = 1),
body AS (SELECT * FROM c WHERE row_number > 1 AND cell_type <> 'empty'),
types AS (SELECT workbook_id, sheet_name, column_letters, cell_type, count(*) AS n, min(row_number) AS fr FROM body GROUP BY 1, 2, 3, 4),
tops AS (SELECT workbook_id, sheet_name, column_letters, arg_max(cell_type, n * 1000000000 - fr) AS kind,
    string_agg(cell_type, '|' ORDER BY cell_type) AS types_found, count(*) AS type_count FROM types GROUP BY 1, 2, 3),
pii AS (SELECT workbook_id, sheet_name, column_letters, bool_or(regexp_matches(trim(value), '^[^@\\s]+@[^@\\s]+\\.[a-zA-Z]{2,}$')
    OR regexp_matches(trim(value), '^\\d{3}\\.?\\d{3}\\.?\\d{3}-?\\d{2}$') OR regexp_matches(trim(value), '^(\\+?55)?\\s*\\(?\\d{2}\\)?\\s*\\d{4,5}-?\\d{4}$')) AS p
  FROM body WHERE cell_type = 'string' GROUP BY 1, 2, 3),
measures AS (SELECT workbook_id, sheet_name, column_letters, count(*) AS filled,
    count(DISTINCT CASE WHEN cell_type <> 'error' THEN cell_type || ':' || value END) AS uniq,
    bool_or(formula_expression IS NOT NULL) AS has_formula,
    min(CASE WHEN cell_type = 'number' THEN CAST(value AS DOUBLE) END) AS lo, max(CASE WHEN cell_type = 'number' THEN CAST(value AS DOUBLE) END) AS hi,
    avg(CASE WHEN cell_type = 'number' THEN CAST(value AS DOUBLE) END) AS mean,
    min(CASE WHEN cell_type = 'date' THEN CAST(value AS DATE) END) AS d1, max(CASE WHEN cell_type = 'date' THEN CAST(value AS DATE) END) AS d2,
    min(CASE WHEN cell_type = 'string' THEN length(value) END) AS l1, max(CASE WHEN cell_type = 'string' THEN length(value) END) AS l2,
    count(*) FILTER (WHERE cell_type = 'error') AS errors FROM body GROUP BY 1, 2, 3),
profile AS (SELECT h.workbook_id, h.sheet_name, 1 AS header_row, h.column_letters, field_name, coalesce(kind, 'empty') AS predominant_type,
    coalesce(types_found, '') AS types_found, coalesce(filled, 0) AS filled_count, CAST(max_row - 1 - coalesce(filled, 0) AS BIGINT) AS blank_count,
    round(coalesce(filled, 0) * 100.0::DOUBLE / (max_row - 1), 1) AS fill_pct, coalesce(uniq, 0) AS unique_count,
    coalesce(filled, 0) > 0 AND uniq < filled AS duplicate_flag, coalesce(has_formula, false) AS has_formula,
    coalesce(filled > 1 AND uniq = 1, false) AS constant_value_flag, lo AS min, hi AS max, round(mean, 4) AS mean, d1 AS date_min, d2 AS date_max,
    CAST(l1 AS INTEGER) AS text_len_min, CAST(l2 AS INTEGER) AS text_len_max, coalesce(type_count, 0) > 1 AS mixed_types_flag,
    coalesce(errors, 0) AS error_count, coalesce(filled = max_row - 1 AND uniq = filled, false) AS candidate_key_flag,
    coalesce(uniq > 0 AND uniq / filled <= 0.2 AND kind = 'string', false) AS candidate_category_flag,
    coalesce(has_formula AND kind IN ('number', 'date'), false) AS candidate_calculated_flag,
    CASE WHEN coalesce(p, false) THEN 'SIM' ELSE 'NAO' END AS potencial_pii
  FROM header h JOIN extent USING (workbook_id, sheet_name) LEFT JOIN measures USING (workbook_id, sheet_name, column_letters)
  LEFT JOIN tops USING (workbook_id, sheet_name, column_letters) LEFT JOIN pii USING (workbook_id, sheet_name, column_letters))"""

STAGED = CELLS + """,
grid AS (SELECT workbook_id, sheet_name, row_number AS source_row, max(value) FILTER (column_letters = 'A') AS a,
    max(value) FILTER (column_letters = 'B') AS b, max(value) FILTER (column_letters = 'C') AS cc, max(value) FILTER (column_letters = 'D') AS dd,
    max(value) FILTER (column_letters = 'F') AS f, max(value) FILTER (column_letters = 'G') AS g FROM c WHERE row_number >= 2 GROUP BY 1, 2, 3),
unit_candidates AS (SELECT workbook_id, sheet_name, source_row, 'DEV' AS development_ref, cc AS tower_ref, a AS unit_ref, cc AS typology_ref,
    TRY_CAST(b AS DECIMAL(12,4)) AS private_area, CAST(NULL AS DECIMAL(12,4)) AS uncovered_area, CAST(NULL AS VARCHAR) AS floor_ref,
    CAST(NULL AS VARCHAR) AS position_ref, 'HIGH' AS mapping_confidence, 'CANDIDATE' AS mapping_status FROM grid WHERE a <> ''),
price_candidates AS (SELECT workbook_id, sheet_name, source_row, a AS unit_ref_guess, TRY_CAST(dd AS DECIMAL(18,2)) AS price_value,
    TRY_CAST(f AS DECIMAL(18,2)) AS price_per_m2_value, 'HIGH' AS mapping_confidence, 'CANDIDATE' AS mapping_status FROM grid WHERE a <> ''),
calibration_candidates AS (SELECT workbook_id, sheet_name, CAST(NULL AS VARCHAR) AS source_cell_ref, source_row, 'FLOOR' AS dimension_guess,
    cc AS category_key_guess, TRY_CAST(g AS DECIMAL(18,6)) AS factor_value FROM grid WHERE cc <> ''
  UNION ALL SELECT s.workbook_id, s.sheet_name, 'B14', NULL, 'EXTRA', 'one', TRY_CAST(raw_value AS DECIMAL(18,6)) FROM sheets s
    LEFT JOIN c ON c.workbook_id = s.workbook_id AND c.sheet_name = s.sheet_name AND cell_ref = 'B14'),
parameter_candidates AS (SELECT s.workbook_id, s.sheet_name, x.ref AS source_cell_ref, x.k AS parameter_key_guess, value AS value_text, x.t AS value_type_guess
  FROM sheets s CROSS JOIN (VALUES ('B12', 'TARGET', 'NUMERIC'), ('H13', 'LABEL', NULL), ('ZZ9', 'MISSING', 'NUMERIC')) x(ref, k, t)
  LEFT JOIN c ON c.workbook_id = s.workbook_id AND c.sheet_name = s.sheet_name AND c.cell_ref = x.ref)"""

DEV = "'DEV-' || upper(substr({w}, 1, 10))"


def cells(d) -> Cells:
    return Cells(d)


@query("cell_rows", f"""WITH {CELLS} SELECT workbook_id, sheet_name, cell_type, count(*) AS cells,
    count(*) FILTER (WHERE formula_expression IS NOT NULL) AS formulas, count(raw_value) AS raw_values, count(cached_value) AS cached_values
    FROM c WHERE cell_type <> 'empty' GROUP BY 1, 2, 3""")
def cell_rows(d):
    """Stored cells: empty ones dropped, a formula's value in the cache."""
    kept = cells(d).cells.where("cell_type <> 'empty'")
    return kept.groupBy("workbook_id", "sheet_name", "cell_type").agg(
        F.count("*").alias("cells"), F.count("formula_expression").alias("formulas"), F.count("raw_value").alias("raw_values"),
        F.count("cached_value").alias("cached_values"),
    )


@query("cell_pivot", f"""WITH {STAGED} SELECT workbook_id, sheet_name, source_row, cc AS category_key_guess, g AS factor_value,
    'FLOOR' AS dimension_guess FROM grid WHERE cc <> ''""")
def cell_pivot(d):
    x = cells(d)
    rows = staging.extract_rows(x.cells, x.mapping, x.map_bound).where("category = 'calibration'")
    return rows.select("workbook_id", "sheet_name", "source_row", "category_key_guess", "factor_value", "dimension_guess")


@query("stage_units", f"WITH {STAGED} SELECT * FROM unit_candidates")
def stage_units(d):
    return cells(d).staged["unit_candidates"]


@query("stage_prices", f"WITH {STAGED} SELECT * FROM price_candidates")
def stage_prices(d):
    return cells(d).staged["price_output_candidates"]


@query("stage_calibrations", f"WITH {STAGED} SELECT * FROM calibration_candidates")
def stage_calibrations(d):
    return cells(d).staged["calibration_candidates"].drop("mapping_confidence", "mapping_status")


@query("stage_parameters", f"WITH {STAGED} SELECT * FROM parameter_candidates")
def stage_parameters(d):
    return cells(d).staged["parameter_candidates"].drop("mapping_confidence", "mapping_status", "notes")


@query("stage_review", f"""WITH {CELLS} SELECT workbook_id, sheet_name, x.source_row, x.source_cell_ref, x.field_label, x.suspected_concept,
    x.confidence, x.status FROM sheets, (VALUES (2, NULL, 'meio', 'PARAMETER', 'MEDIUM', 'REVIEW_REQUIRED'), (NULL, 'Z1', 'baixo', '', 'LOW', 'UNMAPPED'),
    (NULL, 'C2', 'nota', '', 'HIGH', 'REVIEW_REQUIRED')) x(source_row, source_cell_ref, field_label, suspected_concept, confidence, status)""")
def stage_review(d):
    return cells(d).staged["mapping_review"]


@query("stage_counts", f"""WITH {STAGED} SELECT 'unit_candidates' AS target, count(*) AS n FROM unit_candidates
    UNION ALL SELECT 'price_output_candidates', count(*) FROM price_candidates UNION ALL SELECT 'calibration_candidates', count(*) FROM calibration_candidates
    UNION ALL SELECT 'parameter_candidates', count(*) FROM parameter_candidates UNION ALL SELECT 'mapping_review', count(*) * 3 FROM sheets""")
def stage_counts(d):
    return staging.stage_counts(cells(d).staged)


@query("unreadable_numbers", f"""WITH {STAGED} SELECT workbook_id, sheet_name, source_row, 'private_area' AS field, b AS text FROM grid
    WHERE a <> '' AND b <> '' AND TRY_CAST(b AS DECIMAL(12,4)) IS NULL
    UNION ALL SELECT workbook_id, sheet_name, source_row, 'price_value', dd FROM grid WHERE a <> '' AND TRY_CAST(dd AS DECIMAL(18,2)) IS NULL AND dd <> ''""")
def unreadable_numbers(d):
    x = cells(d)
    return staging.unreadable_numbers(staging.extract_rows(x.cells, x.mapping, x.map_bound))


@query("staging_rejects", f"""WITH {STAGED}, r AS (SELECT workbook_id, sheet_name, source_row, CAST(NULL AS VARCHAR) AS source_cell_ref, 'unit' AS category, 'private_area' AS field, b AS text, 'not_a_number' AS reason
      FROM grid WHERE a <> '' AND b <> '' AND TRY_CAST(b AS DECIMAL(12,4)) IS NULL
    UNION ALL SELECT workbook_id, sheet_name, source_row, NULL, 'price_output', 'price_value', dd, 'not_a_number' FROM grid WHERE a <> '' AND TRY_CAST(dd AS DECIMAL(18,2)) IS NULL AND dd <> ''
    UNION ALL SELECT workbook_id, sheet_name, NULL, NULL, 'other', NULL, 'other', 'unknown_category' FROM sheets WHERE sheet_name <> '5-LOW'
    UNION ALL SELECT workbook_id, sheet_name, NULL, source_cell_ref, 'parameter', parameter_key_guess, value_text, CASE WHEN value_text IS NULL THEN 'no_cell' ELSE 'not_a_number' END
      FROM parameter_candidates WHERE value_text IS NULL OR (value_type_guess = 'NUMERIC' AND TRY_CAST(value_text AS DECIMAL(18,6)) IS NULL)
    UNION ALL SELECT workbook_id, sheet_name, NULL, source_cell_ref, 'calibration', category_key_guess, NULL, 'no_cell' FROM calibration_candidates WHERE source_cell_ref = 'B14' AND factor_value IS NULL)
    SELECT * FROM r WHERE sheet_name <> '5-LOW'
    UNION ALL SELECT workbook_id, sheet_name, NULL, x.ref, x.c, NULL, CASE WHEN x.c = 'other' AND x.why = 'unknown_category' THEN 'other' END, x.why FROM sheets,
      (VALUES ('unit', NULL, 'no_sheet'), ('price_output', NULL, 'no_sheet'), ('calibration', NULL, 'no_sheet'), ('other', NULL, 'no_sheet'), ('parameter', 'B12', 'no_sheet'), ('parameter', 'H13', 'no_sheet'),
        ('parameter', 'ZZ9', 'no_sheet'), ('calibration', 'B14', 'no_sheet'), ('note', 'C2', 'no_sheet'), ('other', NULL, 'unknown_category')) x(c, ref, why) WHERE sheet_name = '5-LOW'""")
def staging_rejects(d):
    """What the mapping asked for and cells could not give; the sheets named 5-LOW are taken as lost."""
    x = cells(d)
    kept = x.cells.where("sheet_name <> '5-LOW'")
    rows = staging.extract_rows(kept, x.mapping, x.map_bound)
    return staging.rejects(kept, x.mapping, rows, x.sheets.where("sheet_name <> '5-LOW'"), x.map_bound)


@query("staged_orphans", f"""WITH {STAGED} SELECT workbook_id, sheet_name, count(*) AS rows FROM unit_candidates
    WHERE sheet_name = '1-URGENT' AND workbook_id = 'WB-F' GROUP BY 1, 2""")
def staged_orphans(d):
    """One sheet is taken out of the stored sheets; its staged rows are the orphans."""
    x = cells(d)
    stored = x.sheets.where("not (sheet_name = '1-URGENT' and workbook_id = 'WB-F')")
    return staging.orphans(x.staged["unit_candidates"], stored).groupBy("workbook_id", "sheet_name").agg(F.count("*").alias("rows"))


@query("fidelity_reconcile", f"""WITH {CELLS}, s AS (SELECT workbook_id, sheet_name, count(*) AS source_cells, count(formula_expression) AS source_formulas,
      count(*) FILTER (WHERE row_number % 5000 = 2) AS lost, count(formula_expression) FILTER (WHERE row_number % 5000 = 2) AS lost_f FROM c GROUP BY 1, 2)
    SELECT workbook_id, sheet_name, source_cells, source_cells - lost AS stored_cells, source_formulas, source_formulas - lost_f AS stored_formulas,
    lost = 0 AS identical FROM s""")
def fidelity_reconcile(d):
    """Every cell of the source against a stored table that lost some rows."""
    x = cells(d)
    return staging.reconcile(x.cells, x.cells.where("row_number % 5000 <> 2"))


@query("mapping_confidence", f"""WITH {CELLS} SELECT x.c AS confidence, count(*) * max(x.n) AS entries FROM sheets,
    (VALUES ('HIGH', 9), ('MEDIUM', 1), ('LOW', 1)) x(c, n) GROUP BY 1""")
def mapping_confidence(d):
    return staging.entries_by_confidence(cells(d).mapping)


@query("mapping_file", f"""WITH {CELLS}, e AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'LOW' WHEN k % 7 < 3 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM o)
    SELECT workbook_id, sheet_name, confidence, 'single_cell' AS extraction, count(*) AS entries, count(DISTINCT k) AS ids,
    CAST(sum(CASE WHEN confidence = 'HIGH' AND k % 211 <> 0 THEN total END) AS DECIMAL(28,2)) AS total FROM e GROUP BY ALL""")
def mapping_file(d):
    """A mapping of one cell per order, written as a file and read back: entries, their ids and the values they point at."""
    k, x = F.col("o_orderkey"), cells(d)
    entries = d.table("orders").select(
        F.concat(F.lit("WB-"), "o_orderstatus").alias("workbook_sha256"), F.col("o_orderpriority").alias("sheet_name"),
        F.when(k % 7 == 0, "LOW").when(k % 7 < 3, "MEDIUM").otherwise("HIGH").alias("confidence"), F.lit("parameter").alias("category"),
        F.concat(F.lit("D"), k + 2).alias("cell_ref"), F.concat(F.lit("PRICE_"), k).alias("parameter_key_guess"), F.lit("NUMERIC").alias("value_type_guess"),
    )
    folder = f"{checkpoint_root(d.spark)}/proratio/{uuid.uuid4().hex}"
    files.write_documents(entries.select(F.to_json(F.struct(*entries.columns)).alias("document")), folder)
    mapping = mapping_source.read_mapping(d.spark, folder, lines=True)
    found = x.cells.where("column_letters = 'D'").select("workbook_id", "sheet_name", "cell_ref", effective_value("raw_value", "cached_value").alias("value"))
    value = F.when(F.col("confidence") == "HIGH", F.col("value").try_cast("decimal(18,2)"))
    return mapping.join(found, ["workbook_id", "sheet_name", "cell_ref"], "left").groupBy("workbook_id", "sheet_name", "confidence", "extraction").agg(
        F.count("*").alias("entries"), F.count_distinct("entry_id").alias("ids"), F.sum(value).cast("decimal(28,2)").alias("total"))


@query("serial_dates", f"""WITH {CELLS} SELECT workbook_id, sheet_name, CASE WHEN k % 29 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, count(*) AS cells FROM o GROUP BY ALL""")
def serial_dates(d):
    """Dates that a sheet holds as serial numbers with a time of day; texts are none."""
    k = F.col("o_orderkey")
    days = F.date_diff(F.col("o_orderdate"), F.lit("1899-12-30").cast("date"))
    serial = F.when(k % 29 == 0, "n/d").otherwise((days + (k % 24) / 24).cast("string"))
    cell = d.table("orders").select(F.concat(F.lit("WB-"), "o_orderstatus").alias("workbook_id"), F.col("o_orderpriority").alias("sheet_name"), serial.alias("value"))
    return cell.groupBy("workbook_id", "sheet_name", serial_date(F.col("value").try_cast("double")).alias("day")).agg(F.count("*").alias("cells"))


# --- promotion ---


@query("duplicate_guard", f"""WITH {STAGED} SELECT workbook_id, tower_ref, CAST(floor(CAST(unit_ref AS DOUBLE) / 8) AS VARCHAR) AS unit_ref,
    count(*) AS n FROM unit_candidates GROUP BY ALL HAVING count(*) > 1""")
def duplicate_guard(d):
    """Units cut to coarser codes, so that some collide."""
    units = cells(d).staged["unit_candidates"].withColumn(
        "unit_ref", F.format_string("%d.0", F.floor(F.col("unit_ref").cast("double") / 8))
    )
    return promotion.duplicate_units(units)


@query("promote_units", f"""WITH {STAGED} SELECT sha2.d AS development_id, unit_ref AS unit_code, source_row, sheet_name,
    CAST(coalesce(round(private_area, 2), 0) AS DECIMAL(9,2)) AS closed_area_m2, CAST(0 AS DECIMAL(9,2)) AS open_terrace_area_m2,
    sha256('core.units:' || sha2.k || ':' || coalesce(tower_ref, '') || ':' || unit_ref) AS id, sha256('core.towers:' || sha2.k || ':' || tower_ref) AS tower_id
    FROM unit_candidates JOIN (SELECT DISTINCT workbook_id, {DEV.format(w='workbook_id')} AS k,
      sha256('core.developments:' || {DEV.format(w='workbook_id')}) AS d FROM sheets) sha2 USING (workbook_id)""")
def promote_units(d):
    return promotion.units(cells(d).staged["unit_candidates"]).select(
        "development_id", "unit_code", "source_row", "sheet_name", "closed_area_m2", "open_terrace_area_m2", "id", "tower_id"
    )


@query("promote_labels", f"""WITH {STAGED} SELECT {DEV.format(w='workbook_id')} AS development, tower_ref AS business_key, 'tower' AS kind
    FROM unit_candidates GROUP BY 1, 2 UNION ALL SELECT {DEV.format(w='workbook_id')}, typology_ref, 'typology' FROM unit_candidates GROUP BY 1, 2""")
def promote_labels(d):
    """Distinct towers and typologies of the candidates."""
    x = cells(d)
    units = x.staged["unit_candidates"]
    named = promotion.developments(x.workbooks).select(F.col("id").alias("development_id"), F.col("business_key").alias("development"))
    both = promotion.towers(units).withColumn("kind", F.lit("tower")).unionByName(
        promotion.typologies(units).drop("classification").withColumn("kind", F.lit("typology"))
    )
    return attach(both, named, "development_id", x.sheet_bound, "inner").select("development", "business_key", "kind")


@query("promote_parameters", f"""WITH {STAGED} SELECT parameter_key_guess AS "key", CASE WHEN value_type_guess = 'NUMERIC' THEN 'NUMERIC' ELSE 'TEXT' END AS value_type,
    CASE WHEN value_type_guess = 'NUMERIC' THEN CAST(value_text AS DECIMAL(18,6)) END AS numeric_value,
    CASE WHEN value_type_guess IS NULL THEN value_text END AS text_value, CAST(NULL AS BOOLEAN) AS boolean_value, CAST(NULL AS DATE) AS date_value
    FROM parameter_candidates WHERE trim(value_text) <> ''""")
def promote_parameters(d):
    return promotion.parameters(cells(d).staged["parameter_candidates"]).drop("id", "parameter_set_id", "development_id", "workbook_id", "sheet_name", "source_cell_ref")


@query("promote_calibrations", f"""WITH {STAGED}, k AS (SELECT *, row_number() OVER (PARTITION BY workbook_id, dimension_guess, category_key_guess
      ORDER BY sheet_name, source_row, source_cell_ref) AS rn FROM calibration_candidates WHERE trim(category_key_guess) <> '' AND factor_value IS NOT NULL)
    SELECT dimension_guess AS dimension, category_key_guess AS category_key, CAST(factor_value AS DECIMAL(12,6)) AS factor FROM k WHERE rn = 1""")
def promote_calibrations(d):
    return promotion.calibration_entries(cells(d).staged["calibration_candidates"]).select("dimension", "category_key", "factor")


PRICED = STAGED + """,
imported AS (SELECT u.workbook_id, u.tower_ref, u.unit_ref, price_value, price_per_m2_value FROM price_candidates p
  JOIN unit_candidates u USING (workbook_id, sheet_name, source_row) WHERE price_value IS NOT NULL)"""


@query("promote_prices", f"""WITH {PRICED} SELECT sha256('core.units:' || {DEV.format(w='workbook_id')} || ':' || coalesce(tower_ref, '') || ':' || unit_ref) AS unit_id,
    price_value AS system_calculated_price, CAST(price_per_m2_value AS DECIMAL(12,2)) AS system_calculated_price_per_m2,
    'IMPORTED_REFERENCE' AS result_origin FROM imported""")
def promote_prices(d):
    x = cells(d)
    found = promotion.prices(x.staged["price_output_candidates"], promotion.units(x.staged["unit_candidates"]))
    return found.select("unit_id", "system_calculated_price", "system_calculated_price_per_m2", "result_origin")


OWNERS = f"owners AS (SELECT DISTINCT workbook_id, {DEV.format(w='workbook_id')} AS k FROM sheets), scen AS (SELECT *, sha256('pricing.scenarios:' || k || ':IMPORTED_REFERENCE') AS s, sha256('core.developments:' || k) AS d FROM owners)"
DIMENSIONS = """dims AS (SELECT DISTINCT k, s, d, coalesce(nullif(dimension_guess, ''), 'CALIBRATION') AS dim FROM calibration_candidates JOIN scen USING (workbook_id)
    WHERE trim(category_key_guess) <> '' AND factor_value IS NOT NULL)"""


@query("promote_scenarios", f"""WITH {STAGED}, {OWNERS} SELECT s AS id, d AS development_id, 'IMPORTED_REFERENCE' AS code, 'ACTIVE' AS status,
    sha256('audit.data_sources:' || k) AS data_source_id, workbook_id AS source_name FROM scen""")
def promote_scenarios(d):
    x = cells(d)
    sources = promotion.data_sources(x.workbooks).select("development_id", F.col("id").alias("data_source_id"), F.col("name").alias("source_name"))
    return attach(promotion.scenarios(x.workbooks), sources, "development_id", x.sheet_bound, "inner").select(
        "id", "development_id", "code", "status", "data_source_id", "source_name")


@query("promote_sets", f"""WITH {STAGED}, {OWNERS}, {DIMENSIONS}
    SELECT sha256('pricing.parameter_sets:' || s || ':IMPORTED_PARAMETERS') AS id, s AS scenario_id, 'IMPORTED_PARAMETERS' AS code, 1 AS version, 'ACTIVE' AS status FROM scen
    UNION ALL SELECT sha256('pricing.calibration_sets:' || s || ':' || dim || ':1'), s, dim, 1, 'ACTIVE' FROM dims""")
def promote_sets(d):
    """Parameter sets and calibration sets."""
    x = cells(d)
    both = promotion.parameter_sets(x.workbooks).unionByName(promotion.calibration_sets(x.staged["calibration_candidates"]).drop("dimension"))
    return both.select("id", "scenario_id", "code", "version", "status")


@query("promote_runs", f"""WITH {STAGED}, {OWNERS}, {DIMENSIONS} SELECT sha256('pricing.runs:' || k || ':IMPORTED_REFERENCE_RUN') AS run_id, s AS scenario_id,
    sha256('pricing.parameter_sets:' || s || ':IMPORTED_PARAMETERS') AS parameter_set_id, 'COMPLETED' AS status, sha256('pricing.calibration_sets:' || s || ':' || dim || ':1') AS calibration_set_id
    FROM scen LEFT JOIN dims USING (k, s, d)""")
def promote_runs(d):
    """The imported run of each development and the sets it used."""
    x = cells(d)
    used = promotion.run_calibration_sets(x.staged["calibration_candidates"]).select("run_id", "calibration_set_id")
    found = promotion.runs(x.workbooks).select(F.col("id").alias("run_id"), "scenario_id", "parameter_set_id", "status")
    return found.join(used, "run_id", "left")


@query("candidate_state", f"""WITH {STAGED} SELECT workbook_id, sheet_name, source_row, CASE WHEN source_row % 10 <> 0 THEN
    sha256('core.units:' || {DEV.format(w='workbook_id')} || ':' || coalesce(tower_ref, '') || ':' || unit_ref) END AS entity_id,
    CASE WHEN source_row % 10 <> 0 THEN 'PROMOTED' ELSE 'PENDING' END AS state FROM unit_candidates""")
def candidate_state(d):
    """Every tenth row waits for review; the others became units."""
    x = cells(d)
    waits = F.when(F.col("source_row") % 10 == 0, "REVIEW_REQUIRED").otherwise(F.col("mapping_status"))
    candidates = x.staged["unit_candidates"].withColumn("mapping_status", waits)
    links = promotion.candidate_entities(promotion.units(candidates))
    return promotion.candidate_state(candidates, links).select("workbook_id", "sheet_name", "source_row", "entity_id", "state")


@query("promotion_summary", f"""WITH {PRICED} SELECT 'unit_candidates' AS candidates, count(*) AS total, count(*) AS high_candidate, count(*) AS promoted FROM unit_candidates
    UNION ALL SELECT 'price_output_candidates', count(*), count(*), (SELECT count(*) FROM imported) FROM price_candidates""")
def promotion_summary(d):
    x = cells(d)
    units = promotion.units(x.staged["unit_candidates"])
    return promotion.summary(
        x.staged, {"unit_candidates": units, "price_output_candidates": promotion.prices(x.staged["price_output_candidates"], units)}
    )


@query("promotion_pending", f"""WITH {STAGED} SELECT {DEV.format(w='workbook_id')} AS development, candidates, count(*) AS n FROM (
    SELECT workbook_id, 'unit_candidates' AS candidates FROM unit_candidates UNION ALL SELECT workbook_id, 'parameter_candidates' FROM parameter_candidates
    UNION ALL SELECT workbook_id, 'calibration_candidates' FROM calibration_candidates UNION ALL SELECT workbook_id, 'price_output_candidates' FROM price_candidates)
    GROUP BY 1, 2""")
def promotion_pending(d):
    return promotion.pending_by_workbook(cells(d).staged)


@query("review_counts", f"""WITH {CELLS} SELECT x.c AS confidence, x.s AS status, count(*) AS n FROM sheets, (VALUES ('MEDIUM', 'REVIEW_REQUIRED'),
    ('LOW', 'UNMAPPED'), ('HIGH', 'REVIEW_REQUIRED')) x(c, s) GROUP BY 1, 2""")
def review_counts(d):
    return promotion.review_counts(cells(d).staged["mapping_review"])


@query("lineage_counts", f"""WITH {PRICED} SELECT 'core' AS entity_schema, 'developments' AS entity_table, 'raw.workbooks' AS derived_from, count(DISTINCT workbook_id) AS n FROM sheets
    UNION ALL SELECT 'core', 'units', 'staging.unit_candidates', count(*) FROM unit_candidates
    UNION ALL SELECT 'pricing', 'parameters', 'staging.parameter_candidates', count(*) FROM parameter_candidates WHERE trim(value_text) <> ''
    UNION ALL SELECT 'pricing', 'calibration_entries', 'staging.calibration_candidates', count(DISTINCT (workbook_id, dimension_guess, category_key_guess))
      FROM calibration_candidates WHERE trim(category_key_guess) <> '' AND factor_value IS NOT NULL
    UNION ALL SELECT 'pricing', 'unit_price_results', 'staging.price_output_candidates', count(*) FROM imported""")
def lineage_counts(d):
    x = cells(d)
    rows = promotion.promote(x.staged, x.workbooks)["audit.data_lineage"]
    return rows.groupBy("entity_schema", "entity_table", "derived_from").agg(F.count("*").alias("n"))


CELL_LINES = f"""WITH {PRICED}, runs AS (SELECT DISTINCT workbook_id, {DEV.format(w='workbook_id')} AS k FROM sheets),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY workbook_id, dimension_guess, category_key_guess ORDER BY sheet_name, source_row NULLS FIRST, source_cell_ref NULLS FIRST) AS n
      FROM calibration_candidates WHERE trim(category_key_guess) <> '' AND factor_value IS NOT NULL)
    SELECT 'pricing.unit_price_results' AS start_kind, sha256('pricing.unit_price_results:' || sha256('pricing.runs:' || k || ':IMPORTED_REFERENCE_RUN') || ':' ||
      sha256('core.units:' || k || ':' || coalesce(tower_ref, '') || ':' || unit_ref)) AS start_id,
      workbook_id || '|' || sheet_name || '|D' || source_row AS cell, dd AS value
      FROM price_candidates p JOIN unit_candidates u USING (workbook_id, sheet_name, source_row) JOIN runs USING (workbook_id) JOIN grid USING (workbook_id, sheet_name, source_row)
      WHERE price_value IS NOT NULL
    UNION ALL SELECT 'pricing.parameters', sha256('pricing.parameters:' || k || ':' || parameter_key_guess), workbook_id || '|' || sheet_name || '|' || source_cell_ref, value_text
      FROM parameter_candidates JOIN runs USING (workbook_id) WHERE trim(value_text) <> ''
    UNION ALL SELECT 'pricing.calibration_entries', sha256('pricing.calibration_entries:' || k || ':' || dimension_guess || ':' || category_key_guess),
      workbook_id || '|' || sheet_name || '|' || coalesce(source_cell_ref, 'G' || source_row), coalesce(g, (SELECT max(value) FROM c WHERE c.workbook_id = f.workbook_id
        AND c.sheet_name = f.sheet_name AND c.cell_ref = f.source_cell_ref))
      FROM firsts f JOIN runs USING (workbook_id) LEFT JOIN grid USING (workbook_id, sheet_name, source_row) WHERE n = 1"""


@query("lineage_to_cells", CELL_LINES)
def lineage_to_cells(d):
    """From every imported price, parameter and factor over its candidate to its cell."""
    x = cells(d)
    return lineage.to_cells(x.staged, x.mapping, x.cells, x.map_bound)


ORPHANS = f"""WITH {PRICED}, planted AS (
    SELECT 'core.units.tower_id' AS reference, count(*) AS rows FROM unit_candidates WHERE source_row % 97 = 0
    UNION ALL SELECT 'core.units.tower_id+development_id', count(*) FROM unit_candidates WHERE source_row % 97 = 0
    UNION ALL SELECT 'pricing.unit_price_results.run_id', count(*) FROM imported WHERE CAST(floor(price_value) AS BIGINT) % 50 = 0
    UNION ALL SELECT 'pricing.parameters.parameter_set_id', count(*) FROM parameter_candidates WHERE trim(value_text) <> ''
    UNION ALL SELECT 'audit.data_lineage.data_source_id', count(*) FROM parameter_candidates WHERE trim(value_text) <> ''
    UNION ALL SELECT 'raw.cells.workbook_id+sheet_name', count(*) FROM c WHERE column_letters = 'E' AND row_number % 20 = 2)"""


@query("stored_references", f"{ORPHANS} SELECT * FROM planted WHERE rows > 0")
def stored_references(d):
    """All references of a promoted batch: planted orphans, inline, composite and deferred, and one table written before its parent."""
    x = cells(d)
    found = promotion.promote(x.staged, x.workbooks)
    lost = lambda column, when: F.when(when, F.lit("lost")).otherwise(F.col(column))
    found["core.units"] = found["core.units"].withColumn("tower_id", F.when(F.col("source_row") % 97 == 0, F.lit("lost")).otherwise(F.col("tower_id")))
    found["pricing.unit_price_results"] = found["pricing.unit_price_results"].withColumn(
        "run_id", lost("run_id", F.floor("system_calculated_price").cast("bigint") % 50 == 0))
    found["audit.data_lineage"] = found["audit.data_lineage"].withColumn("data_source_id", lost("data_source_id", F.col("entity_table") == "parameters"))
    stray = (F.col("column_letters") == "E") & (F.col("row_number") % 20 == 2)
    batch = {"raw.cells": x.cells.withColumn("sheet_name", lost("sheet_name", stray)), "pricing.parameters": found["pricing.parameters"]}
    batch |= {name: found[name] for name in references.ORDER if name in found and name not in batch}
    return references.report(references.orphans(batch, {"raw.sheets": x.sheets})).drop("keys")


@query("idempotent_append", f"""WITH {STAGED} SELECT unit_ref AS unit_code, sheet_name FROM unit_candidates WHERE source_row % 3 <> 0""")
def idempotent_append(d):
    """Every unit offered twice to a table that holds each third row already."""
    units = promotion.units(cells(d).staged["unit_candidates"]).select("id", "unit_code", "sheet_name", "source_row")
    stored = units.where("source_row % 3 = 0")
    return publish.not_stored(units.unionByName(units), stored, ["id"], ["source_row"]).select("unit_code", "sheet_name")


# --- profiles and formulas ---


@query("header_row", f"""WITH {CELLS}, rows AS (SELECT workbook_id, sheet_name, row_number, count(*) FILTER (WHERE cell_type <> 'empty') AS filled,
      count(*) FILTER (WHERE cell_type = 'string') AS texts, count(DISTINCT CASE WHEN cell_type = 'string' THEN value END) AS dt,
      count(*) FILTER (WHERE cell_type IN ('number','date','boolean')) AS numbers FROM c GROUP BY 1, 2, 3),
    early AS (SELECT *, min(row_number) OVER w <= 20 AS early, row_number() OVER (PARTITION BY workbook_id, sheet_name ORDER BY row_number) AS rank
      FROM rows WINDOW w AS (PARTITION BY workbook_id, sheet_name)),
    scored AS (SELECT *, texts / filled * 0.5::DOUBLE + CASE WHEN texts > 0 THEN dt / texts ELSE 0 END * 0.2::DOUBLE
      + coalesce(avg(numbers / filled) OVER (PARTITION BY workbook_id, sheet_name ORDER BY row_number ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) * 0.3::DOUBLE AS score
      FROM early WHERE NOT early OR row_number <= 20)
    SELECT workbook_id, sheet_name, row_number AS header_row, CAST(printf('%.2f', least(1, greatest(0, score))) AS DOUBLE) AS header_confidence FROM scored WHERE rank <= 20
    QUALIFY row_number() OVER (PARTITION BY workbook_id, sheet_name ORDER BY score DESC, row_number) = 1""")
def header_row(d):
    return cells(d).headers


@query("field_profile", f"WITH {PROFILE} SELECT * FROM profile")
def field_profile(d):
    return cells(d).fields.drop("header_confidence")


@query("sheet_inventory", f"""WITH {CELLS} SELECT workbook_id, sheet_name, max(row_number) AS n_rows, max(column_index) AS n_cols,
    count(*) FILTER (WHERE cell_type <> 'empty') AS filled_cells, count(formula_expression) AS formula_cells,
    count(*) FILTER (WHERE cell_type = 'error') AS error_cells, 1 AS header_row FROM c GROUP BY 1, 2""")
def sheet_inventory(d):
    x = cells(d)
    return profiling.sheet_inventory(x.cells, x.headers, x.sheet_bound).drop("header_confidence")


@query("quality_issues", f"""WITH {PROFILE}, p AS (SELECT *, sheet_name || '!' || column_letters AS loc FROM profile)
    SELECT workbook_id, sheet_name, 'baixa_cobertura' AS issue_type, loc AS location, 'fill_pct=' || fill_pct AS detail, 'BAIXA' AS severity
      FROM p WHERE blank_count > 0 AND filled_count > 0 AND fill_pct < 50
    UNION ALL SELECT workbook_id, sheet_name, 'tipos_inconsistentes', loc, types_found, 'MEDIA' FROM p WHERE mixed_types_flag
    UNION ALL SELECT workbook_id, sheet_name, 'celulas_com_erro', loc, 'error_count=' || error_count, 'ALTA' FROM p WHERE error_count > 0
    UNION ALL SELECT workbook_id, sheet_name, 'possivel_duplicidade', loc, 'dup_ratio=' || round(1 - unique_count / filled_count, 2), 'BAIXA'
      FROM p WHERE duplicate_flag AND NOT candidate_key_flag AND 1 - unique_count / filled_count > 0.3
    UNION ALL SELECT workbook_id, sheet_name, 'coluna_quase_constante', loc, '', 'BAIXA' FROM p WHERE constant_value_flag
    UNION ALL SELECT workbook_id, sheet_name, 'possivel_chave_ausente', sheet_name, '', 'MEDIA' FROM p GROUP BY 1, 2 HAVING NOT bool_or(candidate_key_flag)
    UNION ALL SELECT workbook_id, sheet_name, 'linha_totalmente_vazia_no_meio', 'row ' || row_number, '', 'MEDIA' FROM c
      GROUP BY workbook_id, sheet_name, row_number HAVING bool_and(cell_type = 'empty')""")
def quality_issues(d):
    x = cells(d)
    return profiling.quality_issues(x.cells, x.fields)


@query("formula_inventory", f"""WITH {CELLS}, p AS (SELECT *, regexp_replace(formula_expression, '(\\$?)([A-Z]{{1,3}})(\\$?)(\\d+)', '\\1\\2\\3#', 'g') AS pattern
      FROM c WHERE formula_expression IS NOT NULL)
    SELECT workbook_id, sheet_name, pattern, count(*) AS occurrences, arg_min(cell_ref, row_number * 16384::BIGINT + column_index) AS example_cell,
    CASE WHEN contains(pattern, 'Tabela') THEN 'Tabela' WHEN contains(pattern, 'Aux') THEN 'Aux' ELSE '' END AS refs_other_sheets,
    contains(pattern, '$') AS has_absolute_ref, regexp_matches(pattern, '(^|[^$])[A-Z]{{1,3}}#') AS has_relative_ref,
    CASE WHEN count(DISTINCT row_number) > 1 AND count(DISTINCT column_index) > 1 THEN 'mixed' WHEN count(DISTINCT row_number) > 1 THEN 'vertical'
      WHEN count(DISTINCT column_index) > 1 THEN 'horizontal' ELSE 'single' END AS direction, CAST(0 AS BIGINT) AS broken_count FROM p GROUP BY 1, 2, 3""")
def formula_inventory(d):
    return formulas.formula_inventory(cells(d).cells)


@query("dependency_edges", f"""WITH {CELLS} SELECT workbook_id, sheet_name AS source_sheet, CASE WHEN formula_expression LIKE 'VLOOKUP%' THEN 'Tabela' ELSE 'Aux' END AS target_sheet,
    count(*) AS reference_count FROM c WHERE column_letters = 'G' AND formula_expression IS NOT NULL GROUP BY 1, 2, 3""")
def dependency_edges(d):
    return formulas.dependency_edges(cells(d).cells)


@query("embedded_parameters", f"""WITH {CELLS}, p AS (SELECT *, regexp_replace(formula_expression, '(\\$?)([A-Z]{{1,3}})(\\$?)(\\d+)', '\\1\\2\\3#', 'g') AS pattern,
      unnest(regexp_extract_all(regexp_replace(formula_expression, '\\$?[A-Z]{{1,3}}\\$?\\d+', ' ', 'g'), '\\d+(\\.\\d+)?')) AS lit FROM c WHERE formula_expression IS NOT NULL),
    f AS (SELECT workbook_id, sheet_name, lit, arg_min(cell_ref, row_number * 16384::BIGINT + column_index) AS location,
      arg_min(formula_expression, row_number * 16384::BIGINT + column_index) AS used_by FROM p GROUP BY workbook_id, sheet_name, pattern, lit)
    SELECT workbook_id, sheet_name, location, lit AS value_or_expression, used_by, CASE WHEN CAST(lit AS DOUBLE) > 0 AND CAST(lit AS DOUBLE) < 1 THEN 'possivel_percentual_ou_peso'
      WHEN lit IN ('100', '1000') THEN 'possivel_conversao_ou_escala' WHEN used_by LIKE 'VLOOKUP%' THEN 'possivel_indice_ou_offset_de_lookup' ELSE 'desconhecido' END AS possible_role,
    NOT (lit IN ('0', '1', '2', '3', '4') AND used_by LIKE 'VLOOKUP%') AS requires_human_explanation FROM f""")
def embedded_parameters(d):
    return formulas.embedded_parameters(cells(d).cells).drop("parameter_id", "origin_type", "confidence")


@query("consistency_flags", f"""WITH {CELLS}, s AS (SELECT workbook_id, sheet_name, column_letters, row_number,
      CASE WHEN formula_expression IS NOT NULL THEN 'formula' WHEN cell_type IN ('number','string','date') AND value <> '' THEN 'manual_value' ELSE 'empty' END AS kind,
      CASE WHEN formula_expression IS NOT NULL THEN regexp_replace(formula_expression, '(\\$?)([A-Z]{{1,3}})(\\$?)(\\d+)', '\\1\\2\\3#', 'g')
        WHEN cell_type IN ('number','string','date') AND value <> '' THEN cell_type END AS detail FROM c),
    n AS (SELECT workbook_id, sheet_name, column_letters, kind, detail, count(*) AS n, min(row_number) AS fr FROM s GROUP BY ALL),
    m AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY workbook_id, sheet_name, column_letters ORDER BY n DESC, fr) = 1),
    d AS (SELECT s.*, NOT (s.kind = 'formula' AND s.detail = m.detail) AS off, row_number() OVER w AS pos FROM s JOIN m USING (workbook_id, sheet_name, column_letters)
      WHERE m.kind = 'formula' AND m.n >= 5 WINDOW w AS (PARTITION BY workbook_id, sheet_name, column_letters ORDER BY s.row_number)),
    i AS (SELECT *, pos - row_number() OVER (PARTITION BY workbook_id, sheet_name, column_letters ORDER BY row_number) AS grp FROM d WHERE off),
    h AS (SELECT *, first_value(kind) OVER w AS k0, first_value(detail) OVER w AS d0 FROM i
      WINDOW w AS (PARTITION BY workbook_id, sheet_name, column_letters, grp ORDER BY row_number))
    SELECT workbook_id, sheet_name, column_letters, min(row_number) || '-' || max(row_number) AS row_range,
    count(*) FILTER (WHERE kind = k0 AND detail IS NOT DISTINCT FROM d0) AS affected_cells, 'formula' AS majority_pattern_kind, max(k0) AS deviation_kind,
    coalesce(max(d0), '') AS deviation_detail, CASE max(k0) WHEN 'manual_value' THEN 'POSSIBLE_MANUAL_OVERRIDE' WHEN 'formula' THEN 'POSSIBLE_ERROR_OR_VARIANT_FORMULA'
      ELSE 'UNKNOWN' END AS classification_hint FROM h GROUP BY workbook_id, sheet_name, column_letters, grp""")
def consistency_flags(d):
    x = cells(d)
    return formulas.consistency_flags(x.cells, x.column_bound, block_rows=1000)
