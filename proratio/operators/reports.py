"""The ten report tables of a set of workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proratio.operators import formulas, profiling, similarity
from proratio.session import counted, stage
from proratio.sources import workbook


def workbook_reports(records: DataFrame, workbook_pairs: DataFrame) -> dict[str, DataFrame]:
    """Report name to table. ``records`` is stored; ``workbook_pairs`` says which workbooks to compare."""
    cells = stage(workbook.all_cells(records))
    sheets = workbook.sheets(records)
    bound = counted(sheets)
    headers = stage(profiling.header_rows(cells, bound))
    fields = stage(profiling.field_profile(cells, headers, bound))
    listed = sheets.withColumn("hidden_rows_count", F.size("hidden_rows")).withColumn("hidden_cols_count", F.size("hidden_cols"))
    named = fields.select(
        "workbook_id", "sheet_name", "field_name",
        F.aggregate(F.split("column_letters", ""), F.lit(0), lambda n, c: (n * 26 + F.ascii(c) - 64).cast("int")).alias("ordinal"),
    )
    return {
        "workbook_inventory": workbook.workbooks(records).drop("hidden_names"),
        "sheet_inventory": profiling.sheet_inventory(cells, headers, bound, listed.drop("hidden_rows", "hidden_cols")),
        "field_profile": fields,
        "formula_inventory": formulas.formula_inventory(cells),
        "dependency_inventory": formulas.dependency_edges(cells),
        "hidden_content_inventory": profiling.hidden_content(workbook.workbooks(records), sheets),
        "quality_issues": profiling.quality_issues(cells, fields),
        "cross_workbook_mapping": similarity.cross_workbook_mapping(workbook_pairs, sheets.select("workbook_id", "sheet_name"), named),
        "embedded_parameters": formulas.embedded_parameters(cells),
        "consistency_flags": formulas.consistency_flags(cells, fields),
    }
