"""Profiles of tall cell tables: headers, columns, sheets, quality issues.

``cells`` carries ``workbook_id, sheet_name, row_number, column_index,
column_letters, cell_ref, cell_type, raw_value, cached_value,
formula_expression``. Sheets and columns may be of any size: whatever is counted
per sheet or column is pre-aggregated where the cells are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proratio.functions.text import effective_value, personal_header, personal_value
from proratio.session import attach, fits

SHEET = ["workbook_id", "sheet_name"]
COLUMN = SHEET + ["column_letters"]
HEADER_ROWS = 20
ROWS_BELOW = 5


def first_rows(cells: DataFrame, bound) -> DataFrame:
    """Cells of each sheet's first rows, ranked: those up to the twentieth, or of a sheet that starts later its first 25.

    The usual case is a filter the scan takes over. Only sheets without any early
    row are ranked, and each task passes on no more of them than could count.
    """
    early = cells.where(F.col("row_number") <= HEADER_ROWS)
    starts = early.select(*SHEET).distinct()
    late = cells.where(F.col("row_number") > HEADER_ROWS)
    few = fits(bound)
    if few:
        late = late.join(F.broadcast(starts), SHEET, "left_anti")
    order = Window.partitionBy(*SHEET).orderBy("row_number")
    ranked = late.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= HEADER_ROWS + ROWS_BELOW)
    if not few:
        # Too many sheets to broadcast: rank all of them, and drop those with early rows when little is left.
        ranked = ranked.join(starts, SHEET, "left_anti")
    return early.withColumn("rank", F.lit(1)).unionByName(ranked)


def header_rows(cells: DataFrame, bound) -> DataFrame:
    """The likeliest header row of each sheet, and how sure that is.

    Candidates are the rows up to the twentieth, or a sheet's first twenty rows if
    it starts later. A row scores by its share of text, how distinct its texts
    are, and how numeric the next five candidates are. ``bound`` proves the number
    of sheets.
    """
    head = first_rows(cells, bound)
    text = F.col("cell_type") == "string"
    rows = head.groupBy(*SHEET, "row_number").agg(
        F.max("rank").alias("rank"),
        F.count_if(F.col("cell_type") != "empty").alias("filled"),
        F.count_if(text).alias("texts"),
        F.size(F.collect_set(F.when(text, effective_value()))).alias("distinct_texts"),
        F.count_if(F.col("cell_type").isin("number", "date", "boolean")).alias("numbers"),
    )
    # At most 25 rows of a sheet are left.
    sheet = Window.partitionBy(*SHEET)
    filled = F.col("filled") > 0
    below = sheet.orderBy("row_number").rowsBetween(1, ROWS_BELOW)
    ratio = F.when(filled, F.col("numbers") / F.col("filled"))
    distinct = F.when(F.col("texts") > 0, F.col("distinct_texts") / F.col("texts")).otherwise(F.lit(0.0))
    score = (
        F.col("texts") / F.col("filled") * 0.5 + distinct * 0.2 + F.coalesce(F.avg(ratio).over(below), F.lit(0.0)) * 0.3
    )
    scored = rows.withColumn("score", F.when(filled, score)).where(
        F.col("score").isNotNull() & (F.col("rank") <= HEADER_ROWS)
    )
    best = scored.groupBy(*SHEET).agg(
        F.max(F.struct(F.col("score").alias("score"), (-F.col("row_number")).alias("row"))).alias("best")
    )
    return best.select(
        *SHEET, (-F.col("best.row")).alias("header_row"),
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("best.score"))), 2).alias("header_confidence"),
    )


def header_fields(cells: DataFrame, headers: DataFrame, bound) -> DataFrame:
    """Named columns of each sheet: those whose header cell is text."""
    at_header = attach(cells, headers, SHEET, bound, "inner").where(F.col("row_number") == F.col("header_row"))
    return at_header.where(F.col("cell_type") == "string").select(
        *COLUMN, "column_index", "header_row", "header_confidence", F.trim(effective_value()).alias("field_name")
    ).where("field_name <> ''")


def field_profile(cells: DataFrame, headers: DataFrame, bound) -> DataFrame:
    """One row of measures per named column.

    Equal values are merged first (so a column's distinct values spread over the
    cluster), then types, then the column.
    """
    fields = header_fields(cells, headers, bound)
    extent = cells.groupBy(*SHEET).agg(F.max("row_number").alias("max_row"))
    value = effective_value()
    data = (
        attach(cells, headers.select(*SHEET, "header_row"), SHEET, bound, "inner")
        .where("row_number > header_row and cell_type <> 'empty'")
        .select(*COLUMN, "cell_type", "row_number", value.alias("value"),
                (F.coalesce(F.col("formula_expression"), F.lit("")) != "").alias("formula"))
    )
    values = data.groupBy(*COLUMN, "cell_type", "value").agg(
        F.count("*").alias("n"), F.min("row_number").alias("first_row"), F.max("formula").alias("formula")
    )
    number = F.when(F.col("cell_type") == "number", F.col("value").try_cast("double"))
    day = F.when(F.col("cell_type") == "date", F.col("value").try_cast("date"))
    size = F.when(F.col("cell_type") == "string", F.length("value"))
    types = values.groupBy(*COLUMN, "cell_type").agg(
        F.sum("n").alias("n"), F.count("*").alias("distinct_values"), F.min("first_row").alias("first_row"),
        F.max("formula").alias("formula"), F.min(number).alias("low"), F.max(number).alias("high"),
        F.sum(number * F.col("n")).alias("total"), F.sum(F.when(number.isNotNull(), F.col("n"))).alias("numbers"),
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.min(size).alias("shortest"), F.max(size).alias("longest"),
        # Every distinct text is looked at.
        F.max(F.when(F.col("cell_type") == "string", personal_value(F.col("value")))).alias("personal"),
    )
    columns = types.groupBy(*COLUMN).agg(
        F.sum("n").alias("filled_count"),
        F.sum(F.when(F.col("cell_type") != "error", F.col("distinct_values")).otherwise(F.lit(0))).alias("unique_count"),
        F.array_join(F.array_sort(F.collect_set("cell_type")), "|").alias("types_found"),
        F.max_by("cell_type", F.struct(F.col("n"), -F.col("first_row"))).alias("predominant_type"),
        F.count("*").alias("type_count"),
        F.max("formula").alias("has_formula"),
        F.min("low").alias("min"), F.max("high").alias("max"), (F.sum("total") / F.sum("numbers")).alias("mean"),
        F.min("first_day").alias("date_min"), F.max("last_day").alias("date_max"),
        F.min("shortest").alias("text_len_min"), F.max("longest").alias("text_len_max"),
        F.max("personal").alias("personal"),
        F.sum(F.when(F.col("cell_type") == "error", F.col("n")).otherwise(F.lit(0))).alias("error_count"),
    )
    profiled = attach(fields, extent, SHEET, bound, "left").join(columns, COLUMN, "left")
    zero = F.lit(0).cast("bigint")
    filled, unique = F.coalesce("filled_count", zero), F.coalesce("unique_count", zero)
    total = (F.col("max_row") - F.col("header_row")).cast("bigint")
    kind = F.coalesce("predominant_type", F.lit("empty"))
    formula = F.coalesce("has_formula", F.lit(False))
    return profiled.select(
        *SHEET, "header_row", "header_confidence", "column_letters", "field_name",
        kind.alias("predominant_type"), F.coalesce("types_found", F.lit("")).alias("types_found"),
        filled.alias("filled_count"), (total - filled).alias("blank_count"),
        F.when(total > 0, F.round(filled * 100.0 / total, 1)).otherwise(F.lit(0.0)).alias("fill_pct"),
        unique.alias("unique_count"), ((filled > 0) & (unique < filled)).alias("duplicate_flag"),
        formula.alias("has_formula"), ((filled > 1) & (unique == 1)).alias("constant_value_flag"),
        "min", "max", F.round("mean", 4).alias("mean"), "date_min", "date_max", "text_len_min", "text_len_max",
        (F.coalesce("type_count", zero) > 1).alias("mixed_types_flag"),
        F.coalesce("error_count", zero).alias("error_count"),
        ((filled == total) & (filled > 0) & (unique == filled)).alias("candidate_key_flag"),
        ((filled > 0) & (unique > 0) & (unique / F.greatest(filled, F.lit(1)) <= 0.2) & (kind == "string")).alias("candidate_category_flag"),
        (formula & kind.isin("number", "date")).alias("candidate_calculated_flag"),
        F.when(personal_header(F.col("field_name")) | F.coalesce("personal", F.lit(False)), "SIM").otherwise("NAO").alias("potencial_pii"),
    )


def quality_issues(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """Findings about rows, columns and sheets, as one table."""
    rows = cells.groupBy(*SHEET, "row_number").agg(F.max(F.col("cell_type") != "empty").alias("any"))
    empty_rows = rows.where(~F.col("any")).select(
        *SHEET, F.lit("linha_totalmente_vazia_no_meio").alias("issue_type"),
        F.concat(F.lit("row "), F.col("row_number").cast("string")).alias("location"), F.lit("").alias("detail"),
        F.lit("MEDIA").alias("severity"),
    )
    dup = 1 - F.try_divide(F.col("unique_count"), F.col("filled_count"))

    def issue(condition: Column, kind: str, detail: Column, severity: str) -> Column:
        return F.when(
            condition, F.struct(F.lit(kind).alias("issue_type"), detail.alias("detail"), F.lit(severity).alias("severity"))
        )

    found = F.array_compact(
        F.array(
            issue((F.col("blank_count") > 0) & (F.col("filled_count") > 0) & (F.col("fill_pct") < 50), "baixa_cobertura",
                  F.concat(F.lit("fill_pct="), F.col("fill_pct").cast("string")), "BAIXA"),
            issue(F.col("mixed_types_flag"), "tipos_inconsistentes", F.col("types_found"), "MEDIA"),
            issue(F.col("error_count") > 0, "celulas_com_erro",
                  F.concat(F.lit("error_count="), F.col("error_count").cast("string")), "ALTA"),
            issue(F.col("duplicate_flag") & ~F.col("candidate_key_flag") & F.coalesce(dup > 0.3, F.lit(False)),
                  "possivel_duplicidade", F.concat(F.lit("dup_ratio="), F.round(dup, 2).cast("string")), "BAIXA"),
            issue(F.col("constant_value_flag"), "coluna_quase_constante", F.lit(""), "BAIXA"),
        )
    )
    columns = fields.select(
        *SHEET, F.concat_ws("!", "sheet_name", "column_letters").alias("location"), F.explode(found).alias("i")
    ).select(*SHEET, "i.issue_type", "location", "i.detail", "i.severity")
    keyless = fields.groupBy(*SHEET).agg(F.max("candidate_key_flag").alias("key")).where(~F.col("key")).select(
        *SHEET, F.lit("possivel_chave_ausente").alias("issue_type"), F.col("sheet_name").alias("location"),
        F.lit("").alias("detail"), F.lit("MEDIA").alias("severity"),
    )
    return empty_rows.unionByName(columns).unionByName(keyless)


def sheet_inventory(cells: DataFrame, headers: DataFrame, bound, sheets: DataFrame | None = None) -> DataFrame:
    """Size and content counts per sheet, with the parsed sheet properties when given."""
    counts = cells.groupBy(*SHEET).agg(
        F.max("row_number").alias("n_rows"), F.max("column_index").alias("n_cols"),
        F.count_if(F.col("cell_type") != "empty").alias("filled_cells"),
        F.count_if(F.coalesce(F.col("formula_expression"), F.lit("")) != "").alias("formula_cells"),
        F.count_if(F.col("cell_type") == "error").alias("error_cells"),
    )
    found = attach(counts, headers, SHEET, bound)
    if sheets is None:
        return found
    parsed = sheets.drop("n_rows", "n_cols").join(found, SHEET, "left")
    return parsed.na.fill(0, ["filled_cells", "formula_cells", "error_cells"])


def hidden_content(workbooks: DataFrame, sheets: DataFrame) -> DataFrame:
    """Hidden sheets, rows, columns and names, and external links."""
    def rows(df, kind, location, detail=F.lit("")):
        return df.select("workbook_id", kind.alias("type"), location.alias("location"), detail.alias("detail"))

    hidden = sheets.where("visibility <> 'visible'")
    found = rows(hidden, F.concat(F.col("visibility"), F.lit("_sheet")), F.col("sheet_name"))
    for column, kind, mark in (("hidden_rows", "hidden_row", "!row"), ("hidden_cols", "hidden_col", "!col")):
        each = sheets.select("workbook_id", "sheet_name", F.explode(column).alias("i"))
        found = found.unionByName(
            rows(each, F.lit(kind), F.concat(F.col("sheet_name"), F.lit(mark), F.col("i").cast("string")))
        )
    names = workbooks.select("workbook_id", F.inline("hidden_names"))
    found = found.unionByName(rows(names, F.lit("hidden_defined_name"), F.col("name"), F.col("value")))
    links = workbooks.where("has_external_links")
    return found.unionByName(rows(links, F.lit("external_link"), F.lit("xl/externalLinks")))
