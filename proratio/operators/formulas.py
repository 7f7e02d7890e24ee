"""Formula audit over cell tables: patterns, dependencies, written numbers, deviations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proratio.functions.formulas import literal_role, literals, needs_explanation, pattern, sheet_references
from proratio.functions.text import effective_value, entity_id
from proratio.operators.profiling import COLUMN, SHEET
from proratio.session import attach, stage

# Rows of a column looked at together when runs are found; longer columns are cut
# into blocks of row numbers and the runs joined over the cuts.
BLOCK_ROWS = 50_000


def formula_cells(cells: DataFrame) -> DataFrame:
    formula = F.col("formula_expression")
    return cells.where(formula.isNotNull() & (formula != ""))


def position(row="row_number", column="column_index"):
    """Place of a cell in reading order as one number (a sheet has under 2**14 columns)."""
    return F.col(row).cast("bigint") * 16384 + F.col(column)


def cell_at(place):
    """The reference of a place made by ``position``."""
    row, index = F.floor(place / 16384), place % 16384
    return F.concat(column_letters(index), row.cast("string"))


def column_letters(index):
    """1 -> A, 27 -> AA, up to three letters."""
    def letter(n):
        return F.chr(n + 65)

    n = index - 1
    one = letter(n % 26)
    two = F.concat(letter(F.floor(n / 26) - 1), one)
    three = F.concat(letter(F.floor((n - 26) / 676) - 1), letter(F.floor((n - 26) / 26) % 26), one)
    return F.when(index <= 26, one).when(index <= 702, two).otherwise(three)


def formula_inventory(cells: DataFrame) -> DataFrame:
    """One row per sheet and formula pattern."""
    formula = F.col("formula_expression")
    used = formula_cells(cells).select(
        *SHEET, pattern(formula).alias("pattern"), F.array_sort(F.array_distinct(sheet_references(formula))).alias("refs"),
        "row_number", "column_index", position().alias("place"), F.contains(formula, F.lit("#REF!")).alias("broken"),
    )
    # Few distinct reference lists per pattern: they are merged after the cells are counted.
    merged = used.groupBy(*SHEET, "pattern", "refs").agg(
        F.count("*").alias("n"), F.min("place").alias("place"), F.min("row_number").alias("r1"), F.max("row_number").alias("r2"),
        F.min("column_index").alias("c1"), F.max("column_index").alias("c2"), F.count_if("broken").alias("broken"),
    )
    groups = merged.groupBy(*SHEET, "pattern").agg(
        F.sum("n").alias("occurrences"), F.min("place").alias("place"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("refs")))), "|").alias("refs_other_sheets"),
        (F.min("r1") != F.max("r2")).alias("rows"), (F.min("c1") != F.max("c2")).alias("cols"), F.sum("broken").alias("broken"),
    )
    p = F.col("pattern")
    return groups.select(
        *SHEET, "pattern", "occurrences", cell_at(F.col("place")).alias("example_cell"), "refs_other_sheets",
        F.contains(p, F.lit("$")).alias("has_absolute_ref"), p.rlike(r"(?<!\$)[A-Z]{1,3}#").alias("has_relative_ref"),
        F.when(F.col("rows") & F.col("cols"), "mixed").when(F.col("rows"), "vertical").when(F.col("cols"), "horizontal")
        .otherwise("single").alias("direction"),
        F.when(F.contains(p, F.lit("#REF!")), F.col("occurrences")).otherwise(F.col("broken")).alias("broken_count"),
    )


def dependency_edges(cells: DataFrame) -> DataFrame:
    """How often each sheet's formulas name each other sheet."""
    targets = formula_cells(cells).select(
        *SHEET, F.explode(sheet_references(F.col("formula_expression"))).alias("target_sheet")
    )
    return targets.where("target_sheet <> '' and target_sheet <> sheet_name").groupBy(
        "workbook_id", F.col("sheet_name").alias("source_sheet"), "target_sheet"
    ).agg(F.count("*").alias("reference_count"))


def embedded_parameters(cells: DataFrame) -> DataFrame:
    """Numbers written into formulas, once per sheet, pattern and number, at their first cell.

    The id is made from that key, so it does not depend on how a sheet is read.
    """
    formula = F.col("formula_expression")
    found = formula_cells(cells).select(
        *SHEET, pattern(formula).alias("pattern"), F.explode(literals(formula)).alias("literal"), position().alias("place"),
        formula.alias("formula"),
    )
    key = [*SHEET, "pattern", "literal"]
    first = found.groupBy(*key).agg(F.min("place").alias("place"), F.min_by("formula", "place").alias("formula"))
    return first.select(
        entity_id(*key).alias("parameter_id"), *SHEET, cell_at(F.col("place")).alias("location"),
        F.col("literal").alias("value_or_expression"), F.col("formula").alias("used_by"),
        literal_role(F.col("literal"), F.col("formula")).alias("possible_role"),
        F.lit("HARDCODED_FORMULA").alias("origin_type"), F.lit("LOW").alias("confidence"),
        needs_explanation(F.col("literal"), F.col("formula")).alias("requires_human_explanation"),
    )


def signature():
    """What a cell is to its column: a formula pattern, a typed value, or nothing."""
    value = effective_value()
    return (
        F.when(F.coalesce(F.col("formula_expression"), F.lit("")) != "",
               F.struct(F.lit("formula").alias("kind"), pattern(F.col("formula_expression")).alias("detail")))
        .when(F.col("cell_type").isin("number", "string", "date") & (F.coalesce(value, F.lit("")) != ""),
              F.struct(F.lit("manual_value").alias("kind"), F.col("cell_type").alias("detail")))
        .otherwise(F.struct(F.lit("empty").alias("kind"), F.lit(None).cast("string").alias("detail")))
    )


def consistency_flags(cells: DataFrame, bound, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Runs of cells that deviate from their column's formula.

    A column counts if it has a formula shared by five cells or more that no other
    signature outnumbers. ``bound`` proves the number of columns.
    """
    signed = cells.select(*COLUMN, "row_number", signature().alias("s")).select(*COLUMN, "row_number", "s.kind", "s.detail")
    return deviating_runs(signed, COLUMN, bound, block_rows)


def deviating_runs(signed: DataFrame, keys: list[str], bound, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Gaps and islands of deviation, for columns of any length.

    Rows are cut into blocks of row numbers. Runs are numbered inside a block and
    described by one row each; only a block's first and last run can go on in its
    neighbours, and those are chained over one row per block.
    """
    counts = signed.groupBy(*keys, "kind", "detail").agg(F.count("*").alias("n"), F.min("row_number").alias("first_row"))
    major = counts.groupBy(*keys).agg(
        F.max(F.struct("n", (-F.col("first_row")).alias("o"), "kind", "detail")).alias("m")
    ).where("m.kind = 'formula' and m.n >= 5").select(*keys, F.col("m.detail").alias("major"))

    block = F.floor(F.col("row_number") / block_rows).alias("block")
    seen = attach(signed.select("*", block), major, keys, bound, "inner").withColumn(
        "off", ~((F.col("kind") == "formula") & (F.col("detail") == F.col("major")))
    )
    inside = Window.partitionBy(*keys, "block").orderBy("row_number")
    before = F.lag("off").over(inside)
    starts = F.col("off") & ~F.coalesce(before, F.lit(False))
    numbered = seen.withColumn("run", F.sum(starts.cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # One row per run and signature: stored, since the chain and the runs both read it.
    pieces = stage(
        numbered.groupBy(*keys, "block", "off", "run", "kind", "detail").agg(
            F.count("*").alias("n"), F.min("row_number").alias("lo"), F.max("row_number").alias("hi")
        )
    )
    runs = pieces.where("off").groupBy(*keys, "block", "run").agg(F.min("lo").alias("start"), F.max("hi").alias("end"))
    edges = pieces.groupBy(*keys, "block").agg(
        F.min("off").alias("all_off"), F.min("lo").alias("block_lo"), F.max("hi").alias("block_hi")
    ).join(
        runs.groupBy(*keys, "block").agg(
            F.min("start").alias("first_start"), F.max("start").alias("last_start"), F.max("end").alias("last_end")
        ),
        [*keys, "block"], "left",
    )
    along = Window.partitionBy(*keys).orderBy("block")
    opens = F.coalesce(F.col("first_start") == F.col("block_lo"), F.lit(False))
    closes = F.coalesce(F.col("last_end") == F.col("block_hi"), F.lit(False))
    linked = edges.withColumn("goes_on", opens & F.coalesce(F.lag(closes).over(along), F.lit(False)))
    # A block that deviates throughout and goes on passes the run's start along.
    source = F.when(~(F.col("all_off") & F.col("goes_on")), F.col("last_start"))
    chain = linked.withColumn(
        "came_from", F.last(source, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    ).where("goes_on").select(*keys, "block", F.col("block_lo").alias("start"), "came_from")

    placed = (
        pieces.where("off").join(runs.drop("end"), [*keys, "block", "run"])
        .join(chain, [*keys, "block", "start"], "left")
        .withColumn("start", F.coalesce("came_from", "start"))
    )
    whole = placed.groupBy(*keys, "start", "kind", "detail").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    at_start = F.col("lo") == F.col("start")
    found = whole.groupBy(*keys, "start").agg(
        F.max("hi").alias("end"), F.max(F.when(at_start, F.struct("n", "kind", "detail"))).alias("s")
    )
    return found.select(
        *keys, F.concat(F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("row_range"),
        F.col("s.n").alias("affected_cells"), F.lit("formula").alias("majority_pattern_kind"),
        F.col("s.kind").alias("deviation_kind"), F.coalesce("s.detail", F.lit("")).alias("deviation_detail"),
        F.when(F.col("s.kind") == "manual_value", "POSSIBLE_MANUAL_OVERRIDE")
        .when(F.col("s.kind") == "formula", "POSSIBLE_ERROR_OR_VARIANT_FORMULA").otherwise("UNKNOWN").alias("classification_hint"),
    )
