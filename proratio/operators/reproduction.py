"""Reproduction check: computed prices against imported ones.

``calculation_inputs`` and the rule graph never see a price; only ``compare``
reads the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proratio.functions.text import column_index, effective_value, numeric_or_null, zero_if_blank
from proratio.session import attach, fits

PRICE = "decimal(18,2)"


def calculation_inputs(units: DataFrame, cells: DataFrame, parameters: DataFrame, *, balcony: str, ancillary: str,
                       override: str, confirmed: list, implicit_tower: dict, bound) -> DataFrame:
    """Unit records for the rule graph, from units and three columns of their own sheet and row.

    ``units`` carries ``unit_id, group_id, workbook_id, sheet_name, source_row`` and
    its areas; ``parameters`` carries ``group_id, key, numeric_value``. The two area
    columns count only for the ``confirmed`` groups.
    """
    wanted = cells.where(F.col("column_letters").isin(balcony, ancillary, override)).select(
        "workbook_id", "sheet_name", F.col("row_number").alias("source_row"), "column_letters",
        effective_value().alias("value"),
    )
    place = ["workbook_id", "sheet_name", "source_row"]
    wide = wanted.groupBy(*place).agg(
        *[F.max(F.when(F.col("column_letters") == c, F.col("value"))).alias(n)
          for n, c in (("h", balcony), ("i", ancillary), ("o", override))]
    )
    values = parameters.groupBy("group_id").agg(
        F.max(F.when(F.col("key") == "UNCOVERED_AREA_FACTOR", F.col("numeric_value"))).alias("UNCOVERED_AREA_FACTOR"),
        F.max(F.when(F.col("key") == "TARGET_PRICE_PER_M2", F.col("numeric_value"))).alias("TARGET_PRICE_PER_M2"),
    )
    open_ = F.col("group_id").isin(confirmed) if confirmed else F.lit(False)
    tower = F.when(F.col("tower_key") != "", F.col("tower_key"))
    if implicit_tower:
        pairs = [F.lit(v) for pair in implicit_tower.items() for v in pair]
        tower = F.coalesce(tower, F.try_element_at(F.create_map(*pairs), F.col("group_id")))

    def unread(c):
        return (open_ & (F.col(c) != "") & numeric_or_null(F.col(c)).isNull()).cast("int")

    joined = attach(units.join(wide, place, "left"), values, "group_id", bound)
    return (
        joined.withColumn("balcony_area_derived", F.when(open_, numeric_or_null(F.col("h"))))
        .withColumn("ancillary_area_derived", F.when(open_, numeric_or_null(F.col("i"))))
        .withColumn("override_amount_derived", zero_if_blank(F.col("o")))
        .withColumn("tower_key_raw", tower)
        .withColumn("non_numeric_areas", F.coalesce(unread("h"), F.lit(0)) + F.coalesce(unread("i"), F.lit(0)))
        .drop("h", "i", "o")
    )


def parameter_values(parameters: DataFrame, parameter_sets: DataFrame, scenarios: DataFrame, bound) -> DataFrame:
    """Stored parameters with the development their set and scenario belong to."""
    return _in_development(parameters, "parameter_set_id", parameter_sets, scenarios, bound).select(
        "development_id", "key", "numeric_value"
    )


def calibration_table(entries: DataFrame, calibration_sets: DataFrame, scenarios: DataFrame, code: str, bound) -> DataFrame:
    """Stored entries of one calibration set code, as the lookup table of each development."""
    sets = calibration_sets.where(F.col("code") == code)
    return _in_development(entries, "calibration_set_id", sets, scenarios, bound).select(
        F.col("development_id").alias("group_id"), "category_key", "factor"
    )


def _in_development(rows: DataFrame, key: str, sets: DataFrame, scenarios: DataFrame, bound) -> DataFrame:
    owners = attach(
        sets.select(F.col("id").alias(key), "scenario_id"),
        scenarios.select(F.col("id").alias("scenario_id"), "development_id"), "scenario_id", bound, "inner",
    ).drop("scenario_id")
    return attach(rows.drop("development_id"), owners, key, sets, "inner")


def units_with_towers(units: DataFrame, towers: DataFrame) -> DataFrame:
    """Stored units, with the sheet and row they came from and their tower's key, if they have one."""
    keys = towers.select(F.col("id").alias("tower_id"), F.col("business_key").alias("tower_key"))
    return attach(units, keys, "tower_id", towers)


# Fixed value: the shape of the lookup formula a calibration grid is read from.
GRID_FORMULA = (
    r"HLOOKUP\([^,]+,\s*'?([^'!]+)'?!\$([A-Z]+)\$(\d+):\$([A-Z]+)\$(\d+)\s*,\s*'?([^'!]+)'?!\$([A-Z]+)\$(\d+)"
)


def grid_from_formula(cells: DataFrame, formulas: DataFrame, bound) -> DataFrame:
    """Lookup tables read out of the formulas that use them.

    ``formulas`` carries ``workbook_id, sheet_name, cell_ref`` of one formula per
    table. Its text names the range and the cell that holds the row index; the
    range's first row gives the keys and row ``first + index - 1`` the factors.
    """
    def part(i):
        return F.regexp_extract("formula_expression", GRID_FORMULA, i)

    few = fits(bound)

    def meet(big, small, keys):
        """Cells by place: a key is a cell or a row of one sheet, so none holds many cells and nothing is salted."""
        return big.join(F.broadcast(small) if few else small, keys)

    # Only cells with such a formula are looked up among the formulas.
    found = (
        meet(cells.where(F.col("formula_expression").rlike(GRID_FORMULA)), formulas.select("workbook_id", "sheet_name", "cell_ref"),
             ["workbook_id", "sheet_name", "cell_ref"])
        .select(
            "workbook_id", F.col("sheet_name").alias("formula_sheet"), F.col("cell_ref").alias("formula_cell"),
            part(1).alias("range_sheet"), part(2).alias("first_col"), part(3).cast("int").alias("first_row"),
            part(4).alias("last_col"), part(6).alias("index_sheet"), F.concat(part(7), part(8)).alias("index_cell"),
        )
    )
    value = effective_value().alias("value")
    index = cells.select(
        "workbook_id", F.col("sheet_name").alias("index_sheet"), F.col("cell_ref").alias("index_cell"),
        value.try_cast("double").cast("int").alias("row_index"),
    )
    located = meet(index, found, ["workbook_id", "index_sheet", "index_cell"]).where("row_index is not null")
    # The two rows of its range that a grid is read from (one, if they are the same) are part of the key.
    grids = located.withColumn("factor_row", F.col("first_row") + F.col("row_index") - 1).withColumn(
        "row_number", F.explode(F.array_distinct(F.array("first_row", "factor_row")))
    )
    grid_cells = cells.select(
        "workbook_id", F.col("sheet_name").alias("range_sheet"), "row_number", "column_letters", "column_index", value
    )
    inside = meet(grid_cells, grids, ["workbook_id", "range_sheet", "row_number"]).where(
        F.col("column_index").between(column_index(F.col("first_col")), column_index(F.col("last_col")))
    )
    keys = ["workbook_id", "formula_sheet", "formula_cell", "column_letters"]
    header = F.col("row_number") == F.col("first_row")
    return (
        inside.groupBy(*keys)
        .agg(
            F.max(F.when(header, F.col("value"))).alias("category_key"),
            F.max(F.when(~header | (F.col("factor_row") == F.col("first_row")), F.col("value"))).alias("factor"),
        )
        .where("category_key <> '' and factor <> ''")
    )


def with_variants(units: DataFrame, variants: list[str], forced_key: str, forced: Column) -> DataFrame:
    """Each unit once per variant; the first variant forces a lookup key on the rows ``forced`` marks."""
    rows = F.array(*[F.lit(v) for v in variants])
    return units.withColumn("variant", F.explode(rows)).withColumn(
        "forced_key", F.when((F.col("variant") == variants[0]) & forced, F.lit(forced_key))
    )


def classify(delta: Column, percent: Column) -> Column:
    """Match class of a price difference, taken at six places."""
    size = F.abs(delta)
    return (
        F.when(delta.isNull(), "BLOCKED")
        .when(delta == 0, "EXACT")
        .when(size <= F.lit("0.01").cast("decimal(3,2)"), "WITHIN_1_CENT")
        .when(size <= F.lit("1.00").cast("decimal(3,2)"), "WITHIN_1_REAL")
        .when(F.coalesce(F.abs(percent) <= F.lit("0.0001").cast("decimal(5,4)"), F.lit(False)), "WITHIN_0_01_PERCENT")
        .otherwise("DIVERGENT")
    )


def compare(reproduced: DataFrame, reference: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Reproduced against reference price per unit, stored at cents. ``carry`` names more columns of ``reproduced`` to keep.

    The class is taken from the unrounded difference, so a stored difference of
    0.00 may be WITHIN_1_CENT. A unit without a reference stays, BLOCKED.
    """
    joined = reproduced.join(reference.select("unit_id", "source_reference_price", "imported_run_id"), "unit_id", "left")
    price = F.col("unit_price")
    delta = F.round(price - F.col("source_reference_price"), 6).cast("decimal(24,6)")
    percent = F.round(F.try_divide(delta, F.col("source_reference_price")), 6).cast("decimal(18,6)")
    raw_percent = F.try_divide(delta, F.col("source_reference_price"))
    kind = classify(delta, raw_percent)
    stored = F.round(price, 2).cast(PRICE)
    return joined.select(
        "development_id", *carry, "unit_id", "imported_run_id", "source_reference_price",
        stored.alias("reproduced_price"),
        (stored - F.col("source_reference_price")).cast(PRICE).alias("delta_absolute"),
        percent.alias("delta_percent"),
        kind.alias("match_classification"),
        F.when(price.isNull(), "MISSING_PARAMETER")
        .when(~kind.isin("EXACT", "WITHIN_1_CENT"), "UNKNOWN")
        .alias("divergence_cause"),
    )


def match_summary(comparisons: DataFrame, *keys: str) -> DataFrame:
    return comparisons.groupBy(*keys, "match_classification").agg(F.count("*").alias("n"))


def development_summary(comparisons: DataFrame) -> DataFrame:
    return comparisons.groupBy("development_id").agg(
        F.count("*").alias("units_total"),
        F.count("reproduced_price").alias("units_calculated"),
        F.count_if(F.col("reproduced_price").isNull()).alias("units_blocked"),
    )


def pending(developments: DataFrame, runs: DataFrame, ruleset_version: str) -> DataFrame:
    """Developments this ruleset version has not completed yet."""
    done = runs.where((F.col("status") == "COMPLETED") & (F.col("ruleset_version") == ruleset_version))
    return developments.join(done.select("development_id"), "development_id", "left_anti")


def trail(evaluated: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """One row per unit and rule value that exists."""
    rows = F.array(
        *[F.struct(F.lit(kind).alias("adjustment_type"), F.col(c).cast("decimal(18,6)").alias("result_value")) for c, kind in steps]
    )
    return evaluated.select("group_id", "unit_id", "ordinal", F.inline(rows)).where("result_value is not null")
