"""Lineage as a graph: one edge table, walked a narrow join a level.

An edge leads from something (its kind and id) to what it was made from. A walk starts
from any entities and follows edges for a bounded number of levels; what has no edge
stays where it is. Only kinds and ids travel, whatever the entities hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proratio.functions.text import packed, unpacked
from proratio.operators import promotion
from proratio.session import attach, fits, stage

EDGE = ["kind", "id", "source_kind", "source_id"]
CELL = "raw.cells"
#: Which mapped field of a row makes the value of a candidate.
VALUE_FIELD = {"price_output_candidates": "price_value", "calibration_candidates": "factor_value"}
CATEGORY = {"price_output_candidates": "price_output", "calibration_candidates": "calibration"}
#: Ends a column may have for its cells to be looked for one by one.
THIN = 1000


def place_id(*columns) -> Column:
    """Id of a place: workbook, sheet, and row or cell."""
    return F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])


def _edges(rows: DataFrame, kind: str, id_: Column, source_kind: str, source: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), id_.alias("id"), F.lit(source_kind).alias("source_kind"), source.alias("source_id"))


def _where() -> Column:
    """Row or cell of a candidate, told apart."""
    return F.coalesce(F.col("source_cell_ref"), F.col("source_row").cast("string"))


def edges(tables: dict[str, DataFrame], mapping: DataFrame, bound) -> DataFrame:
    """Edges from imported prices, parameters and factors to their candidates, and from those to cells.

    ``tables`` are the staged candidates; ``mapping`` the entries they were staged by
    (``workbook_id, sheet_name, category, extraction, columns``), at most ``bound`` of them.
    An edge comes once: each part has a kind of its own, and prices a row per id.
    """
    units = promotion.units(tables["unit_candidates"])
    prices = promotion.prices(tables["price_output_candidates"], units)
    parameters = promotion.parameters(tables["parameter_candidates"])
    factors = promotion.calibration_entries(tables["calibration_candidates"])
    found = _edges(prices, "pricing.unit_price_results", F.col("id"), "staging.price_output_candidates", place_id("workbook_id", "sheet_name", "source_row"))
    found = found.unionByName(_edges(
        parameters, "pricing.parameters", F.col("id"), "staging.parameter_candidates", place_id("workbook_id", "sheet_name", "source_cell_ref")).distinct())
    found = found.unionByName(_edges(
        factors, "pricing.calibration_entries", F.col("id"), "staging.calibration_candidates", place_id("workbook_id", "sheet_name", _where())).distinct())
    ref = tables["parameter_candidates"].where("source_cell_ref is not null")
    at = place_id("workbook_id", "sheet_name", "source_cell_ref")
    found = found.unionByName(_edges(ref, "staging.parameter_candidates", at, CELL, at).distinct())
    for name, field in VALUE_FIELD.items():
        letters = mapping.where((F.col("extraction") == "row_range") & (F.col("category") == CATEGORY[name])).select(
            "workbook_id", "sheet_name", F.col("columns")[field].alias("_letters")).where("_letters is not null")
        rows = tables[name] if "source_cell_ref" in tables[name].columns else tables[name].withColumn("source_cell_ref", F.lit(None).cast("string"))
        rows = attach(rows, letters.groupBy("workbook_id", "sheet_name").agg(F.min("_letters").alias("_letters")), ["workbook_id", "sheet_name"], bound)
        cell = F.coalesce(F.col("source_cell_ref"), F.concat("_letters", F.col("source_row").cast("string")))
        found = found.unionByName(_edges(
            rows, f"staging.{name}", place_id("workbook_id", "sheet_name", _where()), CELL, place_id("workbook_id", "sheet_name", cell)).distinct())
    return found


def walk(starts: DataFrame, graph: DataFrame, levels: int) -> DataFrame:
    """(start_kind, start_id, kind, id): where ``levels`` steps along ``graph`` lead from ``starts`` (kind, id).

    Several edges of one thing lead to several rows; what has none stays. ``graph`` should be
    stored: its kinds are listed first, so that a level joins edges of kinds it can be at alone.
    """
    kinds = graph.select("kind", "source_kind").distinct().collect()
    at = {r["kind"] for r in starts.select("kind").distinct().collect()}
    here = starts.select(F.col("kind").alias("start_kind"), F.col("id").alias("start_id"), "kind", "id")
    for _ in range(levels):
        step = here.join(graph.where(F.col("kind").isin(sorted(k for k in at if k is not None))), ["id", "kind"], "left")
        # What stays has no edges at any level.
        at = {r["source_kind"] for r in kinds if r["kind"] in at}
        here = step.select("start_kind", "start_id", F.coalesce("source_kind", "kind").alias("kind"), F.coalesce("source_id", "id").alias("id"))
    return here


def reached(values: DataFrame, ends: DataFrame) -> DataFrame:
    """The rows of ``values`` that can be an end by its ``id``: of columns with many ends all cells, of others the ends alone.

    A column is a place without its last digits. Where columns are too many to be sent to the cells, all are kept.
    """
    column = F.regexp_replace("id", "[0-9]+$", "").alias("_column")
    counts = stage(ends.groupBy(column).agg(F.count(F.lit(1)).alias("_n")))
    if not fits(counts):
        return values
    thin = stage(ends.select("id", column).join(F.broadcast(counts.where(F.col("_n") <= THIN)), "_column").select("id").distinct())
    if not fits(thin):
        return values
    wide = F.broadcast(counts.where(F.col("_n") > THIN).select("_column", F.lit(True).alias("_wide")))
    one = F.broadcast(thin.withColumn("_one", F.lit(True)))
    kept = values.withColumn("_column", column).join(wide, "_column", "left").join(one, "id", "left").where(F.col("_wide") | F.col("_one"))
    return kept.select(*values.columns)


def to_cells(tables: dict[str, DataFrame], mapping: DataFrame, cells: DataFrame, bound) -> DataFrame:
    """The cell of every imported price, parameter and factor, with the value that stands there."""
    graph = stage(edges(tables, mapping, bound))
    # Ids are shuffled three times on the way.
    graph = graph.withColumns({c: packed(F.col(c)) for c in ("id", "source_id")})
    starts = graph.where(F.col("kind").startswith("pricing.")).select("kind", "id").distinct()
    ends = walk(starts, graph, 2).where(F.col("kind") == CELL)
    ends = stage(ends.select("start_kind", unpacked(F.col("start_id")).alias("start_id"), unpacked(F.col("id")).alias("id")))
    values = cells.select(place_id("workbook_id", "sheet_name", "cell_ref").alias("id"), F.coalesce("raw_value", "cached_value").alias("value"))
    values = reached(values, ends)
    # Places begin alike; sorted by a hash first, two of them are seldom compared in full.
    near = F.xxhash64("id").alias("_near")
    ends, values = ends.select("start_kind", packed(F.col("start_id")).alias("start_id"), "id", near), values.select("*", near)
    return ends.join(values, ["_near", "id"], "left").select("start_kind", unpacked(F.col("start_id")).alias("start_id"), F.col("id").alias("cell"), "value")
