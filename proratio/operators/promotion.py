"""Staged candidates to canonical tables, with lineage.

Nothing is updated in place. Ids come from business keys, so promoting again
finds every row already there; what was promoted is a join, not a flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proratio.functions.text import blank, development_key, entity_id, least_id, packed, typed_value, unpacked
from proratio.session import attach, stage

SCENARIO = "IMPORTED_REFERENCE"
PARAMETER_SET = "IMPORTED_PARAMETERS"
RUN = "IMPORTED_REFERENCE_RUN"
ORIGIN = "IMPORTED_REFERENCE"
DEFAULT_DIMENSION = "CALIBRATION"


class PromotionError(RuntimeError):
    """A batch that must not be promoted; nothing of it is written."""


def eligible(candidates: DataFrame) -> DataFrame:
    return candidates.where("mapping_confidence = 'HIGH' and mapping_status = 'CANDIDATE'")


def development_id(key: str = "development") -> Column:
    return entity_id(F.lit("core.developments"), key)


def scenario_id(key: str = "development") -> Column:
    return entity_id(F.lit("pricing.scenarios"), key, F.lit(SCENARIO))


def run_id(key: str = "development") -> Column:
    return entity_id(F.lit("pricing.runs"), key, F.lit(RUN))


def owned(candidates: DataFrame) -> DataFrame:
    """Candidates with the development their workbook stands for."""
    return eligible(candidates).withColumn("development", development_key(F.col("workbook_id")))


def duplicate_units(candidates: DataFrame) -> DataFrame:
    """Units named twice in a workbook; a missing tower counts as the empty one."""
    return (
        eligible(candidates)
        .groupBy("workbook_id", F.coalesce("tower_ref", F.lit("")).alias("tower_ref"), "unit_ref")
        .agg(F.count("*").alias("n")).where("n > 1")
    )


def require_unique(candidates: DataFrame) -> None:
    """Run before anything is written: one duplicate fails the whole promotion."""
    found = duplicate_units(candidates).limit(1).collect()
    if found:
        raise PromotionError(f"unit {found[0]['tower_ref']}/{found[0]['unit_ref']} appears {found[0]['n']} times")


def new_rows(rows: DataFrame, existing: DataFrame | None, key: str = "id") -> DataFrame:
    """Rows not stored yet."""
    return rows if existing is None else rows.join(existing.select(key), key, "left_anti")


def developments(workbooks: DataFrame) -> DataFrame:
    """Development, data source, scenario and parameter set of each workbook."""
    keyed = workbooks.select("workbook_id").distinct().withColumn("development", development_key(F.col("workbook_id")))
    return keyed.select(
        development_id().alias("id"), F.col("development").alias("business_key"),
        entity_id(F.lit("audit.data_sources"), "development").alias("data_source_id"), scenario_id().alias("scenario_id"),
        entity_id(F.lit("pricing.parameter_sets"), scenario_id(), F.lit(PARAMETER_SET)).alias("parameter_set_id"),
    )


def _keyed(workbooks: DataFrame) -> DataFrame:
    return workbooks.select("workbook_id").distinct().withColumn("development", development_key(F.col("workbook_id")))


def data_sources(workbooks: DataFrame) -> DataFrame:
    """The workbook a development's rows come from, as a source."""
    return _keyed(workbooks).select(
        entity_id(F.lit("audit.data_sources"), "development").alias("id"), F.col("development").alias("code"),
        F.col("workbook_id").alias("name"), F.lit("real").alias("origin_type"), development_id().alias("development_id"),
    )


def scenarios(workbooks: DataFrame) -> DataFrame:
    return _keyed(workbooks).select(
        scenario_id().alias("id"), development_id().alias("development_id"), F.lit(SCENARIO).alias("code"), F.lit("ACTIVE").alias("status")
    )


def parameter_sets(workbooks: DataFrame) -> DataFrame:
    return _keyed(workbooks).select(
        entity_id(F.lit("pricing.parameter_sets"), scenario_id(), F.lit(PARAMETER_SET)).alias("id"), scenario_id().alias("scenario_id"),
        F.lit(PARAMETER_SET).alias("code"), F.lit(1).alias("version"), F.lit("ACTIVE").alias("status"), development_id().alias("development_id"),
    )


def runs(workbooks: DataFrame) -> DataFrame:
    """The run that imported prices hang on."""
    return _keyed(workbooks).select(
        run_id().alias("id"), scenario_id().alias("scenario_id"),
        entity_id(F.lit("pricing.parameter_sets"), scenario_id(), F.lit(PARAMETER_SET)).alias("parameter_set_id"),
        F.lit(RUN).alias("code"), F.lit("COMPLETED").alias("status"), F.lit("IMPORTED_REFERENCE_RUN").alias("run_type"),
        development_id().alias("development_id"),
    )


def calibration_sets(candidates: DataFrame) -> DataFrame:
    """One set per development and dimension that has an entry."""
    dims = _calibrations(candidates).select("development", "dimension").distinct()
    return dims.select(
        _calibration_set().alias("id"), scenario_id().alias("scenario_id"), F.col("dimension").alias("code"), "dimension",
        F.lit(1).alias("version"), F.lit("ACTIVE").alias("status"), development_id().alias("development_id"),
    )


def run_calibration_sets(candidates: DataFrame) -> DataFrame:
    """Which sets the imported run of a development used: all it has."""
    dims = _calibrations(candidates).select("development", "dimension").distinct()
    return dims.select(
        entity_id(F.lit("pricing.run_calibration_sets"), run_id(), _calibration_set()).alias("id"), run_id().alias("run_id"),
        _calibration_set().alias("calibration_set_id"), development_id().alias("development_id"),
    )


def candidate_entities(unit_rows: DataFrame) -> DataFrame:
    """Which candidate became which unit, by workbook, sheet and row."""
    return unit_rows.select(
        entity_id(F.lit("audit.candidate_entities"), "workbook_id", "sheet_name", "source_row", "id").alias("id"), "workbook_id", "sheet_name",
        "source_row", F.lit("core.units").alias("entity_table"), F.col("id").alias("entity_id"), "development_id",
    )


def candidate_state(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates with the entity they became, or PENDING."""
    place = ["workbook_id", "sheet_name", "source_row"]
    return candidates.join(links.select(*place, "entity_id"), place, "left").withColumn(
        "state", F.when(F.col("entity_id").isNotNull(), "PROMOTED").otherwise("PENDING"))


def _calibrations(candidates: DataFrame) -> DataFrame:
    filled = owned(candidates).where(~blank(F.col("category_key_guess")) & F.col("factor_value").isNotNull())
    return filled.withColumn("dimension", F.coalesce(F.when(F.col("dimension_guess") != "", F.col("dimension_guess")), F.lit(DEFAULT_DIMENSION)))


def _calibration_set() -> Column:
    return entity_id(F.lit("pricing.calibration_sets"), scenario_id(), "dimension", F.lit("1"))


def _labels(candidates: DataFrame, column: str, table: str) -> DataFrame:
    named = owned(candidates).where(F.col(column) != "").select("development", column).distinct()
    return named.select(
        entity_id(F.lit(table), "development", column).alias("id"), development_id().alias("development_id"),
        F.col(column).alias("business_key"),
    )


def towers(candidates: DataFrame) -> DataFrame:
    return _labels(candidates, "tower_ref", "core.towers")


def typologies(candidates: DataFrame) -> DataFrame:
    return _labels(candidates, "typology_ref", "core.unit_typologies").withColumn(
        "classification", F.lit("OFFICIAL_TYPOLOGY")
    )


def units(candidates: DataFrame) -> DataFrame:
    """Canonical units, with the sheet and row they came from. A missing area counts as 0; the floor is not carried over."""
    def label(column, table):
        return F.when(F.col(column) != "", entity_id(F.lit(table), "development", column))

    area = "decimal(9,2)"
    zero = F.lit(0)
    return owned(candidates).select(
        entity_id(F.lit("core.units"), "development", "tower_ref", "unit_ref").alias("id"),
        development_id().alias("development_id"), label("tower_ref", "core.towers").alias("tower_id"),
        label("typology_ref", "core.unit_typologies").alias("unit_typology_id"), F.col("unit_ref").alias("unit_code"),
        F.col("position_ref").alias("position_code"),
        F.round(F.coalesce("private_area", zero), 2).cast(area).alias("closed_area_m2"),
        F.round(F.coalesce("uncovered_area", zero), 2).cast(area).alias("open_terrace_area_m2"),
        "workbook_id", "sheet_name", "source_row",
    )


def parameters(candidates: DataFrame) -> DataFrame:
    """Parameters with a value, in the column of their type."""
    filled = owned(candidates).where(~blank(F.col("value_text")))
    return filled.withColumn("v", typed_value(F.col("value_text"), F.col("value_type_guess"))).select(
        entity_id(F.lit("pricing.parameters"), "development", "parameter_key_guess").alias("id"),
        entity_id(F.lit("pricing.parameter_sets"), scenario_id(), F.lit(PARAMETER_SET)).alias("parameter_set_id"),
        F.col("parameter_key_guess").alias("key"), "v.*", development_id().alias("development_id"), "workbook_id", "sheet_name", "source_cell_ref",
    )


def calibration_entries(candidates: DataFrame) -> DataFrame:
    """One entry per set and category, the first by sheet and place; later ones stay unpromoted."""
    place = F.struct("workbook_id", "sheet_name", "source_row", "source_cell_ref")
    first = _calibrations(candidates).groupBy("development", "dimension", F.col("category_key_guess").alias("category_key")).agg(
        F.min_by("factor_value", place).alias("factor"), F.min(place).alias("place")
    )
    return first.select(
        entity_id(F.lit("pricing.calibration_entries"), "development", "dimension", "category_key").alias("id"),
        _calibration_set().alias("calibration_set_id"), "dimension", "category_key",
        F.round("factor", 6).cast("decimal(12,6)").alias("factor"), development_id().alias("development_id"), "place.*",
    )


def prices(candidates: DataFrame, unit_rows: DataFrame, ignore_sheet: bool = False) -> DataFrame:
    """Imported prices of promoted units, matched by source row.

    With ``ignore_sheet`` a row number is looked for in the whole workbook and the
    lowest unit id taken, for sources whose prices and units are on two sheets.
    """
    priced = owned(candidates).where("price_value is not null")
    # Rows and hashes come first in a key: they tell rows apart where these are sorted.
    key = ["source_row", "workbook_id"] if ignore_sheet else ["source_row", "workbook_id", "sheet_name"]
    matched = unit_rows.groupBy(*key).agg(least_id(F.col("id")).alias("unit_id"))
    record = F.struct("workbook_id", "sheet_name", "source_row", "price_value", "price_per_m2_value")
    # A unit has one imported price: the first candidate's. Run and development follow from the key.
    first = priced.join(matched, key).groupBy(packed(F.col("unit_id")).alias("unit_id"), "development").agg(F.min(record).alias("p"))
    first = first.withColumn("unit_id", unpacked(F.col("unit_id"))).withColumn("run_id", run_id())
    return first.select(
        entity_id(F.lit("pricing.unit_price_results"), "run_id", "unit_id").alias("id"), "run_id", "unit_id",
        F.col("p.price_value").alias("system_calculated_price"),
        F.col("p.price_per_m2_value").cast("decimal(12,2)").alias("system_calculated_price_per_m2"),
        F.lit(ORIGIN).alias("result_origin"), development_id().alias("development_id"), "p.workbook_id", "p.sheet_name", "p.source_row",
    )


def lineage(entities: dict[str, tuple[DataFrame, str]], sources: DataFrame) -> DataFrame:
    """One row per promoted entity, with the data source of its development: ``{schema.table: (rows, source)}``; rows carry id and development_id.

    ``sources`` has the data source of each development (``id, development_id``).
    """
    result = None
    for name, (rows, source) in entities.items():
        schema, table = name.split(".")
        one = rows.select(
            F.lit(schema).alias("entity_schema"), F.lit(table).alias("entity_table"), F.col("id").alias("entity_id"),
            F.col("development_id"), F.lit(source).alias("derived_from"),
        )
        result = one if result is None else result.unionByName(one)
    known = sources.select("development_id", F.col("id").alias("data_source_id"))
    return attach(result, known, "development_id", known)


def promote(tables: dict[str, DataFrame], workbooks: DataFrame, existing: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All canonical rows of a staged batch that are not stored yet, and their lineage."""
    existing = existing or {}
    require_unique(tables["unit_candidates"])
    found = developments(workbooks)
    all_units = units(tables["unit_candidates"])
    rows = {
        "core.developments": found,
        "core.towers": towers(tables["unit_candidates"]),
        "core.unit_typologies": typologies(tables["unit_candidates"]),
        "core.units": all_units,
        "pricing.parameters": parameters(tables["parameter_candidates"]),
        "pricing.calibration_entries": calibration_entries(tables["calibration_candidates"]),
        # Stored, since the lineage reads them too and every reader would join and add up again.
        "pricing.unit_price_results": stage(prices(tables["price_output_candidates"], all_units)),
        "audit.data_sources": data_sources(workbooks),
        "pricing.scenarios": scenarios(workbooks),
        "pricing.parameter_sets": parameter_sets(workbooks),
        "pricing.calibration_sets": calibration_sets(tables["calibration_candidates"]),
        "pricing.runs": runs(workbooks),
        "pricing.run_calibration_sets": run_calibration_sets(tables["calibration_candidates"]),
        "audit.candidate_entities": candidate_entities(all_units),
    }
    fresh = {name: new_rows(df, existing.get(name)) for name, df in rows.items()}
    sources = {
        "core.developments": "raw.workbooks", "core.units": "staging.unit_candidates",
        "pricing.parameters": "staging.parameter_candidates",
        "pricing.calibration_entries": "staging.calibration_candidates",
        "pricing.unit_price_results": "staging.price_output_candidates",
    }
    traced = {n: (fresh[n] if n != "core.developments" else fresh[n].withColumn("development_id", F.col("id")), s) for n, s in sources.items()}
    fresh["audit.data_lineage"] = lineage(traced, rows["audit.data_sources"])
    return fresh


def summary(tables: dict[str, DataFrame], promoted: dict[str, DataFrame]) -> DataFrame:
    """Per candidate table: all rows, rows that may be promoted, rows that became entities.

    ``promoted`` gives the entity rows per candidate table. Both the eligible
    candidates and the entities are counted, since they can differ.
    """
    result = None
    for name, df in tables.items():
        if name not in promoted:
            continue
        counts = df.agg(
            F.count("*").alias("total"),
            F.count_if((F.col("mapping_confidence") == "HIGH") & (F.col("mapping_status") == "CANDIDATE")).alias("high_candidate"),
        )
        done = promoted[name].agg(F.count("*").alias("promoted"))
        one = counts.join(F.broadcast(done)).select(F.lit(name).alias("candidates"), "total", "high_candidate", "promoted")
        result = one if result is None else result.unionByName(one)
    return result


def pending_by_workbook(tables: dict[str, DataFrame]) -> DataFrame:
    """Eligible candidates per development and table, before anything is promoted."""
    result = None
    for name, df in tables.items():
        if "mapping_status" not in df.columns:
            continue
        one = owned(df).groupBy("development").agg(F.count("*").alias("n")).withColumn("candidates", F.lit(name))
        result = one if result is None else result.unionByName(one)
    return result


def review_counts(review: DataFrame) -> DataFrame:
    return review.groupBy("confidence", "status").agg(F.count("*").alias("n"))
