"""Raw cells to staged candidates, by mapping entries.

Entries are configuration; cells are not. Entries are attached to the cells, so
only mapped cells are shuffled, once, to bring the fields of a row together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proratio.functions.text import blank, effective_value
from proratio.session import attach, fits, stage

SHEET = ["workbook_id", "sheet_name"]
FIELDS = [
    "tower_ref", "unit_ref", "typology_ref", "private_area", "uncovered_area", "floor_ref", "position_ref",
    "category_key_guess", "factor_value", "unit_ref_guess", "price_value", "price_per_m2_value",
]
NUMBERS = {
    "private_area": "decimal(12,4)", "uncovered_area": "decimal(12,4)", "factor_value": "decimal(18,6)",
    "price_value": "decimal(18,2)", "price_per_m2_value": "decimal(18,2)",
}
EXTRACTIONS = ["single_cell", "row_range"]


class MappingError(ValueError):
    """An entry that cannot be carried out."""


def check_mapping(mapping: DataFrame) -> None:
    """Refuse entries whose way of extraction, or a field of which, is not known."""
    wrong = mapping.where(~F.col("extraction").isin(EXTRACTIONS) & (F.col("confidence") == "HIGH")).limit(1).collect()
    if wrong:
        raise MappingError(f"unknown extraction {wrong[0]['extraction']!r}")
    named = mapping.where("confidence = 'HIGH' and extraction = 'row_range'").select("anchor_field", F.explode("columns").alias("field", "column_letters"))
    # A field that only anchors rows needs no column of its own.
    extra = named.where(~F.col("field").isin(FIELDS) & ~F.col("field").eqNullSafe(F.col("anchor_field"))).limit(1).collect()
    if extra:
        raise MappingError(f"unknown field {extra[0]['field']!r}; known are {', '.join(FIELDS)}")


def _row_entries(mapping: DataFrame) -> DataFrame:
    return mapping.where("confidence = 'HIGH' and extraction = 'row_range'")


def mapped_rows(cells: DataFrame, mapping: DataFrame, bound) -> tuple[DataFrame, list[str]]:
    """A row per row of a sheet with mapped cells, ``found`` their values, and the letters these stand under.

    The mapped cells of a sheet's row are brought together once, an array of a value per
    letter, whatever number of entries and fields read them.
    """
    named = _row_entries(mapping).select(*SHEET, F.explode(F.map_values("columns")).alias("column_letters")).where("column_letters is not null").distinct()
    # Configuration: as many as there are columns that the mapping names.
    letters = sorted(r[0] for r in named.select("column_letters").distinct().collect()) or [""]
    mapped = attach(
        cells.select(*SHEET, "row_number", "column_letters", effective_value().alias("value")).where("value is not null"),
        named, [*SHEET, "column_letters"], bound, "left_semi",
    )
    # The row number comes first, since it tells most keys apart where they are sorted.
    found = mapped.groupBy(F.col("row_number").alias("source_row"), *SHEET).agg(
        F.array(*[F.max(F.when(F.col("column_letters") == c, F.col("value"))) for c in letters]).alias("found")
    )
    return found, letters


def entry_rows(found: DataFrame, letters: list[str], mapping: DataFrame, bound) -> DataFrame:
    """One row per entry and row of its sheet where the anchor field is filled; fields are taken from ``found`` by place."""
    def place(field):
        return (F.array_position(F.array(*[F.lit(c) for c in letters]), F.try_element_at("columns", field)) - 1).cast("int")

    places = _row_entries(mapping).select(
        *SHEET, "entry_id", "start_row", "category", "development_ref", "dimension_guess", place(F.col("anchor_field")).alias("_anchor"),
        *[place(F.lit(f)).alias(f"_{f}") for f in FIELDS],
    )
    rows = attach(found, places, SHEET, bound, "inner").where((F.col("source_row") >= F.col("start_row")) & (F.get("found", "_anchor") != ""))
    return rows.select(
        "entry_id", *SHEET, "source_row", *[F.get("found", f"_{f}").alias(f) for f in FIELDS], "category", "development_ref", "dimension_guess"
    )


def extract_rows(cells: DataFrame, mapping: DataFrame, bound) -> DataFrame:
    """One row per mapped data row: every field of the entry, where the anchor field is filled."""
    return entry_rows(*mapped_rows(cells, mapping, bound), mapping, bound)


def extract_cells(cells: DataFrame, mapping: DataFrame, bound) -> DataFrame:
    """Single-cell entries with the raw and effective value of their cell, NULL if there is none."""
    entries = mapping.where("confidence = 'HIGH' and extraction = 'single_cell'")
    key = [*SHEET, "cell_ref"]
    found = attach(
        cells.select(*key, F.col("raw_value").alias("raw"), effective_value().alias("effective")),
        entries.select(*key).distinct(), key, bound, "inner",
    )
    return entries.join(found, key, "left")


def with_marks(df: DataFrame) -> DataFrame:
    return df.withColumn("mapping_confidence", F.lit("HIGH")).withColumn("mapping_status", F.lit("CANDIDATE"))


def _number(name: str):
    return F.col(name).try_cast(NUMBERS[name]).alias(name)


def unit_candidates(rows: DataFrame) -> DataFrame:
    return with_marks(
        rows.where("category = 'unit'").select(
            *SHEET, "source_row", "development_ref", "tower_ref", "unit_ref", "typology_ref", _number("private_area"),
            _number("uncovered_area"), "floor_ref", "position_ref",
        )
    )


def calibration_candidates(rows: DataFrame, single: DataFrame) -> DataFrame:
    """Calibrations of row ranges and single cells; a single cell is read without its formula cache."""
    ranged = rows.where("category = 'calibration'").select(
        *SHEET, F.lit(None).cast("string").alias("source_cell_ref"), "source_row", "dimension_guess", "category_key_guess",
        _number("factor_value"),
    )
    one = single.where("category = 'calibration'").select(
        *SHEET, F.col("cell_ref").alias("source_cell_ref"), F.lit(None).cast("int").alias("source_row"), "dimension_guess",
        "category_key_guess", F.col("raw").try_cast("decimal(18,6)").alias("factor_value"),
    )
    return with_marks(ranged.unionByName(one))


def price_candidates(rows: DataFrame) -> DataFrame:
    return with_marks(
        rows.where("category = 'price_output'").select(
            *SHEET, "source_row", "unit_ref_guess", _number("price_value"), _number("price_per_m2_value")
        )
    )


def parameter_candidates(single: DataFrame) -> DataFrame:
    return with_marks(
        single.where("category = 'parameter'").select(
            *SHEET, F.col("cell_ref").alias("source_cell_ref"), "parameter_key_guess", F.col("effective").alias("value_text"),
            "value_type_guess", "notes",
        )
    )


def mapping_review(mapping: DataFrame) -> DataFrame:
    """Entries a person must look at: not HIGH, or a single cell of a category nothing handles."""
    unsure = mapping.where("confidence <> 'HIGH'")
    known = F.coalesce(F.col("category").isin("parameter", "calibration"), F.lit(False))
    odd = mapping.where((F.col("confidence") == "HIGH") & (F.col("extraction") == "single_cell") & ~known)

    def rows(df, row, ref, status):
        return df.select(
            *SHEET, row.cast("int").alias("source_row"), ref.alias("source_cell_ref"), "field_label",
            F.coalesce("canonical_concept", F.lit("")).alias("suspected_concept"), "confidence", status.alias("status"),
        )

    return rows(
        unsure, F.col("source_row"), F.col("source_cell_ref"),
        F.when(F.col("confidence") == "LOW", "UNMAPPED").otherwise("REVIEW_REQUIRED"),
    ).unionByName(rows(odd, F.lit(None), F.col("cell_ref"), F.lit("REVIEW_REQUIRED")))


def stage_candidates(cells: DataFrame, mapping: DataFrame, bound) -> dict[str, DataFrame]:
    """All five candidate tables of a mapping. Running it again gives the same rows, keyed by entry content."""
    check_mapping(mapping)
    # Three tables are made of the same rows: the cells are brought together for them once, and stored before each
    # entry has rows of its own. Where entries are too many to be sent to the rows, that join is stored as well.
    found, letters = mapped_rows(cells, mapping, bound)
    within = fits(bound)
    rows = entry_rows(stage(found) if within else found, letters, mapping, bound)
    rows, single = rows if within else stage(rows), extract_cells(cells, mapping, bound)
    return {
        "unit_candidates": unit_candidates(rows),
        "parameter_candidates": parameter_candidates(single),
        "calibration_candidates": calibration_candidates(rows, single),
        "price_output_candidates": price_candidates(rows),
        "mapping_review": mapping_review(mapping),
    }


def unreadable_numbers(rows: DataFrame) -> DataFrame:
    """Filled fields that should be numbers and are not; a strict load stops on them."""
    fields = F.array(
        *[
            F.when(~blank(F.col(f)) & F.col(f).try_cast(k).isNull(), F.struct(F.lit(f).alias("field"), F.col(f).alias("text")))
            for f, k in NUMBERS.items()
        ]
    )
    return rows.select(*SHEET, "source_row", F.explode(F.array_compact(fields)).alias("e")).select(*SHEET, "source_row", "e.*")


#: Categories a row range can be staged as.
ROW_CATEGORIES = ["unit", "calibration", "price_output"]
REJECTS = "workbook_id string, sheet_name string, source_row int, source_cell_ref string, category string, field string, text string, reason string"


def rejects(cells: DataFrame, mapping: DataFrame, rows: DataFrame, sheets: DataFrame, bound) -> DataFrame:
    """What a mapping asked for and staging could not give, a row each with its reason.

    ``rows`` are the extracted rows (``extract_rows``). Reasons: ``not_a_number`` (a filled
    field or cell that should be one), ``no_cell``, ``only_a_cached_value`` (a calibration
    is read without its formula cache), ``unknown_category`` (a row range nothing
    stages), ``no_sheet`` (an entry for a sheet that is not stored).
    """
    none = F.lit(None)

    def listed(df, row, ref, field, text, reason):
        return df.select(*SHEET, row.cast("int").alias("source_row"), ref.cast("string").alias("source_cell_ref"), "category",
                         field.cast("string").alias("field"), text.cast("string").alias("text"), reason.alias("reason"))

    fields = F.array_compact(F.array(*[
        F.when(~blank(F.col(f)) & F.col(f).try_cast(k).isNull(), F.struct(F.lit(f).alias("field"), F.col(f).alias("text"))) for f, k in NUMBERS.items()]))
    unread = rows.where(F.col("category").isin(ROW_CATEGORIES)).select(*SHEET, "source_row", "category", F.explode(fields).alias("e"))
    found = listed(unread, F.col("source_row"), none, F.col("e.field"), F.col("e.text"), F.lit("not_a_number"))
    high = mapping.where("confidence = 'HIGH'")
    odd = high.where((F.col("extraction") == "row_range") & ~F.coalesce(F.col("category").isin(ROW_CATEGORIES), F.lit(False)))
    found = found.unionByName(listed(odd, none, none, none, F.col("category"), F.lit("unknown_category")))
    known = sheets.select(*SHEET).distinct()
    lost = high.join(known, SHEET, "left_anti")
    found = found.unionByName(listed(lost, none, F.col("cell_ref"), none, none, F.lit("no_sheet")))
    single = extract_cells(cells, mapping.join(known, SHEET, "left_semi"), bound).where(F.col("category").isin("parameter", "calibration"))
    number = (F.col("category") == "calibration") | (F.col("value_type_guess") == "NUMERIC")
    read = F.when(F.col("category") == "calibration", F.col("raw")).otherwise(F.col("effective"))
    reason = (
        F.when(blank(F.col("effective")), "no_cell").when(blank(read), "only_a_cached_value")
        .when(F.coalesce(number, F.lit(False)) & read.try_cast("decimal(18,6)").isNull(), "not_a_number"))
    name = F.coalesce("parameter_key_guess", "category_key_guess")
    return found.unionByName(listed(single, none, F.col("cell_ref"), name, F.col("effective"), reason).where("reason is not null"))


def stage_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per staged table."""
    result = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("target"), "n")
        result = one if result is None else result.unionByName(one)
    return result


def orphans(staged: DataFrame, sheets: DataFrame) -> DataFrame:
    """Staged rows whose workbook and sheet are not stored."""
    return staged.join(sheets.select(*SHEET), SHEET, "left_anti")


def entries_by_confidence(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("confidence").agg(F.count("*").alias("entries"))


def reconcile(source: DataFrame, stored: DataFrame) -> DataFrame:
    """Cell and formula counts per sheet, source against stored, and how many cells differ.

    Every cell is compared: equal cells have equal digests, so only counts and
    digest sums per sheet meet, not the cells.
    """
    def sums(df, prefix):
        digest = F.xxhash64("cell_ref", "cell_type", "raw_value", "cached_value", "formula_expression")
        return df.groupBy(*SHEET).agg(
            F.count("*").alias(f"{prefix}_cells"), F.count_if(F.coalesce("formula_expression", F.lit("")) != "").alias(f"{prefix}_formulas"),
            F.sum(digest.cast("decimal(20,0)")).alias(f"{prefix}_digest"),
        )

    both = sums(source, "source").join(sums(stored, "stored"), SHEET, "full")
    return both.select(
        *SHEET, "source_cells", "stored_cells", "source_formulas", "stored_formulas",
        F.col("source_digest").eqNullSafe(F.col("stored_digest")).alias("identical"),
    )
