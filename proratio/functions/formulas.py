"""Functions over spreadsheet formula texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of a cell reference, a sheet reference and a number in a formula.
CELL_REFERENCE = r"(\$?)([A-Z]{1,3})(\$?)(\d+)"
SHEET_REFERENCE = r"(?:'([^']+)'|([A-Za-z_][A-Za-z0-9_. ]*))!"
NUMBER_LITERAL = r"(?<![A-Za-z$])-?\d+\.\d+|(?<![A-Za-z$])-?\d+(?!\.\d)"
SMALL_NUMBERS = ["0", "1", "2", "3", "4", "-1"]


def pattern(formula: Column) -> Column:
    """The formula without row numbers: $A$12 becomes $A$#."""
    return F.regexp_replace(formula, CELL_REFERENCE, "$1$2$3#")


def sheet_references(formula: Column) -> Column:
    """Sheets a formula names, one entry per mention."""
    found = F.regexp_extract_all(formula, F.lit(SHEET_REFERENCE), F.lit(0))
    return F.transform(found, lambda s: F.regexp_replace(s, "^'|'?!$", ""))


def literals(formula: Column) -> Column:
    """Numbers written into the formula, references aside."""
    bare = F.regexp_replace(formula, CELL_REFERENCE, " ")
    bare = F.regexp_replace(bare, r"(?:'[^']+'|[A-Za-z_][\w .]*)!", " ")
    return F.regexp_extract_all(bare, F.lit(NUMBER_LITERAL), F.lit(0))


def literal_role(literal: Column, formula: Column) -> Column:
    """What a written number probably is."""
    value = literal.try_cast("double")
    lookup = formula.rlike(r"(?i)(VLOOKUP|HLOOKUP)\(")
    return (
        F.when(value.isNull(), "desconhecido")
        .when((value > 0) & (value < 1), "possivel_percentual_ou_peso")
        .when(value.isin(100.0, 1000.0), "possivel_conversao_ou_escala")
        .when((value == F.floor(value)) & value.between(0, 60) & lookup, "possivel_indice_ou_offset_de_lookup")
        .when(F.abs(value) >= 1000, "possivel_valor_monetario_ou_area_total")
        .otherwise("desconhecido")
    )


def needs_explanation(literal: Column, formula: Column) -> Column:
    """Small whole numbers inside lookups explain themselves."""
    return ~(literal.isin(SMALL_NUMBERS) & formula.rlike(r"(?i)(VLOOKUP|HLOOKUP|MATCH|INDEX)\("))
