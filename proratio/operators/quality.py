"""Constraints as data: one operator turns a table and its rules into violations.

A predicate rule is broken only where it is false: an unknown value passes, as in
a CHECK. All predicate rules of a table are tested in one pass over it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``kind`` is check, unique, foreign or belongs."""

    id: str
    kind: str
    columns: tuple[str, ...]
    predicate: str = ""
    reference: DataFrame | None = field(default=None, compare=False)
    reference_columns: tuple[str, ...] = ()
    owner: str = ""


def not_null(column: str) -> Rule:
    return Rule(f"{column}_not_null", "check", (column,), f"{column} is not null")


def domain(column: str, values: list[str]) -> Rule:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return Rule(f"{column}_domain", "check", (column,), f"{column} in ({listed})")


def check(rule_id: str, predicate: str, *columns: str) -> Rule:
    """Range, order in time, one-of and conditional rules."""
    return Rule(rule_id, "check", columns, predicate)


def one_of(rule_id: str, kind: str, values: dict[str, str]) -> Rule:
    """Exactly the column that ``kind`` names is filled."""
    cases = [
        "(" + " and ".join([f"{kind} = '{k}'"] + [f"{c} is {'not ' if c == column else ''}null" for c in values.values()]) + ")"
        for k, column in values.items()
    ]
    return Rule(rule_id, "check", (kind, *values.values()), " or ".join(cases))


def unique(*columns: str, where: str = "") -> Rule:
    """No two rows with equal keys; a key with a NULL equals nothing."""
    return Rule("_".join(columns) + "_unique", "unique", columns, where)


def foreign(columns: list[str], reference: DataFrame, reference_columns: list[str]) -> Rule:
    return Rule("_".join(columns) + "_foreign", "foreign", tuple(columns), "", reference, tuple(reference_columns))


def belongs(rule_id: str, column: str, owner: str, reference: DataFrame, key: str, reference_owner: str) -> Rule:
    """The row's owner is also the owner of what ``column`` names."""
    return Rule(rule_id, "belongs", (column,), "", reference, (key, reference_owner), owner)


def violations(df: DataFrame, rules: list[Rule], key: list[str]) -> DataFrame:
    """Rows ``rule_id, key, detail``: one per broken rule and row (per key, for unique)."""
    def text(columns):
        return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])

    parts: list[DataFrame] = []
    checks = [r for r in rules if r.kind == "check"]
    if checks:
        broken = [~F.expr(r.predicate) for r in checks]
        # Few rows break a rule: the others are left before any text of theirs is made.
        rows = df.where(reduce(lambda a, b: a | b, broken))
        found = F.array_compact(
            F.array(*[F.when(b, F.struct(F.lit(r.id).alias("rule_id"), text(r.columns).alias("detail"))) for b, r in zip(broken, checks)])
        )
        parts.append(rows.select(text(key).alias("key"), F.explode(found).alias("b")).select("b.rule_id", "key", "b.detail"))
    for rule in rules:
        filled = df
        for c in rule.columns:
            filled = filled.where(F.col(c).isNotNull())
        if rule.kind == "unique":
            rows = filled.where(rule.predicate) if rule.predicate else filled
            # Counted where the rows are, so a key repeated without end stays one row. A key names what holds
            # the row first and the row last, so keys are told apart sooner from behind where they are sorted.
            found = rows.groupBy(*reversed(rule.columns)).agg(F.count("*").alias("n")).where("n > 1")
            parts.append(found.select(F.lit(rule.id).alias("rule_id"), text(rule.columns).alias("key"), F.col("n").cast("string").alias("detail")))
        elif rule.kind == "foreign":
            names = {c: f"_{i}" for i, c in enumerate(rule.reference_columns)}
            known = rule.reference.select(*[F.col(c).alias(n) for c, n in names.items()])
            match = None
            for c, n in zip(rule.columns, names.values()):
                match = (F.col(c) == F.col(n)) if match is None else match & (F.col(c) == F.col(n))
            parts.append(filled.join(known, match, "left_anti").select(F.lit(rule.id).alias("rule_id"), text(key).alias("key"), text(rule.columns).alias("detail")))
        elif rule.kind == "belongs":
            ref_key, ref_owner = rule.reference_columns
            known = rule.reference.select(F.col(ref_key).alias("_k"), F.col(ref_owner).alias("_o"))
            wrong = filled.join(known, F.col(rule.columns[0]) == F.col("_k")).where(~F.col(rule.owner).eqNullSafe(F.col("_o")))
            parts.append(wrong.select(F.lit(rule.id).alias("rule_id"), text(key).alias("key"), F.col("_o").cast("string").alias("detail")))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def applicable(df: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules whose columns a table has; a table may hold part of an entity's columns."""
    return [r for r in rules if set(r.columns) <= set(df.columns)]


def report(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_id").agg(F.count("*").alias("violations"))


def require(df: DataFrame, rules: list[Rule], key: list[str]) -> None:
    """Raise with a few examples if any rule is broken."""
    sample = violations(df, rules, key).limit(5).collect()
    if sample:
        raise ValueError("; ".join(f"{r['rule_id']}: {r['key']} ({r['detail']})" for r in sample))


def validation_rows(found: DataFrame, run_id: str, check_type: str, severity: str = "ERROR") -> DataFrame:
    """Rule counts as stored validations: expected 0, actual the count."""
    money = "decimal(18,2)"
    return report(found).select(
        F.lit(run_id).alias("run_id"), F.concat_ws(":", F.lit(check_type), "rule_id").alias("check_type"),
        F.when(F.col("violations") == 0, "INFO").otherwise(severity).alias("severity"), F.lit(0).cast(money).alias("expected_value"),
        F.col("violations").cast(money).alias("actual_value"), F.col("violations").cast(money).alias("difference"),
    )


# --- rules of the stored entities -----------------------------------------

STATES = ["PENDING", "RUNNING", "COMPLETED", "FAILED"]
LIFE = ["DRAFT", "ACTIVE", "SUPERSEDED", "ARCHIVED"]
LEVELS = ["HIGH", "MEDIUM", "LOW"]
ORIGINS = ["real", "imputed", "synthetic", "hybrid"]


def _in_time() -> Rule:
    return check("completed_after_started", "completed_at >= started_at", "started_at", "completed_at")


def _valid_period() -> Rule:
    return check("valid_period", "valid_to > valid_from", "valid_from", "valid_to")


def _positive(column: str) -> Rule:
    return check(f"{column}_positive", f"{column} > 0", column)


def _not_negative(column: str) -> Rule:
    return check(f"{column}_not_negative", f"{column} >= 0", column)


ENTITY_RULES: dict[str, list[Rule]] = {
    "core.developments": [not_null("business_key"), _positive("total_floors"), unique("business_key")],
    "core.towers": [not_null("development_id"), not_null("business_key"), unique("development_id", "business_key")],
    "core.unit_typologies": [
        not_null("development_id"), not_null("business_key"), _not_negative("bedrooms"), _not_negative("suites"),
        domain("classification", ["OFFICIAL_TYPOLOGY", "DERIVED_GROUPING", "UNKNOWN"]), unique("development_id", "business_key"),
    ],
    "core.units": [
        not_null("development_id"), not_null("unit_code"), not_null("closed_area_m2"), _positive("floor"), _not_negative("closed_area_m2"),
        _not_negative("balcony_area_m2"), _not_negative("ancillary_area_m2"), _not_negative("open_terrace_area_m2"),
        _not_negative("parking_spaces"), domain("orientation", ["N", "S", "L", "O"]), domain("position_type", ["frente", "fundos", "lateral"]),
        unique("development_id", "tower_id", "unit_code"),
    ],
    "pricing.scenarios": [
        not_null("development_id"), not_null("code"), domain("status", LIFE), unique("development_id", "code"),
        unique("development_id", where="status = 'ACTIVE'"),
    ],
    "pricing.parameter_sets": [_positive("version"), domain("status", LIFE), _valid_period(), unique("scenario_id", "code", "version")],
    "pricing.parameters": [
        not_null("key"), domain("value_type", ["NUMERIC", "TEXT", "BOOLEAN", "DATE"]), unique("parameter_set_id", "key"),
        one_of("typed_value", "value_type", {"NUMERIC": "numeric_value", "TEXT": "text_value", "BOOLEAN": "boolean_value", "DATE": "date_value"}),
    ],
    "pricing.calibration_sets": [
        not_null("code"), not_null("dimension"), _positive("version"), domain("status", LIFE), _valid_period(),
        unique("scenario_id", "code", "version"),
    ],
    "pricing.calibration_entries": [not_null("category_key"), not_null("factor"), unique("calibration_set_id", "category_key")],
    "pricing.runs": [
        domain("status", STATES), _in_time(),
        domain("run_type", ["SYSTEM_RUN", "IMPORTED_REFERENCE_RUN", "REPRODUCTION_VALIDATION_RUN"]),
    ],
    "pricing.vgv_targets": [
        domain("origin", ["MANUAL", "MARKET_PRICING_ENGINE", "IMPORTED_REFERENCE"]), _positive("target_value"), domain("status", LIFE),
        check("market_needs_prediction", "origin <> 'MARKET_PRICING_ENGINE' or market_prediction_id is not null", "origin"),
    ],
    "pricing.unit_adjustments": [not_null("adjustment_type"), not_null("result_value"), _positive("sequence_order")],
    "pricing.unit_price_results": [
        not_null("system_calculated_price"), check("share_range", "participation_share between 0 and 1", "participation_share"),
        _not_negative("system_calculated_price"), domain("result_origin", ["SYSTEM_CALCULATED", "IMPORTED_REFERENCE"]), unique("run_id", "unit_id"),
    ],
    "pricing.unit_overrides": [_not_negative("previous_price"), _not_negative("proposed_price"), _not_negative("final_price")],
    "pricing.validations": [not_null("check_type"), domain("severity", ["INFO", "WARNING", "ERROR"])],
    "pricing.reproduction_comparisons": [
        domain("match_classification", ["EXACT", "WITHIN_1_CENT", "WITHIN_1_REAL", "WITHIN_0_01_PERCENT", "DIVERGENT", "BLOCKED"]),
        domain("divergence_cause", [
            "ROUNDING", "MISSING_PARAMETER", "WRONG_MAPPING", "DERIVATION_ERROR", "CALIBRATION_SELECTION", "DORMANT_RULE_APPLIED",
            "OVERRIDE", "FORMULA_VARIATION", "SOURCE_ANOMALY", "IMPLEMENTATION_BUG", "BUSINESS_RULE_AMBIGUITY", "UNKNOWN",
        ]),
        unique("reproduction_run_id", "unit_id"),
    ],
    "audit.data_sources": [not_null("name"), domain("origin_type", ORIGINS), unique("code")],
    "audit.data_lineage": [not_null("entity_schema"), not_null("entity_table"), not_null("entity_id"), not_null("data_source_id")],
    "audit.promotion_runs": [domain("status", STATES), _in_time(), unique("ingest_batch_id", "mapping_version")],
    "audit.reproduction_runs": [domain("status", STATES), _in_time(), unique("development_id", "ruleset_version")],
    "raw.ingest_batches": [domain("status", STATES), _not_negative("source_count"), _in_time()],
    "raw.workbooks": [not_null("source_filename"), _positive("source_size_bytes"), unique("source_sha256")],
    "raw.sheets": [domain("visibility", ["visible", "hidden", "veryHidden"]), unique("workbook_id", "sheet_name")],
    "raw.cells": [
        _positive("row_number"), _positive("column_index"), domain("cell_type", ["string", "number", "date", "boolean", "error", "empty"]),
        unique("workbook_id", "sheet_name", "cell_ref"),
    ],
    "staging.unit_candidates": [domain("mapping_confidence", LEVELS), domain("mapping_status", ["CANDIDATE", "REVIEW_REQUIRED", "REJECTED"])],
    "staging.mapping_review": [domain("confidence", LEVELS), domain("status", ["UNMAPPED", "REVIEW_REQUIRED"])],
    "hedonic.observations": [
        _positive("andar"), _positive("area"), _not_negative("quartos"), _not_negative("suite"), _not_negative("vagas"), _not_negative("varanda_m2"),
        domain("vista", ["rua", "parque", "mar"]), domain("orientacao", ["N", "S", "L", "O"]), domain("posicao", ["frente", "fundos", "lateral"]),
        domain("fase_obra", ["lancamento", "construcao", "acabamento", "pronto"]), _not_negative("meses_lancamento"), _positive("preco_m2"),
        *[check(f"{c}_range", f"{c} between 1 and 5", c) for c in ("padrao_score", "lazer_score", "localizacao_score")],
        unique("empreendimento", "torre", "apartamento"),
    ],
}
