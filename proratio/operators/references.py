"""References between stored entities: inline, deferred and composite ones, judged together.

Every parent key and every child's reference becomes a row (target, key, role) of one
union. One aggregation brings all roles of a key together, so any number of references
to a parent costs one pass, and a key that very many children name is combined where
they are. An inline reference needs a parent that is stored already or stands earlier in the
batch, like the child's own table; a deferred one is judged when the batch is whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    columns: tuple[str, ...]
    parent: str
    keys: tuple[str, ...] = ("id",)
    deferred: bool = False

    @property
    def target(self) -> str:
        return f"{self.parent}({','.join(self.keys)})"


def to(column: str, parent: str, key: str = "id", deferred: bool = False) -> Reference:
    return Reference((column,), parent, (key,), deferred)


_SOURCE = to("data_source_id", "audit.data_sources", deferred=True)
_SHEET = Reference(("workbook_id", "sheet_name"), "raw.sheets", ("workbook_id", "sheet_name"))

#: What each entity refers to; an empty list says that it refers to nothing.
REFERENCES: dict[str, list[Reference]] = {
    "core.developments": [_SOURCE],
    "core.towers": [to("development_id", "core.developments")],
    "core.unit_typologies": [to("development_id", "core.developments")],
    "core.units": [
        to("development_id", "core.developments"), to("tower_id", "core.towers"), to("unit_typology_id", "core.unit_typologies"), _SOURCE,
        # A unit's tower is one of the unit's own development.
        Reference(("tower_id", "development_id"), "core.towers", ("id", "development_id")),
    ],
    "pricing.scenarios": [to("development_id", "core.developments")],
    "pricing.parameter_sets": [to("scenario_id", "pricing.scenarios")],
    "pricing.parameters": [to("parameter_set_id", "pricing.parameter_sets"), _SOURCE],
    "pricing.calibration_sets": [to("scenario_id", "pricing.scenarios")],
    "pricing.calibration_entries": [to("calibration_set_id", "pricing.calibration_sets")],
    "pricing.runs": [to("scenario_id", "pricing.scenarios"), to("parameter_set_id", "pricing.parameter_sets")],
    "pricing.run_calibration_sets": [to("run_id", "pricing.runs"), to("calibration_set_id", "pricing.calibration_sets")],
    "pricing.vgv_targets": [to("scenario_id", "pricing.scenarios"), to("run_id", "pricing.runs")],
    "pricing.unit_price_results": [to("run_id", "pricing.runs"), to("unit_id", "core.units")],
    "pricing.unit_adjustments": [
        to("run_id", "pricing.runs"), to("unit_id", "core.units"), to("calibration_entry_id", "pricing.calibration_entries"),
        to("parameter_id", "pricing.parameters"),
    ],
    "pricing.unit_overrides": [
        to("run_id", "pricing.runs"), to("unit_id", "core.units"),
        # Only a unit that has a result in the run can be overridden there.
        Reference(("run_id", "unit_id"), "pricing.unit_price_results", ("run_id", "unit_id")),
    ],
    "pricing.validations": [to("run_id", "pricing.runs")],
    "pricing.reproduction_comparisons": [
        to("reproduction_run_id", "audit.reproduction_runs"), to("imported_run_id", "pricing.runs"), to("unit_id", "core.units"),
    ],
    "audit.data_sources": [],
    "audit.data_lineage": [_SOURCE],
    "audit.promotion_runs": [to("ingest_batch_id", "raw.ingest_batches")],
    "audit.reproduction_runs": [to("development_id", "core.developments"), to("pricing_run_id", "pricing.runs")],
    "raw.ingest_batches": [],
    "raw.workbooks": [to("ingest_batch_id", "raw.ingest_batches")],
    "raw.sheets": [to("workbook_id", "raw.workbooks", "workbook_id")],
    "raw.cells": [_SHEET],
    "staging.unit_candidates": [_SHEET],
    "staging.parameter_candidates": [_SHEET],
    "staging.calibration_candidates": [_SHEET],
    "staging.price_output_candidates": [_SHEET],
    "staging.mapping_review": [_SHEET],
    "hedonic.observations": [],
}

#: An order of writing in which every inline reference is met.
ORDER = [
    "raw.ingest_batches", "raw.workbooks", "raw.sheets", "raw.cells", "core.developments", "core.towers", "core.unit_typologies", "core.units",
    "pricing.scenarios", "pricing.parameter_sets", "pricing.parameters", "pricing.calibration_sets", "pricing.calibration_entries", "pricing.runs",
    "pricing.run_calibration_sets", "pricing.vgv_targets", "pricing.unit_price_results", "pricing.unit_adjustments", "pricing.unit_overrides",
    "pricing.validations", "audit.data_sources", "audit.data_lineage",
]


class OrphanError(ValueError):
    """A batch that names rows which do not exist."""


def orphans(batch: dict[str, DataFrame], stored: dict[str, DataFrame] | None = None, rules: dict[str, list[Reference]] | None = None) -> DataFrame:
    """(reference, key, rows): how many rows of ``batch`` name a key that no parent has, or not yet.

    The order of ``batch`` is that of writing; ``stored`` tables are there before it.
    A reference with a NULL refers to nothing. References whose columns a table does
    not have, or whose parent is neither in the batch nor stored, are left out.
    """
    rules, stored = REFERENCES if rules is None else rules, stored or {}
    kind = "target string, key array<string>, reference string, seen int"
    place = {name: i for i, name in enumerate(batch)}
    parts, parents, late, own = [], {}, {}, {}

    def role(target, columns, reference, seen):
        key = F.array(*[F.col(c).cast("string") for c in columns])
        return F.struct(F.lit(target).alias("target"), key.alias("key"), F.lit(reference).cast("string").alias("reference"), F.lit(seen).cast("int").alias("seen"))

    roles_of = {}
    for name, df in batch.items():
        for ref in rules.get(name, []):
            if set(ref.columns) <= set(df.columns) and (ref.parent in batch or ref.parent in stored):
                label = f"{name}.{'+'.join(ref.columns)}"
                filled = F.lit(True)
                for c in ref.columns:
                    filled = filled & F.col(c).isNotNull()
                roles_of.setdefault((name, "batch"), []).append(F.when(filled, role(ref.target, ref.columns, label, None)))
                parents[ref.target], late[label], own[label] = ref, ref.deferred, place[name]
    for target, ref in parents.items():
        for where, tables, seen in (("stored", stored, -1), ("batch", batch, place.get(ref.parent))):
            if ref.parent in tables:
                roles_of.setdefault((ref.parent, where), []).append(role(target, ref.keys, None, seen))
    # A table is read once for all its roles.
    for (name, where), found in roles_of.items():
        df = batch[name] if where == "batch" else stored[name]
        parts.append(df.select(F.inline(F.array(*found))).where("target is not null"))
    if not parents:
        return next(iter(batch.values())).sparkSession.createDataFrame([], "reference string, key string, rows bigint")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    assert every.schema.simpleString() == "struct<" + ",".join(f.replace(" ", ":", 1) for f in kind.split(", ")) + ">"
    # First by role, where the rows are; then the few roles of a key.
    roles = every.groupBy("target", "key", "reference").agg(F.count(F.lit(1)).alias("rows"), F.min("seen").alias("seen"))
    children = F.collect_list(F.when(F.col("reference").isNotNull(), F.struct("reference", "rows")))
    keys = roles.groupBy("target", "key").agg(F.min("seen").alias("seen"), children.alias("children"))

    def listed(values):
        return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])

    found = keys.select("key", "seen", F.inline("children"))
    early = F.col("seen") <= F.element_at(listed(own), F.col("reference"))
    met = F.col("seen").isNotNull() & (F.element_at(listed(late), F.col("reference")) | early)
    return found.where(~met).select("reference", F.array_join("key", "|").alias("key"), "rows")


def report(found: DataFrame) -> DataFrame:
    return found.groupBy("reference").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("keys"))


def require(batch: dict[str, DataFrame], stored: dict[str, DataFrame] | None = None) -> None:
    """Raise with a few examples if any reference leads nowhere."""
    ordered = {n: batch[n] for n in sorted(batch, key=lambda n: ORDER.index(n) if n in ORDER else len(ORDER))}
    sample = orphans(ordered, stored).limit(5).collect()
    if sample:
        raise OrphanError("; ".join(f"{r['reference']}: {r['key']} ({r['rows']} rows)" for r in sample))
