"""Reproduction as stored runs that resume: a development is worked out once per ruleset version.

Units and imported prices are stored a batch per development. A run finds, from the
manifest alone, the developments its ruleset version has not completed, reads only their
partitions, prices all variants of them in one pass over the rule graph, and publishes a
batch per development. Imported prices are read only when everything is priced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proratio.operators import reproduction, rulegraph
from proratio.session import counted, stage
from proratio.sources.publish import Manifest

UNITS, IMPORTED, COMPARED = "core.rule_units", "pricing.imported_results", "pricing.reproduction_comparisons"
IMPORTED_SCHEMA = "development_id string, unit_id bigint, source_reference_price decimal(18,2), imported_run_id string"
COMPARED_SCHEMA = (
    "development_id string, variant string, unit_id bigint, imported_run_id string, source_reference_price decimal(18,2), reproduced_price decimal(18,2),"
    " delta_absolute decimal(18,2), delta_percent decimal(18,6), match_classification string, divergence_cause string, attempt string"
)


def store_inputs(manifest: Manifest, units: DataFrame, imported: DataFrame) -> None:
    """Units (with ``development_id``) and imported prices, a batch per development; developments that are stored stay as they are."""
    for table, rows in ((UNITS, units), (IMPORTED, imported)):
        manifest.publish_each(table, rows, F.concat(F.lit(f"{table}:"), F.col("development_id").cast("string")))


def _batch(version: str, development: Column) -> Column:
    return F.concat(F.lit(f"{COMPARED}:{version}:"), development)


def pending(manifest: Manifest, version: str) -> DataFrame:
    """(development_id, batch_id): stored developments that this ruleset version has not completed, with the batch of their units."""
    done = manifest.state().where("status = 'COMPLETED'").select("batch_id", "table_name")
    units = done.where(F.col("table_name") == UNITS).select(F.substring("batch_id", len(UNITS) + 2, 1 << 20).alias("development_id"), "batch_id")
    finished = done.where(F.col("table_name") == COMPARED).select(F.col("batch_id").alias("_b"))
    return units.join(finished, _batch(version, F.col("development_id")) == F.col("_b"), "left_anti")


def in_variants(ruleset: rulegraph.Ruleset, output: str) -> rulegraph.Ruleset:
    """The ruleset whose lookup ``output`` takes a row's ``forced_key`` where there is one."""
    rules = [{**r, "operands": {**r["operands"], "row_key_overrides": "forced_key"}} if o == output else r for o, r in ruleset.rules.items()]
    return rulegraph.Ruleset({"inputs": ruleset.inputs, "rules": rules})


def priced(units: DataFrame, ruleset: rulegraph.Ruleset, tables: dict[str, DataFrame], variants: list[str], price: str, forced_output: str,
           forced_key: str, forced: Column, bound: int) -> DataFrame:
    """(development_id, variant, unit_id, lookup key, unit_price) of all variants, from one evaluation: a group is a development in a variant."""
    def group(name):
        return F.concat_ws("|", F.col(name).cast("string"), "variant")

    each = reproduction.with_variants(units, variants, forced_key, forced).withColumn("group_id", group("development_id"))
    names = F.explode(F.array(*[F.lit(v) for v in variants]))
    own = {o: t.withColumn("variant", names).withColumn("group_id", group("group_id")).drop("variant") for o, t in tables.items()}
    rules = in_variants(ruleset, forced_output).only([price])
    found = rulegraph.evaluate(each, rules, tables=own, bound=bound * len(variants))
    return found.select(F.col("development_id").cast("string").alias("development_id"), "variant", "unit_id", "forced_key", F.col(price).alias("unit_price"))


def reproduce(manifest: Manifest, version: str, ruleset: rulegraph.Ruleset, unit_schema: str, tables: dict[str, DataFrame], *, variants: list[str],
              forced_output: str, forced_key: str, forced: Column, price: str = "unit_price", attempt: str = "", chosen: DataFrame | None = None) -> DataFrame:
    """Reproduce the pending developments, or those of them in ``chosen`` (development_id); (batch_id, status) of each that was worked out.

    A call that was cut short leaves its developments pending; the next one goes on with them.
    """
    open_ = pending(manifest, version)
    if chosen is not None:
        open_ = open_.join(chosen.select(F.col("development_id").cast("string").alias("development_id")), "development_id", "left_semi")
    open_ = stage(open_)
    units = stage(manifest.read(UNITS, unit_schema, open_))
    reproduced = stage(priced(units, ruleset, tables, variants, price, forced_output, forced_key, forced, counted(open_)))
    # Only now, and only of these developments.
    reference = manifest.read(IMPORTED, IMPORTED_SCHEMA, open_.select(F.concat(F.lit(f"{IMPORTED}:"), "development_id").alias("batch_id")))
    rows = reproduction.compare(reproduced, reference, ("variant",)).withColumn("attempt", F.lit(attempt))
    columns = [f.split()[0] for f in COMPARED_SCHEMA.split(", ")]
    return manifest.publish_each(COMPARED, rows.select(*columns), _batch(version, F.col("development_id")))


def comparisons(manifest: Manifest, version: str) -> DataFrame:
    """Stored comparisons of a ruleset version."""
    batches = manifest.state().where(F.col("batch_id").startswith(f"{COMPARED}:{version}:")).select("batch_id").distinct()
    return manifest.read(COMPARED, COMPARED_SCHEMA, batches)
