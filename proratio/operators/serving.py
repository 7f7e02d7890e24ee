"""Views over stored runs: current price, dashboard rows, key figures, document, charts."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proratio.operators.allocation import latest
from proratio.session import attach, checkpoint_root, stage

PRICE = "decimal(18,2)"
NO_TOWER = "SEM-TORRE"


def latest_runs(scenarios: DataFrame, runs: DataFrame, run_type: str | None = None) -> DataFrame:
    """The newest COMPLETED run of each ACTIVE scenario; an unset completion counts as newest."""
    done = runs.where(F.col("status") == "COMPLETED")
    if run_type is not None:
        done = done.where(F.col("run_type") == run_type)
    active = scenarios.where(F.col("status") == "ACTIVE").select("scenario_id")
    newest = latest(
        done.join(active, "scenario_id", "left_semi"), ["scenario_id"],
        F.col("completed_at").isNull(), F.col("completed_at"), F.col("run_id"),
    )
    return newest.select("scenario_id", "development_id", "run_id")


def latest_overrides(overrides: DataFrame) -> DataFrame:
    """The newest decision per run and unit; equal times are settled by the event id."""
    return latest(
        overrides.select("run_id", "unit_id", "final_price", "decided_at", "event_id"),
        ["run_id", "unit_id"], F.col("decided_at"), F.col("event_id"),
    )


def unit_price_current(scenarios: DataFrame, runs: DataFrame, results: DataFrame, overrides: DataFrame, bound,
                       run_type: str | None = None) -> DataFrame:
    """Current price per unit: the newest run's price, or its newest override."""
    newest = latest_runs(scenarios, runs, run_type).select("run_id")
    current = attach(results, newest, "run_id", bound, "inner")
    decided = latest_overrides(overrides).select(
        "run_id", "unit_id", F.col("final_price").alias("override_final_price")
    )
    return current.join(decided, ["run_id", "unit_id"], "left").withColumn(
        "current_final_price", F.coalesce("override_final_price", "system_price")
    )


def with_labels(current: DataFrame, towers: DataFrame, typologies: DataFrame, tower_bound, typology_bound) -> DataFrame:
    """Rows that name tower and typology by id, with the names the two tables hold; an id they do not hold has none.

    Both tables have one row per ``tower_id`` or ``typology_id`` and a ``name``. A dimension within its
    bound is broadcast, and rows of a hot tower or typology are divided where it is not.
    """
    found = attach(current, towers.select("tower_id", F.col("name").alias("tower")), "tower_id", tower_bound)
    return attach(found, typologies.select("typology_id", F.col("name").alias("typology")), "typology_id", typology_bound)


def units_enriched(current: DataFrame) -> DataFrame:
    """Dashboard rows: labels, adjustment, price per area and status of each unit."""
    zero = F.lit(0).cast(PRICE)
    overridden = F.col("override_final_price").isNotNull()
    fallback = F.when(
        F.col("private_area_m2") > 0, F.round(F.try_divide("current_final_price", "private_area_m2"), 2).cast(PRICE)
    ).otherwise(zero)
    return current.select(
        "development_id",
        "unit_id",
        F.coalesce("tower", F.lit(NO_TOWER)).alias("tower"),
        "unit_code",
        F.coalesce("typology", F.lit("")).alias("typology"),
        "floor",
        F.coalesce("position", F.lit("")).alias("position"),
        "private_area_m2",
        "uncovered_area_m2",
        "weighted_area_m2",
        "participation_share",
        F.col("system_price"),
        F.when(overridden, F.col("override_final_price") - F.col("system_price")).otherwise(zero).cast(PRICE).alias("adjustment"),
        F.col("current_final_price").alias("final_price"),
        F.coalesce("price_per_m2", fallback).alias("price_per_m2"),
        F.when(overridden, "AJUSTE").otherwise("VALIDADO").alias("status"),
    )


def development_label(units: DataFrame, names: DataFrame, bound) -> DataFrame:
    """One row: the development's name, or how many there are and which.

    The names are reduced to one per development before they are joined into a text.
    """
    present = units.select("development_id").distinct()
    named = attach(present, names, "development_id", bound, "inner")
    listed = F.array_join(F.array_sort(F.collect_set("name")), ", ")
    return named.agg(
        F.count("*").alias("n"), F.max("name").alias("only"), listed.alias("all")
    ).select(
        F.when(F.col("n") == 1, F.col("only"))
        .otherwise(F.concat(F.col("n").cast("string"), F.lit(" empreendimentos ("), F.col("all"), F.lit(")")))
        .alias("name")
    )


def ratio2(top: Column, bottom: Column) -> Column:
    """Two-place quotient, 0 where the divisor is not positive."""
    return F.when(bottom > 0, F.round(F.try_divide(top, bottom), 2)).otherwise(F.lit(0)).cast(PRICE)


def error_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts and error sizes of reproduced against reference prices; empty input gives zeros."""
    delta = F.col("delta_absolute").cast("decimal(18,2)")
    zero = F.lit(0)
    found = rows.groupBy(*keys) if keys else rows
    return found.agg(
        F.count("*").alias("units_analyzed"),
        F.count_if(F.col("match_classification").isin("EXACT", "WITHIN_1_CENT")).alias("within_1_cent"),
        F.count_if(F.col("match_classification") == "EXACT").alias("exact_matches"),
        F.coalesce(F.sum(delta), zero).cast("decimal(28,2)").alias("aggregate_delta"),
        # avg of decimal(18,2) keeps six places
        F.coalesce(F.round(F.avg(F.abs(delta)), 2), zero).cast(PRICE).alias("mae"),
        F.coalesce(F.max(F.abs(delta)), zero).cast(PRICE).alias("max_absolute_error"),
        F.round(F.sqrt(F.coalesce(F.avg((delta * delta).cast("double")), F.lit(0.0))), 2).alias("rmse"),
    )


def kpis(units: DataFrame, validation: DataFrame) -> DataFrame:
    """One row of key figures; ``validation`` is the one row of ``error_metrics``."""
    # One pass over the units: sums per label pair, then over the pairs.
    pairs = units.groupBy("tower", "typology").agg(
        F.sum("final_price").alias("vgv"), F.count("*").alias("n"), F.sum("private_area_m2").alias("area"),
        F.count_if(F.col("adjustment") != 0).alias("adjusted"),
    )
    figures = pairs.agg(
        F.coalesce(F.sum("vgv"), F.lit(0)).cast(PRICE).alias("vgv"), F.coalesce(F.sum("n"), F.lit(0)).alias("units_count"),
        F.sum("area").cast("decimal(22,2)").alias("area"), F.coalesce(F.sum("adjusted"), F.lit(0)).alias("adjustments_count"),
        F.count_distinct("tower").alias("towers_count"), F.count_distinct("typology").alias("typologies_count"),
    )
    accuracy = F.when(
        F.col("units_analyzed") > 0,
        F.round(F.try_divide(F.col("within_1_cent") * 100, F.col("units_analyzed").cast("decimal(18,0)")), 1),
    ).otherwise(F.lit(0))
    # Two one-row tables, so this join cannot grow.
    return (
        figures.join(F.broadcast(validation.select("units_analyzed", "within_1_cent")))
        .select(
            "vgv", "units_count", "towers_count", "typologies_count",
            ratio2(F.col("vgv"), F.col("area")).alias("avg_price_per_m2"), "adjustments_count",
            accuracy.cast("decimal(5,1)").alias("reproduction_accuracy_pct"),
            F.col("within_1_cent").alias("within_1_cent_count"),
        )
    )


def newest_reproduction(runs: DataFrame) -> DataFrame:
    """(development_id, reproduction_run_id): the newest completed reproduction of each development; ties go to the higher id."""
    done = runs.where("status = 'COMPLETED'").groupBy("development_id").agg(F.max(F.struct("completed_at", "id")).alias("r"))
    return done.select("development_id", F.col("r.id").alias("reproduction_run_id"))


def validation_block(comparisons: DataFrame, runs: DataFrame, units: DataFrame, bound) -> DataFrame:
    """Comparisons of each development's newest completed reproduction, with the unit's tower and code.

    ``bound`` proves the number of developments.
    """
    key = ["development_id", "reproduction_run_id"]
    newest = attach(comparisons, newest_reproduction(runs), key, bound, "inner")
    return newest.join(units.select("unit_id", "tower", "unit_code"), "unit_id").select(
        *key, F.coalesce("tower", F.lit(NO_TOWER)).alias("tower"), "unit_code", "source_reference_price", "reproduced_price",
        "delta_absolute", "match_classification",
    )


def document_lines(units: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One JSON line per unit beside its keys, whatever the number of units; readers order lines by the keys."""
    return units.select(*keys, F.to_json(F.struct(*fields)).alias("document"))


def head_fields(meta: dict[str, str], label: DataFrame, figures: DataFrame, validation: DataFrame) -> dict[str, DataFrame]:
    """The objects at the head of the dashboard document, each one row of JSON."""
    one = label.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in meta.items()])
    objects = {"meta": one, "development": label, "kpis": figures, "validation": validation}
    return {k: df.select(F.to_json(F.struct(*df.columns)).alias("document")) for k, df in objects.items()}


def labels(units: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column as JSON texts beside themselves, as elements of a list."""
    return units.where(F.col(column).isNotNull()).select(column).distinct().select(column, F.to_json(F.array(column)).alias("t")).select(
        column, F.expr("substr(t, 2, length(t) - 2)").alias("document"))


def nested_document(head: dict[str, DataFrame], lists: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One JSON object as lines: fields of ``head`` (one row each with ``document``), then lists of any length.

    A list is rows with ``document`` (the element's JSON) and the keys that order it, unique and never
    NULL. ``section`` and a struct of keys per list order the lines; an element but the first of its
    list begins with a comma, and the first is found by the two lowest keys of the list. Repeated first keys
    would leave out a comma, so they are an error. An empty list is ``[]``, and a ``head`` of no rows
    leaves its field out, so the first field must have its row.
    """
    if not head:
        raise ValueError("a document needs a field before its lists")
    spark = next(iter(head.values())).sparkSession

    def fixed(section: int, text: str) -> DataFrame:
        return spark.range(1).select(F.lit(section).alias("section"), F.lit(text).alias("line"))

    parts, section = [fixed(0, "{")], 1
    for i, (name, df) in enumerate(head.items()):
        parts.append(df.select(F.lit(section).alias("section"), F.concat(F.lit(f'{"," if i else ""}"{name}":'), "document").alias("line")))
        section += 1
    for name, (df, keys) in lists.items():
        lowest = df.select(*keys).orderBy(*keys).limit(2).collect()
        if len(lowest) == 2 and lowest[0] == lowest[1]:
            raise ValueError(f"{name}: the first key occurs more than once")
        first = F.lit(bool(lowest))
        for k in keys:
            first = first & (F.col(k) == F.lit(lowest[0][k] if lowest else None))
        parts.append(fixed(section, f',"{name}":['))
        parts.append(df.select(
            F.lit(section + 1).alias("section"), F.struct(*keys).alias(f"key_{name}"), F.concat(F.when(first, "").otherwise(","), "document").alias("line")))
        parts.append(fixed(section + 2, "]"))
        section += 3
    parts.append(fixed(section, "}"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part, allowMissingColumns=True)
    return found


def write_nested(document: DataFrame, folder: str) -> None:
    """Write the lines of ``nested_document`` so that the files of the folder, joined by name, are the document.

    One range sort; a file holds a range of lines and none of them needs to know another's.
    """
    order = ["section", *[c for c in document.columns if c.startswith("key_")]]
    document.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(folder)


def lineage_trace(results: DataFrame, steps: Column, runs: DataFrame, overrides: DataFrame, validations: DataFrame,
                  tower_rows: DataFrame, run_bound) -> DataFrame:
    """Every priced unit with all that made its price: run, scenario, tower, steps, factor sources, override, validation.

    Runs, towers and validations are attached, overrides join on the unit, and the
    steps (``allocation.adjustment_steps``) are worked out from the result's own columns.
    """
    decided = latest_overrides(overrides).select("run_id", "unit_id", F.col("final_price").alias("override_final_price"))
    run_rows = runs.select("run_id", "scenario_id", "status", "completed_at")
    checks = validations.select("development_id", "severity", "difference")
    traced = attach(results, run_rows, "run_id", run_bound, "inner")
    traced = attach(traced, checks, "development_id", run_bound, "left")
    traced = attach(traced, tower_rows.select("development_id", "tower", "tower_id"), ["development_id", "tower"], tower_rows)
    traced = traced.join(decided, ["run_id", "unit_id"], "left")
    return traced.select("*", F.inline(steps)).select(
        "scenario_id", "run_id", "tower_id", "unit_id", "sequence_order", "adjustment_type", "source_set", "source_key",
        "result_value", "system_price", "override_final_price", "severity",
    )


# --- charts and table -----------------------------------------------------


def price_by_floor(units: DataFrame) -> DataFrame:
    """Average price per area by floor; units without a floor are left out."""
    return units.where("floor is not null").groupBy("floor").agg(
        F.count("*").alias("units"),
        ratio2(F.sum("final_price"), F.sum("private_area_m2")).alias("price_per_m2"),
    )


def share_by_tower(units: DataFrame) -> DataFrame:
    return units.groupBy("development_id", "tower").agg(
        F.count("*").alias("units"),
        F.sum("participation_share").cast("decimal(18,6)").alias("share"),
        F.sum("final_price").cast(PRICE).alias("vgv"),
    )


def price_histogram(units: DataFrame, low: int, high: int, bins: int) -> DataFrame:
    """Units per price class; below and above the range fall into the outer classes 0 and bins + 1."""
    return units.groupBy(
        F.width_bucket(F.col("final_price").cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")
    ).agg(F.count("*").alias("units"), F.min("final_price").alias("lowest"), F.max("final_price").alias("highest"))


def price_by_area(units: DataFrame, step: int = 10) -> DataFrame:
    """The price and area scatter as area classes of ``step`` square metres."""
    return units.groupBy((F.floor(F.col("private_area_m2") / step) * step).cast("int").alias("area_from")).agg(
        F.count("*").alias("units"), F.min("final_price").alias("lowest"), F.max("final_price").alias("highest"),
        F.sum("final_price").cast(PRICE).alias("vgv"),
    )


def adjustment_list(units: DataFrame) -> DataFrame:
    """Only the units people adjusted."""
    return units.where("adjustment <> 0").select(
        "development_id", "tower", "unit_code", "system_price", "adjustment", "final_price"
    )


def units_table(units: DataFrame, search: str = "", status: str | None = None, sort: str = "unit_code",
                descending: bool = False, page: int = 0, page_size: int = 50) -> DataFrame:
    """One page of the searchable unit table; ties are settled by development, tower and unit."""
    if search:
        text = F.lower(F.concat_ws(" ", "tower", "unit_code", "typology", "position"))
        units = units.where(F.contains(text, F.lit(search.lower())))
    if status:
        units = units.where(F.col("status") == status)
    first = F.col(sort).desc() if descending else F.col(sort)
    ordered = units.orderBy(first, "development_id", "tower", "unit_code")
    return ordered.offset(page * page_size).limit(page_size)


@dataclass(frozen=True)
class StoredOrder:
    """A table in a stored order: range partitions, and per range its first place, its rows and its last key."""

    path: str
    schema: StructType
    keys: tuple[tuple[str, bool], ...]
    ranges: DataFrame

    def _rows(self, chosen: DataFrame) -> DataFrame:
        """Rows of the chosen ranges with their place; the other partitions are pruned. There are as many ranges as tasks wrote."""
        stored = self.ranges.sparkSession.read.schema(self.schema).parquet(self.path)
        return stored.join(F.broadcast(chosen.select("_range", "_first")), "_range").withColumn("_place", F.col("_first") + F.col("_at"))

    def _page(self, rows: DataFrame, size: int) -> DataFrame:
        return rows.orderBy("_place").limit(size).drop("_range", "_first", "_at", "_place")

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 0); it reads the one or two ranges that hold it, however deep it lies."""
        first = number * size
        chosen = self.ranges.where((F.col("_first") < first + size) & (F.col("_first") + F.col("_n") > first))
        return self._page(self._rows(chosen).where(F.col("_place") >= first), size)

    def after(self, key: dict, size: int) -> DataFrame:
        """The ``size`` rows behind a key, which is that of the last row seen; rows that come or go before it shift nothing."""
        def column(c, of):
            return F.col(f"{of}.{c}") if of else F.col(c)

        def passed(of):
            beyond, same = F.lit(False), F.lit(True)
            for name, descending in self.keys:
                value = column(name, of)
                beyond = beyond | (same & (value < F.lit(key[name]) if descending else value > F.lit(key[name])))
                same = same & (value == F.lit(key[name]))
            return beyond

        ahead = self.ranges.where(passed("_last"))
        end = ahead.groupBy().agg(F.min(F.col("_first") + F.col("_n")).alias("e")).scalar()
        return self._page(self._rows(ahead.where(F.col("_first") < end + size)).where(passed("")), size)


def store_order(units: DataFrame, keys: list[tuple[str, bool]], ranges: int) -> StoredOrder:
    """Sort once, into ``ranges`` partitions; ``keys`` are (column, descending), unique together and never NULL."""
    order = [F.col(c).desc() if descending else F.col(c).asc() for c, descending in keys]
    placed = units.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumn("_range", F.shiftright("_id", 33).cast("int")).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")
    path = f"{checkpoint_root(units.sparkSession)}/proratio/{uuid.uuid4().hex}"
    placed.write.partitionBy("_range").parquet(path)
    stored = units.sparkSession.read.schema(placed.schema).parquet(path)
    found = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.max_by(F.struct(*[c for c, _ in keys]), "_at").alias("_last"))
    # One row per range: few enough for one task to number.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return StoredOrder(path, placed.schema, tuple(keys), stage(found.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))))
