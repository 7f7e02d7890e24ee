"""The pricing domain, derived from the given tables.

A development is a nation, a unit is an order, its areas come from the order's
lines, its target total and imported price from the order totals. Everything is
derived from whole tables; nothing is invented but small configuration.
"""

from __future__ import annotations

import uuid
from decimal import Decimal
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proratio.operators import allocation, reproduction, rulegraph, serving
from proratio.operators.allocation import AllocationConfig
from proratio.session import checkpoint_root, counted, spread, stage
from proratio.sources.publish import Manifest
from proratio.sources.tables import read_table

CONFIG = AllocationConfig(
    bands={"GARDEN": (1, 2), "CENTRE": (3, 6), "SKY": (7, 10)},
    floor_factors={"GARDEN": Decimal("0.97"), "CENTRE": Decimal("1.03"), "SKY": Decimal("1.08")},
    position_factors={"F": Decimal("0.99"), "O": Decimal("1.01"), "P": Decimal("1.07")},
    parameters={allocation.UNCOVERED: Decimal("0.35")},
)

# run code, status, completed_at
RUNS = [
    ("PLAIN", "COMPLETED", "2026-03-02 08:15:00"),
    ("DECIDED", "COMPLETED", "2026-03-02 09:40:00"),
    ("BROKEN", "FAILED", "2026-03-02 10:05:00"),
]
OVERRIDE_RUN = "DECIDED"


RULESET = rulegraph.Ruleset(
    {
        "inputs": {
            n: {} for n in (
                "closed_area", "terrace_area", "unit_code_raw", "floor_text", "position_code_raw",
                "override_amount_derived", "UNCOVERED_AREA_FACTOR", "TARGET_PRICE_PER_M2",
            )
        },
        "rules": [
            {"output": "total_area", "operation": "sum", "operands": {"fields": ["closed_area", "terrace_area"]}},
            {"output": "weighted_area", "operation": "weighted_sum",
             "operands": {"base_fields": ["closed_area"], "weighted_field": "terrace_area",
                          "weight_parameter": "UNCOVERED_AREA_FACTOR"}},
            {"output": "floor_factor", "operation": "lookup_table",
             "operands": {"key_source_field": "unit_code_raw", "derivation": "magnitude_prefix",
                          "derivation_params": {"threshold": 10_000, "digits_below": 1, "digits_at_or_above": 2},
                          "missing_key_defaults": {"8": "0.06"}}},
            {"output": "corner_factor", "operation": "lookup_table_composite",
             "operands": {"key_source_fields": ["floor_text", "position_code_raw"], "key_separator": "-",
                          "table": {"1-F": "0.07", "4-O": "0.12", "6-P": "0.035", "9-F": "0.015"}}},
            {"output": "adjusted_area", "operation": "multiply_factors",
             "operands": {"base": "weighted_area", "factors": ["floor_factor"]}},
            {"output": "group_total", "operation": "group_sum", "operands": {"fields": ["adjusted_area"]}},
            {"output": "group_budget", "operation": "multiply_by_parameter",
             "operands": {"field": "group_total", "parameter": "TARGET_PRICE_PER_M2"}},
            {"output": "share", "operation": "ratio_to_group_total",
             "operands": {"numerator_field": "adjusted_area", "group_total_field": "group_total"}},
            {"output": "unit_price", "operation": "linear_price",
             "operands": {"participation_field": "share", "group_value_field": "group_budget",
                          "addend_field": "override_amount_derived"}},
            {"output": "price_per_m2", "operation": "divide",
             "operands": {"numerator_field": "unit_price", "denominator_field": "total_area"}},
            {"output": "idle_area", "operation": "sum", "status": "DORMANT", "operands": {"fields": ["terrace_area"]}},
            {"output": "idle_price", "operation": "multiply_factors",
             "operands": {"base": "idle_area", "factors": ["floor_factor"]}},
        ],
    }
)
LABELS = {
    "mode": "DEMO", "algorithm": allocation.ALGORITHM,
    "disclaimer": "derived from synthetic order tables", "source": "given tables",
}


class Domain:
    """Lazily derived domain tables of one data folder, for one query."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @cached_property
    def developments(self) -> DataFrame:
        """The dimension that bounds how many developments there are."""
        return self.table("nation").select(
            F.col("n_nationkey").alias("development_id"), F.col("n_name").alias("name"),
            F.col("n_regionkey").alias("region"),
        )

    @cached_property
    def bound(self) -> int:
        """How many developments there can be, counted once."""
        return counted(self.developments)

    @cached_property
    def all_units(self) -> DataFrame:
        """Every unit, valid or not, written once: the queries read it several times."""
        areas = self.table("lineitem").groupBy("l_orderkey").agg(
            F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("closed"), F.count("*").alias("terrace")
        )
        orders = spread(self.table("orders")).join(areas, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        customers = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        area = "decimal(12,2)"
        units = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("c_nationkey").alias("development_id"),
            F.col("c_mktsegment").alias("tower"),
            F.col("o_orderpriority").alias("typology"),
            F.col("o_orderkey").alias("unit_id"),
            F.col("o_orderkey").cast("string").alias("unit_code"),
            (F.col("o_orderkey") % 10 + 1).cast("int").alias("floor"),
            F.col("o_orderstatus").alias("position"),
            F.coalesce(F.col("closed"), F.lit(0)).cast(area).alias("private_area_m2"),
            F.coalesce(F.col("terrace"), F.lit(0)).cast(area).alias("uncovered_area_m2"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("order_total"),
            F.col("o_orderdate").alias("order_date"),
        )
        return stage(units)

    @cached_property
    def units(self) -> DataFrame:
        """Units that can be allocated; ``allocation.violations`` lists the others."""
        return self.all_units.where("private_area_m2 > 0")

    @cached_property
    def towers(self) -> DataFrame:
        """The towers there are, from the customers and not from the units."""
        return self.table("customer").select(F.col("c_nationkey").alias("development_id"), F.col("c_mktsegment").alias("tower")).distinct()

    @cached_property
    def typologies(self) -> DataFrame:
        """Every development offers the priorities that occur in any."""
        kinds = self.table("orders").select(F.col("o_orderpriority").alias("typology")).distinct().groupBy().agg(F.collect_set("typology").alias("all"))
        return self.developments.select("development_id").withColumn("typology", F.explode(kinds.scalar()))

    def manifest(self) -> Manifest:
        """A manifest of its own for one query."""
        return Manifest(self.spark, f"{checkpoint_root(self.spark)}/proratio/{uuid.uuid4().hex}")

    @cached_property
    def completed_runs(self) -> DataFrame:
        """(development_id, run_id, code, completed_at) of the completed runs."""
        return self.runs.where("status = 'COMPLETED'").select("development_id", "run_id", F.col("run_code").alias("code"), "completed_at")

    @property
    def run_bound(self) -> int:
        return self.bound * len(RUNS)

    @cached_property
    def targets(self) -> DataFrame:
        return self.units.groupBy("development_id").agg(
            F.sum("order_total").cast("decimal(18,2)").alias("target_value")
        )

    @cached_property
    def allocated(self) -> DataFrame:
        return allocation.allocate(self.units, self.targets, CONFIG, self.bound)

    @cached_property
    def stored_allocation(self) -> DataFrame:
        """The allocation as a stored table, for queries that read it more than once."""
        return stage(self.allocated)

    @cached_property
    def override_events(self) -> DataFrame:
        """Purchase events as override decisions on the order their user id names."""
        return (
            self.table("events")
            .where("event_type = 'purchase'")
            .select(
                F.col("user_id").alias("unit_id"), F.col("value").cast("decimal(18,2)").alias("override_delta"),
                F.col("ts").alias("decided_at"), "event_id",
            )
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Three runs per development."""
        rows = F.array(
            *[
                F.struct(F.lit(c).alias("run_code"), F.lit(s).alias("status"), F.lit(t).cast("timestamp").alias("completed_at"))
                for c, s, t in RUNS
            ]
        )
        return self.scenarios.select("scenario_id", "development_id", F.inline(rows)).withColumn(
            "run_id", F.concat_ws(":", "scenario_id", "run_code")
        )

    @cached_property
    def scenarios(self) -> DataFrame:
        """One scenario per development; every fifth is still a draft."""
        return self.developments.select(
            F.concat(F.lit("SC-"), F.col("development_id").cast("string")).alias("scenario_id"),
            "development_id",
            F.when(F.col("development_id") % 5 == 4, "DRAFT").otherwise("ACTIVE").alias("status"),
        )

    @cached_property
    def results(self) -> DataFrame:
        """The allocation stored under each completed run."""
        codes = [c for c, s, _ in RUNS if s == "COMPLETED"]
        rows = allocation.run_rows(self.stored_allocation, codes)
        return rows.withColumn(
            "run_id", F.concat(F.lit("SC-"), F.col("development_id").cast("string"), F.lit(":"), F.col("run_code"))
        )

    def priced_overrides(self, events: DataFrame) -> DataFrame:
        priced = allocation.apply_overrides(self.stored_allocation, events, ["unit_id"], carry=("development_id",))
        return priced.withColumn(
            "run_id", F.concat(F.lit("SC-"), F.col("development_id").cast("string"), F.lit(f":{OVERRIDE_RUN}"))
        )

    @cached_property
    def overrides(self) -> DataFrame:
        """Every override decision of the override run, priced."""
        return self.priced_overrides(self.override_events)

    @cached_property
    def last_overrides(self) -> DataFrame:
        """The newest decision per unit, priced. Chosen before the join, where tasks
        can reduce a unit with very many events; joined first it would fill one task."""
        newest = allocation.latest(self.override_events, ["unit_id"], F.col("decided_at"), F.col("event_id"))
        return self.priced_overrides(newest)

    @cached_property
    def current(self) -> DataFrame:
        return serving.unit_price_current(self.scenarios, self.runs, self.results, self.last_overrides, self.bound)

    @cached_property
    def dashboard_units(self) -> DataFrame:
        return serving.units_enriched(self.current)

    # --- rule graph and reproduction ---

    @cached_property
    def rule_units(self) -> DataFrame:
        """Unit records for the rule graph; none of its columns is a price of the unit."""
        override = (
            F.when((F.col("unit_id") % 333 == 0) & (F.col("development_id") % 6 == 1), "n/d")
            .when(F.col("unit_id") % 50 == 0, "100.25")
            .otherwise("0")
        )
        return self.units.select(
            "unit_id", F.col("development_id").alias("group_id"), F.col("unit_id").alias("ordinal"),
            F.col("private_area_m2").alias("closed_area"), F.col("uncovered_area_m2").alias("terrace_area"),
            (F.col("floor") * 1000 + F.col("unit_id") % 4).cast("string").alias("unit_code_raw"),
            F.concat(F.col("floor").cast("string"), F.lit(".0")).alias("floor_text"),
            F.col("position").alias("position_code_raw"), override.alias("override_amount_derived"),
            F.lit("0.35").alias("UNCOVERED_AREA_FACTOR"),
            (F.col("development_id") * 10 + 5000).cast("decimal(18,6)").alias("TARGET_PRICE_PER_M2"),
        )

    @cached_property
    def floor_table(self) -> DataFrame:
        """Floor factors per development; floor 8 has none, and floor 7 has none in some developments."""
        floors = F.explode(F.sequence(F.lit(1), F.lit(10)))
        return (
            self.developments.select(F.col("development_id").alias("group_id"), floors.alias("f"))
            .where("f <> 8 and not (f = 7 and group_id % 8 = 5)")
            .select(
                "group_id", F.col("f").cast("string").alias("category_key"),
                ((F.col("f") - 5).cast("decimal(4,0)") * F.lit("0.01").cast("decimal(2,2)")).alias("factor"),
            )
        )

    @cached_property
    def evaluated(self) -> DataFrame:
        return self.evaluated_rules(list(RULESET.rules))

    def evaluated_rules(self, outputs: list[str]) -> DataFrame:
        """Only the rules that ``outputs`` need."""
        return rulegraph.evaluate(self.rule_units, RULESET.only(outputs), tables={"floor_factor": self.floor_table}, bound=self.bound)

    @cached_property
    def reproduced(self) -> DataFrame:
        """Reproduced prices as a stored table: the check reads them more than once."""
        return stage(self.evaluated.select(F.col("group_id").alias("development_id"), "unit_id", "unit_price"))

    @cached_property
    def reference_prices(self) -> DataFrame:
        """Imported prices, worked out from the units' own figures and not by the rule graph.

        A price is the weighted area at the development's rate, plus the amount decided;
        by a rule of the unit it is off by a cent, by less than a unit of money, by a
        share, is the order's total, or is absent.
        """
        def exact(text, kind):
            return F.lit(text).cast(kind)

        unit, dev, floor = F.col("unit_id"), F.col("development_id"), F.col("floor")
        slope = (
            F.when(floor == 8, exact("1.06", "decimal(4,2)"))
            .when((floor == 7) & (dev % 8 == 5), F.lit(None))
            .otherwise(exact("1", "decimal(4,2)") + (floor - 5).cast("decimal(4,0)") * exact("0.01", "decimal(2,2)"))
        ).cast("decimal(5,2)")
        area = F.col("private_area_m2") + F.col("uncovered_area_m2") * exact("0.35", "decimal(2,2)")
        decided = (
            F.when((unit % 333 == 0) & (dev % 6 == 1), F.lit(None)).when(unit % 50 == 0, exact("100.25", "decimal(5,2)")).otherwise(exact("0", "decimal(5,2)"))
        ).cast("decimal(5,2)")
        own = F.round(area * slope * (dev * 10 + 5000).cast("decimal(8,0)") + decided, 2).cast("decimal(18,2)")
        kind = unit % 8
        price = (
            F.when((kind == 5) | F.col("own").isNull(), F.col("order_total"))
            .when(kind == 2, F.col("own") + exact("0.01", "decimal(18,2)"))
            .when(kind == 3, F.col("own") + exact("0.75", "decimal(18,2)"))
            .when(kind == 4, F.col("own") + F.floor(F.col("own") / 20000).cast("decimal(12,0)"))
            .otherwise(F.col("own"))
        )
        return self.units.withColumn("own", own).where(kind != 6).select(
            "unit_id", price.cast("decimal(18,2)").alias("source_reference_price"),
            F.concat(F.lit("IMPORTED-"), dev.cast("string")).alias("imported_run_id"),
        )

    @cached_property
    def reproduction_runs(self) -> DataFrame:
        """Two reproductions of each development; in every third one the newer failed."""
        rows = F.array(*[
            F.struct(F.lit(n).alias("n"), F.lit(f"2026-03-0{n} 07:00:00").cast("timestamp").alias("completed_at")) for n in (1, 2)
        ])
        found = self.developments.select("development_id", F.inline(rows))
        return found.select(
            F.concat_ws("-", F.lit("REPRO"), "development_id", "n").alias("id"), "development_id", "completed_at",
            F.when((F.col("n") == 2) & (F.col("development_id") % 3 == 0), "FAILED").otherwise("COMPLETED").alias("status"),
        )

    @cached_property
    def comparisons(self) -> DataFrame:
        return reproduction.compare(self.reproduced, self.reference_prices)
