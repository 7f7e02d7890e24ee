"""Proportional allocation: spread a target over units by area and calibration weights.

Units carry ``development_id, tower, unit_code, typology, floor, position,
private_area_m2 decimal(12,2), uncovered_area_m2 decimal(12,2)``; targets carry
``development_id, target_value decimal(18,2)``. ``units`` is read three times,
so pass a stored table (see ``session.stage``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proratio.functions.exact import div, half_even, half_of, mul_div, power, unscale, whole
from proratio.functions.text import DIGEST_WORDS, digest_sums, fixed_text, json_object, json_string
from proratio.session import attach, skew_join, stage

ALGORITHM = "REFERENCE_ALLOCATION_V1"
UNCOVERED = "UNCOVERED_AREA_FACTOR"
FLOOR_SET = "FLOOR_BAND"
POSITION_SET = "POSITION_CATEGORY"

AREA_DIGITS, AREA_SCALE = 12, 2
# Digits of a weighted area; a unit of a billion square metres is refused.
WEIGHT_DIGITS = 11
MONEY_DIGITS = 18
# Spark widens a sum by ten digits, enough for ten billion units in a group.
SUM_DIGITS = 10


class ScenarioError(ValueError):
    """An input that cannot be allocated; nothing is computed from it."""


def decimals(value: Decimal) -> int:
    """Places a factor really uses: 1.050 uses two."""
    return max(0, -value.normalize().as_tuple().exponent)


@dataclass(frozen=True)
class AllocationConfig:
    """Bands, calibration factors and parameters of one scenario (configuration-sized)."""

    bands: dict[str, tuple[int, int]]
    floor_factors: dict[str, Decimal]
    position_factors: dict[str, Decimal]
    parameters: dict[str, Decimal] = field(default_factory=dict)

    @property
    def uncovered(self) -> Decimal:
        if UNCOVERED not in self.parameters:
            raise ScenarioError(f"missing parameter {UNCOVERED}")
        return self.parameters[UNCOVERED]

    @property
    def scales(self) -> tuple[int, int, int]:
        """Places of the uncovered, floor and position factors."""
        tables = ([self.uncovered], self.floor_factors.values(), self.position_factors.values())
        return tuple(max([decimals(v) for v in t], default=0) for t in tables)

    def problems(self) -> list[str]:
        """What is wrong with the configuration itself."""
        found = [f"band without calibration: {b}" for b in self.bands if b not in self.floor_factors]
        found += [f"band out of order: {b} {lo}..{hi}" for b, (lo, hi) in self.bands.items() if lo > hi]
        if UNCOVERED not in self.parameters:
            found.append(f"missing parameter {UNCOVERED}")
        return found

    def check(self) -> None:
        problems = self.problems()
        if problems:
            raise ScenarioError("; ".join(problems))


def floor_band(floor: Column, bands: dict[str, tuple[int, int]]) -> Column:
    """The first band, in declaration order, whose inclusive range holds the floor; NULL if none."""
    chain = F.lit(None).cast("string")
    for name, (low, high) in reversed(list(bands.items())):
        chain = F.when(floor.between(low, high), F.lit(name)).otherwise(chain)
    return chain


def band_table(bands: DataFrame, owner: str = "development_id") -> DataFrame:
    """Bands as one row per floor, so that the range join becomes a hash join.

    ``bands`` has ``development_id, band, low, high, ordinal``. Where ranges
    overlap the lowest ordinal wins.
    """
    floors = bands.where("low <= high").select(owner, F.explode(F.sequence("low", "high")).alias("floor"), "band", "ordinal")
    return floors.groupBy(owner, "floor").agg(F.min_by("band", "ordinal").alias("floor_band"))


def factor(key: Column, factors: dict[str, Decimal], scale: int) -> Column:
    """Calibration factor of a category; NULL on a miss."""
    kind = f"decimal({scale + 6},{scale})"
    if not factors:
        return F.lit(None).cast(kind)
    entries = [part for k, v in factors.items() for part in (F.lit(k), F.lit(str(v)).cast(kind))]
    return F.try_element_at(F.create_map(*entries), key)


def weighted_area(private: Column, uncovered: Column, uncovered_factor: Column) -> Column:
    return private + uncovered * uncovered_factor


def weight_columns(config: AllocationConfig, scales: tuple[int, int, int]) -> dict[str, Column]:
    """Area, band, factors and exact weight of a unit, from its own columns."""
    config.check()
    s_unc, s_floor, s_pos = scales
    area_scale = AREA_SCALE + s_unc
    unc = F.lit(str(config.uncovered)).cast(f"decimal({s_unc + 6},{s_unc})")
    band = floor_band(F.col("floor"), config.bands)
    floor, position = factor(band, config.floor_factors, s_floor), factor(F.col("position"), config.position_factors, s_pos)
    area = weighted_area(F.col("private_area_m2"), F.col("uncovered_area_m2"), unc).cast(
        f"decimal({AREA_DIGITS - AREA_SCALE + 1 + area_scale},{area_scale})"
    )
    return {
        "floor_band": band, "floor_factor": floor, "position_factor": position, "area_weight": area,
        "combined_factor": floor * position,
        "adjustment_weight": (area * (floor * position)).cast(f"decimal({weight_digits(scales)},{area_scale + s_floor + s_pos})"),
    }


def unit_weights(units: DataFrame, config: AllocationConfig) -> DataFrame:
    """Weights of every unit: expressions only, no join."""
    return units.withColumns(weight_columns(config, config.scales))


def weight_digits(scales: tuple[int, int, int]) -> int:
    """Digits of a unit weight: area, its factors' places, and two digits of growth."""
    digits = WEIGHT_DIGITS + 2 + sum(scales)
    if digits + SUM_DIGITS > 36:
        raise ScenarioError(f"factors need {digits} digits; give them with fewer places")
    return digits


def group_totals(weights: DataFrame, targets: DataFrame, scales: tuple[int, int, int], bound, group: list[str]) -> DataFrame:
    """Per group: total weight, target, and the unit that takes the rounding residual.

    That unit has the largest share; ties go to the lowest tower, then the lowest
    unit code (a unit without a tower before those with one). The largest weight is a
    plain maximum, and only the few units that reach it are compared by name. A group
    with a unit that has no weight gets no total: what it lacks blocks it, as a whole.
    """
    measured = weights.groupBy(*group).agg(
        F.when(F.count("adjustment_weight") == F.count(F.lit(1)), F.sum("adjustment_weight")).alias("total_weight"),
        F.max("adjustment_weight").alias("top_weight"),
    )
    digits = weight_digits(scales) + SUM_DIGITS
    total = whole(F.col("total_weight"), AREA_SCALE + sum(scales), digits)
    measured = stage(
        attach(measured, targets, group, bound, "inner").withColumn("total_whole", total).select(
            *group, "target_value", whole(F.col("target_value"), 2, MONEY_DIGITS).alias("target_c"), "total_whole",
            half_of(F.col("total_whole"), digits).alias("half_whole"), "top_weight",
        )
    )
    named = attach(
        weights.select(*group, "tower", "unit_code", "adjustment_weight"), measured.select(*group, "top_weight"), group, bound, "inner"
    ).where("adjustment_weight = top_weight")
    tops = named.groupBy(*group).agg(F.min(F.struct("tower", "unit_code")).alias("top"))
    return stage(
        attach(measured, tops, group, bound).select(
            *group, "target_value", "target_c", "total_whole", "half_whole", F.col("top.tower").alias("top_tower"),
            F.col("top.unit_code").alias("top_unit"),
        )
    )


def unpriced(weights: DataFrame) -> DataFrame:
    """Units whose weight is missing, and what they lack: the reasons their groups have no prices."""
    lacks = F.array_compact(F.array(
        F.when(F.col("floor_factor").isNull(), F.lit("floor_factor")), F.when(F.col("position_factor").isNull(), F.lit("position_factor")),
        F.when(F.col("area_weight").isNull(), F.lit("area_weight")),
    ))
    return weights.where(F.col("adjustment_weight").isNull()).select("development_id", "tower", "unit_code", F.array_join(lacks, ",").alias("missing"))


def allocate(units: DataFrame, targets: DataFrame, config: AllocationConfig, bound=None) -> DataFrame:
    """Price every unit so that each development sums to its target, to the cent.

    ``bound`` proves the number of developments (see ``session.attach``); by
    default the targets table itself is counted.
    """
    return allocate_weights(units.columns, unit_weights(units, config), targets, config.scales, bound)


def table_weights(units: DataFrame, bands: DataFrame, calibrations: DataFrame, parameters: DataFrame,
                  scales: tuple[int, int, int], bounds: tuple, owner: str = "development_id") -> DataFrame:
    """``unit_weights`` where every ``owner`` (a development) brings its own bands, factors and parameter.

    ``calibrations`` carries the owner, ``set_code, category_key, factor``;
    ``parameters`` the owner, ``key, numeric_value``. ``scales`` says how many places
    the three factors use and ``bounds`` how many floors the bands cover, and how many
    calibration entries and parameters there can be.
    """
    s_unc, s_floor, s_pos = scales
    area_scale = AREA_SCALE + s_unc
    floors = band_table(bands, owner)
    rows = attach(units, floors, [owner, "floor"], bounds[0])
    for code, key, name, scale in ((FLOOR_SET, "floor_band", "floor_factor", s_floor), (POSITION_SET, "position", "position_factor", s_pos)):
        entries = calibrations.where(F.col("set_code") == code).select(
            owner, F.col("category_key").alias(key), F.col("factor").cast(f"decimal({scale + 6},{scale})").alias(name)
        )
        rows = attach(rows, entries, [owner, key], bounds[1])
    unc = parameters.where(F.col("key") == UNCOVERED).select(
        owner, F.col("numeric_value").cast(f"decimal({s_unc + 6},{s_unc})").alias("_unc")
    )
    rows = attach(rows, unc, owner, bounds[2])
    kind = f"decimal({weight_digits(scales)},{area_scale + s_floor + s_pos})"
    area = weighted_area(F.col("private_area_m2"), F.col("uncovered_area_m2"), F.col("_unc"))
    return (
        rows.withColumn("area_weight", area.cast(f"decimal({AREA_DIGITS - AREA_SCALE + 1 + area_scale},{area_scale})"))
        .drop("_unc")
        .withColumn("combined_factor", F.col("floor_factor") * F.col("position_factor"))
        .withColumn("adjustment_weight", (F.col("area_weight") * F.col("combined_factor")).cast(kind))
    )


def allocate_weights(columns: list[str], weights: DataFrame, targets: DataFrame, scales: tuple[int, int, int], bound=None,
                     group: tuple[str, ...] = ("development_id",)) -> DataFrame:
    """Prices from weights whose three factors use ``scales`` places; each ``group`` has a target."""
    group = list(group)
    bound = targets if bound is None else bound
    scale = AREA_SCALE + sum(scales)
    w_digits = weight_digits(scales)
    total_digits = w_digits + SUM_DIGITS
    totals = group_totals(weights, targets, scales, bound, group)
    w = whole(F.col("adjustment_weight"), scale, w_digits)
    total, half = F.col("total_whole"), F.col("half_whole")
    joined = attach(weights, totals, group, bound, "inner").withColumn(
        "rounded_c", mul_div(F.col("target_c"), w, total, digits=(MONEY_DIGITS, w_digits, total_digits), half=half)
    )
    sums = joined.groupBy(*group).agg(F.sum("rounded_c").alias("sum_c"))
    residual = attach(totals, sums, group, bound, "inner").select(
        *group, "top_tower", "top_unit", (F.col("target_c").cast("bigint") - F.col("sum_c")).alias("residual_c")
    )
    # (tower, unit_code) is unique in a development, so one unit takes the residual.
    closed = attach(joined.drop("top_tower", "top_unit"), residual, group, bound, "inner")
    takes = F.col("tower").eqNullSafe(F.col("top_tower")) & F.col("unit_code").eqNullSafe(F.col("top_unit"))
    price_c = F.col("rounded_c") + F.when(takes, F.col("residual_c")).otherwise(F.lit(0))
    million, hundred = power(6), F.lit("100").cast("decimal(3,0)")
    area_c = whole(F.col("private_area_m2"), AREA_SCALE, AREA_DIGITS)
    # Sixteen digits of cents and an area of one hundredth: beyond, the whole-number quotient would wrap.
    fits = F.abs(F.col("price_c")) < F.lit(10**16)
    per_area = mul_div(
        F.when(fits | F.col("price_c").isNull(), F.col("price_c")).otherwise(F.raise_error(F.lit("a price of over 16 digits of cents")).cast("bigint")).cast("decimal(18,0)"), hundred, area_c, digits=(18, 3, AREA_DIGITS),
        half=div(area_c, F.lit(2).cast("decimal(1,0)")).cast("decimal(12,0)"),
    )
    return closed.withColumn("price_c", price_c).select(
        *[c for c in columns if c != "floor_band"],
        "floor_band",
        "floor_factor",
        "position_factor",
        F.col("area_weight").alias("weighted_area_m2"),
        F.col("combined_factor").alias("combined_weight_factor"),
        "adjustment_weight",
        unscale(mul_div(w, million, total, digits=(w_digits, 7, total_digits), even=True, half=half), 6, 9).alias("participation_share"),
        unscale(F.col("price_c"), 2, MONEY_DIGITS).alias("system_price"),
        F.when(takes & (F.col("residual_c") != 0), unscale(F.col("residual_c"), 2, MONEY_DIGITS)).alias("residual_applied"),
        unscale(per_area, 2, MONEY_DIGITS).alias("price_per_m2"),
        "target_value",
    )


def violations(units: DataFrame, targets: DataFrame, config: AllocationConfig, towers: DataFrame | None = None,
               typologies: DataFrame | None = None) -> DataFrame:
    """Every reason an input cannot be allocated, as ``rule, development_id, key, detail``."""
    def rows(df, rule, key, detail):
        return df.select(
            F.lit(rule).alias("rule"), "development_id", key.cast("string").alias("key"),
            detail.cast("string").alias("detail"),
        )

    unit = F.concat_ws("/", "tower", "unit_code")
    weights = units.withColumn("band", floor_band(F.col("floor"), config.bands))
    known = list(config.position_factors)
    flags = F.array_compact(
        F.array(
            F.when(~(F.col("private_area_m2") > 0), F.struct(F.lit("area_not_positive").alias("rule"),
                   F.col("private_area_m2").cast("string").alias("detail"))),
            F.when(F.col("band").isNull(), F.struct(F.lit("floor_without_band").alias("rule"),
                   F.col("floor").cast("string").alias("detail"))),
            F.when(~F.coalesce(F.col("position").isin(known), F.lit(False)),
                   F.struct(F.lit("position_without_calibration").alias("rule"), F.col("position").alias("detail"))),
        )
    )
    per_unit = weights.select("development_id", unit.alias("key"), F.explode(flags).alias("f")).select(
        F.col("f.rule").alias("rule"), "development_id", "key", F.col("f.detail").alias("detail")
    )
    repeated = units.groupBy("development_id", "tower", "unit_code").count().where("count > 1")
    found = per_unit.unionByName(rows(repeated, "duplicate_unit", unit, F.col("count")))
    found = found.unionByName(
        rows(targets.where("target_value <= 0"), "target_not_positive", F.col("development_id"), F.col("target_value"))
    )
    for known_rows, column, rule in ((towers, "tower", "unknown_tower"), (typologies, "typology", "unknown_typology")):
        if known_rows is not None:
            missing = units.join(known_rows.select("development_id", column), ["development_id", column], "left_anti")
            found = found.unionByName(rows(missing, rule, unit, F.col(column)))
    return found


def require_valid(*args, **kwargs) -> None:
    """Raise ScenarioError with a few examples when any violation exists."""
    sample = violations(*args, **kwargs).limit(5).collect()
    if sample:
        raise ScenarioError("; ".join(f"{r['rule']}: {r['key']} ({r['detail']})" for r in sample))


def reconciliation(allocated: DataFrame) -> DataFrame:
    """VGV_RECONCILIATION per development: expected, actual, difference, severity; ERROR as well where prices are missing."""
    return (
        allocated.groupBy("development_id")
        .agg(F.max("target_value").alias("expected_value"), F.sum("system_price").cast("decimal(18,2)").alias("actual_value"),
             F.count_if(F.col("system_price").isNull()).alias("unpriced"))
        .withColumn("difference", (F.col("actual_value") - F.col("expected_value")).cast("decimal(18,2)"))
        .withColumn("severity", F.when((F.col("difference") == 0) & (F.col("unpriced") == 0), "INFO").otherwise("ERROR"))
        .drop("unpriced")
        .withColumn("check_type", F.lit("VGV_RECONCILIATION"))
    )


def adjustment_steps() -> Column:
    """The three ordered steps of a priced unit, each with what it started from and the source of its factor."""
    value, rate = "decimal(18,6)", "decimal(12,6)"
    after_floor = (F.col("weighted_area_m2") * F.col("floor_factor")).cast(value)

    def step(order, kind, start, rate_column, result, source, entry):
        return F.struct(
            F.lit(order).alias("sequence_order"), F.lit(kind).alias("adjustment_type"),
            start.cast(value).alias("input_value"), rate_column.cast(rate).alias("factor_value"),
            result.cast(value).alias("result_value"), source.alias("source_set"), entry.alias("source_key"),
        )

    return F.array(
        step(1, "AREA_WEIGHTING", F.col("private_area_m2"), F.lit(None), F.col("weighted_area_m2"),
             F.lit("PARAMETER"), F.lit(UNCOVERED)),
        step(2, "FLOOR_PREMIUM", F.col("weighted_area_m2"), F.col("floor_factor"), after_floor,
             F.lit(FLOOR_SET), F.col("floor_band")),
        step(3, "POSITION_PREMIUM", after_floor, F.col("position_factor"), F.col("adjustment_weight"),
             F.lit(POSITION_SET), F.col("position")),
    )


def adjustment_trail(allocated: DataFrame) -> DataFrame:
    """The steps of every unit as rows."""
    return allocated.select("development_id", "tower", "unit_code", F.inline(adjustment_steps()))


def apply_overrides(prices: DataFrame, events: DataFrame, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """One priced record per override event: previous, proposed = final, impact.

    A unit may have any share of the events: the join divides the rows of such a unit.
    The system price is never changed. Events that name no priced unit are left
    out here; ``override_errors`` lists them. ``carry`` names more columns of the
    priced unit to keep.
    """
    final = F.round(F.col("system_price") + F.col("override_delta"), 2).cast("decimal(18,2)")
    return (
        skew_join(events, prices.select(*keys, *carry, "system_price"), keys)
        .withColumn("previous_price", F.col("system_price"))
        .withColumn("proposed_price", final)
        .withColumn("final_price", final)
        .withColumn("vgv_impact", (final - F.col("system_price")).cast("decimal(18,2)"))
        .drop("system_price")
    )


def override_errors(prices: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    return events.join(prices.select(*keys), keys, "left_anti")


def latest(events: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Newest row per key. ``order`` is descending and must end in a unique column."""
    record = F.struct(*[F.col(c) for c in events.columns if c not in keys])
    return events.groupBy(*keys).agg(F.max_by(record, F.struct(*order)).alias("r")).select(*keys, "r.*")


def run_totals(allocated: DataFrame, overrides: DataFrame, bound) -> DataFrame:
    """Target, system total, final total and the change the overrides made."""
    system = allocated.groupBy("development_id").agg(
        F.max("target_value").alias("target_vgv"), F.sum("system_price").cast("decimal(18,2)").alias("system_vgv")
    )
    change = overrides.groupBy("development_id").agg(F.sum("vgv_impact").cast("decimal(18,2)").alias("d"))
    zero = F.lit(0).cast("decimal(18,2)")
    delta = F.coalesce(F.col("d"), zero)
    return attach(system, change, "development_id", bound, "left").select(
        "development_id", "target_vgv", "system_vgv",
        (F.col("system_vgv") + delta).cast("decimal(18,2)").alias("final_vgv"),
        delta.alias("vgv_delta_after_override"),
    )


def unit_payload(allocated: DataFrame) -> DataFrame:
    """Each unit as canonical JSON text: keys in order, no blanks, decimals as fixed-point text.

    Fields are first quantised to the scale they are stored at, ties to even.
    """
    fields = {
        "combined_weight_factor": fixed_text(half_even(F.col("combined_weight_factor"), 6, 12)),
        "participation_share": fixed_text(F.col("participation_share")),
        "system_calculated_price": fixed_text(F.col("system_price")),
        "system_calculated_price_per_m2": fixed_text(F.col("price_per_m2")),
        "tower_business_key": json_string(F.col("tower")),
        "unit_code": json_string(F.col("unit_code")),
        "weighted_area_m2": fixed_text(half_even(F.col("weighted_area_m2"), 4, 16)),
    }
    return allocated.select(
        "development_id", "tower", "unit_code", "target_value", "system_price",
        json_object({k: F.coalesce(v, F.lit("null")) for k, v in fields.items()}).alias("payload"),
    )


def logical_hash(allocated: DataFrame, bound, algorithm: str = ALGORITHM) -> DataFrame:
    """SHA-256 per development over target, total, number and digests of its canonical units.

    The units' digests enter as sums of their words, so their order does not matter, a
    development of any size is added up where its units are, and no text is gathered.
    ``bound`` is not needed any more; no table is joined.
    """
    units = unit_payload(allocated).withColumn("digest", F.sha2("payload", 256))
    sums = units.groupBy("development_id").agg(
        F.max("target_value").alias("target_value"), F.sum("system_price").cast("decimal(18,2)").alias("total"),
        F.count(F.lit(1)).alias("units"), *digest_sums(F.col("digest")),
    )
    document = json_object(
        {
            "algorithm": json_string(F.lit(algorithm)),
            "target_vgv": fixed_text(F.col("target_value")),
            "total_system_price": F.coalesce(fixed_text(F.col("total")), F.lit("null")),
            "units": json_string(F.concat_ws(",", "units", *DIGEST_WORDS)),
        }
    )
    return sums.select("development_id", F.sha2(document, 256).alias("logical_hash"))


def published_hash(allocated: DataFrame, algorithm: str = ALGORITHM) -> DataFrame:
    """SHA-256 per development of its one published document, which lists all units in order.

    The document is as long as the development, so this is for exchange of small
    developments with programs that know this form; ``logical_hash`` is for all.
    """
    docs = unit_payload(allocated).groupBy("development_id").agg(
        F.max("target_value").alias("target_value"), F.sum("system_price").cast("decimal(18,2)").alias("total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tower", "unit_code", "payload"))), lambda u: u["payload"]), ",").alias("body"),
    )
    document = json_object(
        {
            "algorithm": json_string(F.lit(algorithm)),
            "target_vgv": fixed_text(F.col("target_value")),
            "total_system_price": fixed_text(F.col("total")),
            "units": F.concat(F.lit("["), F.col("body"), F.lit("]")),
        }
    )
    return docs.select("development_id", F.sha2(document, 256).alias("logical_hash"))


def run_rows(allocated: DataFrame, codes: list[str]) -> DataFrame:
    """The same allocation stored under several runs."""
    return allocated.withColumn("run_code", F.explode(F.array(*[F.lit(c) for c in codes])))


def verify(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Expected against stored values: one row per key and field that differ."""
    e = expected.select(*keys, *[F.col(f).alias(f"e_{f}") for f in fields])
    a = actual.select(*keys, *[F.col(f).alias(f"a_{f}") for f in fields])
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f"e_{f}").cast("string").alias("expected"),
                     F.col(f"a_{f}").cast("string").alias("actual"))
            for f in fields
        ]
    )
    return (
        e.join(a, keys, "full").select(*keys, F.inline(pairs)).where("not (expected <=> actual)")
    )


def config_tables(spark, configs: dict[str, AllocationConfig]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bands, calibration entries and parameters of named configurations, as tables keyed by ``variant``."""
    bands, entries, parameters = [], [], []
    for name, config in configs.items():
        config.check()
        bands += [(name, b, lo, hi, i) for i, (b, (lo, hi)) in enumerate(config.bands.items())]
        for code, factors in ((FLOOR_SET, config.floor_factors), (POSITION_SET, config.position_factors)):
            entries += [(name, code, k, v) for k, v in factors.items()]
        parameters += [(name, k, v) for k, v in config.parameters.items()]
    return (
        spark.createDataFrame(bands, "variant string, band string, low int, high int, ordinal int"),
        spark.createDataFrame(entries, "variant string, set_code string, category_key string, factor decimal(12,6)"),
        spark.createDataFrame(parameters, "variant string, key string, numeric_value decimal(18,6)"),
    )


def sensitivity(units: DataFrame, targets: DataFrame, variants: dict[str, tuple[AllocationConfig, Decimal]],
                bound: int | None = None) -> DataFrame:
    """The allocation under several configurations and target multiples.

    Every unit is read as one row per variant, so all variants take as many passes
    as one. ``bound`` is the number of developments, if known.
    """
    scales = tuple(max(s) for s in zip(*[config.scales for config, _ in variants.values()]))
    configs = {n: c for n, (c, _) in variants.items()}
    bands, calibrations, parameters = config_tables(units.sparkSession, configs)
    sizes = (
        sum(max(0, hi - lo + 1) for c in configs.values() for lo, hi in c.bands.values()),
        sum(len(c.floor_factors) + len(c.position_factors) for c in configs.values()),
        sum(len(c.parameters) for c in configs.values()),
    )
    goals = F.array(*[
        F.struct(F.lit(name).alias("variant"),
                 F.round(F.col("target_value") * F.lit(str(multiple)).cast("decimal(6,2)"), 2).cast("decimal(18,2)").alias("target_value"))
        for name, (_, multiple) in variants.items()
    ])
    each = units.withColumn("variant", F.explode(F.array(*[F.lit(n) for n in variants])))
    weights = table_weights(each, bands, calibrations, parameters, scales, sizes, "variant")
    wanted = targets.select("development_id", F.inline(goals))
    limit = wanted if bound is None else bound * len(variants)
    columns = ["variant", "development_id", "tower", "unit_code", "typology"]
    priced = allocate_weights(columns, weights, wanted, scales, limit, ("variant", "development_id"))
    return priced.select(*columns, "floor_band", "system_price", "participation_share")


def participation_by(allocated: DataFrame, *keys: str) -> DataFrame:
    """Shares and totals by band, typology or variant."""
    return allocated.groupBy(*keys).agg(
        F.count("*").alias("units"),
        F.sum("participation_share").cast("decimal(18,6)").alias("share"),
        F.sum("system_price").cast("decimal(18,2)").alias("system_vgv"),
    )
