"""Allocation, serving, rule graph and reproduction queries."""

from __future__ import annotations

import uuid
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import functions as F

from proratio.operators import allocation, reproduction, reproduction_runs, rulegraph, runs, serving
from proratio.plans import sql
from proratio.plans.domain import CONFIG, LABELS, OVERRIDE_RUN, RULESET
from proratio.plans.registry import query
from proratio.session import attach, checkpoint_root, stage
from proratio.sources import files, scenario

M = sql.M
PRICE_COLUMNS = [
    "development_id", "tower", "typology", "unit_id", "floor", "floor_band", "position", "private_area_m2",
    "uncovered_area_m2", "floor_factor", "position_factor", "weighted_area_m2", "combined_weight_factor",
    "participation_share", "system_price", "residual_applied", "price_per_m2",
]


# --- allocation ---


@query("allocation_prices", f"WITH {sql.ALLOC} SELECT {', '.join(PRICE_COLUMNS)} FROM alloc")
def allocation_prices(d):
    """Refused as a whole if any unit, target or factor is invalid."""
    allocation.require_valid(d.units, d.targets, CONFIG, towers=d.towers, typologies=d.typologies)
    return d.allocated.select(*PRICE_COLUMNS)


@query(
    "allocation_violations",
    f"""WITH {sql.UNITS} SELECT 'area_not_positive' AS rule, development_id, tower || '/' || unit_code AS "key",
    CAST(private_area_m2 AS VARCHAR) AS detail FROM all_units WHERE NOT private_area_m2 > 0
    UNION ALL SELECT 'position_without_calibration', development_id, tower || '/' || unit_code, position
    FROM all_units WHERE position NOT IN ('F','O','P')
    UNION ALL SELECT 'duplicate_unit', development_id, tower || '/' || unit_code, CAST(count(*) AS VARCHAR)
    FROM all_units GROUP BY development_id, tower, unit_code HAVING count(*) > 1""",
)
def allocation_violations(d):
    return allocation.violations(d.all_units, d.targets, CONFIG, towers=d.towers)


@query(
    "allocation_reconciliation",
    f"""WITH {sql.ALLOC} SELECT development_id, max(target_value) AS expected_value, CAST(sum(system_price) AS {M}) AS actual_value,
    CAST(sum(system_price) - max(target_value) AS {M}) AS difference,
    CASE WHEN sum(system_price) = max(target_value) THEN 'INFO' ELSE 'ERROR' END AS severity,
    'VGV_RECONCILIATION' AS check_type FROM alloc GROUP BY 1""",
)
def allocation_reconciliation(d):
    return allocation.reconciliation(d.allocated)


@query(
    "allocation_totals",
    f"""WITH {sql.ALLOC},{sql.OVERRIDES}, change AS (SELECT development_id, sum(vgv_impact) AS v FROM newest GROUP BY 1)
    SELECT a.development_id, max(target_value) AS target_vgv, CAST(sum(system_price) AS {M}) AS system_vgv,
    CAST(sum(system_price) + coalesce(max(v), 0) AS {M}) AS final_vgv, CAST(coalesce(max(v), 0) AS {M}) AS vgv_delta_after_override
    FROM alloc a LEFT JOIN change c ON c.development_id = a.development_id GROUP BY 1""",
)
def allocation_totals(d):
    return allocation.run_totals(d.stored_allocation, d.last_overrides, d.bound)


@query(
    "adjustment_trail",
    f"""WITH {sql.ALLOC}, steps AS (
    SELECT development_id, tower, unit_code, 1 AS sequence_order, 'AREA_WEIGHTING' AS adjustment_type,
      CAST(private_area_m2 AS DECIMAL(18,6)) AS input_value, CAST(NULL AS DECIMAL(12,6)) AS factor_value,
      CAST(weighted_area_m2 AS DECIMAL(18,6)) AS result_value, 'PARAMETER' AS source_set, 'UNCOVERED_AREA_FACTOR' AS source_key FROM alloc
    UNION ALL SELECT development_id, tower, unit_code, 2, 'FLOOR_PREMIUM', CAST(weighted_area_m2 AS DECIMAL(18,6)),
      CAST(floor_factor AS DECIMAL(12,6)), CAST(weighted_area_m2 * floor_factor AS DECIMAL(18,6)), 'FLOOR_BAND', floor_band FROM alloc
    UNION ALL SELECT development_id, tower, unit_code, 3, 'POSITION_PREMIUM', CAST(weighted_area_m2 * floor_factor AS DECIMAL(18,6)),
      CAST(position_factor AS DECIMAL(12,6)), CAST(adjustment_weight AS DECIMAL(18,6)), 'POSITION_CATEGORY', position FROM alloc)
    SELECT * FROM steps""",
)
def adjustment_trail(d):
    return allocation.adjustment_trail(d.allocated)


@query(
    "override_latest",
    f"""WITH {sql.ALLOC},{sql.OVERRIDES} SELECT run_id, unit_id, final_price, decided_at, event_id FROM newest""",
)
def override_latest(d):
    return serving.latest_overrides(d.last_overrides)


@query(
    "override_applied",
    f"""WITH {sql.ALLOC},{sql.OVERRIDES} SELECT unit_id, event_id, decided_at, override_delta, previous_price,
    final_price AS proposed_price, final_price, CAST(vgv_impact AS {M}) AS vgv_impact FROM overrides""",
)
def override_applied(d):
    return d.overrides.select(
        "unit_id", "event_id", "decided_at", "override_delta", "previous_price", "proposed_price", "final_price", "vgv_impact"
    )


@query(
    "override_errors",
    f"""WITH {sql.UNITS} SELECT user_id AS unit_id, event_id FROM events
    WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM units u WHERE u.unit_id = user_id)""",
)
def override_errors(d):
    return allocation.override_errors(d.units, d.override_events, ["unit_id"]).select("unit_id", "event_id")


GAPS_SQL = sql.UNITS.replace("units AS (SELECT * FROM all_units", """units AS (SELECT * REPLACE (CASE WHEN unit_id % 7 <> 0 THEN tower END AS tower,
  CASE WHEN development_id % 6 = 1 AND unit_id % 97 = 0 THEN 'X' ELSE position END AS position) FROM all_units""") + "," + sql.allocation()


@query(
    "allocation_blocked",
    f"""WITH {GAPS_SQL}, found AS (SELECT *, count(*) OVER w > count(position_factor) OVER w AS lacks FROM alloc WINDOW w AS (PARTITION BY development_id))
    SELECT development_id, unit_id, tower, CASE WHEN NOT lacks THEN system_price END AS system_price,
    CASE WHEN NOT lacks THEN residual_applied END AS residual_applied, CASE WHEN lacks THEN 'ERROR' ELSE 'INFO' END AS severity FROM found""",
)
def allocation_blocked(d):
    """Units without a tower, and in some developments positions nothing is known of: those developments get no price."""
    position = F.when((F.col("development_id") % 6 == 1) & (F.col("unit_id") % 97 == 0), "X").otherwise(F.col("position"))
    units = d.units.withColumn("tower", F.when(F.col("unit_id") % 7 != 0, F.col("tower"))).withColumn("position", position)
    found = stage(allocation.allocate(units, d.targets, CONFIG, d.bound))
    checks = allocation.reconciliation(found).select("development_id", "severity")
    return found.join(F.broadcast(checks), "development_id").select("development_id", "unit_id", "tower", "system_price", "residual_applied", "severity")


@query(
    "allocation_hash",
    f"""WITH {sql.ALLOC}, units_h AS (SELECT development_id, target_value, system_price, sha256(
      '{{"combined_weight_factor":"' || CAST(CAST(combined_weight_factor AS DECIMAL(12,6)) AS VARCHAR)
      || '","participation_share":"' || CAST(CAST(participation_share AS DECIMAL(9,6)) AS VARCHAR)
      || '","system_calculated_price":"' || CAST(system_price AS VARCHAR)
      || '","system_calculated_price_per_m2":"' || CAST(price_per_m2 AS VARCHAR)
      || '","tower_business_key":"' || tower || '","unit_code":"' || unit_code
      || '","weighted_area_m2":"' || CAST(CAST(weighted_area_m2 AS DECIMAL(16,4)) AS VARCHAR) || '"}}') AS h FROM alloc)
    SELECT development_id, sha256('{{"algorithm":"REFERENCE_ALLOCATION_V1","target_vgv":"' || CAST(max(target_value) AS VARCHAR) || '","total_system_price":"'
      || CAST(CAST(sum(system_price) AS {M}) AS VARCHAR) || '","units":"' || count(*) || ',' || {sql.digest_sums('h')} || '"}}') AS logical_hash
    FROM units_h GROUP BY 1""",
)
def allocation_hash(d):
    return allocation.logical_hash(d.stored_allocation, d.bound)


@query(
    "run_results",
    f"""WITH {sql.ALLOC} SELECT 'SC-' || development_id || ':' || c AS run_id, unit_id, system_price, participation_share
    FROM alloc, (VALUES ('PLAIN'), ('DECIDED')) r(c)""",
)
def run_results(d):
    return d.results.select("run_id", "unit_id", "system_price", "participation_share")


RUN_FIELDS = ["run_id", "units", "adjustments", "target_value", "total", "difference", "severity", "logical_hash", "overrides", "override_impact", "final_total"]


@query("allocation_run_stored", f"WITH {sql.ALLOC},{sql.OVERRIDES},{sql.stored_runs('alloc', 'overrides')} SELECT {', '.join(RUN_FIELDS)} FROM stored")
def allocation_run_stored(d):
    """Runs of every development validated, written, audited and read back from their stored tables."""
    manifest = d.manifest()
    events = d.override_events.join(d.units.select("unit_id"), "unit_id", "left_semi")
    runs.store(manifest, "given", d.units, d.targets, CONFIG, d.completed_runs, events, override_code=OVERRIDE_RUN, keys=["unit_id"],
               bound=d.run_bound, towers=d.towers, typologies=d.typologies)
    return runs.summary(runs.read(manifest), d.run_bound).select(*RUN_FIELDS)


TAMPERED = f"""{sql.ALLOC},{sql.OVERRIDES},{sql.stored_runs('alloc', 'overrides')},
    changed AS (SELECT * REPLACE (CAST(CASE WHEN unit_id % 1000 = 7 AND development_id % 4 = 1 THEN system_price + 0.01 ELSE system_price END AS {M}) AS system_price) FROM alloc),
    fewer AS (SELECT * FROM overrides WHERE NOT (event_id % 2 = 0 AND development_id % 4 = 2)),{sql.stored_runs('changed', 'fewer', 't_')}"""
COMPARED = ["units", "total", "severity", "logical_hash", "overrides", "override_impact"]


@query(
    "verify_run",
    f"""WITH {TAMPERED}, fields AS (""" + " UNION ALL ".join(
        f"SELECT run_id, '{f}' AS field, CAST(e.{f} AS VARCHAR) AS expected, CAST(t.{f} AS VARCHAR) AS actual FROM stored e JOIN t_stored t USING (run_id)" for f in COMPARED
    ) + ") SELECT * FROM fields WHERE expected IS DISTINCT FROM actual",
)
def verify_run(d):
    """Stored runs in which some prices and decisions were changed by a writer without the gate, against what they should be."""
    priced = d.stored_allocation
    cent = F.lit("0.01").cast("decimal(18,2)")
    changed = stage(priced.withColumn("system_price", F.when(
        (F.col("unit_id") % 1000 == 7) & (F.col("development_id") % 4 == 1), (F.col("system_price") + cent).cast(M)).otherwise(F.col("system_price"))))
    decided = allocation.apply_overrides(priced, d.override_events, ["unit_id"], carry=("development_id", "tower", "unit_code")).withColumn(
        "run_id", F.concat(F.lit("SC-"), F.col("development_id").cast("string"), F.lit(f":{OVERRIDE_RUN}")))
    kept = decided.where("not (event_id % 2 = 0 and development_id % 4 = 2)")
    manifest = d.manifest()
    manifest.publish("allocation:changed", lambda: runs.tables_of(changed, d.completed_runs, kept, d.run_bound))
    expected = runs.summary(runs.tables_of(priced, d.completed_runs, decided, d.run_bound), d.run_bound)
    actual = runs.summary(runs.read(manifest), d.run_bound)
    return allocation.verify(stage(expected), stage(actual), ["run_id"], COMPARED)


VARIANTS = {
    "base": (CONFIG, Decimal(1)),
    "uncovered_0.90": (replace(CONFIG, parameters={allocation.UNCOVERED: Decimal("0.90")}), Decimal(1)),
    "sky_1.50": (replace(CONFIG, floor_factors={**CONFIG.floor_factors, "SKY": Decimal("1.50")}), Decimal(1)),
    "target_x2": (CONFIG, Decimal(2)),
}


@query(
    "sensitivity_by_band",
    f"""WITH {sql.UNITS},{sql.allocation(prefix='b_')},{sql.allocation(unc=90, prefix='u_')},
    {sql.allocation(bands=(97, 103, 150), prefix='h_')},{sql.allocation(multiple=2, prefix='t_')},
    v AS (SELECT 'base' AS variant, * FROM b_alloc UNION ALL SELECT 'uncovered_0.90', * FROM u_alloc
      UNION ALL SELECT 'sky_1.50', * FROM h_alloc UNION ALL SELECT 'target_x2', * FROM t_alloc)
    SELECT variant, floor_band, count(*) AS units, CAST(sum(participation_share) AS DECIMAL(18,6)) AS share,
    CAST(sum(system_price) AS {M}) AS system_vgv FROM v GROUP BY ALL""",
)
def sensitivity_by_band(d):
    rows = allocation.sensitivity(d.units, d.targets, VARIANTS, d.bound)
    return allocation.participation_by(rows, "variant", "floor_band")


@query(
    "participation_by_typology",
    f"""WITH {sql.ALLOC} SELECT development_id, typology, count(*) AS units,
    CAST(sum(participation_share) AS DECIMAL(18,6)) AS share, CAST(sum(system_price) AS {M}) AS system_vgv FROM alloc GROUP BY 1, 2""",
)
def participation_by_typology(d):
    return allocation.participation_by(d.allocated, "development_id", "typology")


@query(
    "band_range_join",
    f"""WITH {sql.UNITS}, bands AS (SELECT n_nationkey AS g, b, lo + n_nationkey % 2 AS lo, hi, o FROM nation,
      (VALUES ('GARDEN', 1, 4, 1), ('CENTRE', 3, 7, 2), ('SKY', 7, 9, 3)) t(b, lo, hi, o))
    SELECT development_id, unit_id, floor, (SELECT arg_min(b, o) FROM bands WHERE g = development_id AND floor BETWEEN lo AND hi) AS floor_band
    FROM units""",
)
def band_range_join(d):
    """Overlapping bands per development: the first declared wins, a floor outside all gets none."""
    rows = [("GARDEN", 1, 4, 1), ("CENTRE", 3, 7, 2), ("SKY", 7, 9, 3)]
    literal = F.array(
        *[F.struct(F.lit(b).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("high"), F.lit(o).alias("ordinal")) for b, lo, hi, o in rows]
    )
    bands = d.developments.select("development_id", F.inline(literal)).withColumn("low", F.col("lo") + F.col("development_id") % 2)
    table = allocation.band_table(bands)
    return attach(d.units.select("development_id", "unit_id", "floor"), table, ["development_id", "floor"], table)


# --- serving ---


CURRENT = ["development_id", "run_id", "unit_id", "system_price", "override_final_price", "current_final_price",
           "price_per_m2", "participation_share", "weighted_area_m2"]


@query("unit_price_current", f"WITH {sql.CURRENT} SELECT {', '.join(CURRENT)} FROM current")
def unit_price_current(d):
    return d.current.select(*CURRENT)


@query("units_enriched", f"WITH {sql.CURRENT} SELECT * FROM enriched")
def units_enriched(d):
    return d.dashboard_units


@query(
    "dashboard_kpis",
    f"""WITH {sql.CURRENT}, {sql.COMPARE.split(sql.UNITS + ',', 1)[1]}
    SELECT CAST(sum(final_price) AS {M}) AS vgv, count(*) AS units_count, count(DISTINCT tower) AS towers_count,
    count(DISTINCT typology) AS typologies_count,
    {sql.cents(sql.half_up('(sum(final_price) * 100)::HUGEINT * 100', '(sum(private_area_m2) * 100)::HUGEINT'))} AS avg_price_per_m2,
    count(*) FILTER (WHERE adjustment <> 0) AS adjustments_count,
    (SELECT {sql.dec(sql.half_up('within_1_cent * 1000', 'units_analyzed'), 1, 5)} FROM metrics) AS reproduction_accuracy_pct,
    (SELECT within_1_cent FROM metrics) AS within_1_cent_count FROM enriched""",
)
def dashboard_kpis(d):
    return serving.kpis(d.dashboard_units, serving.error_metrics(d.comparisons))


@query(
    "development_label",
    f"""WITH {sql.CURRENT} SELECT CASE WHEN count(DISTINCT development_id) = 1 THEN max(name) ELSE
    count(DISTINCT development_id) || ' empreendimentos (' || string_agg(DISTINCT name, ', ' ORDER BY name) || ')' END AS name
    FROM enriched JOIN scenarios USING (development_id)""",
)
def development_label(d):
    return serving.development_label(d.dashboard_units, d.developments.select("development_id", "name"), d.bound)


@query(
    "validation_block",
    f"""WITH {sql.COMPARE} SELECT a.tower, a.unit_code, c.source_reference_price, c.reproduced_price, c.delta_absolute,
    c.match_classification FROM comparisons c JOIN units a ON a.unit_id = c.unit_id""",
)
def validation_block(d):
    return d.comparisons.join(d.units.select("unit_id", "tower", "unit_code"), "unit_id").select(
        F.coalesce("tower", F.lit(serving.NO_TOWER)).alias("tower"), "unit_code", "source_reference_price",
        "reproduced_price", "delta_absolute", "match_classification",
    )


@query(
    "validation_newest",
    f"""WITH {sql.COMPARE} SELECT c.development_id, 'REPRO-' || c.development_id || '-' || CASE WHEN c.development_id % 3 = 0 THEN 1 ELSE 2 END AS reproduction_run_id,
    CASE WHEN a.unit_id % 7 = 0 THEN 'SEM-TORRE' ELSE a.tower END AS tower, a.unit_code, c.source_reference_price, c.reproduced_price, c.delta_absolute,
    c.match_classification FROM comparisons c JOIN units a ON a.unit_id = c.unit_id""",
)
def validation_newest(d):
    """The comparisons lie under two reproductions; units without a tower get the label for it."""
    run = F.explode(F.array(*[F.concat_ws("-", F.lit("REPRO"), "development_id", F.lit(n)) for n in (1, 2)]))
    stored_rows = d.comparisons.withColumn("reproduction_run_id", run)
    units = d.units.withColumn("tower", F.when(F.col("unit_id") % 7 != 0, F.col("tower")))
    return serving.validation_block(stored_rows, d.reproduction_runs, units, d.bound)


@query(
    "error_metrics",
    f"WITH {sql.COMPARE} SELECT * FROM metrics",
)
def error_metrics(d):
    return serving.error_metrics(d.comparisons)


UNIT_FIELDS = ["tower", "unit_code", "typology", "floor", "position", "private_area_m2", "uncovered_area_m2",
               "weighted_area_m2", "participation_share", "system_price", "adjustment", "final_price", "price_per_m2", "status"]


@query(
    "units_labelled",
    f"""WITH {sql.CURRENT} SELECT development_id, unit_code, CASE WHEN tower = 'HOUSEHOLD' THEN 'SEM-TORRE' ELSE 'Torre ' || tower END AS tower,
    CASE WHEN typology = '5-LOW' THEN '' ELSE 'Tipo ' || typology END AS typology, final_price, status FROM enriched""",
)
def units_labelled(d):
    """Units that name tower and typology by id, joined to tables that hold all names but one each."""
    key = lambda c: F.concat_ws(":", F.col("development_id").cast("string"), c)
    current = d.current.withColumn("tower_id", key("tower")).withColumn("typology_id", key("typology")).drop("tower", "typology")
    towers = d.towers.where("tower <> 'HOUSEHOLD'").select(key("tower").alias("tower_id"), F.concat(F.lit("Torre "), "tower").alias("name"))
    kinds = d.typologies.where("typology <> '5-LOW'").select(key("typology").alias("typology_id"), F.concat(F.lit("Tipo "), "typology").alias("name"))
    found = serving.units_enriched(serving.with_labels(current, towers, kinds, towers, kinds))
    return found.select("development_id", "unit_code", "tower", "typology", "final_price", "status")


NUMBERS = {"floor": "int", "private_area_m2": "decimal(18,2)", "uncovered_area_m2": "decimal(18,2)", "weighted_area_m2": "decimal(18,4)",
           "participation_share": "decimal(18,10)", "system_price": "decimal(18,2)", "adjustment": "decimal(18,2)", "final_price": "decimal(18,2)",
           "price_per_m2": "decimal(18,2)"}
UNIT_TEXT = " || '|' || ".join(f"CAST(CAST({c} AS {NUMBERS[c]}) AS VARCHAR)" if c in NUMBERS else c for c in UNIT_FIELDS)
KPIS = ["vgv", "units_count", "towers_count", "typologies_count", "avg_price_per_m2", "adjustments_count", "reproduction_accuracy_pct",
        "within_1_cent_count"]
METRICS = ["units_analyzed", "within_1_cent", "exact_matches", "aggregate_delta", "mae", "max_absolute_error", "rmse"]


def unfolded(fields: list[str], section: str, table: str) -> str:
    names, values = ", ".join(f"'{f}'" for f in fields), ", ".join(f"CAST(CAST({f} AS DECIMAL(28,2)) AS VARCHAR)" for f in fields)
    return f"SELECT '{section}' AS section, unnest([{names}]) AS name, unnest([{values}]) AS value FROM {table}"


@query(
    "dashboard_document",
    f"""WITH {sql.CURRENT}, {sql.COMPARE.split(sql.UNITS + ',', 1)[1]},
    kpis AS (SELECT CAST(sum(final_price) AS {M}) AS vgv, count(*) AS units_count, count(DISTINCT tower) AS towers_count,
        count(DISTINCT typology) AS typologies_count,
        {sql.cents(sql.half_up('(sum(final_price) * 100)::HUGEINT * 100', '(sum(private_area_m2) * 100)::HUGEINT'))} AS avg_price_per_m2,
        count(*) FILTER (WHERE adjustment <> 0) AS adjustments_count,
        (SELECT {sql.dec(sql.half_up('within_1_cent * 1000', 'units_analyzed'), 1, 5)} FROM metrics) AS reproduction_accuracy_pct,
        (SELECT within_1_cent FROM metrics) AS within_1_cent_count FROM enriched)
    SELECT 'meta' AS section, unnest([{", ".join(f"'{k}'" for k in LABELS)}]) AS name, unnest([{", ".join(f"'{v}'" for v in LABELS.values())}]) AS value
    UNION ALL SELECT 'development', 'name', CASE WHEN count(DISTINCT development_id) = 1 THEN max(name) ELSE
        count(DISTINCT development_id) || ' empreendimentos (' || string_agg(DISTINCT name, ', ' ORDER BY name) || ')' END
        FROM enriched JOIN scenarios USING (development_id)
    UNION ALL {unfolded(KPIS, 'kpis', 'kpis')} UNION ALL {unfolded(METRICS, 'validation', 'metrics')}
    UNION ALL SELECT DISTINCT 'label', NULL, tower FROM enriched UNION ALL SELECT DISTINCT 'label', NULL, typology FROM enriched
    UNION ALL SELECT 'unit', NULL, {UNIT_TEXT} FROM enriched""",
)
def dashboard_document(d):
    """The nested document written over many files, and every value of it read back from them."""
    units = stage(d.dashboard_units)
    validation = stage(serving.error_metrics(d.comparisons))
    names = d.developments.select("development_id", "name")
    head = serving.head_fields(LABELS, serving.development_label(units, names, d.bound), serving.kpis(units, validation), validation)
    lists = {c + "s": (stage(serving.labels(units, c)), [c]) for c in ("tower", "typology")}
    keys = ["development_id", "tower", "unit_code"]
    lists["units"] = (serving.document_lines(units, keys, UNIT_FIELDS), keys)
    folder = f"{checkpoint_root(d.spark)}/proratio/{uuid.uuid4().hex}"
    serving.write_nested(serving.nested_document(head, lists), folder)
    line = F.regexp_replace("value", "^,", "")
    lines = d.spark.read.text(folder).select(line.alias("line"))
    field = lines.select(F.regexp_extract("line", r'^"(\w+)":(\{.*)$', 1).alias("section"), F.regexp_extract("line", r'^"(\w+)":(\{.*)$', 2).alias("object"))
    number = F.col("value").cast("decimal(28,2)").cast("string")
    fields = field.where("section <> ''").select("section", F.explode(F.from_json("object", "map<string,string>")).alias("name", "value")).withColumn(
        "value", F.when(F.col("section").isin("kpis", "validation"), number).otherwise(F.col("value")))
    none = F.lit(None).cast("string").alias("name")
    labels = lines.where(F.col("line").rlike('^".*"$')).select(
        F.lit("label").alias("section"), none, F.from_json(F.concat(F.lit("["), "line", F.lit("]")), "array<string>")[0].alias("value"))
    row = F.from_json("line", ", ".join(f"{c} {NUMBERS.get(c, 'string')}" for c in UNIT_FIELDS))
    unit = lines.where(F.col("line").startswith("{") & F.col("line").endswith("}")).select(row.alias("u")).select(
        F.lit("unit").alias("section"), none, F.concat(*[x for c in UNIT_FIELDS for x in (F.lit("|"), F.col("u")[c].cast("string"))][1:]).alias("value"))
    return fields.unionByName(labels).unionByName(unit)


LINE_FIELDS = ["tower", "unit_code", "typology", "floor", "position", "private_area_m2", "system_price", "adjustment", "final_price", "status"]


@query(
    "document_lines",
    f"""WITH {sql.CURRENT} SELECT development_id, tower, unit_code, '{{"tower":"' || tower || '","unit_code":"' || unit_code || '","typology":"' || typology
      || '","floor":' || floor || ',"position":"' || position || '","private_area_m2":' || private_area_m2 || ',"system_price":' || system_price
      || ',"adjustment":' || adjustment || ',"final_price":' || final_price || ',"status":"' || status || '"}}' AS document FROM enriched""",
)
def document_lines(d):
    return serving.document_lines(d.dashboard_units, ["development_id", "tower", "unit_code"], LINE_FIELDS)


@query(
    "chart_price_by_floor",
    f"""WITH {sql.CURRENT} SELECT floor, count(*) AS units,
    {sql.cents(sql.half_up('(sum(final_price) * 100)::HUGEINT * 100', '(sum(private_area_m2) * 100)::HUGEINT'))} AS price_per_m2
    FROM enriched WHERE floor IS NOT NULL GROUP BY floor""",
)
def chart_price_by_floor(d):
    return serving.price_by_floor(d.dashboard_units)


@query(
    "chart_share_by_tower",
    f"""WITH {sql.CURRENT} SELECT development_id, tower, count(*) AS units, CAST(sum(participation_share) AS DECIMAL(18,6)) AS share,
    CAST(sum(final_price) AS {M}) AS vgv FROM enriched GROUP BY 1, 2""",
)
def chart_share_by_tower(d):
    return serving.share_by_tower(d.dashboard_units)


@query(
    "chart_price_histogram",
    f"""WITH {sql.CURRENT} SELECT CAST(CASE WHEN final_price < 0 THEN 0 WHEN final_price >= 1000000 THEN 21
    ELSE floor(final_price / 50000) + 1 END AS BIGINT) AS bin, count(*) AS units, min(final_price) AS lowest, max(final_price) AS highest
    FROM enriched GROUP BY 1""",
)
def chart_price_histogram(d):
    return serving.price_histogram(d.dashboard_units, 0, 1_000_000, 20)


@query(
    "chart_price_by_area",
    f"""WITH {sql.CURRENT} SELECT CAST(floor(private_area_m2 / 10) * 10 AS INTEGER) AS area_from, count(*) AS units,
    min(final_price) AS lowest, max(final_price) AS highest, CAST(sum(final_price) AS {M}) AS vgv FROM enriched GROUP BY 1""",
)
def chart_price_by_area(d):
    return serving.price_by_area(d.dashboard_units)


@query(
    "chart_adjustments",
    f"""WITH {sql.CURRENT} SELECT development_id, tower, unit_code, system_price, adjustment, final_price FROM enriched WHERE adjustment <> 0""",
)
def chart_adjustments(d):
    return serving.adjustment_list(d.dashboard_units)


@query(
    "units_table_page",
    f"""WITH {sql.CURRENT} SELECT * FROM enriched
    WHERE contains(lower(tower || ' ' || unit_code || ' ' || typology || ' ' || position), 'machinery') AND status = 'VALIDADO'
    ORDER BY final_price DESC, development_id, tower, unit_code LIMIT 25 OFFSET 25""",
)
def units_table_page(d):
    return serving.units_table(
        d.dashboard_units, search="Machinery", status="VALIDADO", sort="final_price", descending=True, page=1, page_size=25
    )


ORDER = [("final_price", True), ("development_id", False), ("tower", False), ("unit_code", False)]
PAGE, PAGE_ROWS = 300, 3


@query(
    "units_table_after",
    f"""WITH {sql.CURRENT} SELECT development_id, tower, unit_code, final_price FROM enriched
    ORDER BY final_price DESC, development_id, tower, unit_code LIMIT {2 * PAGE_ROWS} OFFSET {PAGE * PAGE_ROWS}""",
)
def units_table_after(d):
    """A deep page by its number, and the one behind its last row by that row's key; neither sorts or reads what lies before."""
    order = serving.store_order(d.dashboard_units, ORDER, 16)
    page = stage(order.page(PAGE, PAGE_ROWS))
    columns = ["development_id", "tower", "unit_code", "final_price"]
    last = page.select(*columns).orderBy("final_price", F.desc("development_id"), F.desc("tower"), F.desc("unit_code")).first()
    if last is None:
        return page.select(*columns)
    return page.select(*columns).union(order.after(last.asDict(), PAGE_ROWS).select(*columns))


# --- rule graph ---


def _rule(name: str, columns: list[str], expression: str, extra: str = ""):
    def plan(d):
        rows = d.evaluated_rules([c.split()[-1] for c in columns])
        if extra:
            rows = rows.where(extra)
        return rows.select("unit_id", *[F.expr(c) for c in columns])

    query(name, f"WITH {sql.RULES} SELECT unit_id, {expression} FROM rules")(plan)


_rule("rule_sum", ["total_area"], f"{sql.dec('total2', 2)} AS total_area")
_rule("rule_weighted_sum", ["weighted_area"], f"{sql.dec('w4', 4)} AS weighted_area")
_rule("rule_lookup", ["floor_factor"], f"CASE WHEN f2 >= 0 THEN 1 ELSE -1 END * {sql.dec('abs(f2)', 2)} AS floor_factor")
_rule(
    "rule_lookup_composite", ["corner_factor"],
    "CAST(CASE floor || '-' || position WHEN '1-F' THEN 0.07 WHEN '4-O' THEN 0.12 WHEN '6-P' THEN 0.035 "
    "WHEN '9-F' THEN 0.015 END AS DECIMAL(12,6)) AS corner_factor",
)
_rule("rule_multiply_factors", ["adjusted_area"], f"{sql.dec('adj8', 8)} AS adjusted_area")
_rule("rule_ratio", ["round(share, 12) AS share"], f"{sql.dec(sql.half_up('adj8 * 1000000000000::HUGEINT', 'tot8'), 12)} AS share")
_rule("rule_linear_price", ["round(unit_price, 4) AS unit_price"], f"{sql.dec(sql.half_up('price10', '1000000::HUGEINT'), 4)} AS unit_price")
_rule(
    "rule_divide", ["round(price_per_m2, 4) AS price_per_m2"],
    f"{sql.dec(sql.half_up('price10', '(total2 * 10000)::HUGEINT'), 4)} AS price_per_m2",
)


@query(
    "rule_group_values",
    f"""WITH {sql.RULES} SELECT DISTINCT group_id, {sql.dec('tot8', 8, 24)} AS group_total, {sql.dec('budget10', 10, 28)} AS group_budget FROM rules""",
)
def rule_group_values(d):
    """group_sum and multiply_by_parameter: one row per development."""
    return d.evaluated.groupBy("group_id").agg(
        F.max("_g_group_total").alias("group_total"), F.max("_g_group_budget").alias("group_budget")
    )


@query(
    "rule_blocked",
    f"""WITH {sql.RULES}, g AS (SELECT group_id, count(*) AS units, count(*) FILTER (WHERE f2 IS NULL) AS floor_missing,
      count(*) FILTER (WHERE price10 IS NULL) AS price_missing FROM rules GROUP BY 1)
    SELECT group_id, units, 'floor_factor' AS rule, floor_missing AS missing, CAST(NULL AS VARCHAR) AS reason FROM g
    UNION ALL SELECT group_id, units, 'unit_price', price_missing, NULL FROM g
    UNION ALL SELECT group_id, units, 'idle_area', units, 'DORMANT' FROM g
    UNION ALL SELECT group_id, units, 'idle_price', units, 'BLOCKED_TRANSITIVELY_VIA:idle_area' FROM g""",
)
def rule_blocked(d):
    wanted = ["floor_factor", "unit_price", "idle_area", "idle_price"]
    return rulegraph.blocked_units(d.evaluated, RULESET).where(F.col("rule").isin(wanted))


@query(
    "rule_result_hash",
    f"""WITH {sql.RULES}, lines AS (SELECT group_id, sha256(unit_id || '|' || unit_id || '|' || coalesce(CAST({sql.dec('w4 * 100', 6)} AS VARCHAR), '')
      || '|' || coalesce(CAST({sql.dec('adj8', 8)} AS VARCHAR), '')) AS h FROM rules)
    SELECT group_id, sha256(count(*) || ',' || {sql.digest_sums('h')}) AS result_hash FROM lines GROUP BY 1""",
)
def rule_result_hash(d):
    fields = ["weighted_area", "adjusted_area"]
    return rulegraph.result_hash(d.evaluated_rules(fields), fields)


@query(
    "rule_input_rejects",
    f"""WITH {sql.RULES} SELECT unit_id, group_id, 'override_amount_derived' AS input, 'n/d' AS text, 'not_a_number' AS reason FROM rules WHERE unit_id % 333 = 0 AND group_id % 6 = 1
    UNION ALL SELECT unit_id, group_id, 'closed_area', CAST(closed_area AS VARCHAR) || '00001', 'too_many_places' FROM rules WHERE unit_id % 101 = 0
    UNION ALL SELECT unit_id, group_id, 'closed_area', '1000000000000' || CAST(closed_area AS VARCHAR), 'too_long' FROM rules WHERE unit_id % 101 <> 0 AND unit_id % 103 = 0""",
)
def rule_input_rejects(d):
    """Areas given as texts, some of them longer than their type, some with more places, and amounts that are no numbers."""
    text = F.col("closed_area").cast("string")
    units = d.rule_units.withColumn("closed_area", F.when(F.col("unit_id") % 101 == 0, F.concat(text, F.lit("00001")))
                                    .when(F.col("unit_id") % 103 == 0, F.concat(F.lit("1000000000000"), text)).otherwise(text))
    return rulegraph.input_rejects(units, RULESET)


# --- reproduction ---


@query("reproduction_comparison", f"WITH {sql.COMPARE} SELECT * FROM comparisons")
def reproduction_comparison(d):
    return d.comparisons


@query(
    "match_summary",
    f"WITH {sql.COMPARE} SELECT development_id, match_classification, count(*) AS n FROM comparisons GROUP BY 1, 2",
)
def match_summary(d):
    return reproduction.match_summary(d.comparisons, "development_id")


@query(
    "reproduction_development_summary",
    f"""WITH {sql.COMPARE} SELECT development_id, count(*) AS units_total, count(reproduced_price) AS units_calculated,
    count(*) FILTER (WHERE reproduced_price IS NULL) AS units_blocked FROM comparisons GROUP BY 1""",
)
def reproduction_development_summary(d):
    return reproduction.development_summary(d.comparisons)


@query(
    "reproduction_trail",
    f"""WITH {sql.RULES} SELECT group_id, unit_id, 'TOTAL_AREA' AS adjustment_type, CAST({sql.dec('total2', 2)} AS DECIMAL(18,6)) AS result_value FROM rules
    UNION ALL SELECT group_id, unit_id, 'WEIGHTED_AREA', CAST({sql.dec('w4', 4)} AS DECIMAL(18,6)) FROM rules
    UNION ALL SELECT group_id, unit_id, 'FLOOR_FACTOR', CAST(CASE WHEN f2 >= 0 THEN 1 ELSE -1 END * {sql.dec('abs(f2)', 2)} AS DECIMAL(18,6))
    FROM rules WHERE f2 IS NOT NULL""",
)
def reproduction_trail(d):
    steps = [("total_area", "TOTAL_AREA"), ("weighted_area", "WEIGHTED_AREA"), ("floor_factor", "FLOOR_FACTOR")]
    return reproduction.trail(d.evaluated, steps).drop("ordinal")


RULESET_VERSION = "sha256:0"
UNIT_SCHEMA = (
    "development_id bigint, unit_id bigint, ordinal bigint, closed_area decimal(12,2), terrace_area decimal(12,2), unit_code_raw string, floor_text string,"
    " position_code_raw string, override_amount_derived string, UNCOVERED_AREA_FACTOR string, TARGET_PRICE_PER_M2 decimal(18,6)"
)


def _reproduce(d, manifest, attempt: str = "", chosen=None):
    return reproduction_runs.reproduce(
        manifest, RULESET_VERSION, RULESET, UNIT_SCHEMA, {"floor_factor": d.floor_table}, variants=list(sql.VARIANTS), forced_output="floor_factor",
        forced_key="1", forced=F.col("unit_id") % 100 < 4, attempt=attempt, chosen=chosen)


def _stored_inputs(d):
    """A manifest that holds the units and imported prices of every development."""
    manifest = d.manifest()
    units = d.rule_units.withColumnRenamed("group_id", "development_id")
    imported = d.reference_prices.join(d.units.select("unit_id", "development_id"), "unit_id")
    reproduction_runs.store_inputs(manifest, runs.typed(units, UNIT_SCHEMA), runs.typed(imported, reproduction_runs.IMPORTED_SCHEMA))
    return manifest


@query(
    "anomaly_variants",
    f"""WITH {sql.VARIANT_COMPARE} SELECT variant, fkey AS floor_key, count(*) AS units, count(reproduced_price) AS priced,
    CAST(sum(reproduced_price) AS {M}) AS total FROM v_compared GROUP BY 1, 2""",
)
def anomaly_variants(d):
    """Every unit priced in two variants by one evaluation: listed source rows forced to floor 1, or left consistent."""
    units = d.rule_units.withColumnRenamed("group_id", "development_id")
    rows = reproduction_runs.priced(units, RULESET, {"floor_factor": d.floor_table}, list(sql.VARIANTS), "unit_price", "floor_factor", "1",
                                    F.col("unit_id") % 100 < 4, d.bound)
    rows = rows.join(d.rule_units.select("unit_id", F.regexp_replace("floor_text", r"\.0$", "").alias("own_key")), "unit_id")
    price = F.round("unit_price", 2).cast(M)
    return rows.groupBy("variant", F.coalesce("forced_key", "own_key").alias("floor_key")).agg(
        F.count("*").alias("units"), F.count(price).alias("priced"), F.sum(price).cast(M).alias("total"))


@query(
    "reproduction_run_stored",
    f"""WITH {sql.VARIANT_COMPARE} SELECT development_id, variant, match_classification, count(*) AS units, CAST(sum(reproduced_price) AS {M}) AS total
    FROM v_compared GROUP BY 1, 2, 3""",
)
def reproduction_run_stored(d):
    """Both variants of all developments reproduced from stored units, compared with stored imports, stored and read back."""
    manifest = _stored_inputs(d)
    _reproduce(d, manifest)
    return reproduction_runs.comparisons(manifest, RULESET_VERSION).groupBy("development_id", "variant", "match_classification").agg(
        F.count("*").alias("units"), F.sum("reproduced_price").cast(M).alias("total"))


@query(
    "reproduction_resume",
    f"""WITH {sql.VARIANT_COMPARE} SELECT development_id, variant, CASE WHEN CAST(development_id AS BIGINT) % 3 = 0 THEN 'first' ELSE 'second' END AS attempt,
    count(*) AS units, count(reproduced_price) AS calculated FROM v_compared GROUP BY 1, 2, 3""",
)
def reproduction_resume(d):
    """A first call gets as far as every third development, a second one does the rest, and a third one finds nothing to do."""
    manifest = _stored_inputs(d)
    _reproduce(d, manifest, "first", d.developments.where("development_id % 3 = 0"))
    _reproduce(d, manifest, "second")
    _reproduce(d, manifest, "third")
    return reproduction_runs.comparisons(manifest, RULESET_VERSION).groupBy("development_id", "variant", "attempt").agg(
        F.count("*").alias("units"), F.count("reproduced_price").alias("calculated"))


@query(
    "reproduction_pending",
    """SELECT c_custkey AS development_id FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING')""",
)
def reproduction_pending(d):
    """Customers as developments: every third has a run of this ruleset version, completed unless it is a BUILDING one."""
    customers = d.table("customer")
    runs = customers.where("c_custkey % 3 = 0").select(
        F.col("c_custkey").alias("development_id"), F.lit("sha256:0").alias("ruleset_version"),
        F.when(F.col("c_mktsegment") == "BUILDING", "FAILED").otherwise("COMPLETED").alias("status"),
    )
    return reproduction.pending(customers.select(F.col("c_custkey").alias("development_id")), runs, "sha256:0")


# --- files of scenarios ---

DOCUMENT_UNITS = 500


@query(
    "scenario_documents",
    f"""WITH {sql.UNITS}, t AS (SELECT development_id, CAST(sum(order_total) AS {M}) AS target_value FROM units GROUP BY 1)
    SELECT CAST(u.development_id AS VARCHAR) AS development_id, tower, typology || '/' || private_area_m2 || '/' || uncovered_area_m2 AS typology, unit_code, floor,
    position, private_area_m2, uncovered_area_m2, target_value FROM units u JOIN t USING (development_id)""",
)
def scenario_documents(d):
    """Scenarios written as documents of about 500 units at most, read back, with the areas of their typologies and their target."""
    dev = F.col("development_id").cast("string").alias("business_key")
    kind = F.concat_ws("/", "typology", F.col("private_area_m2").cast("string"), F.col("uncovered_area_m2").cast("string"))
    parts = d.units.count() // DOCUMENT_UNITS + 1
    unit = F.struct(F.col("tower").alias("tower_business_key"), kind.alias("typology_business_key"), "unit_code", "floor", F.col("position").alias("position_category"))
    typology = F.struct(kind.alias("business_key"), F.col("private_area_m2").cast("string").alias("private_area_m2"),
                        F.col("uncovered_area_m2").cast("string").alias("uncovered_area_m2"))
    # Parts are dealt by a hash, so however many units a development has, a document holds few.
    listed = d.units.groupBy("development_id", F.pmod(F.xxhash64("unit_id"), F.lit(parts)).alias("part")).agg(
        F.collect_list(unit).alias("units"), F.collect_set(typology).alias("typologies"))
    documents = listed.select(F.to_json(F.struct(F.struct(dev).alias("development"), "typologies", "units")).alias("document"))
    target = F.struct(F.col("target_value").cast("string").alias("target_value"), F.lit("MANUAL").alias("origin")).alias("vgv_target")
    heads = d.targets.select(F.to_json(F.struct(F.struct(dev).alias("development"), target)).alias("document"))
    folder = f"{checkpoint_root(d.spark)}/proratio/{uuid.uuid4().hex}"
    files.write_documents(documents.unionByName(heads), folder)
    rows = scenario.read_scenarios(d.spark, folder, lines=True)
    return attach(scenario.units(rows), scenario.targets(rows), "development_id", d.bound, "inner")
