"""Constraint, privacy, similarity, grid, input and publishing queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from proratio.operators import allocation, privacy, promotion, quality, reproduction, serving, sets, similarity
from proratio.plans import cells as cell_plans
from proratio.plans import sql
from proratio.plans.cells import STAGED
from proratio.plans.domain import CONFIG
from proratio.plans.registry import query
from proratio.session import attach, checkpoint_root, counted, spread, stage
from proratio.sources.publish import Manifest


# --- constraints ---


def _line_rules(d):
    return [
        quality.not_null("l_shipdate"),
        quality.domain("l_returnflag", ["A", "N"]),
        quality.check("l_discount_range", "l_discount between 0 and 0.05", "l_discount"),
        quality.check("shipped_in_time", "l_shipdate < date '2001-09-01'", "l_shipdate"),
        quality.check("open_needs_tax", "l_linestatus <> 'O' or l_tax > 0", "l_linestatus", "l_tax"),
        quality.unique("l_orderkey", "l_linenumber"),
        quality.foreign(["l_suppkey"], d.table("supplier").where("s_suppkey % 7 <> 0"), ["s_suppkey"]),
        quality.foreign(["l_orderkey"], d.table("orders"), ["o_orderkey"]),
    ]


@query(
    "constraint_report",
    """WITH v AS (SELECT 'l_returnflag_domain' AS rule_id FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
    UNION ALL SELECT 'l_discount_range' FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.05::DOUBLE
    UNION ALL SELECT 'shipped_in_time' FROM lineitem WHERE NOT l_shipdate < TIMESTAMP '2001-09-01'
    UNION ALL SELECT 'open_needs_tax' FROM lineitem WHERE NOT (l_linestatus <> 'O' OR l_tax > 0)
    UNION ALL SELECT 'l_orderkey_l_linenumber_unique' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    UNION ALL SELECT 'l_suppkey_foreign' FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0)
    UNION ALL SELECT 'l_orderkey_foreign' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
    SELECT rule_id, count(*) AS violations FROM v GROUP BY 1""",
)
def constraint_report(d):
    return quality.report(quality.violations(d.table("lineitem"), _line_rules(d), ["l_orderkey", "l_linenumber"]))


@query(
    "temporal_order",
    """WITH s AS (SELECT l_orderkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1),
    r AS (SELECT o_orderkey AS k, o_orderdate AS started_at, CASE WHEN o_orderkey % 97 <> 0 THEN a END AS completed_at, b AS valid_from,
      CASE WHEN o_orderkey % 41 = 0 THEN a WHEN o_orderkey % 5 > 0 THEN b + INTERVAL 1 DAY END AS valid_to FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
    SELECT 'completed_after_started' AS rule_id, CAST(k AS VARCHAR) AS "key" FROM r WHERE completed_at < started_at
    UNION ALL SELECT 'valid_period', CAST(k AS VARCHAR) FROM r WHERE valid_to <= valid_from""",
)
def temporal_order(d):
    """Runs and periods with start and end, some still open, some ended before they began."""
    k = F.col("o_orderkey")
    shipped = d.table("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    rows = d.table("orders").join(shipped, k == F.col("l_orderkey"), "left").select(
        k.alias("k"), F.col("o_orderdate").alias("started_at"), F.when(k % 97 != 0, F.col("a")).alias("completed_at"), F.col("b").alias("valid_from"),
        F.when(k % 41 == 0, F.col("a")).when(k % 5 > 0, F.col("b") + F.expr("interval 1 day")).alias("valid_to"),
    )
    entities = ("audit.promotion_runs", "pricing.parameter_sets")
    rules = [r for e in entities for r in quality.applicable(rows, quality.ENTITY_RULES[e])]
    return quality.violations(rows, rules, ["k"]).select("rule_id", "key")


@query(
    "constraint_violations",
    f"""WITH {sql.UNITS}, s AS (SELECT c_custkey, c_nationkey AS development_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'ACTIVE' ELSE 'DRAFT' END AS status FROM customer)
    SELECT 'development_id_unique' AS rule_id, CAST(development_id AS VARCHAR) AS "key", CAST(count(*) AS VARCHAR) AS detail FROM s WHERE status = 'ACTIVE'
      GROUP BY development_id HAVING count(*) > 1
    UNION ALL SELECT 'status_domain', CAST(c_custkey AS VARCHAR), status FROM s WHERE status NOT IN ('DRAFT', 'SUPERSEDED')""",
)
def constraint_violations(d):
    """At most one active scenario per development, and a narrow status domain, over customers."""
    scenarios = d.table("customer").select(
        "c_custkey", F.col("c_nationkey").alias("development_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "ACTIVE").otherwise("DRAFT").alias("status"),
    )
    rules = [quality.unique("development_id", where="status = 'ACTIVE'"), quality.domain("status", ["DRAFT", "SUPERSEDED"])]
    return quality.violations(scenarios, rules, ["c_custkey"])


@query(
    "typed_values",
    """WITH p AS (SELECT event_id, event_type, CASE WHEN event_type = 'purchase' THEN value END AS amount,
      CASE WHEN event_type = 'view' OR event_id % 97 = 0 THEN props END AS note FROM events)
    SELECT 'typed_value' AS rule_id, CAST(event_id AS VARCHAR) AS "key" FROM p WHERE NOT ((event_type = 'purchase' AND amount IS NOT NULL AND note IS NULL)
      OR (event_type = 'view' AND note IS NOT NULL AND amount IS NULL))""",
)
def typed_values(d):
    """The column an event's type names must be filled, and no other."""
    rows = d.table("events").select(
        "event_id", "event_type", F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"),
        F.when((F.col("event_type") == "view") | (F.col("event_id") % 97 == 0), F.col("props")).alias("note"),
    )
    rule = quality.one_of("typed_value", "event_type", {"purchase": "amount", "view": "note"})
    return quality.violations(rows, [rule], ["event_id"]).drop("detail")


@query(
    "owner_check",
    """SELECT 'supplier_nation' AS rule_id, CAST(l_orderkey AS VARCHAR) || '|' || l_linenumber AS "key", CAST(s_nationkey AS VARCHAR) AS detail
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
    WHERE c_nationkey <> s_nationkey""",
)
def owner_check(d):
    """Lines whose supplier is not of the customer's nation."""
    lines = (
        d.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
        .join(d.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
        .join(d.table("customer").select("c_custkey", "c_nationkey"), "c_custkey")
    )
    rule = quality.belongs("supplier_nation", "l_suppkey", "c_nationkey", d.table("supplier"), "s_suppkey", "s_nationkey")
    return quality.violations(lines, [rule], ["l_orderkey", "l_linenumber"])


# Cells with a kind of no table, in no row, or stored twice: what the rules must find.
PLANTED_SQL = f"""WITH {cell_plans.CELLS}, planted AS (
    SELECT 'cell_type_domain' AS rule_id, count(*) AS violations FROM c WHERE column_letters = 'A' AND row_number % 50 = 0
    UNION ALL SELECT 'row_number_positive', count(*) FROM c WHERE column_letters = 'C' AND row_number % 40 = 0
    UNION ALL SELECT 'workbook_id_sheet_name_cell_ref_unique', count(*) FROM c WHERE column_letters = 'D' AND row_number % 30 = 0)"""


def broken_entities(d):
    x = cell_plans.cells(d)
    at = lambda letters, n: (F.col("column_letters") == letters) & (F.col("row_number") % n == 0)
    twice = x.cells.where(at("D", 30))
    cells = x.cells.withColumn("cell_type", F.when(at("A", 50), "odd").otherwise(F.col("cell_type"))).withColumn(
        "row_number", F.when(at("C", 40), 0).otherwise(F.col("row_number"))).unionByName(twice)
    found = quality.violations(cells, quality.ENTITY_RULES["raw.cells"], ["workbook_id", "sheet_name", "cell_ref"])
    units = promotion.units(x.staged["unit_candidates"])
    return found.unionByName(quality.violations(units, quality.applicable(units, quality.ENTITY_RULES["core.units"]), ["id"]))


@query("stored_entity_rules", f"{PLANTED_SQL} SELECT * FROM planted WHERE violations > 0")
def stored_entity_rules(d):
    """Promoted units keep the rules of their table; of the cells, those planted break theirs."""
    return quality.report(broken_entities(d))


@query(
    "stored_validations",
    f"""{PLANTED_SQL} SELECT 'CHECK-1' AS run_id, 'ENTITY:' || rule_id AS check_type, 'ERROR' AS severity, CAST(0 AS DECIMAL(18,2)) AS expected_value,
    CAST(violations AS DECIMAL(18,2)) AS actual_value, CAST(violations AS DECIMAL(18,2)) AS difference FROM planted WHERE violations > 0""",
)
def stored_validations(d):
    return quality.validation_rows(broken_entities(d), "CHECK-1", "ENTITY")


# --- privacy ---

TEXT_PATTERNS = {
    **privacy.PATTERNS,
    "email": r"[^\s@]+@[^\s@]+\.[a-zA-Z]{2,}",
    "cpf": r"\d{3}\.?\d{3}\.?\d{3}-?\d{2}",
}


def _scan_sql() -> str:
    parts = []
    for label, p in TEXT_PATTERNS.items():
        literal = p.replace("'", "''")
        parts.append(f"SELECT doc_id, '{label}' AS label, CAST(len(regexp_extract_all(text, '{literal}')) AS INTEGER) AS matches, "
                     f"regexp_extract(text, '{literal}') AS excerpt FROM documents WHERE regexp_matches(text, '{literal}')")
    return " UNION ALL ".join(parts)


@query("pattern_scan", _scan_sql())
def pattern_scan(d):
    return privacy.pattern_scan(spread(d.table("documents")), "doc_id", "text", TEXT_PATTERNS)


MARKERS = ["# words to look for", "", "License", "example.com", "  license "]


@query(
    "marker_scan",
    """SELECT doc_id, substr(m, 1, 4) || '***' AS marker FROM documents, (VALUES ('License'), ('example.com'), ('license')) t(m) WHERE contains(text, m)""",
)
def marker_scan(d):
    return privacy.marker_scan(spread(d.table("documents")), "doc_id", "text", privacy.parse_markers(MARKERS))


@query(
    "page_marker_scan",
    """SELECT page_id, substr(m, 1, 4) || '***' AS marker FROM pages, (VALUES ('track('), ('spam-farm')) t(m) WHERE contains(html, m)""",
)
def page_marker_scan(d):
    return privacy.marker_scan(spread(d.table("pages")), "page_id", "html", ["track(", "spam-farm"])


@query(
    "name_rules",
    """SELECT url, 'extensao proibida' AS finding FROM pages WHERE regexp_matches(regexp_replace(url, '[?#].*$', ''), '(?i)\\.(html|xlsx|sql)$')
    UNION ALL SELECT url, 'arquivo de ambiente' FROM pages WHERE regexp_matches(regexp_replace(url, '[?#].*$', ''), '(^|/)\\.env[^/]*$')""",
)
def name_rules(d):
    return privacy.name_rules(d.table("pages"), "url", r"(?i)\.(html|xlsx|sql)$")


@query(
    "mode_check",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'meta.mode is PRIVATE' WHEN 'error' THEN 'invalid JSON' ELSE 'meta.mode is missing' END AS finding
    FROM events WHERE event_type <> 'view'""",
)
def mode_check(d):
    text = (
        F.when(F.col("event_type") == "view", '{"meta":{"mode":"DEMO"}}').when(F.col("event_type") == "click", '{"meta":{"mode":"PRIVATE"}}')
        .when(F.col("event_type") == "error", F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    )
    return privacy.mode_check(d.table("events").select("event_id", text.alias("text")), "event_id", "text")


# --- similarity ---


@query("name_similarity")
def name_similarity(d):
    """Brands as workbooks, types as sheets, part names as columns; each brand against the next."""
    parts = d.table("part").select(
        F.col("p_brand").alias("workbook_id"), F.col("p_type").alias("sheet_name"), F.col("p_name").alias("field_name"), F.col("p_partkey").alias("ordinal")
    )
    fields = stage(parts.groupBy("workbook_id", "sheet_name", "field_name").agg(F.min("ordinal").alias("ordinal")))
    sheets = fields.select("workbook_id", "sheet_name").distinct()
    number = F.regexp_extract("workbook_id", r"(\d+)$", 1).cast("int")
    books = fields.select("workbook_id", number.alias("n")).distinct()
    pairs = books.select(F.col("workbook_id").alias("workbook_a"), (F.col("n") + 1).alias("n")).join(
        books.select(F.col("workbook_id").alias("workbook_b"), "n"), "n"
    ).drop("n")
    return similarity.cross_workbook_mapping(pairs, sheets, fields)


# --- reproduction inputs and grids ---


@query(
    "grid_lookup",
    """WITH g AS (SELECT 'C-' || c_custkey AS workbook_id, c_custkey, i FROM customer, range(1, 13) t(i))
    SELECT workbook_id, chr(CAST(64 + i AS INTEGER)) AS column_letters, (c_custkey % 5 + 1) || '-' || i AS category_key,
    CAST(i * 10 + (c_custkey % 3 + 2) AS VARCHAR) || '.0' AS factor FROM g WHERE i BETWEEN 3 AND 10 AND NOT (i = 5 AND c_custkey % 2 = 0)""",
)
def grid_lookup(d):
    """A lookup formula, its index cell and its grid per customer; a blank key is left out."""
    workbook = F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("workbook_id")
    base = d.table("customer").select(workbook)

    def cell(sheet, letters, index, row, raw, cached, formula):
        return F.struct(
            F.lit(sheet).alias("sheet_name"), letters.alias("column_letters"), index.cast("int").alias("column_index"), row.cast("int").alias("row_number"),
            raw.cast("string").alias("raw_value"), cached.cast("string").alias("cached_value"), formula.cast("string").alias("formula_expression"),
        )

    none = F.lit(None)
    k = F.col("c_custkey")
    i = F.col("i")
    grid = F.array(
        cell("Grade", F.chr(i + 64), i, F.lit(3), F.when(~((i == 5) & (k % 2 == 0)), F.concat((k % 5 + 1).cast("string"), F.lit("-"), i.cast("string"))), none, none),
        *[cell("Grade", F.chr(i + 64), i, F.lit(3 + r), F.concat((i * 10 + r + 1).cast("string"), F.lit(".0")), none, none) for r in (1, 2, 3)],
    )
    fixed = F.array(
        cell("Calc", F.lit("F"), F.lit(6), F.lit(2), none, F.lit("1.0"), F.lit("HLOOKUP(A2&\"-\"&B2,'Grade'!$C$3:$J$6,Aux!$B$1,0)+1")),
        cell("Aux", F.lit("B"), F.lit(2), F.lit(1), none, F.concat((k % 3 + 2).cast("string"), F.lit(".0")), F.lit("ROWS(A1:A4)")),
    )
    books = spread(d.table("customer").select(workbook, "c_custkey"))
    columns = books.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(12))))
    cells = columns.select("workbook_id", F.inline(grid)).unionByName(books.select("workbook_id", F.inline(fixed))).withColumn(
        "cell_ref", F.concat("column_letters", F.col("row_number").cast("string"))
    )
    cells = stage(cells)
    formulas = base.select("workbook_id", F.lit("Calc").alias("sheet_name"), F.lit("F2").alias("cell_ref"))
    found = reproduction.grid_from_formula(cells, formulas, counted(base))
    return found.select("workbook_id", "column_letters", "category_key", "factor")


@query(
    "calculation_inputs",
    f"""WITH {STAGED}, e AS (SELECT workbook_id, sheet_name, row_number AS source_row, value FROM c WHERE column_letters = 'E'),
    d AS (SELECT g.workbook_id, g.sheet_name, g.source_row, g.a, TRY_CAST(g.dd AS DECIMAL(38,18)) IS NOT NULL AS num, g.dd, g.g, e.value AS ov
      FROM grid g LEFT JOIN e USING (workbook_id, sheet_name, source_row) WHERE a <> '')
    SELECT a AS unit_code, sheet_name, CASE WHEN workbook_id <> 'WB-F' AND num THEN dd END AS balcony_area_derived,
    CASE WHEN workbook_id <> 'WB-F' THEN g END AS ancillary_area_derived, CASE WHEN ov IS NULL THEN '0' END AS override_amount_derived,
    CAST(CASE WHEN workbook_id = 'WB-F' THEN 0.40 ELSE 0.55 END AS DECIMAL(18,6)) AS "UNCOVERED_AREA_FACTOR",
    CASE WHEN workbook_id <> 'WB-F' AND NOT num AND dd <> '' THEN 1 ELSE 0 END AS non_numeric_areas FROM d""",
)
def calculation_inputs(d):
    """Unit records joined to three columns of their own sheet; two workbooks have confirmed columns."""
    x = cell_plans.cells(d)
    units = promotion.units(x.staged["unit_candidates"]).select(
        F.col("id").alias("unit_id"), F.col("workbook_id").alias("group_id"), "workbook_id", "sheet_name", "source_row", "unit_code",
        "closed_area_m2", F.lit("").alias("tower_key"),
    )
    parameters = x.workbooks.select(
        F.col("workbook_id").alias("group_id"), F.lit("UNCOVERED_AREA_FACTOR").alias("key"),
        F.when(F.col("workbook_id") == "WB-F", "0.40").otherwise("0.55").cast("decimal(18,6)").alias("numeric_value"),
    )
    rows = reproduction.calculation_inputs(
        units, x.cells, parameters, balcony="D", ancillary="G", override="E", confirmed=["WB-O", "WB-P"],
        implicit_tower={"WB-F": "T1"}, bound=x.sheet_bound,
    )
    return rows.select("unit_code", "sheet_name", "balcony_area_derived", "ancillary_area_derived", "override_amount_derived",
                       "UNCOVERED_AREA_FACTOR", "non_numeric_areas")


def _canonical(d):
    x = cell_plans.cells(d)
    owners = promotion.developments(x.workbooks)
    scenarios = owners.select(F.col("scenario_id").alias("id"), F.col("id").alias("development_id"))
    return x, owners, scenarios


@query(
    "parameter_by_development",
    f"""WITH {STAGED} SELECT sha256('core.developments:' || 'DEV-' || upper(substr(workbook_id, 1, 10))) AS development_id, parameter_key_guess AS "key",
    CASE WHEN value_type_guess = 'NUMERIC' THEN CAST(value_text AS DECIMAL(18,6)) END AS numeric_value FROM parameter_candidates WHERE trim(value_text) <> ''""",
)
def parameter_by_development(d):
    """Stored parameters joined to their set and scenario."""
    x, owners, scenarios = _canonical(d)
    sets = owners.select(F.col("parameter_set_id").alias("id"), "scenario_id")
    rows = promotion.parameters(x.staged["parameter_candidates"])
    return reproduction.parameter_values(rows, sets, scenarios, x.sheet_bound)


@query(
    "calibration_by_development",
    f"""WITH {STAGED}, k AS (SELECT *, row_number() OVER (PARTITION BY workbook_id, category_key_guess ORDER BY sheet_name, source_row) AS rn FROM calibration_candidates
      WHERE dimension_guess = 'FLOOR' AND trim(category_key_guess) <> '' AND factor_value IS NOT NULL)
    SELECT sha256('core.developments:' || 'DEV-' || upper(substr(workbook_id, 1, 10))) AS group_id, category_key_guess AS category_key,
    CAST(factor_value AS DECIMAL(12,6)) AS factor FROM k WHERE rn = 1""",
)
def calibration_by_development(d):
    """Stored calibration entries of one set code as each development's lookup table."""
    x, owners, scenarios = _canonical(d)
    entries = promotion.calibration_entries(x.staged["calibration_candidates"])
    sets = (
        entries.select(F.col("calibration_set_id").alias("id"), F.col("dimension").alias("code"), "development_id").distinct()
        .join(owners.select(F.col("id").alias("development_id"), "scenario_id"), "development_id").drop("development_id")
    )
    return reproduction.calibration_table(entries, sets, scenarios, "FLOOR", x.sheet_bound)


@query(
    "units_with_towers",
    f"""WITH {STAGED} SELECT unit_ref AS unit_code, sheet_name, source_row, tower_ref AS tower_key FROM unit_candidates""",
)
def units_with_towers(d):
    x = cell_plans.cells(d)
    units, towers = promotion.units(x.staged["unit_candidates"]), promotion.towers(x.staged["unit_candidates"])
    return reproduction.units_with_towers(units, towers).select("unit_code", "sheet_name", "source_row", "tower_key")


# --- sets ---


def _two_sided(left: str, right: str, name: str, a: str, b: str) -> str:
    return (f"SELECT '{name}' AS set_name, development_id, k AS \"key\", '{a}' AS only FROM ({left} EXCEPT {right})"
            f" UNION ALL SELECT '{name}', development_id, k, '{b}' FROM ({right} EXCEPT {left})")


_FLOORS_LEFT = "SELECT development_id, CAST(floor AS VARCHAR) AS k FROM units"
_FLOORS_RIGHT = "SELECT g AS development_id, CAST(f AS VARCHAR) AS k FROM floors"
_BUYERS_LEFT = "SELECT c_nationkey AS development_id, CAST(c_custkey AS VARCHAR) AS k FROM customer"
_BUYERS_RIGHT = "SELECT c_nationkey AS development_id, CAST(o_custkey AS VARCHAR) AS k FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F'"


@query(
    "set_differences",
    f"WITH {sql.RULES} {_two_sided(_FLOORS_LEFT, _FLOORS_RIGHT, 'floors', 'units', 'factors')} UNION ALL "
    f"{_two_sided(_BUYERS_LEFT, _BUYERS_RIGHT, 'buyers', 'customers', 'orders')}",
)
def set_differences(d):
    """Floors that units have against floors that factors are listed for, and customers against those with an open order: both sides of each."""
    def named(left, right, name, a, b):
        return sets.differences(left, right, ["development_id", "key"], a, b).select(F.lit(name).alias("set_name"), "development_id", "key", "only")

    floors = named(
        d.units.select("development_id", F.col("floor").cast("string").alias("key")),
        d.floor_table.select(F.col("group_id").alias("development_id"), F.col("category_key").alias("key")), "floors", "units", "factors")
    customers = d.table("customer").select(F.col("c_nationkey").alias("development_id"), F.col("c_custkey").cast("string").alias("key"))
    open_ = d.table("orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").cast("string").alias("key"))
    return floors.unionByName(named(customers, open_.join(customers, "key"), "buyers", "customers", "orders"))


# --- allocation from tables, lineage, publishing ---


@query(
    "allocation_by_tables",
    f"""WITH {sql.UNITS}, weights AS (SELECT *, (CAST(private_area_m2 * 100 AS HUGEINT) * 100 + CAST(uncovered_area_m2 * 100 AS HUGEINT) * (40 + development_id))
      * (CASE WHEN floor <= 2 THEN 100 WHEN floor <= 6 THEN 105 + development_id % 3 ELSE 110 END) * (CASE position WHEN 'F' THEN 100 WHEN 'O' THEN 102 ELSE 104 + development_id % 2 END) AS w FROM units),
    totals AS (SELECT development_id, sum(w)::HUGEINT AS tw, (sum(order_total) * 100)::HUGEINT AS tc FROM weights GROUP BY 1),
    r AS (SELECT u.development_id, unit_id, {sql.half_up('tc * w', 'tw')} AS rc, tc, row_number() OVER (PARTITION BY u.development_id ORDER BY w DESC, tower, unit_code) AS rn
      FROM weights u JOIN totals t ON t.development_id = u.development_id)
    SELECT development_id, unit_id, {sql.cents('rc + CASE WHEN rn = 1 THEN tc - (sum(rc) OVER (PARTITION BY development_id))::HUGEINT ELSE 0 END')} AS system_price FROM r""",
)
def allocation_by_tables(d):
    """Each development brings its own bands, calibration entries and parameter."""
    dev = d.developments.select("development_id")
    k = F.col("development_id")

    def rows(*structs):
        return F.inline(F.array(*structs))

    bands = dev.select("development_id", rows(*[
        F.struct(F.lit(b).alias("band"), F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.lit(i).alias("ordinal"))
        for i, (b, (lo, hi)) in enumerate(CONFIG.bands.items())
    ]))

    def entry(code, key, factor):
        return F.struct(F.lit(code).alias("set_code"), F.lit(key).alias("category_key"),
                        (factor.cast("decimal(5,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(12,6)").alias("factor"))

    calibrations = dev.select("development_id", rows(
        entry(allocation.FLOOR_SET, "GARDEN", F.lit(100)), entry(allocation.FLOOR_SET, "CENTRE", 105 + k % 3), entry(allocation.FLOOR_SET, "SKY", F.lit(110)),
        entry(allocation.POSITION_SET, "F", F.lit(100)), entry(allocation.POSITION_SET, "O", F.lit(102)), entry(allocation.POSITION_SET, "P", 104 + k % 2),
    ))
    parameters = dev.select(
        "development_id", F.lit(allocation.UNCOVERED).alias("key"),
        ((40 + k).cast("decimal(5,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(18,6)").alias("numeric_value"),
    )
    floors = 10
    weights = stage(allocation.table_weights(d.units, bands, calibrations, parameters, (2, 2, 2), (d.bound * floors, d.bound * 6, d.bound)))
    priced = allocation.allocate_weights(d.units.columns, weights, d.targets, (2, 2, 2), d.bound)
    return priced.select("development_id", "unit_id", "system_price")


@query(
    "lineage_trace",
    f"""WITH {sql.ALLOC},{sql.OVERRIDES}, steps AS (SELECT unit_id, 1 AS sequence_order, 'AREA_WEIGHTING' AS adjustment_type, 'PARAMETER' AS source_set, 'UNCOVERED_AREA_FACTOR' AS source_key,
      CAST(weighted_area_m2 AS DECIMAL(18,6)) AS result_value FROM alloc
      UNION ALL SELECT unit_id, 2, 'FLOOR_PREMIUM', 'FLOOR_BAND', floor_band, CAST(weighted_area_m2 * floor_factor AS DECIMAL(18,6)) FROM alloc
      UNION ALL SELECT unit_id, 3, 'POSITION_PREMIUM', 'POSITION_CATEGORY', position, CAST(adjustment_weight AS DECIMAL(18,6)) FROM alloc),
    r AS (SELECT 'SC-' || development_id || ':' || x AS run_id, x, * FROM alloc, (VALUES ('PLAIN'), ('DECIDED')) t(x))
    SELECT 'SC-' || r.development_id AS scenario_id, r.run_id, r.development_id || '/' || r.tower AS tower_id, r.unit_id, sequence_order, adjustment_type, source_set, source_key,
    result_value, system_price, n.final_price AS override_final_price, 'INFO' AS severity FROM r JOIN steps s ON s.unit_id = r.unit_id
    LEFT JOIN newest n ON n.unit_id = r.unit_id AND n.run_id = r.run_id""",
)
def lineage_trace(d):
    towers = d.units.select("development_id", "tower").distinct().withColumn(
        "tower_id", F.concat(F.col("development_id").cast("string"), F.lit("/"), F.col("tower"))
    )
    return serving.lineage_trace(
        d.results, allocation.adjustment_steps(), d.runs, d.last_overrides, allocation.reconciliation(d.stored_allocation),
        towers, d.bound * 3,
    )


@query(
    "published_batches",
    f"""WITH {sql.UNITS} SELECT region AS batch, count(*) AS units, CAST(sum(order_total) AS {sql.M}) AS total FROM units
    JOIN (SELECT n_nationkey, n_regionkey AS region FROM nation) ON n_nationkey = development_id WHERE region <> 3 GROUP BY 1""",
)
def published_batches(d):
    """Units published region by region in one write: a repeated call changes nothing, a refused region is not seen."""
    manifest = Manifest(d.spark, f"{checkpoint_root(d.spark)}/proratio/{uuid.uuid4().hex}")
    units = attach(d.units, d.developments.select("development_id", "region"), "development_id", d.bound, "inner").select("region", "unit_id", "order_total")

    def refused(written):
        return written.where("region = 3").select("batch_id", F.lit("region 3 is not to be published").alias("note")).distinct()

    for _ in range(2):
        manifest.publish_each("units", units, F.concat(F.lit("r"), "region"), refused)
    return manifest.read("units", "region int, unit_id bigint, order_total decimal(18,2)").groupBy(F.col("region").alias("batch")).agg(
        F.count("*").alias("units"), F.sum("order_total").cast(sql.M).alias("total")
    )
