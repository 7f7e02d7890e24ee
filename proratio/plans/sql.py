"""SQL building blocks of the checks: the same domain, written for a plain SQL engine."""

from __future__ import annotations

M = "DECIMAL(18,2)"


def cents(x: str) -> str:
    """Whole cents as money."""
    return f"CAST(CAST({x} AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS {M})"


def half_up(n: str, d: str) -> str:
    """Rounded quotient of whole numbers that are not negative."""
    return f"((2 * ({n}) + ({d})) // (2 * ({d})))"


def half_even(n: str, d: str) -> str:
    q, r = f"(({n}) // ({d}))", f"(({n}) % ({d}))"
    return f"(CASE WHEN 2*{r} > ({d}) OR (2*{r} = ({d}) AND {q} % 2 = 1) THEN {q} + 1 ELSE {q} END)"


def dec(x: str, scale: int, precision: int = 18) -> str:
    """Whole number of the last place as a decimal."""
    unit = "0." + "0" * (scale - 1) + "1"
    return f"CAST(CAST({x} AS DECIMAL({38 - scale - 1},0)) * CAST({unit} AS DECIMAL({scale + 1},{scale})) AS DECIMAL({precision},{scale}))"


UNITS = f"""
line_area AS (SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(12,2))) AS closed, count(*) AS terrace
  FROM lineitem GROUP BY l_orderkey),
all_units AS (SELECT c_nationkey AS development_id, c_mktsegment AS tower, o_orderpriority AS typology,
    o_orderkey AS unit_id, CAST(o_orderkey AS VARCHAR) AS unit_code, CAST(o_orderkey % 10 + 1 AS INTEGER) AS floor,
    o_orderstatus AS position, CAST(coalesce(closed, 0) AS DECIMAL(12,2)) AS private_area_m2,
    CAST(coalesce(terrace, 0) AS DECIMAL(12,2)) AS uncovered_area_m2, CAST(o_totalprice AS {M}) AS order_total,
    o_orderdate AS order_date
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN line_area ON l_orderkey = o_orderkey),
units AS (SELECT * FROM all_units WHERE private_area_m2 > 0)"""


def digest_sums(h: str) -> str:
    """Sums of the eight 32-bit words of hex digests, as text between commas."""
    return " || ',' || ".join(f"CAST(sum(CAST('0x' || substr({h}, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))


def allocation(unc: int = 35, bands=(97, 103, 108), positions=(99, 101, 107), multiple: int = 1, prefix: str = "") -> str:
    """The allocation in whole cents; weights are whole numbers of the eighth place."""
    p = prefix
    return f"""
{p}weights AS (SELECT *, CASE WHEN floor BETWEEN 1 AND 2 THEN 'GARDEN' WHEN floor BETWEEN 3 AND 6 THEN 'CENTRE'
      WHEN floor BETWEEN 7 AND 10 THEN 'SKY' END AS floor_band,
    CASE WHEN floor BETWEEN 1 AND 2 THEN {bands[0]} WHEN floor BETWEEN 3 AND 6 THEN {bands[1]} ELSE {bands[2]} END AS fp,
    CASE position WHEN 'F' THEN {positions[0]} WHEN 'O' THEN {positions[1]} WHEN 'P' THEN {positions[2]} END AS pp,
    CAST(private_area_m2 * 100 AS HUGEINT) * 100 + CAST(uncovered_area_m2 * 100 AS HUGEINT) * {unc} AS a4
  FROM units),
{p}totals AS (SELECT development_id, sum(a4 * fp * pp)::HUGEINT AS tw, (sum(order_total) * 100 * {multiple})::HUGEINT AS tc
  FROM {p}weights GROUP BY 1),
{p}rounded AS (SELECT w.*, a4 * fp * pp AS w8, tw, tc, {half_up('tc * (a4 * fp * pp)', 'tw')} AS rc,
    {half_even('(a4 * fp * pp) * 1000000', 'tw')} AS ppm,
    row_number() OVER (PARTITION BY w.development_id ORDER BY a4 * fp * pp DESC, tower NULLS FIRST, unit_code) AS rn
  FROM {p}weights w JOIN {p}totals t ON w.development_id = t.development_id),
{p}closed AS (SELECT *, tc - (sum(rc) OVER (PARTITION BY development_id))::HUGEINT AS res FROM {p}rounded),
{p}alloc AS (SELECT development_id, tower, typology, unit_id, unit_code, floor, position, private_area_m2,
    uncovered_area_m2, order_total, order_date, floor_band, {dec('fp', 2)} AS floor_factor, {dec('pp', 2)} AS position_factor,
    {dec('a4', 4)} AS weighted_area_m2, {dec('fp * pp', 4)} AS combined_weight_factor,
    {dec('w8', 8, 24)} AS adjustment_weight,
    {dec('ppm', 6)} AS participation_share,
    rc + CASE WHEN rn = 1 THEN res ELSE 0 END AS pc,
    {cents('rc + CASE WHEN rn = 1 THEN res ELSE 0 END')} AS system_price,
    CASE WHEN rn = 1 AND res <> 0 THEN {cents('res')} END AS residual_applied,
    {cents(half_up('(rc + CASE WHEN rn = 1 THEN res ELSE 0 END) * 100', '(private_area_m2 * 100)::HUGEINT'))} AS price_per_m2,
    {cents('tc')} AS target_value
  FROM {p}closed)"""


ALLOC = UNITS + "," + allocation()

OVERRIDES = f"""
scenarios AS (SELECT 'SC-' || n_nationkey AS scenario_id, n_nationkey AS development_id, n_name AS name,
    CASE WHEN n_nationkey % 5 = 4 THEN 'DRAFT' ELSE 'ACTIVE' END AS status FROM nation),
events_o AS (SELECT user_id AS unit_id, CAST(value AS {M}) AS override_delta, ts AS decided_at, event_id
  FROM events WHERE event_type = 'purchase'),
overrides AS (SELECT a.development_id, a.tower, a.unit_code, e.unit_id, override_delta, decided_at, event_id,
    system_price AS previous_price, CAST(system_price + override_delta AS {M}) AS final_price,
    override_delta AS vgv_impact, 'SC-' || a.development_id || ':DECIDED' AS run_id
  FROM events_o e JOIN alloc a ON a.unit_id = e.unit_id),
newest AS (SELECT * FROM overrides QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY decided_at DESC, event_id DESC) = 1)"""

CURRENT = ALLOC + "," + OVERRIDES + f""",
current AS (SELECT 'SC-' || a.development_id || ':DECIDED' AS run_id, a.*, n.final_price AS override_final_price,
    coalesce(n.final_price, a.system_price) AS current_final_price
  FROM alloc a JOIN scenarios s ON s.development_id = a.development_id AND s.status = 'ACTIVE'
  LEFT JOIN newest n ON n.unit_id = a.unit_id),
enriched AS (SELECT development_id, unit_id, tower, unit_code, typology, floor, position, private_area_m2,
    uncovered_area_m2, weighted_area_m2, participation_share, system_price,
    CAST(CASE WHEN override_final_price IS NOT NULL THEN override_final_price - system_price ELSE 0 END AS {M}) AS adjustment,
    current_final_price AS final_price, price_per_m2,
    CASE WHEN override_final_price IS NOT NULL THEN 'AJUSTE' ELSE 'VALIDADO' END AS status
  FROM current)"""

RULES = UNITS + f""",
floors AS (SELECT n_nationkey AS g, f FROM nation, range(1, 11) t(f) WHERE f <> 8 AND NOT (f = 7 AND n_nationkey % 8 = 5)),
rule_in AS (SELECT unit_id, development_id AS group_id, private_area_m2 AS closed_area, uncovered_area_m2 AS terrace_area,
    floor, position, CAST(floor * 1000 + unit_id % 4 AS VARCHAR) AS code,
    CASE WHEN unit_id % 333 = 0 AND development_id % 6 = 1 THEN NULL WHEN unit_id % 50 = 0 THEN 10025 ELSE 0 END AS addend,
    (development_id * 10 + 5000)::HUGEINT AS rate, order_total FROM units),
keyed AS (SELECT *, CASE WHEN CAST(code AS INTEGER) < 10000 THEN substr(code, 1, 1) ELSE substr(code, 1, 2) END AS fkey FROM rule_in),
rule0 AS (SELECT k.*, CASE WHEN f IS NOT NULL THEN f - 5 WHEN fkey = '8' THEN 6 END AS f2,
    (closed_area * 100 + terrace_area * 100)::HUGEINT AS total2,
    ((closed_area * 100)::HUGEINT * 100 + (terrace_area * 100)::HUGEINT * 35) AS w4
  FROM keyed k LEFT JOIN floors ON g = group_id AND CAST(f AS VARCHAR) = fkey),
rule1 AS (SELECT *, w4 * (100 + f2) * 100 AS adj8 FROM rule0),
groups AS (SELECT group_id, CASE WHEN count(*) = count(adj8) THEN sum(adj8)::HUGEINT END AS tot8, min(rate) AS rate0 FROM rule1 GROUP BY 1),
rule2 AS (SELECT r.*, tot8, tot8 * rate0 * 100 AS budget10, {half_up('adj8 * 100000000000000000000::HUGEINT', 'tot8')} AS share20
  FROM rule1 r JOIN groups USING (group_id)),
rules AS (SELECT *, {half_up('share20 * budget10', '100000000000000000000::HUGEINT')} + addend::HUGEINT * 100000000 AS price10 FROM rule2)"""

COMPARE = RULES + f""",
based AS (SELECT *, {half_up('price10', '100000000::HUGEINT')} AS base_c, {half_up('adj8 * rate + addend::HUGEINT * 1000000', '1000000::HUGEINT')} AS own_c FROM rules),
refs AS (SELECT *, CASE WHEN unit_id % 8 = 6 THEN NULL WHEN unit_id % 8 = 5 OR own_c IS NULL THEN (order_total * 100)::HUGEINT
    WHEN unit_id % 8 = 2 THEN own_c + 1 WHEN unit_id % 8 = 3 THEN own_c + 75
    WHEN unit_id % 8 = 4 THEN own_c + (own_c // 2000000) * 100 ELSE own_c END AS ref_c FROM based),
deltas AS (SELECT *, {half_up('price10', '10000::HUGEINT')} - ref_c * 10000 AS d6 FROM refs),
comparisons AS (SELECT group_id AS development_id, unit_id, CASE WHEN ref_c IS NOT NULL THEN 'IMPORTED-' || group_id END AS imported_run_id,
    {cents('ref_c')} AS source_reference_price, {cents('base_c')} AS reproduced_price, {cents('base_c - ref_c')} AS delta_absolute,
    CASE WHEN d6 >= 0 THEN 1 ELSE -1 END * {dec(half_up('abs(d6) * 100', 'ref_c'), 6)} AS delta_percent,
    CASE WHEN d6 IS NULL THEN 'BLOCKED' WHEN d6 = 0 THEN 'EXACT' WHEN abs(d6) <= 10000 THEN 'WITHIN_1_CENT'
      WHEN abs(d6) <= 1000000 THEN 'WITHIN_1_REAL' WHEN abs(d6) <= ref_c THEN 'WITHIN_0_01_PERCENT' ELSE 'DIVERGENT' END AS match_classification,
    CASE WHEN price10 IS NULL THEN 'MISSING_PARAMETER' WHEN d6 IS NULL OR abs(d6) > 10000 THEN 'UNKNOWN' END AS divergence_cause
  FROM deltas),
metrics AS (SELECT count(*) AS units_analyzed,
    count(*) FILTER (WHERE match_classification IN ('EXACT','WITHIN_1_CENT')) AS within_1_cent,
    count(*) FILTER (WHERE match_classification = 'EXACT') AS exact_matches,
    CAST(coalesce(sum(delta_absolute), 0) AS DECIMAL(28,2)) AS aggregate_delta,
    CAST(coalesce(round(avg(abs(delta_absolute)), 2), 0) AS {M}) AS mae,
    CAST(coalesce(max(abs(delta_absolute)), 0) AS {M}) AS max_absolute_error,
    round(sqrt(coalesce(avg(CAST(delta_absolute AS DOUBLE) * CAST(delta_absolute AS DOUBLE)), 0)), 2) AS rmse
  FROM comparisons)"""


def hashes(source: str, p: str = "") -> str:
    """CTE ``hashes``: the logical hash of each development of an allocation."""
    return f"""{p}units_h AS (SELECT development_id, target_value, system_price, sha256(
      '{{"combined_weight_factor":"' || CAST(CAST(combined_weight_factor AS DECIMAL(12,6)) AS VARCHAR)
      || '","participation_share":"' || CAST(CAST(participation_share AS DECIMAL(9,6)) AS VARCHAR)
      || '","system_calculated_price":"' || CAST(system_price AS VARCHAR)
      || '","system_calculated_price_per_m2":"' || CAST(price_per_m2 AS VARCHAR)
      || '","tower_business_key":"' || tower || '","unit_code":"' || unit_code
      || '","weighted_area_m2":"' || CAST(CAST(weighted_area_m2 AS DECIMAL(16,4)) AS VARCHAR) || '"}}') AS h FROM {source}),
    {p}hashes AS (SELECT development_id, sha256('{{"algorithm":"REFERENCE_ALLOCATION_V1","target_vgv":"' || CAST(max(target_value) AS VARCHAR) || '","total_system_price":"'
      || CAST(CAST(sum(system_price) AS {M}) AS VARCHAR) || '","units":"' || count(*) || ',' || {digest_sums('h')} || '"}}') AS logical_hash
    FROM {p}units_h GROUP BY 1)"""


def stored_runs(source: str, overrides: str, p: str = "") -> str:
    """CTE ``stored``: what each run's tables amount to; decisions lie under the code DECIDED."""
    return hashes(source, p) + f""",
    {p}sums AS (SELECT development_id, count(*) AS units, max(target_value) AS target_value, CAST(sum(system_price) AS {M}) AS total FROM {source} GROUP BY 1),
    {p}decided AS (SELECT development_id, count(*) AS n, sum(vgv_impact) AS impact FROM {overrides} GROUP BY 1),
    {p}stored AS (SELECT 'SC-' || s.development_id || ':' || code AS run_id, units, units * 3 AS adjustments, target_value, total,
      CAST(total - target_value AS {M}) AS difference, CASE WHEN total = target_value THEN 'INFO' ELSE 'ERROR' END AS severity, logical_hash,
      CASE WHEN code = 'DECIDED' THEN coalesce(n, 0) ELSE 0 END AS overrides,
      CAST(CASE WHEN code = 'DECIDED' THEN coalesce(impact, 0) ELSE 0 END AS {M}) AS override_impact,
      CAST(total + CASE WHEN code = 'DECIDED' THEN coalesce(impact, 0) ELSE 0 END AS {M}) AS final_total
    FROM {p}sums s JOIN {p}hashes USING (development_id) LEFT JOIN {p}decided d ON d.development_id = s.development_id, (VALUES ('PLAIN'), ('DECIDED')) r(code))"""


VARIANTS = ("as_implemented_in_source", "consistent_rule_variant")


def _variant_rules() -> str:
    """The rule graph once per variant: in the first one, listed units look up floor 1."""
    import re

    text = RULES.split(UNITS + ",", 1)[1]
    text = re.sub(r"\b(floors|rule_in|keyed|rule0|rule1|groups|rule2|rules)\b", r"v_\1", text)
    values = ", ".join(f"('{v}')" for v in VARIANTS)
    for old, new in (
        ("order_total FROM units)", f"order_total, var FROM units, (VALUES {values}) t(var))"),
        ("CASE WHEN CAST(code AS INTEGER) < 10000", f"CASE WHEN var = '{VARIANTS[0]}' AND unit_id % 100 < 4 THEN '1' WHEN CAST(code AS INTEGER) < 10000"),
        ("(SELECT group_id, CASE WHEN count(*)", "(SELECT group_id, var, CASE WHEN count(*)"), ("FROM v_rule1 GROUP BY 1)", "FROM v_rule1 GROUP BY 1, 2)"),
        ("USING (group_id)", "USING (group_id, var)"),
    ):
        assert old in text, old
        text = text.replace(old, new)
    return text


# Both variants against the imported prices, which know of none.
VARIANT_COMPARE = f"""{COMPARE},{_variant_rules()},
v_deltas AS (SELECT v.*, r.ref_c, {half_up('v.price10', '100000000::HUGEINT')} AS base_c, {half_up('v.price10', '10000::HUGEINT')} - r.ref_c * 10000 AS d6
  FROM v_rules v JOIN refs r ON r.unit_id = v.unit_id),
v_compared AS (SELECT CAST(group_id AS VARCHAR) AS development_id, var AS variant, unit_id, fkey, {cents('base_c')} AS reproduced_price,
    CASE WHEN d6 IS NULL THEN 'BLOCKED' WHEN d6 = 0 THEN 'EXACT' WHEN abs(d6) <= 10000 THEN 'WITHIN_1_CENT'
      WHEN abs(d6) <= 1000000 THEN 'WITHIN_1_REAL' WHEN abs(d6) <= ref_c THEN 'WITHIN_0_01_PERCENT' ELSE 'DIVERGENT' END AS match_classification
  FROM v_deltas)"""
