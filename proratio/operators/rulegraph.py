"""Configurable rule graphs over units and groups, as one DataFrame plan.

A ruleset is a dict with ``inputs`` and ``rules``; each rule names its
``output``, ``operation``, ``operands`` and optionally ``status`` and ``type``.
Rules turn into columns. A missing operand gives NULL; a blocked rule gives NULL
and blocks whatever depends on it.

Group values (``group_sum``, ``multiply_by_parameter``) are one row per group,
computed by partial aggregation and attached back, so that a group holding a
large part of the units gathers nowhere.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proratio.functions.text import DIGEST_WORDS, composite_key, digest_sums, magnitude_prefix, number
from proratio.session import attach, stage

BLOCKING = {"BLOCKED_BY_AMBIGUITY", "DORMANT", "NOT_REQUIRED_FOR_REPRODUCTION", "ANALYSIS_ONLY"}

# Type of a rule's output unless the rule declares one. Wide enough for the
# values, narrow enough that Spark keeps the places of products and quotients.
TYPES = {
    "sum": "decimal(18,6)",
    "add": "decimal(18,6)",
    "weighted_sum": "decimal(18,6)",
    "multiply_factors": "decimal(18,8)",
    "lookup_table": "decimal(12,6)",
    "lookup_table_composite": "decimal(12,6)",
    "group_sum": "decimal(24,8)",
    "multiply_by_parameter": "decimal(28,10)",
    "ratio_to_group_total": "decimal(22,20)",
    "linear_price": "decimal(28,10)",
    "divide": "decimal(28,10)",
}
INPUT = "decimal(18,6)"
GROUP_OPERATIONS = ("group_sum", "multiply_by_parameter")


# Operations whose type follows wider operands; the others divide, and keep the places they have.
WIDENED = ("sum", "add", "weighted_sum", "multiply_factors", "group_sum")


def _digits(kind: str) -> tuple[int, int]:
    """Whole digits and places of a decimal type."""
    precision, scale = kind.removeprefix("decimal(").removesuffix(")").split(",")
    return int(precision) - int(scale), int(scale)


def _widened(rule: dict, operands: dict[str, tuple[int, int]], least: tuple[int, int]) -> str:
    """A type that holds every result of a rule over operands of these digits; refused beyond 38."""
    op, o = rule["operation"], rule.get("operands", {})
    if op == "multiply_factors":
        whole_, places = sum(w for w, _ in operands.values()) + len(o.get("factors", [])), sum(s for _, s in operands.values())
    elif op == "weighted_sum":
        weight = operands.get(o.get("weight_parameter"), (1, 0))
        parts = [operands[f] for f in o.get("base_fields", [])]
        if o.get("weighted_field"):
            field = operands[o["weighted_field"]]
            parts.append((field[0] + weight[0], field[1] + weight[1]))
        whole_, places = max(w for w, _ in parts) + len(str(len(parts))), max(s for _, s in parts)
    else:
        grown = 10 if op == "group_sum" else len(str(len(operands)))
        whole_, places = max(w for w, _ in operands.values()) + grown, max(s for _, s in operands.values())
    whole_, places = max(whole_, least[0]), max(places, min(least[1], 38 - whole_) if whole_ < 38 else 0)
    if whole_ + places > 38:
        raise RulesetError(f"rule {rule['output']} needs {whole_ + places} digits; declare its type, or narrower inputs")
    return f"decimal({whole_ + places},{places})"


class RulesetError(ValueError):
    """A ruleset that cannot be evaluated: unknown operation, missing variable or cycle."""


class Ruleset:
    """A checked ruleset. Among rules of equal output the last one counts."""

    def __init__(self, data: dict):
        self.inputs = dict(data.get("inputs", {}))
        self.rules = {rule["output"]: rule for rule in data.get("rules", [])}
        self.uses = {output: self._variables(rule) for output, rule in self.rules.items()}
        for output, names in self.uses.items():
            unknown = [n for n in names if n not in self.inputs and n not in self.rules]
            if unknown:
                raise RulesetError(f"rule {output}: undeclared {', '.join(unknown)}")
        for output, rule in self.rules.items():
            keys = _key_fields(rule)
            derived = [k for k in keys if k in self.rules]
            if derived:
                raise RulesetError(f"rule {output}: lookup keys are read from the input record, not from {derived}")
        self.order = self._order()
        self.types = self._types()

    def only(self, outputs: list[str]) -> "Ruleset":
        """The rules these outputs need, blocked ones included."""
        wanted, open_ = set(), [o for o in outputs if o in self.rules]
        while open_:
            output = open_.pop()
            if output not in wanted:
                wanted.add(output)
                open_ += [u for u in self.uses[output] if u in self.rules]
        return Ruleset({"inputs": self.inputs, "rules": [r for o, r in self.rules.items() if o in wanted]})

    @staticmethod
    def version(text: bytes) -> str:
        return f"sha256:{hashlib.sha256(text).hexdigest()[:16]}"

    @classmethod
    def parse(cls, text: str) -> "Ruleset":
        return cls(json.loads(text))

    @staticmethod
    def _variables(rule: dict) -> list[str]:
        op, o = rule["operation"], rule.get("operands", {})
        single = {
            "multiply_by_parameter": ["field"],
            "ratio_to_group_total": ["numerator_field", "group_total_field"],
            "linear_price": ["participation_field", "group_value_field", "addend_field"],
            "divide": ["numerator_field", "denominator_field"],
            "weighted_sum": ["weighted_field"],
            "multiply_factors": ["base"],
            "lookup_table": ["key_source_field"],
        }
        several = {
            "sum": "fields", "add": "fields", "group_sum": "fields", "weighted_sum": "base_fields",
            "multiply_factors": "factors", "lookup_table_composite": "key_source_fields",
        }
        if op not in single and op not in several and op != "passthrough_raw":
            raise RulesetError(f"unknown operation {op!r} in rule {rule['output']}")
        names = [o.get(f) for f in single.get(op, [])] + list(o.get(several.get(op), []))
        return [n for n in names if n]

    def _order(self) -> list[str]:
        """Outputs, each after what it uses."""
        done: list[str] = []
        while len(done) < len(self.rules):
            ready = [
                o for o in self.rules
                if o not in done and all(u in done or u not in self.rules for u in self.uses[o])
            ]
            if not ready:
                raise RulesetError(f"cycle among {sorted(set(self.rules) - set(done))}")
            done += ready
        return done

    def _types(self) -> dict[str, str]:
        """Decimal type of each input that declares one, and of each rule: its own, that of its operation, or one as wide as its operands need."""
        found = {n: spec["type"] for n, spec in self.inputs.items() if isinstance(spec, dict) and spec.get("type")}
        wide = set(found)
        for output in self.order:
            rule = self.rules[output]
            own = TYPES.get(rule["operation"], INPUT)
            operands = [u for u in [*self.uses[output], rule.get("operands", {}).get("weight_parameter")] if u]
            if rule.get("type"):
                own = rule["type"]
            elif wide & set(operands) and rule["operation"] in WIDENED:
                own = _widened(rule, {u: _digits(found.get(u, INPUT)) for u in operands}, _digits(own))
                wide.add(output)
            found[output] = own
        return found

    @property
    def numbers(self) -> list[str]:
        """Inputs that are read as numbers."""
        keys = {k for r in self.rules.values() for k in _key_fields(r)}
        names = [n for o, r in self.rules.items() for n in [
            *[u for u in self.uses[o] if u not in _key_fields(r)], *[r.get("operands", {}).get(p) for p in ("weight_parameter", "parameter")]]]
        return [n for n in self.inputs if n in names and n not in keys]

    @property
    def blocked(self) -> dict[str, str]:
        """Blocked outputs and why, directly or through what they use."""
        found = {o: r["status"] for o, r in self.rules.items() if r.get("status", "ACTIVE") in BLOCKING}
        for output in self.order:
            if output not in found:
                via = next((u for u in self.uses[output] if u in found), None)
                if via:
                    found[output] = f"BLOCKED_TRANSITIVELY_VIA:{via}"
        return found


def _key_fields(rule: dict) -> list[str]:
    o = rule.get("operands", {})
    if rule["operation"] == "lookup_table":
        return [o["key_source_field"]]
    if rule["operation"] == "lookup_table_composite":
        return list(o["key_source_fields"])
    return []


def check_inputs(units: DataFrame, ruleset: Ruleset) -> None:
    """Binary floating point is refused: money is never computed from it."""
    floats = [n for n, t in units.dtypes if t in ("float", "double") and n in ruleset.inputs]
    if floats:
        raise TypeError(f"float inputs are not allowed: {floats}")


def input_rejects(units: DataFrame, ruleset: Ruleset) -> DataFrame:
    """(unit_id, group_id, input, text, reason): texts of numeric inputs that their type cannot hold as they stand.

    Reasons: ``not_a_number``; ``too_long`` (more whole digits than the type has);
    ``too_many_places`` (it would be rounded). A missing value is no reject: it blocks.
    """
    kinds = dict(units.dtypes)
    found = []
    for name in ruleset.numbers:
        if kinds.get(name) != "string":
            continue
        whole_, places = _digits(ruleset.types.get(name, INPUT))
        text = F.trim(F.col(name))
        plain = text.rlike(r"^[+-]?[0-9]*\.?[0-9]+$|^[+-]?[0-9]+\.$")
        used = F.length(F.regexp_extract(text, r"\.([0-9]*?)0*$", 1))
        lead = F.length(F.regexp_extract(text, r"^[+-]?0*([0-9]*)", 1))
        reason = (
            F.when(text == "", None).when(~plain, F.when(text.try_cast(f"decimal({whole_ + places},{places})").isNull(), "not_a_number"))
            .when(lead > whole_, "too_long").when(used > places, "too_many_places"))
        found.append(F.when(reason.isNotNull(), F.struct(F.lit(name).alias("input"), F.col(name).alias("text"), reason.alias("reason"))))
    if not found:
        return units.select("unit_id", "group_id", F.lit("").alias("input"), F.lit("").alias("text"), F.lit("").alias("reason")).limit(0)
    return units.select("unit_id", "group_id", F.inline(F.array_compact(F.array(*found))))


def _value(units: DataFrame, name: str) -> Column:
    """An input as a number (text that is none becomes NULL), a rule's output as it is."""
    kind = dict(units.dtypes)[name]
    return F.col(name).try_cast(INPUT) if kind == "string" else F.col(name)


def _total(parts: list[Column]) -> Column:
    result = F.lit(0).cast(INPUT)
    for p in parts:
        result = result + p
    return result


def _lookup(units: DataFrame, key: Column, rule: dict, tables: dict[str, DataFrame], group: str, bound) -> DataFrame:
    """Table value of a key: the row's forced key first, listed defaults last."""
    o, output = rule["operands"], rule["output"]
    kind = rule.get("type", TYPES[rule["operation"]])
    forced = o.get("row_key_overrides", {})
    if isinstance(forced, dict) and forced:
        pairs = [F.lit(v) for pair in forced.items() for v in pair]
        key = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("unit_id").cast("string")), key)
    elif isinstance(forced, str):
        # a column of forced keys, NULL where the row keeps its own
        key = F.coalesce(F.col(forced), key)
    defaults = o.get("missing_key_defaults", {}) if rule["operation"] == "lookup_table" else {}

    def literal(mapping):
        if not mapping:
            return F.lit(None).cast(kind)
        entries = [c for k, v in mapping.items() for c in (F.lit(k), F.lit(str(v)).cast(kind))]
        return F.try_element_at(F.create_map(*entries), key)

    table = tables.get(output)
    if table is None:
        return units.withColumn(output, F.coalesce(literal(o.get("table", {})), literal(defaults)))
    rows = table.select(
        F.col("group_id").alias(group), F.col("category_key").alias(f"_{output}_key"),
        F.col("factor").cast(kind).alias(f"_{output}"),
    )
    keyed = units.withColumn(f"_{output}_key", key)
    joined = attach(keyed, rows, [group, f"_{output}_key"], rows if bound is None else bound)
    return joined.withColumn(output, F.coalesce(F.col(f"_{output}"), literal(defaults))).drop(
        f"_{output}_key", f"_{output}"
    )


def _unit_column(units: DataFrame, rule: dict, groups: set[str]) -> Column:
    """Expression of a rule that gives each unit a value."""
    op, o = rule["operation"], rule.get("operands", {})

    def unit(name):
        # A group value is not visible per unit, except to the rules made for it.
        return F.lit(None).cast(INPUT) if name in groups else _value(units, name)

    def of_group(name):
        return F.col(f"_g_{name}") if name in groups else F.lit(None).cast(INPUT)

    if op in ("sum", "add"):
        return _total([unit(f) for f in o["fields"]])
    if op == "weighted_sum":
        total = _total([unit(f) for f in o.get("base_fields", [])])
        weight_name = o.get("weight_parameter")
        weight = F.lit(1).cast(INPUT)
        if weight_name:
            # read from the input record, so a rule's output is no weight
            weight = _value(units, weight_name) if weight_name in units.columns else F.lit(None).cast(INPUT)
        if o.get("weighted_field"):
            return total + unit(o["weighted_field"]) * weight
        return F.when(weight.isNotNull(), total)
    if op == "multiply_factors":
        result = unit(o["base"])
        for f in o.get("factors", []):
            result = result * (F.lit(1).cast("decimal(1,0)") + unit(f))
        return result
    if op == "ratio_to_group_total":
        return F.try_divide(unit(o["numerator_field"]).cast("decimal(18,8)"), of_group(o["group_total_field"]))
    if op == "linear_price":
        addend = unit(o["addend_field"]) if o.get("addend_field") else F.lit(0).cast(INPUT)
        return unit(o["participation_field"]) * of_group(o["group_value_field"]) + addend
    if op == "divide":
        return F.try_divide(unit(o["numerator_field"]), unit(o["denominator_field"]))
    raise RulesetError(f"unknown operation {op!r}")


def _group_rows(units: DataFrame, rules: list[dict], group: str, ordinal: str, known: set[str]) -> DataFrame:
    """Group values of ``rules`` and the parameters they read, one row per group."""
    measures, results = [], []
    for rule in rules:
        output, o = rule["output"], rule["operands"]
        kind = rule.get("type", TYPES[rule["operation"]])
        if rule["operation"] == "group_sum":
            # One missing value leaves the group without a total.
            field = o["fields"][0]
            value = F.lit(None).cast(INPUT) if field in known else _value(units, field)
            measures.append(F.when(F.count(value) == F.count(F.lit(1)), F.sum(value)).cast(kind).alias(f"_g_{output}"))
        else:
            first = F.lit(None).cast(INPUT)
            if o["parameter"] in units.columns:
                first = F.min_by(_value(units, o["parameter"]), F.col(ordinal))
            measures.append(first.cast("decimal(14,6)").alias(f"_p_{output}"))
            results.append((output, o["field"], kind))
    rows = units.groupBy(group).agg(*measures)
    for output, source, kind in results:
        # the source is a group value of this or an earlier level
        if f"_g_{source}" in rows.columns:
            base = F.col(f"_g_{source}")
            rows = rows.withColumn(f"_g_{output}", (base * F.col(f"_p_{output}")).cast(kind)).drop(f"_p_{output}")
    return rows


def evaluate(units: DataFrame, ruleset: Ruleset, *, group: str = "group_id", ordinal: str = "ordinal",
             tables: dict[str, DataFrame] | None = None, bound=None) -> DataFrame:
    """All rule outputs as columns on the units; group values as ``_g_<output>``.

    ``units`` is read once per level of group values, so pass a stored table.
    ``tables`` gives lookup tables per group (``group_id, category_key, factor``)
    by rule output. ``bound`` proves the number of groups.
    """
    check_inputs(units, ruleset)
    for name in ruleset.numbers:
        # Inputs that declare a type are read in it; lookups read the text.
        if ruleset.inputs[name].get("type") and dict(units.dtypes).get(name) == "string":
            units = units.withColumn(name, F.col(name).try_cast(ruleset.inputs[name]["type"]))
    tables = tables or {}
    blocked = ruleset.blocked
    is_group = {o for o, r in ruleset.rules.items() if r["operation"] in GROUP_OPERATIONS}
    bound = units.select(group).distinct() if bound is None else bound
    pending = list(ruleset.order)
    done: set[str] = set(ruleset.inputs)
    levels = 0
    while pending:
        progressed = False
        for output in list(pending):
            rule = ruleset.rules[output]
            if output in is_group and output not in blocked:
                continue
            if any(u in pending for u in ruleset.uses[output]) and output not in blocked:
                continue
            kind = ruleset.types[output]
            if output in blocked:
                units = units.withColumn(output, F.lit(None).cast(kind))
            elif rule["operation"] == "lookup_table":
                o = rule["operands"]
                key = F.col(o["key_source_field"]).cast("string")
                if o.get("derivation") == "magnitude_prefix":
                    p = o["derivation_params"]
                    key = magnitude_prefix(key, p["threshold"], p["digits_below"], p["digits_at_or_above"])
                units = _lookup(units, key, rule, tables, group, None)
            elif rule["operation"] == "lookup_table_composite":
                o = rule["operands"]
                key = composite_key([F.col(f).cast("string") for f in o["key_source_fields"]], o.get("key_separator", "-"))
                units = _lookup(units, key, rule, tables, group, None)
            elif rule["operation"] != "passthrough_raw":
                units = units.withColumn(output, _unit_column(units, rule, is_group).cast(kind))
            pending.remove(output)
            done.add(output)
            progressed = True
        # Group values whose sources are all there, or come from this same level.
        level: list[str] = []
        for output in pending:
            if output in is_group and all(u in done or u in level for u in ruleset.uses[output]):
                level.append(output)
        if level:
            if levels:
                units = stage(units)
            levels += 1
            rows = _group_rows(units, [{**ruleset.rules[o], "type": ruleset.types[o]} for o in level], group, ordinal, is_group)
            earlier = [c for c in units.columns if c.startswith("_g_")]
            units = attach(units, rows, group, bound)
            for output in level:
                rule = ruleset.rules[output]
                if f"_g_{output}" not in units.columns:
                    base = F.col(f"_g_{rule['operands']['field']}") if f"_g_{rule['operands']['field']}" in earlier else F.lit(None)
                    kind = ruleset.types[output]
                    units = units.withColumn(f"_g_{output}", (base * F.col(f"_p_{output}")).cast(kind))
                pending.remove(output)
                done.add(output)
            units = units.drop(*[c for c in units.columns if c.startswith("_p_")])
        elif not progressed:
            raise RulesetError(f"cannot evaluate {pending}")
    return units


def blocked_report(spark, ruleset: Ruleset) -> DataFrame:
    """Rules that are not run, and why."""
    return spark.createDataFrame(sorted(ruleset.blocked.items()), "rule string, reason string")


def blocked_units(units: DataFrame, ruleset: Ruleset, group: str = "group_id") -> DataFrame:
    """How many units of each group each rule leaves without a value."""
    names = [o for o in ruleset.order if o in units.columns]
    counts = F.array(*[F.struct(F.lit(o).alias("rule"), F.count_if(F.col(o).isNull()).alias("missing")) for o in names])
    reasons = ruleset.blocked
    pairs = [F.lit(v) for pair in reasons.items() for v in pair]
    reason = F.try_element_at(F.create_map(*pairs), F.col("rule")) if pairs else F.lit(None).cast("string")
    return (
        units.groupBy(group).agg(F.count("*").alias("units"), counts.alias("c"))
        .select(group, "units", F.inline("c")).withColumn("reason", reason)
    )


def row_digest(fields: list[str], uid: str = "unit_id") -> Column:
    """One unit's line of the result text: id and values, a missing value as empty text."""
    parts = [F.col(uid).cast("string")] + [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    return F.concat_ws("|", *parts)


def result_hash(units: DataFrame, fields: list[str], bound=None, group: str = "group_id", ordinal: str = "ordinal") -> DataFrame:
    """SHA-256 per group over the number and the digests of its units' lines.

    A line holds the unit's place, id and values. Digests enter as sums of their words,
    so a group of any size is added up where its units are.
    """
    line = F.concat_ws("|", F.coalesce(F.col(ordinal).cast("string"), F.lit("")), row_digest(fields))
    sums = units.select(group, F.sha2(line, 256).alias("digest")).groupBy(group).agg(F.count(F.lit(1)).alias("units"), *digest_sums(F.col("digest")))
    return sums.select(group, F.sha2(F.concat_ws(",", "units", *DIGEST_WORDS), 256).alias("result_hash"))
