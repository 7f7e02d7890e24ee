"""Repair of conversations: cheapest edits of a turn sequence, by Four-Russians block tables.

A repaired conversation has the role initials ``(s?(ua)+)?``. Rows may be kept,
given the role user or assistant, or deleted, and empty rows of these roles may be
inserted. What it takes to finish from each of the pattern's four states is a vector of
costs; its differences are bounded, so few vectors exist once the least entry is taken
off. ``TABLES`` holds, for each of them and each block of ``BLOCK`` row kinds, the vector
in front of the block and the cost that is added. A conversation is read from its end,
a lookup per block. Then blocks are expanded again, vector by vector, and
traced from the front: at each step the least letter that lies on a cheapest way is
taken, so ties are settled for the whole audit.

Rows are placed by a range sort and judged where they lie, so a conversation of any
length is spread over tasks; only its row kinds, a byte each, meet in one
value, as its audit does by definition. Texts pass in sorted streams.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proratio.llm.common import ranked, stored

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Row kinds looked up at once.
BLOCK = 3
#: Rows whose kinds are put together in one step.
PIECE = 4096

# States of the pattern: nothing yet, after s, after u, after a.
_NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
_ENDS = (0, 3)
#: The role a state asks for next, among those that can be given or inserted.
_WANTED = ["user", "user", "assistant", "user"]
_INF = 1 << 20

#: Row kinds: role initial, or another one, each sound or truncated; and one that must go.
KINDS = "suaoSUAOx"


def _steps(state: int, kind: str) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row in letter order; inserts aside."""
    found = [("D", DELETE, state)]
    if kind != "x":
        role, more = kind.lower(), TRUNCATED * kind.isupper()
        if role in _NEXT[state]:
            found.append(("K", more, _NEXT[state][role]))
        found.append(("R", REROLE + more, _NEXT[state][_WANTED[state][0]]))
    return found


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs to finish from each state when rows may be inserted first."""
    costs = list(costs)
    for _ in costs:
        for state in range(4):
            costs[state] = min(costs[state], INSERT + costs[_NEXT[state][_WANTED[state][0]]])
    return tuple(costs)


#: Costs where no row is left.
END = _with_inserts([0 if s in _ENDS else _INF for s in range(4)])


def before(costs: tuple[int, ...], kind: str) -> tuple[int, ...]:
    """The vector in front of a row, from the one behind it."""
    return _with_inserts([min(cost + costs[to] for _, cost, to in _steps(state, kind)) for state in range(4)])


class Tables:
    """Normalised vectors, and for each with each block of kinds: the vector in front and the cost added."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        least = min(END)
        self.end, self.end_cost = 0, least
        self.vectors = [tuple(c - least for c in END)]
        known, one = {self.vectors[0]: 0}, []
        for vector in self.vectors:  # grows while it is read
            row = []
            for kind in KINDS:
                front = before(vector, kind)
                low = min(front)
                front = tuple(c - low for c in front)
                if front not in known:
                    known[front] = len(self.vectors)
                    self.vectors.append(front)
                row.append((known[front], low))
            one.append(row)
        self.one = np.array(one, np.int64)
        to, cost = self.one[:, :, 0], self.one[:, :, 1]
        self.to, self.cost = to, cost
        # A block's number is that of its last kind, times the kinds, plus the one before, and so on: rows are read from the end.
        for _ in range(block - 1):
            self.cost = (self.cost[:, :, None] + cost[self.to]).reshape(len(self.vectors), -1)
            self.to = to[self.to].reshape(len(self.vectors), -1)


TABLES = Tables()
_CODE = np.full(256, -1, np.int64)
_CODE[list(KINDS.encode())] = range(len(KINDS))


def repair(kinds: str, tables: Tables = TABLES) -> tuple[int, str]:
    """Least cost, and the least of its audits: D, I, K and R in order."""
    codes, t = _CODE[np.frombuffer(kinds.encode(), np.uint8)], tables.block
    whole = len(codes) // t
    head = len(codes) - whole * t  # the front rows that fill no block
    blocks = np.zeros(whole, np.int64)
    for i in reversed(range(t)):
        blocks = blocks * len(KINDS) + codes[head + i::t][:whole]
    # Vectors behind each block, from the end; blocks by lookup.
    behind, vector, total = np.zeros(whole, np.int64), tables.end, tables.end_cost
    to, cost = tables.to, tables.cost
    for j in range(whole - 1, -1, -1):
        behind[j] = vector
        total += int(cost[vector, blocks[j]])
        vector = int(to[vector, blocks[j]])
    audit, state = [], 0
    spans = [(0, head, vector)] + [(head + j * t, head + (j + 1) * t, int(behind[j])) for j in range(whole)]
    for n, (first, last, vector) in enumerate(spans):
        inside = [tables.vectors[vector]]
        for kind in reversed(kinds[first:last]):
            inside.append(before(inside[-1], kind))
        total += inside[-1][0] if n == 0 else 0
        for i, kind in enumerate(kinds[first:last]):
            front, back = inside[last - first - i], inside[last - first - i - 1]
            state = _trace(audit, state, front, back, kind)
    while state not in _ENDS:
        audit.append("I")
        state = _NEXT[state][_WANTED[state][0]]
    return total, "".join(audit)


def _trace(audit: list[str], state: int, front: tuple[int, ...], back: tuple[int, ...], kind: str) -> int:
    """Edits up to and with one row; the state behind it."""
    while True:
        ways = [(letter, to) for letter, cost, to in _steps(state, kind) if cost + back[to] == front[state]]
        asked = _NEXT[state][_WANTED[state][0]]
        if INSERT + front[asked] == front[state]:
            ways.append(("I", asked))
        letter, to = min(ways)
        audit.append(letter)
        state = to
        if letter != "I":
            return state


# --- tables ------------------------------------------------------------------

_BLANKS = " \t\n\x0b\x0c\r"


def _text(name: str) -> Column:
    """A value as text; null is one space."""
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the fixed damage: crc32 of ``conv_id:turn`` modulo 20."""
    key = F.concat(_text("conv_id"), F.lit(":"), _text("turn"))
    fault = F.crc32(F.encode(key, "UTF-8")) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(_text("text"), "[.!?]", "")).otherwise(_text("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(_text("role"))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def judged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, rank, kind, fault) of each row, stored; rank from 0 within a conversation.

    Rows go by turn, nulls first, then by role and text. ``fault`` is the first of
    blank, duplicate, truncated, or null. Null roles and texts count as one space.
    """
    placed = ranked(rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text")),
                    [F.col("turn").asc_nulls_first(), "role", "text"], ["conv_id"])
    # Which rows are the first of their role and text: one digest a row, combined where the rows are.
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = placed.groupBy(F.col("conv_id").alias("_c"), digest.alias("_d")).agg(F.min("rank").alias("_r")).select("_c", "_r")
    same = placed["conv_id"].eqNullSafe(F.col("_c")) & (placed["rank"] == F.col("_r"))
    placed = placed.join(firsts, same, "left")
    seen = F.rtrim("text", F.lit(_BLANKS))
    last = F.substring(seen, -1, 1)
    fault = F.when(seen == "", F.lit("blank")).when(F.col("_r").isNull(), F.lit("duplicate")).when(~last.isin(".", "!", "?"), F.lit("truncated"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    kind = F.when(fault.isin("blank", "duplicate"), F.lit("x")).when(fault == "truncated", F.upper(kind)).otherwise(kind)
    return stored(placed.select("conv_id", "turn", "role", "text", "rank", kind.alias("kind"), fault.alias("fault"), initial.alias("initial")), "turns")


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation of judged rows: counts of faults, gaps and illegal neighbours, cost and audit."""
    number = lambda c: F.count_if(c).alias
    part = F.expr(f"rank div {PIECE}")
    pieces = rows.groupBy("conv_id", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "kind", "initial"))).alias("all"),
        number(F.col("fault") == "blank")("blank"), number(F.col("fault") == "duplicate")("duplicate"), number(F.col("fault") == "truncated")("truncated"))
    pieces = pieces.select("conv_id", "part", "blank", "duplicate", "truncated", F.expr("concat_ws('', transform(all, x -> x.kind))").alias("kinds"),
                           F.expr("transform(all, x -> x.initial)").alias("initials"))
    legal = F.expr("""aggregate(sequence(1, size(initials)), 0L, (n, i) -> n + if(i > 1 and
        not coalesce(concat(get(initials, i - 2), get(initials, i - 1)) in ('su', 'ua', 'au'), false), 1L, 0L))""")
    pieces = pieces.withColumn("illegal", legal).withColumn("first", F.expr("initials[0]")).withColumn("last", F.expr("initials[size(initials) - 1]"))
    whole = pieces.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("part", "kinds", "first", "last"))).alias("all"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    borders = F.expr("""aggregate(sequence(1, size(all)), 0L, (n, i) -> n + if(i > 1 and
        not (concat(get(all, i - 2).last, get(all, i - 1).first) in ('su', 'ua', 'au')), 1L, 0L))""")
    whole = whole.select("conv_id", "blank", "duplicate", "truncated", (F.col("illegal") + borders).alias("illegal"),
                         F.expr("concat_ws('', transform(all, x -> x.kinds))").alias("kinds"))

    def of(batches):
        for batch in batches:
            found = [repair(k) for k in batch.column("kinds").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in ("conv_id", "blank", "duplicate", "truncated", "illegal")],
                pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string()),
            ], ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    kind = dict(rows.dtypes)["conv_id"]
    solved = whole.mapInArrow(of, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    # Turns are told apart before they are counted, so that those of a long conversation spread.
    turns = rows.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv_id").alias("_c")).agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    joined = solved.join(turns, solved["conv_id"].eqNullSafe(F.col("_c")), "left")
    return joined.select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _edited(stream):
    """(conversation, role, text, letter) of each repaired row; (conversation, None, None, None) ends one.

    ``stream`` gives (conversation, rank, role, text) sorted; a conversation's rank -1 has its audit as text.
    """
    open_, conv, audit, at, state = False, None, "", 0, 0

    def insert():
        nonlocal at, state
        role = _WANTED[state]
        at, state = at + 1, _NEXT[state][role[0]]
        return conv, role, "", "I"

    def finish():
        while at < len(audit):
            yield insert()
        yield conv, None, None, None

    for own, rank, role, text in stream:
        if rank < 0:
            if open_:
                yield from finish()
            open_, conv, audit, at, state = True, own, text, 0, 0
            continue
        while audit[at] == "I":
            yield insert()
        letter = audit[at]
        at += 1
        if letter == "D":
            continue
        if letter == "R":
            role = _WANTED[state]
        state = _NEXT[state][role[0]]
        yield conv, role, text, letter
    if open_:
        yield from finish()


def _stream(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows with their audit in front, a conversation in one task, in order; nothing is gathered, only sorted."""
    heads = audits.select("conv_id", F.lit(-1).cast("long").alias("rank"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return rows.select("conv_id", "rank", "role", "text").union(heads).repartition("conv_id").sortWithinPartitions("conv_id", "rank")


def _tuples(batches):
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(4)])


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired turns of judged rows; place from 0."""
    kind = dict(rows.dtypes)["conv_id"]
    arrow = rows.select("conv_id").schema

    def of(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(arrow).append(pa.field("place", pa.int64())).append(pa.field("edit", pa.string())).append(
            pa.field("role", pa.string())).append(pa.field("text", pa.string()))
        out, place = [], 0
        for conv, role, text, letter in _edited(_tuples(batches)):
            if letter is None:
                place = 0
                continue
            out.append((conv, place, letter, role, text))
            place += 1
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return _stream(rows, audits).mapInArrow(of, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of a conversation's repaired ``role:text`` lines."""
    kind = dict(rows.dtypes)["conv_id"]
    arrow = rows.select("conv_id").schema

    def of(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(arrow).append(pa.field("repaired_sha256", pa.string()))
        out, digest, begun = [], hashlib.sha256(), False
        for conv, role, text, letter in _edited(_tuples(batches)):
            if letter is not None:
                digest.update((("\n" if begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                begun = True
                continue
            out.append((conv, digest.hexdigest()))
            digest, begun = hashlib.sha256(), False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return _stream(rows, audits).mapInArrow(of, f"conv_id {kind}, repaired_sha256 string")


def repair_report(originals: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``originals``: what is wrong with its ``rows``, the cheapest repair, and the digest of its result.

    A conversation without rows has zeros, an empty audit and the digest of the empty
    text. A null conv_id is a conversation. Repeated rows are duplicates but the first;
    rows that tie in turn go by role and text. Columns beyond conv_id, turn, role and
    text are not read. Texts and conversations of any length pass in streams.
    """
    all_rows = judged(rows)
    found = stored(audits(all_rows), "audits")
    hashes = digests(all_rows, found)
    names = originals.select(F.col("conv_id").alias("_all")).distinct()
    out = names.join(found, F.col("_all").eqNullSafe(found["conv_id"]), "left").drop("conv_id")
    out = out.join(hashes, F.col("_all").eqNullSafe(hashes["conv_id"]), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        F.col("_all").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
