"""Conversation repair against a search over all edits, and the query against plain Python."""

import functools
import hashlib
import random
import re
import zlib

from proratio.llm import queries, turns

ROWS = "conv_id long, turn long, role string, text string"


def search(kinds):
    """Least (cost, audit) by recursion over rows and states; three inserts in a row are never of use."""
    moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @functools.lru_cache(None)
    def go(i, state, inserts):
        ways = []
        if i == len(kinds):
            ways += [(0, "")] if state in (0, 3) else []
        else:
            kind = kinds[i]
            ways.append((3, "D", go(i + 1, state, 0)))
            if kind != "x":
                if kind.lower() in moves[state]:
                    ways.append((kind.isupper(), "K", go(i + 1, moves[state][kind.lower()], 0)))
                ways += [(2 + kind.isupper(), "R", go(i + 1, to, 0)) for r, to in moves[state].items() if r in "ua"]
        if inserts < 3:
            ways += [(2, "I", go(i, to, inserts + 1)) for r, to in moves[state].items() if r in "ua"]
        return min([(w[0] + w[2][0], w[1] + w[2][1]) if len(w) == 3 else w for w in ways if len(w) == 2 or w[2]], default=None)

    return go(0, 0, 0)


def test_block_tables_give_the_cheapest_and_least_audit():
    rng = random.Random(1)
    tables = [turns.Tables(n) for n in (1, 2, 3)]
    for n in range(2500):
        kinds = "".join(rng.choice(turns.KINDS if n % 2 else "suaUAx") for _ in range(rng.randrange(0, 12)))
        want = search(kinds)
        for t in tables:
            assert turns.repair(kinds, t) == want, kinds


def test_patterns():
    assert turns.repair("") == (0, "")
    assert turns.repair("suaua") == (0, "KKKKK")
    assert turns.repair("sua" * 2) == (3, "KKKDKK")
    assert turns.repair("x") == (3, "D")
    assert turns.repair("a") == (2, "IK")
    assert turns.repair("A") == (3, "D")  # an insert and the truncation cost no less


def fields(value):
    return " " if value is None else str(value)


def slow_damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = fields(role), fields(text)
        fault = zlib.crc32(f"{fields(conv)}:{fields(turn)}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def slow_report(originals, rows):
    report = {}
    for conv in {r[0] for r in originals}:
        own = sorted((r[1] is not None, r[1] or 0, r[2], r[3]) for r in rows if r[0] == conv)
        seen, kinds, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            kept = text.strip(" \t\n\v\f\r")
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None
            seen.add((role, text))
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            kinds += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
            if fault:
                counts[fault] += 1
        at = [t for has, t, _, _ in own if has]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        roles = [r[:1] for _, _, r, _ in own]
        cost, audit = search(kinds)
        out, queue = [], list(own)
        state = {0: "u", 1: "u", 2: "a", 3: "u"}
        now = 0
        moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
        for letter in audit:
            role, text = ("", "") if letter == "I" else queue.pop(0)[2:]
            if letter == "D":
                continue
            if letter in "IR":
                role = {"u": "user", "a": "assistant"}[state[now]]
            now = moves[now][role[0]]
            out.append(f"{role}:{text}")
        assert not queue
        report[conv] = (gaps, *counts.values(), sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
                        hashlib.sha256("\n".join(out).encode()).hexdigest())
    return report


def got(frame):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in frame.collect()}


def test_query_against_plain_python(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op12_repair"](spark, folder)) == slow_report(rows, slow_damaged(rows))


def awkward():
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None, 4]), rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["system", "user", "assistant", "tool", "", None]),
             rng.choice(["Yes.", "no", "", " \n", None, "é?", "Ω　", "long " * 20_000 + "!"])) for _ in range(34)]
    return rows + [(7, 0, "user", "x."), (7, 0, "user", "x."), (8, None, None, None)]


def test_awkward_rows_and_empty_tables(spark):
    rows = awkward()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS + ", rank long, kind string").repartition(3)
    plain = [(c, t, fields(r), fields(x)) for c, t, r, x in rows]
    assert got(turns.repair_report(table, table)) == slow_report(rows, plain)
    assert got(turns.repair_report(table, turns.damaged(table))) == slow_report(rows, slow_damaged(rows))
    empty = spark.createDataFrame([], ROWS)
    assert got(turns.repair_report(empty, empty)) == {}
    assert got(turns.repair_report(table, empty))[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_follow_the_pattern(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), f"{t}.") for c in range(20) for t in range(rng.randrange(1, 9))]
    judged = turns.judged(spark.createDataFrame(rows, ROWS))
    audits = turns.audits(judged)
    out = {}
    for r in turns.repaired(judged, audits).orderBy("conv_id", "place").collect():
        out.setdefault(r["conv_id"], []).append(r)
    assert out and all(re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in own)) for own in out.values())
    assert all([r["place"] for r in own] == list(range(len(own))) for own in out.values())
