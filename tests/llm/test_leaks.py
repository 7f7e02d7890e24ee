"""The positional index against plain Python: phrases, proximity, and contaminated documents."""

import hashlib
import random
import re

from proratio.llm import common, leaks
from test_llm_operators import DOCS, awkward_rows

QUERIES = "phrase long, words array<string>"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus():
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["A", "É", "e1"]) if rng.random() < 0.1 else rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    return [*rows, (90, "A.b,c;D e"), (91, None), (92, ""), (93, "漢字 a b　c"), (90, "a b a b a b")]


def test_phrases(spark):
    rng, rows = random.Random(3), corpus()
    queries = [(i, [rng.choice("abcdefgh") for _ in range(n)]) for i, n in enumerate([1, 1, 2, 2, 3, 3, 3, 4, 4, 2])] + [(20, ["a", "a"]), (21, ["zz", "a"]), (22, ["É"]), (23, ["漢字"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for segment in (1, 300, 1 << 20):
        index = leaks.build(docs, segment)
        ids = {r["row"]: r["doc_id"] for r in leaks.documents(index).collect()}
        got = sorted((ids[r["row"]], r["phrase"], tuple(sorted(r["starts"]))) for r in leaks.phrases(index, spark.createDataFrame(queries, QUERIES)).collect())
        want = []
        for doc, text in rows:
            w = words(text)
            for i, q in queries:
                at = tuple(k for k in range(len(w) - len(q) + 1) if w[k:k + len(q)] == q)
                want += [(doc, i, at)] if at else []
        assert got == sorted(want)


def test_proximity(spark):
    rows = corpus()
    queries = [(0, ["a", "b"]), (1, ["a", "c", "e"]), (2, ["h"]), (3, ["a", "b", "a"]), (4, ["É", "a"]), (5, ["none", "a"])]
    index = leaks.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 400)
    ids = {r["row"]: r["doc_id"] for r in leaks.documents(index).collect()}
    for span in (1, 4, 9):
        got = sorted((ids[r["row"]], r["phrase"], r["start"], r["end"]) for r in leaks.near(index, spark.createDataFrame(queries, QUERIES), span).collect())
        want = []
        for doc, text in rows:
            w = words(text)
            for i, q in queries:
                holds = lambda s, e: set(q) <= set(w[s:e + 1])  # noqa: B023, E731
                want += [(doc, i, s, e) for s in range(len(w)) for e in range(s, min(len(w), s + span))
                         if holds(s, e) and not holds(s + 1, e) and not holds(s, e - 1)]
        assert got == sorted(want)


def slow(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9)):
            if w:
                windows.setdefault(tuple(w[k:k + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in frame.collect()), key=str)


def test_contamination_of_awkward_tables(spark):
    rows = awkward_rows()
    long = rows[6][1].split()
    items = [(3, " ".join(long[100:130])), (20, " ".join(long[5000:5010])), (100, "one"), (None, "id HERE"), (4, None), (5, ""), (6, "?!"), (7, "One"), (3, "漢字")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", row long, term string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, phrase long")
    assert got(leaks.contamination(docs, bench)) == slow([(r[0], r[1]) for r in rows], items)
    none = spark.createDataFrame([], bench.schema)
    assert got(leaks.contamination(docs, none)) == slow([(r[0], r[1]) for r in rows], [])
    assert leaks.contamination(spark.createDataFrame([], DOCS), bench).collect() == []


def test_common_passage(spark):
    """A passage in every document, often, and in several items."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(14))
    docs = [(i, " ".join([passage] * rng.randrange(1, 4) + [rng.choice("xyz")] + [passage])) for i in range(60)]
    items = [(i, passage if i % 2 else "q " + passage) for i in range(6)]
    table = common.stored(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert got(leaks.contamination(table, spark.createDataFrame(items, "item_id long, text string"))) == slow(docs, items)
