"""References over one union, and lineage walked along edges."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from proratio import session
from proratio.functions import text
from proratio.operators import lineage, quality, references
from proratio.operators.references import Reference, orphans, to


def got(found):
    return {(r["reference"], r["key"], r["rows"]) for r in found.collect()}


def test_every_entity_declares_its_references():
    assert set(quality.ENTITY_RULES) <= set(references.REFERENCES)
    parents = {ref.parent for refs in references.REFERENCES.values() for ref in refs}
    assert parents <= set(references.REFERENCES)
    # In the order of writing no inline reference comes before its parent.
    place = {n: i for i, n in enumerate(references.ORDER)}
    for name in references.ORDER:
        for ref in references.REFERENCES[name]:
            assert ref.deferred or place[ref.parent] <= place[name]


RULES = {
    "tower": [],
    "unit": [to("tower_id", "tower"), Reference(("tower_id", "owner"), "tower", ("id", "owner"))],
    "note": [to("unit_id", "unit"), to("source_id", "source", deferred=True)],
    "source": [],
}


def tables(spark):
    return {
        "tower": spark.createDataFrame([(1, "x"), (2, "y")], "id int, owner string"),
        "unit": spark.createDataFrame([(10, 1, "x"), (11, 2, "x"), (12, 9, "x"), (13, 9, "y"), (14, None, "x"), (15, 2, None)], "id int, tower_id int, owner string"),
        "note": spark.createDataFrame([(10, 5), (99, 5), (99, 6), (None, None)], "unit_id int, source_id int"),
        "source": spark.createDataFrame([(5,)], "id int"),
    }


def test_inline_composite_and_deferred(spark):
    t = tables(spark)
    assert got(orphans(t, rules=RULES)) == {
        ("unit.tower_id", "9", 2), ("unit.tower_id+owner", "2|x", 1), ("unit.tower_id+owner", "9|x", 1), ("unit.tower_id+owner", "9|y", 1),
        ("note.unit_id", "99", 2), ("note.source_id", "6", 1)}
    assert {tuple(r) for r in references.report(orphans(t, rules=RULES)).where("reference = 'unit.tower_id+owner'").collect()} == {("unit.tower_id+owner", 3, 3)}


def test_an_inline_parent_must_come_first_and_a_deferred_one_need_not(spark):
    t = tables(spark)
    late = {n: t[n] for n in ("note", "unit", "tower", "source")}
    found = got(orphans(late, rules=RULES))
    assert ("note.unit_id", "10", 1) in found and ("unit.tower_id", "1", 1) in found
    assert not {f for f in found if f[0] == "note.source_id" and f[1] == "5"}
    # What is stored is there before the batch.
    stored = {"tower": t["tower"], "unit": t["unit"]}
    assert got(orphans({"note": t["note"], "source": t["source"]}, stored, RULES)) == {("note.unit_id", "99", 2), ("note.source_id", "6", 1)}


def test_keys_of_several_columns_do_not_run_together(spark):
    rules = {"c": [Reference(("a", "b"), "p", ("a", "b"))], "p": []}
    t = {"p": spark.createDataFrame([("1|2", "3")], "a string, b string"), "c": spark.createDataFrame([("1", "2|3"), ("1|2", "3")], "a string, b string")}
    assert [r["rows"] for r in orphans(t, rules=rules).collect()] == [1]


def test_a_key_that_most_rows_name_is_combined_where_they_are(spark):
    t = {"tower": spark.createDataFrame([(1,)], "id int"), "unit": spark.range(50_000).select(F.lit(7).alias("tower_id"))}
    found = orphans(t, rules={"unit": [to("tower_id", "tower")], "tower": []})
    assert got(found) == {("unit.tower_id", "7", 50_000)}
    assert "partial_count" in found._jdf.queryExecution().executedPlan().toString()


def test_a_batch_with_an_orphan_is_refused(spark):
    unit = spark.createDataFrame([("u", "d", "t")], "id string, development_id string, tower_id string")
    tower = spark.createDataFrame([("t", "other")], "id string, development_id string")
    dev = spark.createDataFrame([("d",), ("other",)], "id string")
    with pytest.raises(references.OrphanError, match="tower_id.development_id"):
        references.require({"core.units": unit, "core.towers": tower, "core.developments": dev})
    references.require({"core.units": unit.withColumn("tower_id", F.lit(None).cast("string")), "core.towers": tower, "core.developments": dev})


def test_walks_end_where_edges_end(spark):
    graph = spark.createDataFrame([("a", "1", "b", "1"), ("a", "1", "b", "2"), ("b", "1", "c", "9"), ("c", "9", "d", "8")], "kind string, id string, source_kind string, source_id string")
    starts = spark.createDataFrame([("a", "1"), ("a", "7")], "kind string, id string")
    ends = lambda n: {(r["start_id"], r["kind"], r["id"]) for r in lineage.walk(starts, graph, n).collect()}
    assert ends(1) == {("1", "b", "1"), ("1", "b", "2"), ("7", "a", "7")}
    assert ends(2) == {("1", "c", "9"), ("1", "b", "2"), ("7", "a", "7")}
    assert ends(5) == {("1", "d", "8"), ("1", "b", "2"), ("7", "a", "7")}


def test_cells_that_can_be_no_end_are_left_out_early(spark, monkeypatch):
    values = spark.createDataFrame([(f"w|s{s}|{c}{r}", f"{c}{r}") for s in (1, 2) for c in "BDE" for r in range(1, 41)], "id string, value string")
    ends = spark.createDataFrame([(f"w|s1|D{r}",) for r in range(2, 30)] * 2 + [("w|s1|B12",), ("w|s2|ZZ9",), ("w|s2|E7",)], "id string")
    monkeypatch.setattr(lineage, "THIN", 5)
    got = sorted(r["id"] for r in lineage.reached(values, ends).collect())
    assert got == sorted([f"w|s1|D{r}" for r in range(1, 41)] + ["w|s1|B12", "w|s2|E7"])
    monkeypatch.setattr(session, "BROADCAST_ROWS", 2)
    assert lineage.reached(values, ends).count() == values.count()


def test_ids_are_packed_and_come_back(spark):
    digest = [hashlib.sha256(bytes([i])).hexdigest() for i in range(40)]
    odd = ["", "abc", digest[0].upper(), digest[1] + "\n", digest[2][:-1], "\n" + digest[3][1:], "é" * 32, "\x01", "A" * 32, None]
    t = spark.createDataFrame([(i % 3, x) for i, x in enumerate(digest + odd)], "g int, x string")
    rows = t.select("x", text.packed(F.col("x")).alias("p")).select("x", "p", text.unpacked(F.col("p")).alias("back")).collect()
    assert all(r["x"] == r["back"] for r in rows) and len({r["p"] and bytes(r["p"]) for r in rows}) == len(rows)
    assert {len(r["p"]) for r in rows if r["x"] in digest} == {33}
    both = t.groupBy("g").agg(F.min("x").alias("a"), text.least_id(F.col("x")).alias("b"))
    assert all(r["a"] == r["b"] for r in both.unionByName(t.where(F.col("x").isin(digest)).groupBy("g").agg(F.min("x").alias("a"), text.least_id(F.col("x")).alias("b"))).collect())


def test_staging_leaves_no_shuffle_behind(spark):
    """What a stage has shuffled goes with it, and the setting is as it was."""
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = {files.apply(i).getName() for i in range(files.size())}
        return {n for n in names if n.startswith("shuffle_")}

    table = spark.range(5000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n")).repartition(3, "n")
    setting, before = spark.conf.get(session.CLEANUP, None), shuffles()
    staged = session.stage(table)
    for _ in range(50):  # they are removed meanwhile
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(session.CLEANUP, None) == setting
    assert staged.count() == 100
