"""The nested document: whatever the number of files, joined by name they are one JSON text."""

import json
import os

import pytest
from pyspark.sql import functions as F

from proratio.operators import serving


def joined(folder):
    names = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    return "".join(open(f"{folder}/{f}", encoding="utf-8").read() for f in names), len(names)


def one(spark, **values):
    return spark.range(1).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in values.items()])).alias("document"))


def test_files_joined_by_name_parse(spark, tmp_path):
    units = spark.range(5000).select(
        (F.col("id") % 7).cast("int").alias("g"), F.concat(F.lit('T"\n,{'), F.col("id") % 3).alias("tower"), F.col("id").alias("unit"))
    head = {"meta": one(spark, mode="x", note='a "quoted", {text}'), "kpis": one(spark, n=5000)}
    keys = ["g", "unit"]
    lists = {"towers": (serving.labels(units, "tower"), ["tower"]), "none": (units.where("unit < 0").select("unit", F.lit("1").alias("document")), ["unit"]),
             "units": (serving.document_lines(units, keys, ["tower", "unit"]), keys)}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        serving.write_nested(serving.nested_document(head, lists), str(tmp_path / "d"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    text, files = joined(tmp_path / "d")
    found = json.loads(text)
    assert files > 4
    assert list(found) == ["meta", "kpis", "towers", "none", "units"]
    assert found["meta"]["note"] == 'a "quoted", {text}' and found["kpis"] == {"n": 5000} and found["none"] == []
    assert found["towers"] == [f'T"\n,{{{i}' for i in range(3)]
    assert [u["unit"] for u in found["units"]] == sorted(range(5000), key=lambda i: (i % 7, i))


def test_repeated_first_keys_are_refused(spark):
    rows = spark.createDataFrame([(1, "1"), (1, "2"), (2, "3")], "k int, document string")
    with pytest.raises(ValueError):
        serving.nested_document({"meta": one(spark, a=1)}, {"rows": (rows, ["k"])})
    with pytest.raises(ValueError):
        serving.nested_document({}, {"rows": (rows.where("k = 2"), ["k"])})
