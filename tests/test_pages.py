"""Pages of a stored order: the same rows as sorting, from the partitions that hold them."""

import random

from pyspark.sql import functions as F

from proratio.operators import serving

KEYS = [("price", True), ("code", False)]


def test_pages_by_number_and_by_key(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), f"u{i:03d}", i) for i in range(500)]
    units = spark.createDataFrame(rows, "price int, code string, n int").repartition(4)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    order = serving.store_order(units, KEYS, 9)
    assert order.ranges.agg(F.sum("_n")).first()[0] == 500 and order.ranges.count() > 4
    for size in (1, 7, 60, 600):
        for number in (0, 1, 3, 499 // size, 500):
            assert [tuple(r) for r in order.page(number, size).collect()] == want[number * size:(number + 1) * size]
    for at in (0, 13, 250, 498, 499):
        key = {"price": want[at][0], "code": want[at][1]}
        assert [tuple(r) for r in order.after(key, 20).collect()] == want[at + 1:at + 21]
    # A key need not be that of a row.
    assert [tuple(r) for r in order.after({"price": 99, "code": ""}, 5).collect()] == want[:5]


def test_other_ranges_are_pruned(spark):
    units = spark.range(10_000).select(F.col("id").alias("price"), F.col("id").cast("string").alias("code"))
    order = serving.store_order(units, KEYS, 20)
    page = order.page(40, 100)
    assert page.count() == 100
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "RangePartitioning" not in plan
    first = page.first()["price"]
    held = order.ranges.where(F.col("_first").between(4000 - 600, 4100)).count()
    assert first == 9999 - 4000 and held <= 3
