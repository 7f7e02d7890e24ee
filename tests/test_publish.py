"""The manifest as a log: one of several writers wins, snapshots change nothing, batches are read by partition."""

import pytest
from pyspark.sql import functions as F

from proratio.sources.publish import SNAPSHOT, Folder, Manifest


def test_a_version_file_is_created_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "log"))
    assert folder.names() == [] and folder.put_if_absent("1.json", "first") and not folder.put_if_absent("1.json", "second")
    assert (tmp_path / "log" / "1.json").read_text() == "first" and folder.names() == ["1.json"]


def test_of_two_writers_of_a_batch_one_is_published(spark, tmp_path):
    """The second writer begins and ends while the first one is at work."""
    first, second = (Manifest(spark, str(tmp_path)) for _ in range(2))
    told = []

    def slow():
        told.append(second.publish("b", lambda: {"t": spark.range(5)}))
        return {"t": spark.range(7)}

    assert first.publish("b", slow) is False and told == [True]
    for m in (first, second):
        assert m.read("t", "id bigint").count() == 5 and m.completed("b")
    # A version number another writer took in between is not taken twice.
    numbers = [n for n in first.log.names() if n.endswith(".json")]
    assert len(numbers) == len(set(numbers)) == 3


def test_a_failure_after_another_writer_won_does_not_hide_the_batch(spark, tmp_path):
    first, second = (Manifest(spark, str(tmp_path)) for _ in range(2))

    def fails():
        second.publish("b", lambda: {"t": spark.range(5)})
        raise ValueError("lost its input")

    with pytest.raises(ValueError):
        first.publish("b", fails)
    assert first.read("t", "id bigint").count() == 5


def test_snapshots_keep_the_state(spark, tmp_path):
    m = Manifest(spark, str(tmp_path))
    for i in range(SNAPSHOT // 2 + 2):  # two versions each
        m.publish(f"b{i}", lambda i=i: {"t": spark.range(i)})
    _, later, snapshot = m._versions()
    assert snapshot and len(later) <= 4
    state = sorted(map(tuple, m.state().drop("recorded_at").collect()))
    m.compact()
    assert sorted(map(tuple, m.state().drop("recorded_at").collect())) == state and m._versions()[1] == []
    assert m.read("t", "id bigint").count() == sum(range(SNAPSHOT // 2 + 2))
    assert not m.publish("b3", lambda: {"t": spark.range(9)})


def test_many_batches_in_one_version(spark, tmp_path):
    m, rows = Manifest(spark, str(tmp_path)), spark.range(100)
    refuse = lambda w: w.where("batch_id = '3'").select("batch_id", F.lit("no").alias("note")).distinct()
    got = {tuple(r) for r in m.publish_each("t", rows, F.col("id") % 4, refuse).collect()}
    assert got == {("0", "COMPLETED"), ("1", "COMPLETED"), ("2", "COMPLETED"), ("3", "FAILED")}
    assert m.read("t", "id bigint").count() == 75
    assert {tuple(r) for r in m.publish_each("t", rows, F.col("id") % 4).collect()} == {("3", "COMPLETED")}
    assert m.read("t", "id bigint").count() == 100
    assert m._versions()[0] == 2


def test_other_partitions_are_not_read(spark, tmp_path):
    m = Manifest(spark, str(tmp_path))
    m.publish_each("t", spark.range(1000), F.col("id") % 10)
    wanted = spark.createDataFrame([("4",)], "batch_id string")
    rows = m.read("t", "id bigint", wanted)
    assert rows.count() == 100
    assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString()
