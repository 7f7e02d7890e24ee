"""The pipeline against its stages by brute force, and its stages on awkward tables."""

import corpus_pipeline
from proratio.llm import common, queries, toxicity
from test_llm_operators import DOCS, awkward_rows, check_packing
from test_near_copies import slow_kept

import __spark_entry__


def test_pipeline_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scorer = toxicity.Scorer(toxicity.fit(docs, labels))
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if scorer.score(r["text"]) < toxicity.CUT}
    kept = slow_kept(texts)
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == kept
    check_packing(rows, {i: texts[i] for i in kept})
    assert len({r["sequence_id"] for r in rows}) == max(r["sequence_id"] for r in rows) + 1


def test_mixing_decides_the_order_of_sequences(spark):
    """Sequences are numbered by their first piece in the mixed order."""
    rows = [(i, "word " * (i % 7 * 90 + 40), "en", f"s{i % 3}", 1) for i in range(150)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = common.stored(corpus_pipeline.mix_sources(spark, docs, ""))
    place = {r["doc_id"]: n for n, r in enumerate(sorted(mixed.select(
        "doc_id", mixed["_metadata.file_name"].alias("f"), mixed["_metadata.row_index"].alias("n")).collect(), key=lambda r: (r["f"], r["n"])))}
    firsts = {}
    for r in corpus_pipeline.pack_windows(spark, mixed, "").collect():
        firsts[r["sequence_id"]] = min(firsts.get(r["sequence_id"], 10 ** 9), place[r["doc_id"]])
    assert [firsts[i] for i in range(len(firsts))] == sorted(firsts.values())


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (awkward_rows(), []):
        docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", score long")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            docs = common.stored(out)
        packed = corpus_pipeline.pack_windows(spark, docs, str(tmp_path)).collect()
        assert sum(r["start"] == 0 for r in packed) == docs.count()
        assert corpus_pipeline.pack_windows(spark, spark.createDataFrame(docs.collect(), docs.schema), "").count() == len(packed)


def test_all_queries_are_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and set(queries.QUERIES) <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
