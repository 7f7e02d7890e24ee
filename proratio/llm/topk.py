"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are cut into ``LISTS`` runs; a run's inner products with a
query are that query's score list, and a score is the sum over the lists. Phase one
takes the best entries of each list and, from their exact scores, a cutoff that the
k-th best score cannot fall below. Phase two takes, of each list, all entries that
reach the cutoff divided by the number of lists: a score at the cutoff must reach
that in some list. Phase three works out the scores of what came in exactly.

Lists are columns of one table, so a phase reads only its list. Queries go in blocks
of bounded size, broadcast to tasks; equal vectors are one entry, with their smallest
ids, so ties among copies cost nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proratio.llm.common import stored

SCALE = 256
LISTS = 2
#: Queries broadcast at once.
BLOCK = 4096


def whole_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """Distinct (vec_id, vec): components as floor(scale * x). Null vectors and those with null or non-finite components take no part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vectors = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    vectors = vectors.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine))
    return vectors.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("vec")).distinct()


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in doubles while no sum can pass 2^53, else in whole numbers of any size."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    top = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1]
    if top < 2.0 ** 52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def search(table: DataFrame, every: int, k: int, lists: int = LISTS, block: int = BLOCK, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best for each row whose vec_id is divisible by ``every``, its own id left out.

    Equal scores go by smaller vec_id. Repeated rows count once; vectors of other
    Equal scores go by smaller vec_id. Repeated rows count once; vectors of other
    lengths are filled up with zeros. A score beyond a long is an error.
    """
    rows = stored(whole_vectors(table, scale), "vectors")
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    lists = max(1, min(lists, width))
    rows = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vec"))))
    # k + 1 ids of each vector are enough, as one may be the query's own; tasks cut theirs before the shuffle.
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    ids = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    cuts = np.linspace(0, width, lists + 1).astype(int)
    entries = stored(ids.select(F.monotonically_increasing_id().alias("entry"), "vec", "ids",
                                *[F.slice("vec", int(a) + 1, int(b - a)).alias(f"list{j}") for j, (a, b) in enumerate(zip(cuts, cuts[1:]))]), "entries")
    asked = rows.filter(F.col("vec_id") % every == 0)
    asked = stored(asked.join(entries.select("vec", "entry"), "vec").select(F.col("vec_id").alias("query_id"), F.col("entry").alias("q")), "asked")
    queries = stored(entries.join(asked.select(F.col("q").alias("entry")).distinct(), "entry", "left_semi").select("entry", "vec"), "queries")
    total = queries.count()
    found = None
    blocks = -(-total // block)
    for i in range(blocks):
        # About ``block`` queries of ``width`` numbers.
        part = queries.filter(F.pmod(F.xxhash64("entry"), F.lit(blocks)) == i).orderBy("entry").collect()
        if not part:
            continue
        ids_, matrix = np.array([r["entry"] for r in part]), np.array([r["vec"] for r in part], np.int64).reshape(len(part), width)
        best = stored(_best(entries, ids_, matrix, cuts, k + 1), "best")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    hits = asked.join(found, "q").join(entries.select("entry", "ids"), "entry")
    hits = hits.select("query_id", "score", F.explode("ids").alias("vec_id")).filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(entries: DataFrame, ids: np.ndarray, matrix: np.ndarray, cuts: np.ndarray, k: int) -> DataFrame:
    """(q, entry, score) of all entries that reach the k-th best score of a query; ``ids`` and ``matrix`` are a block of queries."""
    lists = len(cuts) - 1

    def scan(j: int, take):
        """Entries of list ``j`` that ``take`` picks, from a task's rows at once in batches."""
        width, own = int(cuts[j + 1] - cuts[j]), matrix[:, cuts[j]:cuts[j + 1]]

        def task(batches):
            yield from take(((b.column(0).to_numpy(), _dot(own, _matrix(b.column(1), width))) for b in batches))

        return entries.select("entry", f"list{j}").mapInArrow(task, "q int, entry long")

    def out(q, entry):
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(entry, pa.int64())], ["q", "entry"])

    def top(parts):
        """The k best of each query in this task's part of the list."""
        scores, names = None, None
        for entry, found in parts:
            names = np.broadcast_to(entry, found.shape) if names is None else np.c_[names, np.broadcast_to(entry, found.shape)]
            scores = found if scores is None else np.c_[scores, found]
            if scores.shape[1] > k:
                keep = np.argsort(-scores, axis=1, kind="stable")[:, :k] if scores.dtype == object else np.argpartition(-scores, k - 1, axis=1)[:, :k]
                scores, names = np.take_along_axis(scores, keep, 1), np.take_along_axis(names, keep, 1)
        if names is not None:
            yield out(np.repeat(np.arange(len(names)), names.shape[1]), names.ravel())

    def scored(pairs: DataFrame, least: np.ndarray | None) -> DataFrame:
        """Exact scores of (q, entry) pairs; those of a block's queries for one entry are one row."""
        by_entry = pairs.groupBy("entry").agg(F.collect_set("q").alias("qs"))

        def task(batches):
            for b in batches:
                q, e, s = [], [], []
                for entry, qs, vec in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _matrix(b.column(2), matrix.shape[1])):
                    qs = np.array(qs)
                    found = _dot(matrix[qs], vec[None, :])[:, 0]
                    ok = np.ones(len(qs), bool) if least is None else (found >= least[qs]).astype(bool)
                    q += qs[ok].tolist()
                    e += [entry] * int(ok.sum())
                    s += found[ok].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(e, pa.int64()), pa.array(s, pa.int64())], ["q", "entry", "score"])

        return by_entry.join(entries.select("entry", "vec"), "entry").select("entry", "qs", "vec").mapInArrow(task, "q int, entry long, score long")

    def union(parts):
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole

    # Phase one. Per query of the block one number comes back: the k-th best exact score so far.
    first = scored(union([scan(j, top) for j in range(lists)]).distinct(), None)
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    cutoffs = first.withColumn("n", nth).filter(F.col("n") == k).select("q", "score").collect()
    lowest = -(1 << 62)
    least = np.full(len(ids), lowest, np.int64)
    for r in cutoffs:
        least[r["q"]] = r["score"]

    def enough(parts):
        for entry, found in parts:
            hit = (found * lists >= least[:, None]).astype(bool) | (least == lowest)[:, None]
            q, e = np.nonzero(hit)
            yield out(q, entry[e])

    # Phases two and three.
    sufficient = union([scan(j, enough) for j in range(lists)])
    reached = scored(sufficient, least)

    @F.pandas_udf("long")
    def name(q: pd.Series) -> pd.Series:
        return pd.Series(ids[q.to_numpy()])

    return reached.select(name("q").alias("q"), "entry", "score")
