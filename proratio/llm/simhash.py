"""Near duplicates by SimHash with multi-index hashing.

A fingerprint has 64 bits, cut into two halves. Two fingerprints with at most three
differing bits differ by at most one in a half, so each fingerprint looks up the
33 members of the Hamming ball of radius 1 around each half in a table keyed by that
half, and only matches are verified over all bits. Copies have one fingerprint and
enter once. Groups are connected components, found by alternating star steps over
tables; no link, label or fingerprint passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proratio.llm.common import stored, text_of

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Links up to which Spark may choose to broadcast them. It goes by the size of files, and those of a dense group pack well.
FEW_LINKS = 200_000


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """64 bits: bit i is set if it is set in over half of the shingle hashes; 0 for a text without words."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not parts:
        return 0
    if len(parts) > words:
        shingles = [b" ".join(s) for s in zip(*[parts[i:] for i in range(words)])]
    else:
        shingles = [b" ".join(parts)]
    hash_of = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash_of(s, SEED) for s in shingles), "<u8", len(shingles))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long. Whole texts; null is empty."""
    keep = list(keep)

    def of(batches):
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(len(keep)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(found)], [*keep, "fp"])

    source = docs.select(*keep, text_of().alias("_text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in source.select(*keep).dtypes)
    return source.mapInArrow(of, f"{kinds}, fp long")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints in ``distinct`` (column fp) within ``radius`` bits.

    The table holds each half of each fingerprint; the ball members of a half ask it.
    A pair found by both halves is kept for the first one only.
    """
    if radius > 3:
        raise ValueError("balls of radius 1 in two halves reach three differing bits")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    halves = F.array(F.struct(F.lit(0).alias("half"), low.alias("value")), F.struct(F.lit(1).alias("half"), high.alias("value")))
    table = distinct.select("fp", F.explode(halves).alias("h")).select(F.col("fp").alias("b"), "h.half", "h.value")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    asked = distinct.select("fp", F.explode(halves).alias("h")).select(
        F.col("fp").alias("a"), "h.half", F.col("h.value").alias("own"), F.explode(flips).alias("flip")
    ).select("a", "half", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.bit_count(differ.bitwiseAND(F.lit(0xFFFFFFFF))) <= 1
    near = (F.bit_count(differ) <= radius) & (F.col("a") < F.col("b")) & ((F.col("half") == 0) | ~first)
    # Spark sizes both sides as the table they are exploded from, so that either could be broadcast, the one of 66 rows a fingerprint first.
    return asked.hint("merge").join(table, ["half", "value"]).filter(near).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component, for nodes other than the label.

    Large-star and small-star steps in turn until the edges stay as they are; each
    step is written to the shared folder, which cuts the lineage.
    """
    def mark(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    # a > b in all edges from here on.
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = mark(edges)
    while before[0]:
        # No step has more edges than the one before.
        sized = (lambda df: df) if before[0] <= FEW_LINKS else (lambda df: df.hint("merge"))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        # Large star: greater neighbours of a node are tied to its smallest one.
        large = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(sized(least), "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stored(large.distinct(), "edges")
        # Small star: smaller neighbours of a node, and itself, are tied to the smallest.
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sized(smallest), "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(smallest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): each distinct fingerprint and one fingerprint that stands for its group.

    ``prints`` has a column fp and should be stored, for it is read several times.
    """
    distinct = stored(prints.select("fp").distinct(), "fingerprints")
    labels = components(links(distinct, radius))
    return distinct.join(labels, distinct.fp == labels.node, "left").select("fp", F.coalesce("label", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Repeated rows each give a row. Rows without an id link like others, but the
    component id is the smallest id there is (null if none has one).
    """
    prints = stored(fingerprints(docs), "prints")
    roots = stored(grouped(prints, radius), "roots")
    # Copies first become one row per fingerprint, so a group of any size is combined where its rows are.
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    lowest = lowest.join(roots, "fp")
    ids = lowest.groupBy("root").agg(F.min("low").alias("component_id"))
    members = roots.join(ids, "root").select("fp", "component_id")
    return prints.join(members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near duplicates, with their columns as they are.

    Of each group the row with the smallest doc_id stays (a null id only where no row
    has one); of repeated rows with that id, one.
    """
    kept = stored(docs.withColumn("_llm_row", F.monotonically_increasing_id()), "rows")
    prints = stored(fingerprints(kept, ["_llm_row", "doc_id"]), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_llm_row").alias("row"))).alias("first")
    lowest = prints.groupBy("fp").agg(first)
    lowest = lowest.join(grouped(prints, radius), "fp").groupBy("root").agg(F.min("first").alias("first"))
    return kept.join(lowest.select(F.col("first.row").alias("_llm_row")), "_llm_row", "left_semi").drop("_llm_row")
