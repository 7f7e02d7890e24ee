"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks. Block i (from 0) of a source with weight w is
released at slot floor(i / w) and due at slot ceil((i + 1) / w); in each slot the
released block with the earliest deadline runs, so after any number of slots a source
is less than one block away from its share. Weights are whole numbers of slots in a
frame: all windows line up at the end of a frame, the schedule repeats, and only one
frame, of fixed size, is ever worked out. Everything runs in DataFrame functions.

A source that has no block left leaves its slots empty, so the others keep their
rates among each other; every document is placed exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proratio.llm.common import ranked

#: Slots in a frame, about: weights are rounded to whole slots, one at least.
FRAME = 1000
#: Documents in a block.
BLOCK = 16
#: Exponent on a source's share where no weights are given: below 1 lifts small sources.
TEMPERATURE = 0.7
#: Sources a frame can hold; a table with more fails with a message rather than being cut.
SOURCES = 5000


def target_weights(docs: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, weight): the share of documents of each source, raised to ``temperature``."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("source", F.pow(F.col("n").cast("double"), F.lit(temperature)).alias("weight"))


def frame(weights: DataFrame, slots: int = FRAME) -> DataFrame:
    """(source, share, turn, slot, frame): the slot of each of a source's ``share`` turns in a frame of ``frame`` slots.

    ``weights`` has one row per source; weights that are null or not above 0 count as
    the smallest share, one slot. Sources are put in one row, SOURCES at most.
    """
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
    shares = weights.select("source", weight.alias("w")).groupBy().agg(
        F.sum("w").alias("total"), F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("order"), "source"))).alias("all"))
    shares = shares.withColumn("all", F.expr(
        f"transform(all, x -> named_struct('source', x.source, 'share', greatest(1L, cast(round(-x.order * {slots} / if(total > 0, total, 1)) as bigint))))"))
    shares = shares.withColumn("all", F.when(F.size("all") <= SOURCES, F.col("all")).otherwise(
        F.raise_error(F.lit(f"more than {SOURCES} sources: group them before mixing"))))
    shares = shares.filter(F.size("all") > 0).select(
        "all", F.expr("transform(all, x -> x.share)").alias("p"), F.expr("aggregate(all, 0L, (n, x) -> n + x.share)").alias("q"))
    # Earliest deadline first. State: blocks run of each source, and who ran in each slot.
    ran = shares.withColumn("ran", F.expr("""
        aggregate(sequence(0L, q - 1),
          named_struct('done', transform(p, x -> 0L), 'out', cast(array() as array<int>)),
          (s, t) -> transform(
            array(array_min(transform(p, (w, i) -> if(s.done[i] * q div w <= t, named_struct('due', ((s.done[i] + 1) * q + w - 1) div w, 'i', i), null))).i),
            i -> named_struct('done', transform(s.done, (n, j) -> if(i = j, n + 1, n)), 'out', concat(s.out, array(i))))[0],
          s -> s.out)"""))
    turns = ran.select("all", "q", F.posexplode("ran").alias("slot", "i"))
    turns = turns.select(F.col("all")[F.col("i")].alias("x"), F.col("slot").cast("long").alias("slot"), F.col("q").alias("frame"))
    turn = F.row_number().over(Window.partitionBy("x.source").orderBy("slot")) - 1
    return turns.select("x.source", "x.share", turn.cast("long").alias("turn"), "slot", "frame")


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, slots: int = FRAME) -> DataFrame:
    """``docs`` (doc_id, source and any others) with their place in the mix.

    Adds _mix_block (number of the block in its source), _mix_slot, _mix_place (in the
    block) and _mix_on_target (no source has run dry before this slot). Order by slot
    and place is the mix. Within a source documents follow their id. A null
    source is a source; sources absent from ``weights`` get the smallest share;
    repeated rows and null ids are placed like others.
    """
    here = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weights = target_weights(docs)
    else:
        given = weights.groupBy(F.col("source").alias("_s")).agg(F.max("weight").cast("double").alias("weight"))
        weights = here.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "weight")
    turns = frame(weights, slots).select(*[F.col(c).alias(f"_mix_f_{c}") for c in ("source", "share", "turn", "slot", "frame")])
    shares = turns.filter(F.col("_mix_f_turn") == 0).select(
        F.col("_mix_f_source").alias("_mix_s"), F.col("_mix_f_share").alias("_mix_share"))

    def place(df, at):
        """The slot of block ``at`` of a source. A frame has at most FRAME + SOURCES turns, so both sides may be broadcast."""
        with_share = df.join(F.broadcast(shares), F.col("source").eqNullSafe(F.col("_mix_s")))
        here = F.col("source").eqNullSafe(F.col("_mix_f_source")) & (F.col(at) % F.col("_mix_share") == F.col("_mix_f_turn"))
        return with_share.join(F.broadcast(turns), here).withColumn(
            "_mix_slot", F.expr(f"{at} div _mix_share") * F.col("_mix_f_frame") + F.col("_mix_f_slot")
        ).drop("_mix_s", "_mix_share", *[f"_mix_f_{c}" for c in ("source", "share", "turn", "slot", "frame")])

    dry = here.select("source", F.ceil(F.col("n") / block).cast("long").alias("_mix_blocks"))
    dry = place(dry, "_mix_blocks").groupBy().agg(F.min("_mix_slot").alias("dry"))
    numbered = ranked(docs, ["doc_id"], ["source"], "_mix_rank")
    numbered = numbered.withColumn("_mix_block", F.expr(f"_mix_rank div {block}")).withColumn("_mix_place", F.col("_mix_rank") % block)
    return place(numbered, "_mix_block").withColumn("_mix_on_target", F.col("_mix_slot") < dry.scalar()).drop("_mix_rank")


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows in the order of the mix, across partitions and within; the columns of the mix are dropped."""
    keys = ["_mix_slot", "_mix_place"]
    return mixed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_mix_block", "_mix_on_target", *keys)
