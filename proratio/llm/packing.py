"""Packing documents into fixed windows by non-negative least squares.

A document is cut into whole windows and a rest. The lengths of the rests form a
histogram of bounded size. Shallow combinations of lengths that fill a window are
its columns; non-negative least squares finds how often each should be used, the
counts are rounded down to what there is, and what remains is packed greedily. The
plan is a list of patterns; Spark numbers the pieces of each length and reads their
sequence and offset off the plan, so no task and no driver sees the pieces as a whole.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proratio.llm.common import ranked, stored, text_of

WINDOW = 1024
#: Id put behind each document.
END = 0
PIECE = "start long, length long, ids_crc32 long, doc_tokens long"

class Encoder:
    """Ids as little-endian 32-bit bytes, as the tokenizer of ``path`` gives them.

    Texts in a plain byte-level BPE vocabulary go through a faster encoder of the same
    vocabulary and pattern, which gives the same ids; a text with the spelling of an
    added token goes through the tokenizer itself, and so do all texts otherwise.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.added = [t["content"] for t in parts["added_tokens"]]
        self.fast = None
        before = parts["pre_tokenizer"] or {}
        if parts["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
            import public_tokenizers
            import tiktoken

            # A byte-level vocabulary writes each byte as one visible character: itself, or the next one from 256 on.
            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
            hidden = [b for b in range(256) if b not in set(shown)]
            byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
            ranks = {bytes(byte_of[c] for c in t): i for t, i in parts["model"]["vocab"].items() if t not in self.added}
            self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if not self.fast or any(x in text for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast(text), "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python process."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, keep: list[str] = ("doc_id",), window: int = WINDOW) -> DataFrame:
    """The pieces of each document: ``keep`` columns, start, length, ids_crc32, doc_tokens.

    A null text is empty, and an empty document still has its end id. One pass in
    Arrow batches; only numbers leave it.
    """
    keep = list(keep)

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for i, text in enumerate(batch.column(len(keep)).to_pylist()):
                ids = encode(text) + end if text else end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start:4 * (start + window)]
                    rows.append(i)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    totals.append(total)
            kept = batch.select(list(range(len(keep)))).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *[pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]], [*keep, "start", "length", "ids_crc32", "doc_tokens"])

    source = docs.select(*keep, text_of().alias("_text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in source.select(*keep).dtypes)
    return source.mapInArrow(cut, f"{kinds}, {PIECE}")


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill a window exactly.

    A sequence whose length is a power of two needs no padding, so halves and
    quarters of the window count as windows for one and two lengths.
    """
    here = np.zeros(window + 1, bool)
    here[lengths] = True
    found = []
    size = window
    while size >= 2:
        if here[size]:
            found.append([[size, 0, 0]])
        if size >= window // 8:
            a = lengths[lengths * 2 <= size]
            a = a[here[size - a]]
            found.append(np.c_[size - a, a, np.zeros(len(a), int)])
        size //= 2
    if here[1]:
        found.append([[1, 0, 0]])
    a, b = np.meshgrid(lengths, lengths)
    a, b = a.ravel(), b.ravel()
    c = window - a - b
    ok = (a <= b) & (b <= c)
    ok[ok] = here[c[ok]]
    found.append(np.c_[c[ok], b[ok], a[ok]])
    return np.concatenate([np.asarray(f, int).reshape(-1, 3) for f in found])


def solve(columns: np.ndarray, histogram: np.ndarray, rounds: int = 300, enough: float = 1e-3) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: repeats per column that use up the histogram.

    A length's error counts in proportion to the length, for a long piece left over
    costs more, and against the root of its number of pieces. Unknowns are scaled by
    what a column could use at most; momentum starts anew whenever the error grows.
    """
    size = len(histogram)
    weight = np.where(histogram > 0, np.arange(size) / size / np.sqrt(np.maximum(histogram, 1)), 0)
    scale = np.sqrt(np.where(columns > 0, histogram[columns], np.inf).min(1))
    flat, used = columns.ravel(), (columns > 0) * scale[:, None]
    pull, target = weight[columns] * used, histogram * weight

    def forward(y):
        return np.bincount(flat, (y[:, None] * used).ravel(), size) * weight

    def backward(r):
        return (r[columns] * pull).sum(1)

    # The largest eigenvalue by power steps gives the step length.
    v, norm = np.ones(len(columns)), 1.0
    for _ in range(20):
        v = backward(forward(v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    x = y = np.zeros(len(columns))
    image = ahead = np.zeros(size)
    t, last = 1.0, np.inf
    for _ in range(rounds):
        new = np.maximum(0, y - backward(ahead - target) / (1.02 * norm))
        reached = forward(new)
        loss = float(((reached - target) ** 2).sum())
        if loss > last:
            y, ahead, t, last = x, image, 1.0, np.inf
            continue
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, ahead = new + (t - 1) / t2 * (new - x), reached + (t - 1) / t2 * (reached - image)
        x, image, t, last = new, reached, t2, loss
        if loss < enough:
            break
    return x * scale


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) and their repeats; they use up ``counts`` exactly."""
    left = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], repeats: int):
        for x in lengths:
            left[x] -= repeats
        patterns.append((lengths, int(repeats)))

    def most(lengths: tuple[int, ...]) -> int:
        return min(int(left[x]) // lengths.count(x) for x in set(lengths))

    here = np.flatnonzero(left)
    if len(here):
        columns = combinations(here, window)
        if len(columns):
            x = solve(columns, left.astype(float))
            # Whole repeats, the most used first, as far as the pieces reach.
            for j in np.lexsort((*columns.T, -x)):
                if x[j] < 1:
                    break
                lengths = tuple(int(v) for v in columns[j] if v)
                n = min(most(lengths), int(x[j]))
                if n > 0:
                    take(lengths, n)
    # The rest: the longest left, then each time the longest that still fits.
    while left.any():
        lengths, room, free = [], window, left.copy()
        while room > 0 and (fit := np.flatnonzero(free[: room + 1])).size:
            best = int(fit[-1])
            lengths.append(best)
            free[best] -= 1
            room -= best
        take(tuple(lengths), most(tuple(lengths)))
    return patterns


def pack(docs: DataFrame, tokenizer: str, keep: list[str] = ("doc_id",), order: list[str] = ("doc_id", "start"),
         window: int = WINDOW, along: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset.

    ``order`` decides which pieces of a length come first, and so the sequences they
    get; ``along`` also numbers the sequences by their first piece in that order.
    Sequences are gapless from offset 0 and at most ``window`` long. No document is
    left out; a table without rows gives none.
    """
    cut = stored(pieces(docs, tokenizer, keep, window), "pieces")
    # At most ``window`` rows.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = plan(counts, window)
    sequence, slots = 0, {}
    for lengths, repeats in patterns:
        offset = 0
        for x in lengths:
            slots.setdefault(x, []).append((repeats, sequence, offset, len(lengths)))
            offset += x
        sequence += repeats
    # Of each length: where the runs of its pieces end, and the first sequence and offset of each run.
    runs = {x: (np.cumsum([s[0] for s in v]), np.array([s[1] for s in v]), np.array([s[2] for s in v])) for x, v in slots.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, at: pd.Series) -> pd.DataFrame:
        lengths, ats = length.to_numpy(), at.to_numpy()
        sequences, offsets = np.zeros(len(ats), np.int64), np.zeros(len(ats), np.int64)
        for x in np.unique(lengths):
            rows = lengths == x
            ends, firsts, offs = runs[int(x)]
            j = np.searchsorted(ends, ats[rows], side="right")
            sequences[rows] = firsts[j] + ats[rows] - np.where(j > 0, ends[j - 1], 0)
            offsets[rows] = offs[j]
        return pd.DataFrame({"sequence_id": sequences, "offset": offsets})

    placed = ranked(cut, list(order), ["length"], "_at_length").withColumn("_place", place("length", "_at_length"))
    if along:
        placed = stored(placed, "placed")
        firsts = placed.groupBy(F.col("_place.sequence_id").alias("_sequence")).agg(F.min(F.struct(*order)).alias("_first"))
        numbers = ranked(firsts, [F.col("_first")], name="_number").select("_sequence", "_number")
        placed = placed.join(numbers, F.col("_place.sequence_id") == F.col("_sequence"))
    number = F.col("_number") if along else F.col("_place.sequence_id")
    return placed.select(*keep, "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), "_place.offset")
