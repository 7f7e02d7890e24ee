"""Words of whole batches of texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_set(*members) -> np.ndarray:
    """A table of 256 truths; members are bytes or ranges of them."""
    table = np.zeros(256, bool)
    for m in members:
        table[m if isinstance(m, int) else list(m)] = True
    return table


@dataclass
class Words:
    """All words of some texts, in order, A-Z lower-cased."""

    codes: np.ndarray  # of each word, its place in ``terms``
    terms: pa.StringArray  # different words
    text: np.ndarray  # of each word, the number of its text
    joined: np.ndarray  # whether the next word follows in the same text with no break between


def scan(texts: pa.StringArray, word: np.ndarray, breaks: np.ndarray | None = None) -> Words:
    """Words are longest runs of bytes in ``word``; ``breaks`` are bytes outside it that part neighbours. No nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0]:offsets[-1]] if whole is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = word[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    own = np.cumsum(inside, dtype=np.int32)
    bytes_ = _LOWER[data[inside]]
    places = np.append(own[starts] - 1, len(bytes_)).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(bytes_)).dictionary_encode()
    text = np.searchsorted(offsets[1:], starts, "right")
    joined = np.zeros(len(starts), bool)
    if len(starts) > 1:
        joined[:-1] = text[:-1] == text[1:]
        if breaks is not None:
            gaps = np.cumsum(breaks[data], dtype=np.int32)[starts]
            joined[:-1] &= gaps[:-1] == gaps[1:]
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, text, joined)


def chunks(batches, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in pieces of at least ``limit`` bytes of ``column`` but the last; a row is never cut."""
    held, size = [], 0
    for batch in batches:
        texts = batch.column(column)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        at = 0
        while at < len(texts):
            to = min(len(texts), max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit - size, "left"))))
            held.append(batch.slice(at, to - at))
            size += int(offsets[to] - offsets[at])
            at = to
            if size >= limit:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)
