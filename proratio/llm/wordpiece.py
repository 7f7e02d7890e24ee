"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link and the number of pieces that
following it pops, both worked out once, so a word is read once from left to right
and the number of its greedy longest-match pieces is a sum; no piece is ever built.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proratio.llm.common import text_of

#: Words a task remembers; only a matter of memory.
MEMORY = 200_000
NONE = -1


class Automaton:
    """Pieces that may start a word, and pieces that may go on; both as bytes."""

    def __init__(self, starts, follows=None):
        # Node 0 is the root of a word, node 1 of its continuation.
        self.goto: dict[int, int] = {}
        tokens: set[int] = set()
        nodes = 2
        for root, pieces in ((0, starts), (1, starts if follows is None else follows)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    node = self.goto.get(key, NONE)
                    if node == NONE:
                        node = self.goto[key] = nodes
                        nodes += 1
                if piece:
                    tokens.add(node)
        self.fail, self.pops = [NONE] * nodes, [0] * nodes
        children: list[list[tuple[int, int]]] = [[] for _ in range(nodes)]
        for key, node in self.goto.items():
            children[key >> 8].append((key & 255, node))
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for byte, child in children[node]:
                    below.append(child)
                    if child in tokens:
                        self.fail[child], self.pops[child] = 1, 1
                        continue
                    link, popped = self.fail[node], self.pops[node]
                    while link != NONE and link << 8 | byte not in self.goto:
                        popped += self.pops[link]
                        link = self.fail[link]
                    if link != NONE:
                        self.fail[child], self.pops[child] = self.goto[link << 8 | byte], popped
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of the word; -1 if greedy matching gets stuck."""
        goto, fail, pops = self.goto, self.fail, self.pops
        node = count = 0
        for byte in word:
            while (after := goto.get(node << 8 | byte, NONE)) == NONE:
                if fail[node] == NONE:
                    return NONE
                count += pops[node]
                node = fail[node]
            node = after
        while node > 1:
            if fail[node] == NONE:
                return NONE
            count += pops[node]
            node = fail[node]
        return count


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


@lru_cache(maxsize=2)
def _automaton(path: str) -> Automaton:
    return Automaton(read_ranks(path))


def token_counts(docs: DataFrame, vocabulary: str, mark: bytes = b" ") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_tokens.

    Words are runs of bytes that are no ASCII white space; each is matched with
    ``mark`` before it, which is how the vocabulary writes the start of a word. A word
    that cannot be matched counts as one piece. Whole texts; null is empty, with no
    words. Repeated rows each give a row. One pass, no shuffle; ``vocabulary`` is a
    path every machine has.
    """
    @F.pandas_udf("n_words long, n_tokens long")
    def count(texts: pd.Series) -> pd.DataFrame:
        automaton, known = _automaton(vocabulary), {}
        words_of, tokens_of = [], []
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").split()
            for word in set(words).difference(known):
                known[word] = abs(automaton.count(mark + word))
            words_of.append(len(words))
            tokens_of.append(sum(map(known.__getitem__, words)))
            if len(known) > MEMORY:
                known.clear()
        return pd.DataFrame({"n_words": words_of, "n_tokens": tokens_of}, dtype="int64")

    counted = docs.select("doc_id", count(text_of()).alias("n"))
    return counted.select("doc_id", "n.n_words", "n.n_tokens")
