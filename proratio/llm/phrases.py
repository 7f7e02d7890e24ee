"""Collocations by SON partitioning.

Texts are dealt into ``SHARDS`` shards by chunks. A phrase that occurs at least
``support`` times in all occurs at least support / SHARDS times in some shard, so each
shard is mined completely at that lowered support, level by level: words, then pairs of
frequent words, then triples of frequent pairs, each counted in Spark by shard.
The union of what is frequent in any shard is then counted over all texts, by
its words and exactly.

What is frequent reaches the next pass as a table of ``BITS`` bits, so what is broadcast has
a fixed size. A bit that several phrases share lets more candidates through, never
fewer, and the counts decide; a corpus with very many frequent phrases only gains
less from them (``bits`` is a parameter). In mining a phrase goes by a 64-bit key: two that
share one count as more, and so stay candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proratio.llm.common import stored, text_of
from proratio.llm.words import Words, byte_set, chunks, scan

LONGEST = 3
SUPPORT = 10
SHARDS = 3
#: Bits of the table of frequent phrases; a power of two.
BITS = 1 << 27
#: A candidate goes if a longer one around it occurs at least so many hundredths as often.
INSIDE = 50
BEST = 2000
#: Bytes of text counted at once.
CHUNK = 1 << 23

BREAKS = byte_set(*b".,;:!?", range(0x0A, 0x0E))
WORD = ~(BREAKS | byte_set(0x20, 0x09))

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _seed(*of) -> int:
    return xxhash.xxh64_intdigest(repr(of))


def _shard_mark(shard: int) -> int:
    """What sets the keys of a shard apart from those of others, as a signed long."""
    return _seed("shard", shard) - (1 << 63)


class Bits:
    """Which keys are in a set, by one bit each: never wrong about those which are."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(len(table) * 8 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def marked(keys: DataFrame, bits: int = BITS) -> Bits:
    """The bits of ``keys`` (column key, long). ``bits`` / 8 bytes come to the driver at most."""
    size = 32768  # bits of one bitmap of Spark
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    maps = keys.select(at.alias("at")).groupBy(F.expr(f"at div {size}").alias("part")).agg(F.bitmap_construct_agg(F.expr(f"at % {size}")).alias("map"))
    table = np.zeros(max(bits, size) // 8, np.uint8)
    for row in maps.toLocalIterator():
        table[row["part"] * (size // 8):][:size // 8] = np.frombuffer(row["map"], np.uint8)
    return Bits(table[:bits // 8])


class Chunk:
    """The words of some texts of one language."""

    def __init__(self, lang: str, shard: int, texts: pa.StringArray):
        self.lang, self.shard = lang, shard
        self.words: Words = scan(texts, WORD, BREAKS)
        self.hashes = np.array([xxhash.xxh64_intdigest(t) for t in self.words.terms.to_pylist()], np.uint64)

    def starts(self, n: int) -> np.ndarray:
        """Where runs of ``n`` words begin that no break parts."""
        at = np.arange(len(self.words.codes) - n + 1)
        for i in range(n - 1):
            at = at[self.words.joined[at + i]]
        return at

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        """64-bit keys of the phrases of ``n`` words at ``at``."""
        h = np.full(len(at), _seed(self.lang, n), np.uint64)
        for i in range(n):
            h = _mix((h ^ self.hashes[self.words.codes[at + i]]) * _PRIME)
        return h

    def own_keys(self, at: np.ndarray, n: int) -> np.ndarray:
        """The same within the chunk's shard."""
        return self.keys(at, n) ^ np.array(_shard_mark(self.shard), np.int64).view(np.uint64)

    def numbers(self, at: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the phrases at ``at``, equal only for equal phrases of this chunk."""
        codes, size = self.words.codes, len(self.words.terms)
        own = codes[at]
        for i in range(1, n):
            if i > 1:  # so that numbers stay below the square of the words
                own = np.unique(own, return_inverse=True)[1]
            own = own * size + codes[at + i]
        return own

    def counted(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(one place, count) of each different phrase among those at ``at``."""
        _, first, count = np.unique(self.numbers(at, n), return_index=True, return_counts=True)
        return at[first], count

    def texts(self, at: np.ndarray, n: int) -> pa.Array:
        import pyarrow.compute as pc

        words = [self.words.terms.take(pa.array(self.words.codes[at + i])) for i in range(n)]
        return words[0] if n == 1 else pc.binary_join_element_wise(*words, " ")


def _chunks(batches, shards: int, limit: int):
    """Chunks of one language each; the shard of a chunk follows from its task and place, so a repeated task deals alike."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()
    for batch in chunks(batches, "text", limit):
        langs = batch.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            yield Chunk(lang, number % shards, batch.column("text").filter(pa.array(codes == i)))
        number += 1


def _mined(docs: DataFrame, n: int, frequent, shards: int, limit: int) -> DataFrame:
    """(shard, key, n): phrases of ``n`` words in each shard; their parts of n - 1 words are frequent there."""
    def of(batches):
        for c in _chunks(batches, shards, limit):
            at = c.starts(n)
            at = at[frequent.value.has(c.own_keys(at, n - 1))]
            at = at[frequent.value.has(c.own_keys(at + 1, n - 1))]
            at, count = c.counted(at, n)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(at), c.shard, np.int32)), pa.array(c.keys(at, n).view(np.int64)), pa.array(count)], ["shard", "key", "n"])

    return docs.mapInArrow(of, "shard int, key long, n long").groupBy("shard", "key").agg(F.sum("n").alias("n"))


def words_of(docs: DataFrame, shards: int, limit: int = CHUNK) -> DataFrame:
    """(lang, shard, key, n): each word of each shard, counted; stored."""
    def of(batches):
        for c in _chunks(batches, shards, limit):
            at, count = c.counted(c.starts(1), 1)
            yield pa.RecordBatch.from_arrays([
                pa.array([c.lang] * len(at), pa.string()), pa.array(np.full(len(at), c.shard, np.int32)),
                pa.array(c.keys(at, 1).view(np.int64)), pa.array(count)], ["lang", "shard", "key", "n"])

    found = docs.mapInArrow(of, "lang string, shard int, key long, n long")
    return stored(found.groupBy("lang", "shard", "key").agg(F.sum("n").alias("n")), "words")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS,
                     bits: int = BITS, limit: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``longest`` words that occur ``support`` times in their language: (lang, words, phrase, f); and (lang, n), all words.

    ``docs`` has lang and text, without nulls.
    """
    spark: SparkSession = docs.sparkSession
    shards = max(1, min(shards, support))
    # If every shard had fewer than this, all together would have fewer than the support.
    lowered = -(-support // shards)
    words = words_of(docs, shards, limit)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    mark = F.lit(0).cast("long")
    for shard in range(shards):
        mark = F.when(F.col("shard") == shard, F.lit(_shard_mark(shard))).otherwise(mark)
    level = words.filter(F.col("n") >= lowered).select("shard", "key")
    union = level.select("key")
    for n in range(2, longest + 1):
        own = spark.sparkContext.broadcast(marked(level.select(F.col("key").bitwiseXOR(mark).alias("key")), bits))
        level = stored(_mined(docs, n, own, shards, limit).filter(F.col("n") >= lowered).select("shard", "key"), "frequent")
        union = union.union(level.select("key"))
    wanted = spark.sparkContext.broadcast(marked(union, bits))

    def of(batches):
        for c in _chunks(batches, shards, limit):
            for n in range(1, longest + 1):
                at = c.starts(n)
                at, count = c.counted(at[wanted.value.has(c.keys(at, n))], n)
                yield pa.RecordBatch.from_arrays([
                    pa.array([c.lang] * len(at), pa.string()), pa.array(np.full(len(at), n, np.int32)), c.texts(at, n), pa.array(count)],
                    ["lang", "words", "phrase", "f"])

    exact = docs.mapInArrow(of, "lang string, words int, phrase string, f long").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return stored(exact.filter(F.col("f") >= support), "phrases"), totals


def _best(scored: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each language with their rank: first of many parts of a language, then of fewer, then of it."""
    for parts in (1024, 32):
        part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        place = F.row_number().over(Window.partitionBy("lang", part).orderBy(*keys))
        scored = scored.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*keys))).filter(F.col("rank") <= n)


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, inside: int = INSIDE, best: int = BEST, **mining) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two words or more.

    Null texts are empty, a null language is ``und``, repeated rows count again; further
    columns are not read. A text of any length is taken whole.
    """
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    counts, totals = frequent_phrases(source, support, longest, **mining)
    phrases = counts.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # Every part of a phrase that is frequent is frequent, so both joins find all parts.
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, words - 1)")).alias("k"), "w").select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("tail"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumn("top", F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a")).withColumn("low", wide("l") * wide("r"))
    scored = cuts.withColumn("score", F.expr("top div low")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = phrases.filter("words > 2").select("lang", "a", "words", F.explode(F.expr("sequence(2, words - 1)")).alias("size"), "w").select(
        "lang", "a", F.explode(F.expr("transform(sequence(1, words - size + 1), i -> array_join(slice(w, i, size), ' '))")).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    top = _best(rows, [F.col("score").desc(), F.col("a").desc(), "phrase"], best)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = f"""
  WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
    total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
    runs AS (SELECT lang, k, list_slice(w, i + 1, i + k) AS p FROM (
      SELECT lang, w, k, unnest(range(greatest(len(w) - k + 1, 0))) AS i FROM w, (SELECT unnest(range(1, {LONGEST} + 1)) AS k))),
    f AS (SELECT lang, k, p, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= {SUPPORT}),
    c AS (SELECT * FROM f WHERE k > 1),
    cuts AS (SELECT c.lang, c.p, c.f AS a, t AS k, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, k)) AS t FROM c) c
      JOIN f l ON l.lang = c.lang AND l.p = list_slice(c.p, 1, t) JOIN f r ON r.lang = c.lang AND r.p = list_slice(c.p, t + 1, c.k)),
    least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
    around AS (SELECT lang, list_slice(p, i, i + 1) AS p, max(f) AS longer FROM (SELECT *, unnest(range(1, k)) AS i FROM c WHERE k = 3) GROUP BY ALL),
    kept AS (SELECT x.* FROM least x LEFT JOIN around USING (lang, p) WHERE longer IS NULL OR 100 * longer < {INSIDE} * a),
    named AS (SELECT *, array_to_string(p, ' ') AS phrase FROM kept)
  SELECT lang, row_number() OVER b AS rank, phrase, a, l, r, n, score FROM named JOIN total USING (lang)
  WINDOW b AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER b <= {BEST}"""
