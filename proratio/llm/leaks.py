"""Benchmark passages in training text, by a positional inverted index.

The index is a stored table. Documents are dealt into segments of some megabytes;
per segment and word it holds the sorted places of the word, counted through the
segment with a gap after each document. An occurrence of a phrase lies within one
document, so lists of different segments never meet: phrases go to the segments which
hold their rarest word, and there their lists, shifted by the word's offset, are
intersected from the rarest word on. Nothing else of the corpus is shuffled than lists
of words the phrases use, once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proratio.llm.common import stored, text_of
from proratio.llm.words import byte_set, chunks, scan

#: Words of a window.
WINDOW = 10
#: Bytes of text in a segment, about; a longer document is a segment of its own.
SEGMENT = 1 << 22
#: Letters, digits and all beyond ASCII make words.
WORD = byte_set(range(0x30, 0x3A), range(0x61, 0x7B), range(0x41, 0x5B), range(0x80, 0x100))


def build(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text).

    Two kinds of rows. Documents: segment, row, doc_id, n (words), first (place of the
    first word). Words: segment, term, n, places. Null texts have no words; repeated
    rows and null ids are documents like others; further columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    source = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", text_of().alias("_text"))

    def of(batches):
        for chunk in chunks(batches, "_text", segment):
            rows, ids = chunk.column("_row"), chunk.column("doc_id")
            found = scan(chunk.column("_text"), WORD)
            n = np.bincount(found.text, minlength=len(rows))
            first = np.cumsum(n) - n + np.arange(len(rows))
            name = rows[0].as_py()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(rows), name)), rows, ids, pa.array(n), pa.array(first, pa.int32()),
                pa.nulls(len(rows), pa.string()), pa.nulls(len(rows), pa.list_(pa.int32()))], names)
            order = np.argsort(found.codes, kind="stable")
            places = (order + found.text[order]).astype(np.int32)
            counts = np.bincount(found.codes, minlength=len(found.terms))
            ends = np.append(0, np.cumsum(counts)).astype(np.int32)
            size = len(counts)
            for at in range(0, size, 20_000):
                part = slice(at, min(size, at + 20_000))
                here = ends[part.start:part.stop + 1]
                lists = pa.ListArray.from_arrays(pa.array(here - here[0]), pa.array(places[here[0]:here[-1]]))
                length = part.stop - part.start
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(length, name)), pa.nulls(length, pa.int64()), pa.nulls(length, ids.type), pa.array(counts[part]),
                    pa.nulls(length, pa.int32()), found.terms.slice(part.start, length), lists], names)

    names = ["segment", "row", "doc_id", "n", "first", "term", "places"]
    return stored(source.mapInArrow(of, f"segment long, row long, doc_id {kind}, n long, first int, term string, places array<int>"), "index")


def documents(index: DataFrame) -> DataFrame:
    return index.filter("row is not null").select("segment", "row", "doc_id", "n", "first")


def postings(index: DataFrame) -> DataFrame:
    return index.filter("term is not null").select("segment", "term", "n", "places")


def _searched(index: DataFrame, queries: DataFrame, find, schema: str) -> DataFrame:
    """``find`` in each segment that holds the rarest word of a phrase, and so may hold the phrase.

    It gets a phrase with (offset, number, places) of its words from the rarest on, and
    rows and first places of the segment's documents. A phrase with a word that no
    document of the segment holds is left out.
    """
    queries = stored(queries.filter(F.size("words") > 0).select("phrase", "words"), "phrases")
    terms = queries.select(F.explode("words").alias("term")).distinct()
    known = postings(index).select("term", "n").join(terms, "term").groupBy("term").agg(F.sum("n").alias("n"))
    known = stored(known.withColumn("number", F.monotonically_increasing_id()), "terms")
    steps = queries.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term")).join(known, "term")
    steps = steps.groupBy("phrase", "size").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "number", "term"))).alias("all")).filter(F.size("all") == F.col("size"))
    steps = stored(steps.select("phrase", F.col("all")[0]["term"].alias("term"), F.col("all.number").alias("numbers"), F.col("all.offset").alias("offsets")), "steps")
    asked = postings(index).select("segment", "term").join(steps, "term").select(
        F.col("segment").alias("part"), "phrase", "numbers", "offsets")
    lists = postings(index).join(known.select("term", "number"), "term").select(
        "segment", F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("first"), "number", "places")
    docs = documents(index).filter("n > 0").select("segment", "row", "first", F.lit(None).cast("long").alias("number"), F.lit(None).cast("array<int>").alias("places"))

    def of(left, right):
        left, right = left.combine_chunks(), right.combine_chunks()
        if not left.num_rows or not right.num_rows:
            return None
        number = left.column("number")
        own = left.filter(left.column("row").is_valid()).sort_by("first")
        rows, first = own.column("row").to_numpy(), own.column("first").to_numpy().astype(np.int64)
        held = left.filter(number.is_valid()).combine_chunks()
        numbers = held.column("number").to_numpy()
        places = pa.chunked_array(held.column("places")).combine_chunks() if held.num_rows else pa.array([], pa.list_(pa.int32()))
        ends, flat = places.offsets.to_numpy(), places.values.to_numpy()
        order = np.argsort(numbers)
        numbers = numbers[order]
        wanted = right.column("numbers").combine_chunks()
        cuts, asked = wanted.offsets.to_numpy(), wanted.values.to_numpy()
        offsets = right.column("offsets").combine_chunks().values.to_numpy()
        at = np.searchsorted(numbers, asked)
        there = at < len(numbers)
        there[there] = numbers[at[there]] == asked[there]
        alive = np.flatnonzero(np.logical_and.reduceat(there, cuts[:-1])) if len(cuts) > 1 else []
        phrases = right.column("phrase").to_numpy()

        for p in alive:
            span = range(cuts[p], cuts[p + 1])
            chosen = [order[at[i]] for i in span]
            words = [(int(offsets[i]), j, flat[ends[j]:ends[j + 1]]) for i, j in zip(span, chosen)]
            yield from find(phrases[p], words, rows, first)

    def grouped(key, left, right):
        found = list(of(left, right))
        columns = list(zip(*found)) if found else [[] for _ in arrow]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return docs.union(lists).groupBy("segment").cogroup(asked.groupBy("part")).applyInArrow(grouped, schema)


def _exact(phrase, words, rows, first):
    starts = words[0][2].astype(np.int64) - words[0][0]
    for offset, _, places in words[1:]:
        at = np.searchsorted(places, starts + offset)
        ok = at < len(places)
        ok[ok] = places[at[ok]] == starts[ok] + offset
        starts = starts[ok]
        if not len(starts):
            return
    doc = np.searchsorted(first, starts, "right") - 1
    found, at = np.unique(doc, return_index=True)  # starts are in order, and so are their documents
    for d, own in zip(found, np.split(starts, at[1:])):
        yield rows[d], phrase, len(words), (own - first[d]).astype(np.int32)


def phrases(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(row, phrase, length, starts): where each phrase of ``queries`` (phrase long, words) occurs word for word."""
    return _searched(index, queries, _exact, "row long, phrase long, length int, starts array<int>")


def near(index: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """(row, phrase, start, end): least stretches of at most ``span`` words that hold all different words of a phrase, in any order."""
    def find(phrase, words, rows, first):
        lists = list({number: places for _, number, places in words}.values())
        ends = np.concatenate(lists).astype(np.int64)
        ends.sort()
        # For each end the last place of every word up to it: the least of them starts the stretch.
        starts, ok = np.full(len(ends), np.iinfo(np.int64).max), np.ones(len(ends), bool)
        for places in lists:
            at = np.searchsorted(places, ends, "right") - 1
            ok &= at >= 0
            starts = np.minimum(starts, places[np.maximum(at, 0)])
        ok &= ends - starts < span
        starts, ends = starts[ok], ends[ok]
        doc = np.searchsorted(first, starts, "right") - 1
        same = doc == np.searchsorted(first, ends, "right") - 1
        last = None
        for d, s, e in zip(doc[same], starts[same], ends[same]):
            if s != last:  # a later end with this start is not the least
                yield rows[d], phrase, int(s - first[d]), int(e - first[d])
            last = s

    return _searched(index, queries, find, "row long, phrase long, start int, end int")


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words) of the rows of ``items`` that have words."""
    kind = dict(items.dtypes)["item_id"]

    def of(batches):
        for chunk in chunks(batches, "_text", SEGMENT):
            found = scan(chunk.column("_text"), WORD)
            n = np.bincount(found.text, minlength=chunk.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), found.terms.take(pa.array(found.codes)))
            yield pa.RecordBatch.from_arrays([chunk.column("item_id"), lists], ["item_id", "words"])

    found = items.select("item_id", text_of().alias("_text")).mapInArrow(of, f"item_id {kind}, words array<string>")
    return found.filter(F.size("words") > 0)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: words, words inside occurring windows of ``items`` (item_id, text), and the items they are from.

    An item of fewer than ``window`` words is one window; one without words, or null,
    has none. Items are told apart by their id: rows with the same id are one item, and
    a null id is an item written as empty text. Null documents have no words.
    """
    each = item_words(items)
    cut = F.expr(f"transform(sequence(0, greatest(size(words) - {window}, 0)), i -> slice(words, i + 1, {window}))")
    windows = stored(each.select("item_id", F.explode(cut).alias("words")), "windows")
    distinct = stored(windows.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "windows")
    owners = windows.join(distinct, "words").select("phrase", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()
    index = build(docs)
    found = stored(phrases(index, distinct), "occurrences")
    spans = found.select("row", "length", F.explode("starts").alias("start")).groupBy("row", "start").agg((F.col("start") + F.max("length")).alias("end"))
    covered = F.coalesce(F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = spans.select("row", F.greatest(F.lit(0), F.col("end") - F.greatest("start", covered)).alias("n")).groupBy("row").agg(F.sum("n").alias("n_hit"))
    from_items = found.select("row", "phrase").join(owners, "phrase").select("row", "item").distinct().groupBy("row").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("names"))
    out = documents(index).join(hits, "row", "left").join(from_items, "row", "left")
    none = F.lit(0).cast("long")
    return out.select(
        "doc_id", F.col("n").alias("n_words"), F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
  WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    iw AS (SELECT DISTINCT item_id, list_slice(w, k + 1, k + {WINDOW}) AS p FROM (SELECT item_id, w, unnest(range(greatest(len(w) - {WINDOW} + 1, 1))) AS k FROM i WHERE len(w) > 0)),
    lengths AS (SELECT DISTINCT len(p) AS n FROM iw),
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
    dw AS (SELECT r, n, k, list_slice(w, k + 1, k + n) AS p FROM (SELECT r, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS k FROM d, lengths)),
    found AS (SELECT DISTINCT r, n, k, p FROM dw SEMI JOIN iw USING (p)),
    hit AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS word FROM found) GROUP BY r),
    of AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (
      SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM found JOIN iw USING (p)) GROUP BY r)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN hit USING (r) LEFT JOIN of USING (r)"""
