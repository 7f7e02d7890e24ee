"""Merkle tree fingerprints of documents, in DataFrame functions alone.

The tree has four levels. A leaf is a phrase of up to four words that ends early at
the end of a sentence; the phrases of a line make a paragraph; a run of paragraphs up
to one whose digest starts with 0 makes a section, so that an edit moves no later
border; the sections make the root. Each node is the SHA-256 of its children.

A fingerprint is ``root:labels``. The labels are the first eight hex digits of each
leaf, with ``,`` behind a paragraph and ``;`` behind one that ends a section. Equal
texts have equal roots; likeness and the place of an edit are read off the labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proratio.llm.common import ranked, stored, text_of

_SPACE = r"[ \t\x0B\f\r]"
_VISIBLE = r"[^ \t\x0B\f\r\n]"
_INNER = r"[^ \t\x0B\f\r\n.!?|]"
#: White space before, up to three words that end no sentence, one more word, white space behind; or white space alone.
PHRASE = f"{_SPACE}*(?:{_VISIBLE}*{_INNER}{_SPACE}+){{0,3}}{_VISIBLE}+{_SPACE}*|{_SPACE}+"


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of the text column ``text`` (not null) as column ``name``."""
    leaves, paragraphs = f"_leaves_{name}", f"_paragraphs_{name}"
    sha = lambda x: F.sha2(x, 256)
    df = df.withColumn(leaves, F.transform(
        F.split(F.col(text), "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(PHRASE), F.lit(0)), sha)))
    df = df.withColumn(paragraphs, F.transform(leaves, lambda p: sha(F.array_join(p, ""))))
    ends = lambda d: d.startswith(F.lit("0"))
    sections = F.split(F.array_join(F.transform(paragraphs, lambda d: F.when(ends(d), F.concat(d, F.lit(";"))).otherwise(d)), ""), ";")
    root = sha(F.array_join(F.transform(sections, sha), ""))
    labels = F.array_join(F.transform(leaves, lambda p, i: F.concat(
        F.array_join(F.transform(p, lambda x: F.substring(x, 1, 8)), ""), F.when(ends(F.get(F.col(paragraphs), i)), F.lit(";")).otherwise(F.lit(",")))), "")
    return df.withColumn(name, F.concat(root, F.lit(":"), labels)).drop(leaves, paragraphs)


def _labels(fingerprint: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.substring_index(fingerprint, ":", -1), F.lit("[0-9a-f]{8}"), F.lit(0)))


def likeness(a: str, b: str) -> Column:
    """0 to 1: shared distinct leaves of two fingerprint columns, over the mean of their numbers; 1 for equal roots."""
    x, y = _labels(F.col(a)), _labels(F.col(b))
    both = F.size(x) + F.size(y)
    return F.when(F.col(a) == F.col(b), 1.0).when(both == 0, 0.0).otherwise(
        2.0 * F.size(F.array_intersect(x, y)) / both)


def differing_paragraphs(a: str, b: str) -> Column:
    """Numbers (from 0) of the paragraphs of ``a`` whose leaves occur in no paragraph of ``b``: where an edit lies."""
    parts = lambda c: F.split(F.substring_index(F.col(c), ":", -1), "[,;]")
    found = F.transform(parts(a), lambda p, i: F.when(~F.array_contains(parts(b), p), i))
    return F.when(F.col(a) == F.col(b), F.array().cast("array<int>")).otherwise(F.filter(found, lambda i: i.isNotNull()))


def neighbours(docs: DataFrame) -> DataFrame:
    """(key, prev_key, prev_chars): the document before each in ascending doc_id, and its greatest length.

    From (key, doc_id, text). The one before the first is the last. Rows that repeat
    an id are one place. Null is an id like others and comes first. Only ids are sorted.
    """
    ids = ranked(docs.groupBy("key", "doc_id").agg(F.max(F.length("text")).alias("chars")), ["doc_id"], name="place")
    n = max(ids.count(), 1)
    before = ids.select(((F.col("place") + 1) % n).alias("place"), F.col("key").alias("prev_key"), F.col("chars").alias("prev_chars"))
    return ids.join(before, "place").select("key", "prev_key", "prev_chars")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty. The edited text keeps the first half (rounded up) and takes
    as much as the second half had, or all there is, from the next document: of rows
    that repeat its id, the one with the smallest text.

    Whole texts are shuffled once, by id; to the document before goes what it can use
    of a text, and the text's fingerprint.
    """
    # Null has a key of its own that no number has.
    docs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "doc_id", text_of().alias("text"))
    placed = docs.join(stored(neighbours(docs), "neighbours"), "key")
    # Both sides ask for the same columns of documents, so the texts' exchange is one.
    first = F.row_number().over(Window.partitionBy("key").orderBy("text", "doc_id"))
    given = placed.withColumn("nth", first).where("nth = 1")
    given = fingerprint(given, "text", "next_fingerprint").select(
        F.col("prev_key").alias("key"), F.substring("text", F.lit(1), F.expr("cast(prev_chars div 2 as int)")).alias("next_text"), "next_fingerprint")
    df = placed.join(given, "key").withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    df = df.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    df = fingerprint(fingerprint(df, "text", "fingerprint"), "edited", "edited_fingerprint")
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


def _sql() -> str:
    """The same in SQL. Rows that repeat an id are not in the given tables, so they are left out here."""
    phrase = PHRASE.replace("'", "''")

    def tree(text: str, name: str) -> str:
        return f"""
        {name}_1 AS (SELECT doc_id, list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{phrase}'), lambda l: sha256(l))) AS leaves FROM edited),
        {name}_2 AS (SELECT *, list_transform(leaves, lambda p: sha256(array_to_string(p, ''))) AS paragraphs FROM {name}_1),
        {name} AS (SELECT doc_id, sha256(array_to_string(list_transform(string_split(array_to_string(list_transform(paragraphs,
            lambda d: CASE WHEN d[1] = '0' THEN d || ';' ELSE d END), ''), ';'), lambda s: sha256(s)), '')) || ':' || array_to_string(list_transform(leaves, lambda p, i:
            array_to_string(list_transform(p, lambda x: x[1:8]), '') || CASE WHEN paragraphs[i][1] = '0' THEN ';' ELSE ',' END), '') AS f,
          list_distinct(list_transform(flatten(leaves), lambda x: x[1:8])) AS labels FROM {name}_2)"""

    near = "CASE WHEN {0}.f = {1}.f THEN 1.0::DOUBLE WHEN len({0}.labels) + len({1}.labels) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect({0}.labels, {1}.labels)) / (len({0}.labels) + len({1}.labels)) END"
    return f"""
      WITH whole AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        pairs AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST), first_value(text) OVER (ORDER BY doc_id NULLS FIRST)) AS next FROM whole),
        edited AS (SELECT *, substring(text, 1, n - n // 2) || substring(next, 1, n // 2) AS edited FROM pairs),
        {tree('text', 'own')}, {tree('edited', 'new')}, {tree('next', 'other')}
      SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, own.f AS fingerprint, new.f AS edited_fingerprint,
        {near.format('own', 'new')} AS near_edited, {near.format('own', 'other')} AS near_next
      FROM edited e JOIN own USING (doc_id) JOIN new USING (doc_id) JOIN other USING (doc_id)"""


SQL = _sql()
