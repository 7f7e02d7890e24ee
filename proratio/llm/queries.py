"""The registered queries: each applies one operator, with its production parameters, to its whole table.

SQL expresses op4, op7, op9, op10, op11 and op13; fitted models, tokenizers, hashed
fingerprints, their components and cheapest edits are beyond it. ``tests/llm`` holds all
against brute force, a round trip or held-out labels.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from proratio.llm import leaks, masked_lm, merkle, mixing, packing, phrases, simhash, topk, toxicity, turns, urls, warc, wordpiece
from proratio.llm.common import importable

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark, folder, name):
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pseudo_likelihood(spark, folder):
    return masked_lm.pseudo_likelihood(_table(spark, folder, "documents").select("doc_id", "text"))


def op2_toxicity(spark, folder):
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_packing(spark, folder):
    return packing.pack(_table(spark, folder, "documents").select("doc_id", "text"), TOKENIZER)


def op4_warc(spark, folder):
    return warc.archived(_table(spark, folder, "pages"))


def op5_token_counts(spark, folder):
    return wordpiece.token_counts(_table(spark, folder, "documents"), PIECES)


def op6_simhash(spark, folder):
    return simhash.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"))


def op7_topk(spark, folder):
    return topk.search(_table(spark, folder, "embeddings"), every=50, k=5)


def op8_urls(spark, folder):
    return urls.judge(_table(spark, folder, "pages").select("page_id", "url"))


def op9_merkle(spark, folder):
    return merkle.fingerprints(_table(spark, folder, "documents").select("doc_id", "text"))


def op10_mixing(spark, folder):
    mixed = mixing.mix(_table(spark, folder, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", *[F.col(f"_mix_{c}").alias(c) for c in ("block", "slot", "place", "on_target")])


def op11_decontamination(spark, folder):
    return leaks.contamination(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark"))


def op12_repair(spark, folder):
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return turns.repair_report(rows, turns.damaged(rows))


def op13_collocations(spark, folder):
    return phrases.collocations(_table(spark, folder, "documents").select("lang", "text"))


# Hex digits to base 32: five of them are 20 bits, four letters.
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {n}) & 31) + 1, 1)" for n in (15, 10, 5, 0))
WARC_SQL = f"""
  WITH p AS (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
    d AS (SELECT *, sha1(payload) AS hex FROM p)
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(list_transform(range(8), lambda g: CAST('0x' || substr(hex, CAST(g * 5 + 1 AS INTEGER), 5) AS BIGINT)), lambda v: {_LETTERS}), '') AS payload_digest,
    CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
  FROM d"""
TOPK_SQL = """
  WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
  SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
  WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
MIXING_SQL = f"""
  WITH RECURSIVE n AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), {mixing.TEMPERATURE}) AS w FROM documents GROUP BY source),
    shares AS (SELECT *, greatest(1, CAST(round(w * {mixing.FRAME} / (SELECT sum(w) FROM n)) AS BIGINT)) AS p FROM n),
    one AS (SELECT list(source ORDER BY w DESC, source NULLS FIRST) AS sources, list(p ORDER BY w DESC, source NULLS FIRST) AS p, CAST(sum(p) AS BIGINT) AS q FROM shares),
    run AS (SELECT CAST(0 AS BIGINT) AS t, sources, p, q, list_transform(p, lambda x: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS i FROM one
      UNION ALL SELECT t + 1, sources, p, q, list_transform(done, lambda x, j: CASE WHEN j = k THEN x + 1 ELSE x END), CAST(k AS BIGINT) FROM (
        SELECT *, list_position(due, list_min(due)) AS k FROM (
          SELECT *, list_transform(p, lambda x, j: CASE WHEN done[j] * q // x <= t THEN ((done[j] + 1) * q + x - 1) // x END) AS due FROM run WHERE t < q))),
    turns AS (SELECT sources[i] AS source, p[i] AS share, q, t - 1 AS slot, row_number() OVER (PARTITION BY i ORDER BY t) - 1 AS turn FROM run WHERE i IS NOT NULL),
    d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents),
    b AS (SELECT doc_id, source, r // {mixing.BLOCK} AS block, r % {mixing.BLOCK} AS place FROM d),
    dry AS (SELECT min(ceil(n / {mixing.BLOCK}.0)::BIGINT // share * q + slot) AS t FROM n JOIN turns x ON n.source IS NOT DISTINCT FROM x.source AND ceil(n / {mixing.BLOCK}.0)::BIGINT % share = turn)
  SELECT doc_id, b.source, block, block // share * q + slot AS slot, place, block // share * q + slot < (SELECT t FROM dry) AS on_target
  FROM b JOIN turns x ON b.source IS NOT DISTINCT FROM x.source AND block % share = turn"""

QUERIES = {f.__name__: f for f in (
    op1_pseudo_likelihood, op2_toxicity, op3_packing, op4_warc, op5_token_counts, op6_simhash, op7_topk, op8_urls, op9_merkle, op10_mixing,
    op11_decontamination, op12_repair, op13_collocations)}
ORACLES: dict[str, str] = {"op4_warc": WARC_SQL, "op7_topk": TOPK_SQL, "op9_merkle": merkle.SQL, "op10_mixing": MIXING_SQL,
                           "op11_decontamination": leaks.SQL, "op13_collocations": phrases.SQL}
