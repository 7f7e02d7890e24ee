"""Collocations against plain Python, whatever the shards, chunks and bits."""

import random
import re
from collections import Counter

import pyarrow as pa
from proratio.llm import phrases
from test_llm_operators import DOCS, awkward_rows


def slow_counts(rows, longest=3):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i:i + n])) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    return counts, totals


def slow(rows, support=10, longest=3, inside=50, best=2000):
    counts, totals = slow_counts(rows, longest)
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= support}
    hidden = {(lang, p[i:i + n]) for (lang, p), f in found.items() for n in range(2, len(p)) for i in range(len(p) - n + 1)
              if 100 * f >= inside * counts[lang, p[i:i + n]]}
    out = {}
    for (lang, p), a in found.items():
        if (lang, p) not in hidden:
            cuts = [(10 ** 6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return {(lang, rank, p.decode(), -a, left, right, totals[lang], -s)
            for lang, own in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(own)[:best], 1)}


def got(frame):
    return {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in frame.collect()}


def corpus(n=400):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["New", "york", "é", "漢 字"]
    texts = []
    for i in range(n):
        w = [rng.choice(vocabulary[:rng.choice([6, 20, 64])]) + rng.choice(["", "", "", ",", ".\n", "  "]) for _ in range(rng.randrange(0, 30))]
        texts.append((" ".join(w) + (" New york  city" if i % 5 == 0 else ""), rng.choice(["en", "en", "de", None])))
    return texts


def test_shards_chunks_and_bits_change_nothing(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    want = slow(rows)
    assert len(want) > 25
    for mining in ({}, {"shards": 1}, {"shards": 7, "limit": 500}, {"bits": 1 << 10, "limit": 2000}):
        assert got(phrases.collocations(docs, **mining)) == want


def test_longer_phrases_and_other_thresholds(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert got(phrases.collocations(docs, support=4, longest=4, inside=80, best=7, limit=3000)) == slow(rows, 4, 4, 80, 7)


def test_every_frequent_phrase_is_mined(spark):
    rows = corpus()
    docs = spark.createDataFrame([(t, lang or "und") for t, lang in rows], "text string, lang string").repartition(6)
    counts, totals = phrases.frequent_phrases(docs, limit=400)
    want = {(lang, len(p), " ".join(p), f) for (lang, p), f in slow_counts(rows)[0].items() if f >= 10}
    assert {tuple(r) for r in counts.select("lang", "words", "phrase", "f").collect()} == want
    assert {r["lang"]: r["n"] for r in totals.collect()} == dict(slow_counts(rows)[1])


def test_numbers_are_equal_only_for_equal_phrases():
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdef") for _ in range(500))
    chunk = phrases.Chunk("en", 0, pa.array([text]))
    w = text.split()
    for n in (1, 2, 3, 4):
        at = chunk.starts(n)
        assert len(at) == len(w) - n + 1
        assert len(set(chunk.numbers(at, n).tolist())) == len({tuple(w[i:i + n]) for i in range(len(w) - n + 1)})


def test_awkward_and_empty_tables(spark):
    rows = awkward_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", n long, phrase string")
    assert got(phrases.collocations(docs)) == slow([(r[1], r[2]) for r in rows])
    assert phrases.collocations(spark.createDataFrame([], docs.schema)).collect() == []


def test_counts_beyond_64_bits(spark):
    """Products of counts are exact: 1,000,000 * a * a passes 64 bits from a = 4,294,968 on."""
    row = spark.sql("select cast(cast(1000000 as decimal(7,0)) * cast(900000000000000 as decimal(15,0)) * cast(900000000000000 as decimal(15,0))"
                    " div (cast(900000000000001 as decimal(15,0)) * cast(900000000000000 as decimal(15,0))) as long) as s").first()
    assert row["s"] == 10 ** 6 * 900000000000000 // 900000000000001
