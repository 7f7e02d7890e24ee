"""op8's scores against exact counts in plain Python, of more grams than a fixed table would hold apart."""

import math
import random

from proratio.llm import urls


def test_scores_are_those_of_exact_counts(spark):
    rng = random.Random(4)
    signs = "abcdefghijklmnopqrstuvwxyz0123456789"
    ends = ("org/", "com/de/", "net/")
    rows = [(i, f"https://{''.join(rng.choices(signs, k=20))}.{ends[i % 3]}{''.join(rng.choices(signs, k=40))}") for i in range(900)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").repartition(3)).collect()}
    texts = {i: "\x02" * 4 + u.split("://", 1)[1] + "\x03" for i, u in rows}
    counts, grams = {}, set()
    for i, t in texts.items():
        for at in range(4, len(t)):
            grams.add(t[at - 4:at + 1])
            for o in range(5):
                for kind, g in ((0, t[at - o:at]), (1, t[at - o:at + 1])):
                    counts[i % 3, kind, o, g] = counts.get((i % 3, kind, o, g), 0) + 1
    assert len(grams) > urls.BUCKETS
    for i, t in texts.items():
        assert (got[i]["score"] is None) == (i % 3 < 2)
        if i % 3 == 2:
            total = 0.0
            for at in range(4, len(t)):
                p = [1 / urls.ALPHABET] * 2  # accepted, rejected
                for o in range(5):
                    for m in (0, 1):
                        gram, context = counts.get((m, 1, o, t[at - o:at + 1]), 0), counts.get((m, 0, o, t[at - o:at]), 0)
                        p[m] = (gram + urls.BLEND * p[m]) / (context + urls.BLEND)
                        assert p[m] <= 1
                total += math.log(p[0]) - math.log(p[1])
            assert abs(total / (len(t) - 4) - got[i]["score"]) < 1e-8
