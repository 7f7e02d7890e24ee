"""URL verdicts by host and path rules, and by a character model where no rule fits.

Two variable-order Markov models read a URL character by character: one of accepted
URLs, one of rejected ones (those that an allow or a block rule decides). A
character's probability is blended from the longest context down to none, each order
trusted as far as its context has been seen. The verdict is the sign of the
length-normalised log-likelihood difference against a calibrated cut.

Counts cover all URLs that a rule decides and are exact: a table with a row per context
and per character in context, which grows with the input. Each distinct window of
``ORDER`` + 1 characters is weighed once by joins with that table, and a URL adds up
its windows. ``train`` and ``difference`` are a form of fixed size, in ``BUCKETS`` hashed
cells, in which unlike grams share counts; ``judge`` does not use them. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proratio.llm.common import stored

#: Longest context in characters.
ORDER = 4
#: Cells per order and model for counts of contexts and of characters in context.
BUCKETS = 1 << 14
#: Trust in shorter contexts, in observations.
BLEND = 2.0
#: Characters outside this many count as equally likely where nothing was seen.
ALPHABET = 96
#: Cells of the score histogram in which the cut is sought.
STEPS = 2000
#: Keys in more than one of so many rows are joined by broadcast: fewer than so many keys.
HOT = 10_000
#: Log ratios are kept in steps of 1 / UNIT, so that sums do not depend on their order.
UNIT = 1 << 32
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substring(text, F.instr(text, "://") + 3, F.length(text))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def decided(urls: DataFrame, rules=RULES) -> DataFrame:
    """``urls`` (host, path) with ``rule`` and ``by_rule`` (allow or block), null where no rule fits. The longest wins."""
    fits = []
    for verdict, host, path in rules:
        here = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        fits.append(F.when(here, F.struct(F.lit(len(host) + len(path)).alias("n"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))))
    best = F.array_max(F.array(*fits))
    return urls.withColumn("_best", best).withColumn("rule", F.col("_best.rule")).withColumn("by_rule", F.col("_best.verdict")).drop("_best")


def _cell(gram: Column, order: int, kind: int, model: Column | int) -> Column:
    """Cell of a gram. Layout: order, then context (0) or gram (1), then model (0 rejected, 1 accepted)."""
    base = (order * 2 + kind) * 2 * BUCKETS
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)) + F.lit(base) + model * BUCKETS


def _grams(text: Column, at: Column, order: int) -> tuple[Column, Column]:
    """Context of ``order`` characters before place ``at`` (from 1), and context with the character. Text is padded by ORDER marks."""
    start = at + F.lit(ORDER - order)
    return F.substring(text, start, F.lit(order)), F.substring(text, start, F.lit(order + 1))


def _read(url: str) -> Column:
    """What the models read: marks for the start, then host, path and the rest in lower case without the scheme."""
    return F.concat(F.lit("\x02" * ORDER), F.lower(F.regexp_replace(F.col(url), "^.*?://", "")), F.lit("\x03"))


def train(texts: DataFrame) -> DataFrame:
    """One row, one array of counts, from (text, accepted as 0 or 1); of fixed size."""
    cells = []
    at, text, model = F.col("at"), F.col("text"), F.col("accepted")
    for order in range(ORDER + 1):
        context, gram = _grams(text, at, order)
        cells += [_cell(context, order, 0, model), _cell(gram, order, 1, model)]
    places = texts.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("text") - ORDER)))
    # Equal windows of ORDER + 1 characters first become one row with their number.
    places = places.select(F.substring(text, at, F.lit(ORDER + 1)).alias("text"), "accepted").groupBy("text", "accepted").agg(F.count(F.lit(1)).alias("n"))
    counts = places.withColumn("at", F.lit(1)).select(F.explode(F.array(*cells)).alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("n"))
    every = texts.sparkSession.range((ORDER + 1) * 4 * BUCKETS).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("n"))
    # A row per cell, whatever the input: (ORDER + 1) * 4 * BUCKETS of them.
    full = counts.unionByName(every).groupBy("cell").agg(F.sum("n").alias("n"))
    return full.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "n"))), lambda x: x.n.cast("double")).alias("counts"))


def difference(text: Column, counts: Column, own: Column | None = None) -> Column:
    """Log-likelihood difference, accepted minus rejected, per character of ``text``.

    ``own`` (0 or 1) names the model a training URL is part of: one observation of each
    gram is taken out there, so that it is scored as if it had not been seen. The
    model's array is read in one place, so it stays one object in the plan.
    """
    models = (1, 0)

    def at_place(at):
        cells = []
        for model in models:
            for order in range(ORDER + 1):
                context, gram = _grams(text, at, order)
                cells += [_cell(context, order, 0, model), _cell(gram, order, 1, model)]
        return F.transform(F.array(*cells), lambda c: F.get(counts, c.cast("int")))

    def likelihood(seen, model):
        less = F.when(own == model, 1.0).otherwise(0.0) if own is not None else F.lit(0.0)
        p = F.lit(1.0 / ALPHABET)
        for order in range(ORDER + 1):
            i = 2 * (models.index(model) * (ORDER + 1) + order)
            context, gram = F.greatest(seen[i] - less, F.lit(0.0)), F.greatest(seen[i + 1] - less, F.lit(0.0))
            p = (gram + F.lit(BLEND) * p) / (context + F.lit(BLEND))
        return F.log(p)

    found = F.transform(F.transform(F.sequence(F.lit(1), F.length(text) - ORDER), at_place), lambda seen: likelihood(seen, 1) - likelihood(seen, 0))
    return F.aggregate(found, F.lit(0.0), lambda total, x: total + x) / (F.length(text) - ORDER)


def places(urls: DataFrame) -> DataFrame:
    """(_row, accepted, window) for each character of each URL; ``accepted`` is null where no rule fits."""
    at = F.explode(F.sequence(F.lit(1), F.length("text") - ORDER)).alias("at")
    return urls.select("_row", "accepted", "text", at).select("_row", "accepted", F.substring(F.col("text"), F.col("at"), F.lit(ORDER + 1)).alias("window"))


def attached(asked: DataFrame, table: DataFrame, on: list[str], n: str) -> DataFrame:
    """``asked`` joined with the stored ``table``, which has each key once and in ``n`` how many rows ask it.

    At most HOT keys can be asked by more than one in HOT of the rows; those are broadcast.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * HOT > total
    hot, cold = table.filter(is_hot), table.filter(~is_hot)
    rest = asked.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return asked.join(F.broadcast(hot), on).unionByName(rest)


def ratios(windows: DataFrame) -> DataFrame:
    """(window, n, free, own_1, own_0): log ratio of a window's last character, accepted to rejected, in units of 1 / UNIT.

    ``windows``: (window, n, n_1, n_0), stored: occurrences in all, in accepted and in
    rejected URLs. own_1 and own_0 are for a URL of that model: one observation of each
    gram is taken out, so that it is scored as if it had not been seen.
    """
    keys = []
    for order in range(ORDER + 1):
        for kind, gram in enumerate((F.substring("window", ORDER - order + 1, order), F.substring("window", ORDER - order + 1, order + 1))):
            keys.append(F.struct(F.lit(2 * order + kind).alias("kind"), gram.alias("gram")))
    keyed = windows.select("window", "n", "n_1", "n_0", F.explode(F.array(*keys)).alias("k")).select("window", "n", "n_1", "n_0", "k.kind", "k.gram")
    counts = stored(keyed.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("asked"), F.sum("n_1").alias("all_1"), F.sum("n_0").alias("all_0")), "grams")
    found = attached(keyed.select("window", "n", "kind", "gram"), counts, ["kind", "gram"], "asked")
    # Ten rows a window, side by side.
    seen = found.groupBy("window", "n").agg(*[
        F.sum(F.when(F.col("kind") == i, F.col(f"all_{m}")).otherwise(0)).cast("double").alias(f"c_{m}_{i}") for m in (0, 1) for i in range(2 * ORDER + 2)])

    def likelihood(model, own):
        p = F.lit(1.0 / ALPHABET)
        for order in range(ORDER + 1):
            context, gram = (F.greatest(F.col(f"c_{model}_{2 * order + kind}") - float(own == model), F.lit(0.0)) for kind in (0, 1))
            p = (gram + F.lit(BLEND) * p) / (context + F.lit(BLEND))
        return F.log(p)

    return seen.select("window", "n", *[
        F.round((likelihood(1, own) - likelihood(0, own)) * UNIT).cast("long").alias(name) for name, own in (("free", None), ("own_1", 1), ("own_0", 0))])


def scores(urls: DataFrame) -> DataFrame:
    """Stored ``urls`` (_row, text, accepted and others) with ``score``: the log-likelihood difference per character."""
    one, zero = F.coalesce(F.sum("accepted"), F.lit(0)), F.coalesce(F.sum(1 - F.col("accepted")), F.lit(0))
    windows = stored(places(urls).groupBy("window").agg(F.count(F.lit(1)).alias("n"), one.alias("n_1"), zero.alias("n_0")), "windows")
    found = attached(places(urls), stored(ratios(windows), "ratios"), ["window"], "n")
    value = F.when(F.col("accepted") == 1, F.col("own_1")).when(F.col("accepted") == 0, F.col("own_0")).otherwise(F.col("free"))
    sums = found.groupBy("_row").agg(F.sum(value).alias("total"))
    return urls.join(sums, "_row").withColumn("score", F.col("total") / UNIT / (F.length("text") - ORDER)).drop("total")


def calibrated(scores: DataFrame) -> DataFrame:
    """One row, ``cut``: where accepted URLs below and rejected ones above, each as a share of its kind, are fewest.

    From (score, accepted). A histogram of STEPS cells of the score is enough; among
    equally good cuts the middle one is taken. Without both kinds the cut is 0.
    """
    cell = F.least(F.greatest(F.floor((F.col("score") + 5) / 10 * STEPS), F.lit(0)), F.lit(STEPS - 1)).cast("int")
    counts = scores.groupBy(cell.alias("cell")).agg(F.sum("accepted").alias("good"), F.sum(1 - F.col("accepted")).alias("bad"))
    # At most STEPS rows from here on, in one array.
    one = counts.groupBy().agg(
        F.sum("good").alias("goods"), F.sum("bad").alias("bads"), F.collect_list(F.struct("cell", "good", "bad")).alias("cells"))
    wrong = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda c: F.aggregate(
        "cells", F.lit(0.0), lambda e, x: e + F.when(x.cell < c, x.good / F.col("goods")).otherwise(x.bad / F.col("bads"))))
    one = one.withColumn("wrong", F.when((F.col("goods") > 0) & (F.col("bads") > 0), wrong)).withColumn("least", F.array_min("wrong"))
    best = F.filter(F.transform("wrong", lambda e, i: F.when(e == F.col("least"), i)), lambda i: i.isNotNull())
    middle = F.get(best, (F.size(best) / 2).cast("int"))
    return one.select(F.coalesce(middle / F.lit(float(STEPS)) * 10 - 5, F.lit(0.0)).alias("cut"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, score (null where a rule decides).

    Repeated rows each give a row. A URL that is null or has no ``://`` has empty host
    and path; the method judges it by what it says, null as the empty text. Where no
    URL is decided by a rule both models are empty, the difference is 0 and the
    verdict allow.
    """
    host, path = parts()
    urls = decided(pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path")), rules)
    accepted = F.when(F.col("by_rule").isNotNull(), (F.col("by_rule") == "allow").cast("int"))
    urls = urls.withColumn("text", _read("url")).withColumn("accepted", accepted).drop("url").withColumn("_row", F.monotonically_increasing_id())
    scored = stored(scores(stored(urls, "urls")), "scored")
    cut = calibrated(scored.filter(F.col("accepted").isNotNull()))
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= cut.scalar(), "allow").otherwise("block"))
    score = F.when(F.col("by_rule").isNull(), F.col("score")).alias("score")
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score)
