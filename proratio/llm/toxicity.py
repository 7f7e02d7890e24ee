"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read the words of a clause: insult, threat, target, negation
and reported speech. Their composition is one automaton whose state says what the
clause has shown so far; on an insult or a threat it puts out a weight, raised by a
target and lowered by a negation shortly before or by reported speech. A document's
score comes from its matched clauses, not from its words.

The lexicon is a seed list plus words and word stems induced from labelled documents,
and a logistic curve turns clause weights into a score; both are fitted on a bounded
sample (``SAMPLE``) of the labelled documents.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proratio.llm.common import stored, text_of

#: Labelled documents the model is fitted on, at most: those with the smallest hash of their id.
SAMPLE = 16_000
#: Score from which a document counts as toxic.
CUT = 0.7
#: Lengths of the word stems that induction looks at, beside whole words.
STEMS = (4, 5, 6, 7)
#: Expected number of words that enter the lexicon by chance (Bonferroni bound on the G test).
CHANCE = 0.05
#: Words that a negation or a target reaches.
REACH = 4

INSULTS = "idiot moron imbecile scum loser trash worthless pathetic stupid disgusting dumbass arschloch trottel connard salope crétin idiota imbécil estúpido pendejo dummkopf"
THREATS = "kill murder strangle stab töte umbringen tuer tuerai matar mataré"
TARGETS = "you your you're yours du dich dir euch tu toi vous ti usted vosotros"
NEGATIONS = "not no never isn't aren't wasn't don't didn't nicht kein keine nie pas jamais ne nunca jamás"
REPORTS = "said says wrote claimed called reported quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó"

_TOKEN = re.compile(r"[^\W_][\w'’]*|[.!?;:\n\"“”«»|]")
_WORD = re.compile(r"[^\W_][\w'’]*")
_END = set(".!?;:\n|")
_QUOTE = set("\"“”«»")


@dataclass
class Model:
    """Lexicon weights of whole words and of stems, and the curve from clause weights to a score."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-4.0, 2.0, 1.0, 0.5)


class Transducer:
    """States are integers from 0 (start); ``step`` gives the next state, ``factor`` the weight in a state."""

    def __init__(self, size: int, steps: dict[tuple[int, str], int], factors: list[float]):
        self.size, self.steps, self.factors = size, steps, factors

    def step(self, state: int, symbol: str) -> int:
        return self.steps.get((state, symbol), self.steps.get((state, "*"), state))


def _fading(symbol: str, factor: float) -> Transducer:
    """Set by ``symbol``, gone REACH words later."""
    steps = {(s, "*"): max(0, s - 1) for s in range(REACH + 1)} | {(s, symbol): REACH for s in range(REACH + 1)}
    return Transducer(REACH + 1, steps, [1.0] + [factor] * REACH)


def _lasting(symbols: str, factor: float) -> Transducer:
    """Set by one of ``symbols`` until the clause ends."""
    return Transducer(2, {(0, s): 1 for s in symbols}, [1.0, factor])


class Grammar:
    """The composition: product states as numbers, one table of next states, one weight per state.

    Symbols: I insult, T threat, Y target, N negation, R report, Q quotation mark, O other.
    """

    def __init__(self):
        parts = [_fading("N", 0.25), _fading("Y", 1.5), _lasting("RQ", 0.5)]
        states = list(itertools.product(*[range(p.size) for p in parts]))
        number = {s: i for i, s in enumerate(states)}
        self.next = {x: [number[tuple(p.step(k, x) for p, k in zip(parts, s))] for s in states] for x in "ITYNRQO"}
        self.weight = [float(np.prod([p.factors[k] for p, k in zip(parts, s)])) for s in states]

    def clauses(self, tokens) -> list[float]:
        """Weights of the clauses with a match. ``tokens``: (symbol or '.' for a clause end, lexicon weight)."""
        out, state, total, late = [], 0, 0.0, 0.0
        for symbol, weight in tokens:
            if symbol == ".":
                if total:
                    out.append(total)
                state, total, late = 0, 0.0, 0.0
                continue
            if symbol in "IT":
                total += weight * self.weight[state]
                late = 0.5 * weight * self.weight[state]
            else:
                # A target right after the match ("idiot, you") raises it as one before does.
                total += late if symbol == "Y" else 0.0
                late = 0.0
            state = self.next[symbol][state]
        if total:
            out.append(total)
        return out


class Scorer:
    """The grammar over a lexicon; plain Python for one text at a time inside a task."""

    def __init__(self, model: Model):
        self.grammar, self.model = Grammar(), model
        self.symbols = {w: ("T", 3.0) for w in THREATS.split()}
        for symbol, words in (("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS)):
            self.symbols |= {w: (symbol, 0.0) for w in words.split()}
        self.symbols |= {w: ("I", v) for w, v in model.words.items()}
        self.lengths = sorted({len(s) for s in model.stems}, reverse=True)  # the longest stem decides
        whole = [re.escape(w) + r"(?![\w'’])" for w in [*model.words, *THREATS.split()]]
        starts = [re.escape(s) for s in model.stems]
        # The first letters in one class let the scan leave most words at once.
        firsts = "".join(sorted({re.escape(w[0]) for w in [*model.words, *model.stems, *THREATS.split()]}))
        self.found = re.compile(rf"\b(?=[{firsts}])(?:{'|'.join([*starts, *whole])})")

    def symbol(self, token: str) -> tuple[str, float]:
        if token in _END:
            return ".", 0.0
        if token in _QUOTE:
            return "Q", 0.0
        known = self.symbols.get(token)
        if known is None:
            for n in self.lengths:
                weight = self.model.stems.get(token[:n])
                if weight is not None:
                    known = ("I", weight)
                    break
            else:
                known = ("O", 0.0)
        return known

    def features(self, text: str) -> tuple[float, float, float]:
        """Whether a clause matched, the sum of the clause weights on a log scale, and the greatest of them."""
        low = text.lower()
        if not self.found.search(low):
            return 0.0, 0.0, 0.0
        clauses = self.grammar.clauses(map(self.symbol, _TOKEN.findall(low)))
        return (1.0, float(np.log1p(sum(clauses))), min(float(max(clauses)), 12.0)) if clauses else (0.0, 0.0, 0.0)

    def score(self, text: str) -> float:
        c, *slopes = self.model.curve
        return float(1 / (1 + np.exp(-(c + sum(a * x for a, x in zip(slopes, self.features(text)))))))


def _terms(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return {"w" + w for w in words} | {"s" + w[:n] for w in words for n in STEMS if len(w) > n}


def _g(t, c, n_t, n_c):
    """G statistic of a term seen in t of n_t toxic and c of n_c clean documents; 0 if it leans to clean ones."""
    p = (t + c) / (n_t + n_c)
    own = np.where(t > 0, t * np.log(np.maximum(t, 1e-9) / (n_t * p)), 0) + np.where(c > 0, c * np.log(np.maximum(c, 1e-9) / (n_c * p)), 0)
    return np.where(t * n_c > c * n_t, 2 * own, 0)


def _signatures(text: str) -> list[int]:
    """Three minima of hashes of word triples: copies of a text share most of them."""
    words = _WORD.findall(text.lower())
    triples = {" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))}
    hashes = np.fromiter((xxhash.xxh64_intdigest(t) for t in triples), np.uint64, len(triples))
    return [int((hashes * np.uint64(odd)).min() >> np.uint64(1)) for odd in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def copy_weights(sample: DataFrame) -> dict[int, float]:
    """By row of the sample: one over the number of rows that share a signature with it.

    A text that occurs many times would else make each of its words look like a sign
    of its label. The sample is bounded, and so is this: four numbers a row.
    """
    def sign(batches):
        for batch in batches:
            found = [_signatures(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[i] for f in found], pa.int64()) for i in range(3)]], ["row", "a", "b", "c"])

    rows = sample.select("row", "text").mapInArrow(sign, "row long, a long, b long, c long").toPandas()
    if not len(rows):
        return {}
    sizes = pd.concat([rows.groupby(c)[c].transform("size") for c in "abc"], axis=1).max(axis=1)
    return dict(zip(rows.row.tolist(), (1.0 / sizes).tolist()))


def induce(sample: DataFrame) -> Model:
    """The lexicon from (row, text, toxic): terms far more common in toxic documents than chance allows.

    Document frequencies, with copies weighed as one document, are counted per task and
    summed by Spark; only terms that pass reach the driver. A stem replaces the words
    and longer stems it covers when it is as pure as they are.
    """
    model = Model(words={w: 4.0 for w in INSULTS.split()})
    weights = copy_weights(sample)
    labels = dict(sample.select("row", "toxic").toPandas().itertuples(index=False))
    n_t = sum(w for r, w in weights.items() if labels[r])
    n_c = sum(w for r, w in weights.items() if not labels[r])
    if not n_t or not n_c:
        return model

    def count(batches):
        counts: dict[str, list[float]] = {}
        for batch in batches:
            for row, text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                for term in _terms(text):
                    counts.setdefault(term, [0.0, 0.0])[toxic] += weights[row]
            if len(counts) > 400_000:
                yield from _counted(counts)
                counts = {}
        yield from _counted(counts)

    sums = sample.select("row", "text", "toxic").mapInArrow(count, "term string, t double, c double").groupBy("term").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c"))
    sums = stored(sums, "terms")
    least = 2 * np.log(max(1, sums.count()) / CHANCE)
    # t toxic documents of n_t at their purest give 2 t ln(n / n_t): a bound that Spark applies before the test.
    pure = 2 * np.log((n_t + n_c) / n_t)
    rows = sums.filter((F.col("t") * F.lit(float(pure)) >= F.lit(float(least))) & (F.col("t") * n_c > F.col("c") * n_t * 4)).toPandas()
    rows = rows[_g(rows.t.to_numpy(float), rows.c.to_numpy(float), n_t, n_c) >= least] if len(rows) else rows
    if not len(rows):
        return model
    rows["weight"] = np.log((rows.t + 0.5) / (n_t + 1)) - np.log((rows.c + 0.5) / (n_c + 1))
    terms = {r.term: float(r.weight) for r in rows.itertuples()}
    for term, weight in sorted(terms.items(), key=lambda x: (len(x[0]), x[0])):
        name = term[1:]
        shorter = next((model.stems[name[:n]] for n in STEMS if n < len(name) + (term[0] == "w") and name[:n] in model.stems), None)
        if shorter is None or weight > shorter + 1.5:
            (model.words if term[0] == "w" else model.stems)[name] = weight
    return model


def _counted(counts):
    yield pa.RecordBatch.from_pydict({
        "term": pa.array(list(counts), pa.string()),
        "t": pa.array([v[1] for v in counts.values()], pa.float64()), "c": pa.array([v[0] for v in counts.values()], pa.float64()),
    })


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge. A slope below 0 is left out: more or worse clauses never lower a score."""
    if not len(y) or y.min() == y.max():
        return Model().curve
    use = list(range(x.shape[1]))
    while True:
        a = np.c_[np.ones(len(x)), x[:, use]]
        w, ridge = np.zeros(a.shape[1]), np.diag([1e-6] + [1e-2] * len(use))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
            w = w + np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        if not use or w[1:].min() >= 0:
            break
        use.pop(int(np.argmin(w[1:])))
    full = np.zeros(1 + x.shape[1])
    full[[0, *[1 + i for i in use]]] = w
    return tuple(float(v) for v in full)


def held_out(name: str = "doc_id"):
    """Rows kept from fitting: crc32 of the id as text, mod 3, is 1. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon and curve from at most ``sample`` labelled documents that are not held out.

    Labels that repeat an id count once, as toxic if any says so; null labels are left out.
    """
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` pairs of numbers: proven small, so the texts need no shuffle.
    chosen = stored(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(rows), "doc_id").select(
        F.monotonically_increasing_id().alias("row"), "text", "toxic"), "labelled")
    model = induce(chosen)

    def measure(batches):
        scorer = Scorer(model)
        for batch in batches:
            found = np.array([scorer.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*[pa.array(found[:, i]) for i in range(3)], batch.column(1)], ["m", "a", "b", "y"])

    # As many rows as the sample has: four numbers each.
    seen = chosen.select("text", "toxic").mapInArrow(measure, "m double, a double, b double, y int").toPandas()
    model.curve = fit_curve(seen[["m", "a", "b"]].to_numpy(float), seen.y.to_numpy(float))
    return model


def scorer(model: Model):
    """A column function from a text to its score (0 to 1), in Arrow batches."""
    held: list[Scorer] = []

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Scorer(model))
        return texts.map(held[0].score).astype("float64")

    return of


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from CUT on). One pass, no shuffle.

    Whole texts count. A null or empty text has no clause and gets the score of a
    document without a match. Columns of ``docs`` named like the new ones are replaced.
    """
    return docs.withColumn("score", scorer(model)(text_of(text))).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score below CUT, with their columns as they are."""
    return docs.filter(scorer(fit(docs, labels, sample))(text_of()) < CUT)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Repeated rows and ids each give a row."""
    return score(docs.select("doc_id", "text"), fit(docs, labels, sample)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
