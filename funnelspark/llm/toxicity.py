"""Toxicity by a weighted finite-state grammar.

Words become symbols: insults (with a learned weight), threats, modals, targets, negations, reporting
verbs, quotation marks, clause ends. Four small transducers each read symbols and pass them on with
log weights: negation and reported speech lessen what follows, a target near an insult adds to it, and
modal, threat and target in a row make a threat. Composed into one table they score clauses, not words. A
logistic function of the clause scores gives the document's score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labelled rows used to fit, about, at most.
FIT_ROWS = 20_000
# A word or stem enters the lexicon above this lower bound of its log odds.
LEAST_WEIGHT, CAUTION, LEAST_TOXIC = 1.5, 1.0, 3
STEMS = range(4, 11)
CACHED = 300_000

OTHER, BREAK, NEGATION, REPORT, QUOTE, TARGET, THREAT, MODAL, INSULT = range(9)

# Words of the closed classes, in English, German, French and Spanish.
WORDS = {
    NEGATION: "not no never isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais nunca",
    REPORT: "said says say told called calls wrote writes claimed sagte nannte schrieb dit disait "
            "dijo llamó escribió",
    TARGET: "you your yours u him her them they he she du dich ihr euch sie tu toi vous lui eux tú "
            "ti ustedes ellos",
    THREAT: "kill hurt beat destroy shoot stab burn hang punch töten schlagen tuer frapper matar golpear",
    MODAL: "will gonna going must should shall werde wirst vais va voy vas",
}
# Used where no label can be learned from; of the weight of a word in one toxic text of four.
SEED_INSULTS = "idiot moron stupid scum trash loser pathetic disgusting worthless clown"
SEED_WEIGHT = 4.0
THREAT_WEIGHT = 4.0
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]|[\"“”«»]")


@dataclass(frozen=True)
class Transducer:
    """Deterministic weighted transducer: (state, symbol) -> (state, symbol passed on, log weight).

    Pairs that are not listed keep the state, or lead to ``idle[state]``, and pass the symbol on.
    """

    states: int
    arcs: dict[tuple[int, int], tuple[int, int, float]]
    idle: tuple[int, ...]

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (self.idle[state], symbol, 0.0))


def negation(reach: int = 3, weight: float = 0.2) -> Transducer:
    """Insults and threats up to ``reach`` words after a negation count for less."""
    arcs = {}
    for s in range(reach + 1):
        arcs[s, NEGATION] = (reach, NEGATION, 0.0)
        arcs[s, BREAK] = (0, BREAK, 0.0)
        if s:
            arcs[s, INSULT] = (s - 1, INSULT, math.log(weight))
            arcs[s, THREAT] = (s - 1, THREAT, math.log(weight))
    return Transducer(reach + 1, arcs, tuple(max(0, s - 1) for s in range(reach + 1)))


def reported_speech(weight: float = 0.4) -> Transducer:
    """What follows a reporting verb in its clause, or stands in quotation marks, counts for less."""
    arcs = {}
    for s in range(3):  # plain, reported, quoted
        arcs[s, REPORT] = (s or 1, REPORT, 0.0)
        arcs[s, QUOTE] = (0 if s == 2 else 2, QUOTE, 0.0)
        arcs[s, BREAK] = (0, BREAK, 0.0)
        if s:
            arcs[s, INSULT] = (s, INSULT, math.log(weight))
            arcs[s, THREAT] = (s, THREAT, math.log(weight))
    return Transducer(3, arcs, (0, 1, 2))


def targeted(reach: int = 4, weight: float = 1.5) -> Transducer:
    """An insult up to ``reach`` words after a target counts for more."""
    arcs = {}
    for s in range(reach + 1):
        arcs[s, TARGET] = (reach, TARGET, 0.0)
        arcs[s, BREAK] = (0, BREAK, 0.0)
        if s:
            arcs[s, INSULT] = (s - 1, INSULT, math.log(weight))
    return Transducer(reach + 1, arcs, tuple(max(0, s - 1) for s in range(reach + 1)))


def threatening(reach: int = 3) -> Transducer:
    """A threat word passes only between a modal and, ``reach`` words on at most, a target.

    States: 0 none; 1 to reach: after a modal; then after modal and threat. The target that ends the
    pattern passes on as a threat; the threat word itself passes as an ordinary word.
    """
    arcs, idle = {}, [0] * (2 * reach + 1)
    for s in range(2 * reach + 1):
        idle[s] = s - 1 if s not in (0, 1, reach + 1) else 0
        arcs[s, MODAL] = (reach, MODAL, 0.0)
        arcs[s, BREAK] = (0, BREAK, 0.0)
        arcs[s, THREAT] = (2 * reach, OTHER, 0.0) if 1 <= s <= reach else (idle[s], OTHER, 0.0)
        if s > reach:
            arcs[s, TARGET] = (0, THREAT, 0.0)
    return Transducer(2 * reach + 1, arcs, tuple(idle))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One transducer for ``second`` reading what ``first`` passes on; log weights add up."""
    arcs = {}
    for a in range(first.states):
        for b in range(second.states):
            for symbol in range(INSULT + 1):
                to_a, middle, w = first.step(a, symbol)
                to_b, out, v = second.step(b, middle)
                arcs[a * second.states + b, symbol] = (to_a * second.states + to_b, out, w + v)
    n = first.states * second.states
    return Transducer(n, arcs, tuple(arcs[s, OTHER][0] for s in range(n)))


def grammar() -> Transducer:
    """Negation, reported speech, targets and threats in one table."""
    return compose(compose(compose(negation(), reported_speech()), targeted()), threatening())


class Scorer:
    """Clause scores of texts under a lexicon of words (``=word``) and stems (``^stem``)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.symbols = {w: s for s, words in WORDS.items() for w in words.split()}
        self.symbols |= dict.fromkeys(".!?;\n", BREAK) | dict.fromkeys('"“”«»', QUOTE)
        self.table = grammar()
        self._codes: dict[str, float] = {}

    def code(self, word: str) -> float:
        """Symbol of a word, or INSULT plus its weight."""
        weight = self.lexicon.get("=" + word, 0.0)
        for n in STEMS:
            if len(word) < n:
                break
            weight = max(weight, self.lexicon.get("^" + word[:n], 0.0))
        return INSULT + weight if weight else float(self.symbols.get(word, OTHER))

    def clauses(self, text: str) -> tuple[list[float], int, int]:
        """(scores of clauses that match, different insults, words)."""
        tokens = TOKEN.findall(text.lower())
        known = self._codes
        try:
            codes = [known[t] for t in tokens]
        except KeyError:
            if len(known) > CACHED:
                known.clear()
            for t in set(tokens):
                if t not in known:
                    known[t] = self.code(t)
            codes = [known[t] for t in tokens]
        hits = [i for i, c in enumerate(codes) if c >= INSULT or c == THREAT]
        scores, n, done = [], len(codes), -1
        step = self.table.step
        for i in hits:
            if i < done:
                continue
            # A clause, with quotation marks opened earlier in it, is read from its start.
            a = i
            while a and codes[a - 1] != BREAK:
                a -= 1
            state, score, at, held = 0, 0.0, a, 0.0
            while at < n and codes[at] != BREAK:
                c = codes[at]
                symbol = INSULT if c >= INSULT else int(c)
                state, out, weight = step(state, symbol)
                if out == INSULT:
                    score += (c - INSULT) * math.exp(weight)
                elif out == THREAT:
                    score += THREAT_WEIGHT * math.exp(weight + held)
                elif symbol == THREAT:
                    # Its weight goes to the target that may complete the threat.
                    held = weight
                at += 1
            done = at
            if score:
                scores.append(score)
        return scores, len({tokens[i] for i in hits}), n

    def features(self, text: str | None) -> list[float]:
        """What the final weights are for; a null or empty text has no clauses."""
        scores, kinds, n = self.clauses(text or "")
        total = sum(scores)
        return [
            1.0,
            math.log1p(total),
            math.log1p(max(scores, default=0.0)),
            math.log1p(kinds),
            math.log1p(100 * total / (n + 20)),
        ]


def fit_weights(features, labels, penalty: float = 1e-2, rounds: int = 30):
    """Logistic regression by Newton steps with a small quadratic penalty.

    The first feature is constant. More evidence must not lower a score, so a feature whose weight
    comes out negative is left out.
    """
    import numpy as np

    x, y = np.asarray(features, float), np.asarray(labels, float)
    used = list(range(x.shape[1]))
    while True:
        z, w = x[:, used], np.zeros(len(used))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (p - y) + penalty * w
            curve = (z * (p * (1 - p))[:, None]).T @ z + penalty * np.eye(len(w))
            move = np.linalg.solve(curve, gradient)
            w -= move
            if np.abs(move).max() < 1e-8:
                break
        if len(used) == 1 or w[1:].min() >= 0:
            out = np.zeros(x.shape[1])
            out[used] = w
            return out
        del used[1 + int(w[1:].argmin())]


# Used where no label can be learned from: two insults or a clear clause make a toxic text.
DEFAULT_WEIGHTS = [-4.0, 1.5, 1.0, 1.0, 0.5]


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    weights: list[float]


def _evidence(batches):
    """Per word and stem: toxic and other texts that hold it, in either half."""
    import pyarrow as pa

    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic, half in zip(*[batch.column(c).to_pylist() for c in ("text", "toxic", "half")]):
            seen = set()
            for word in {w for w in TOKEN.findall((text or "").lower()) if w[0].isalpha()}:
                seen.add("=" + word)
                seen.update("^" + word[:n] for n in STEMS if len(word) >= n)
            for item in seen:
                counts.setdefault(item, [0, 0, 0, 0])[2 * half + (not toxic)] += 1
    names = list(counts)
    columns = [pa.array(names, pa.string())]
    columns += [pa.array([counts[n][k] for n in names], pa.int64()) for k in range(4)]
    yield pa.RecordBatch.from_arrays(columns, ["item", "t0", "c0", "t1", "c1"])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the decimal id leaves 1 modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic, half) of about ``fit_rows`` labelled documents that may be learned from.

    They are chosen by a hash of doc_id, which also halves them. Repeated labels count once, a
    toxic one first; null labels and ids do not count. Of repeated documents the least text counts, so the rows are
    as bounded as the ids. The labels in use are few by that bound and go to all tasks, so only their documents
    are shuffled.
    """
    some = labels.filter("toxic is not null and doc_id is not null")
    some = some.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        (F.max("toxic") > 0).alias("toxic")
    )
    some = some.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    share = min(1.0, fit_rows / max(1, some.count()))
    used = some.filter(F.col("_h") < math.ceil((1 << 20) * share))
    used = used.select(F.col("doc_id").alias("_id"), "toxic", (F.col("_h") % 2).cast("int").alias("half"))
    met = docs.select("doc_id", "text").join(F.broadcast(used), F.col("doc_id") == F.col("_id"))
    return met.groupBy("_id", "toxic", "half").agg(F.min("text").alias("text")).select("text", "toxic", "half")


def learn(used: DataFrame, lexicon_size: int | None = None) -> Model:
    """Fit lexicon and weights on (text, toxic, half) rows, which ``training_rows`` bounds.

    The weights of the clause scores are fitted on one half with a lexicon of the other, so that they
    don't trust a lexicon too much; the lexicon that is kept is learned on both. Without rows of both
    labels in both halves the seed words and fixed weights are used. ``lexicon_size`` keeps the strongest words only;
    without it all that pass the tests stay, a number that the rows bound.
    """
    import numpy as np

    sizes = {(r["half"], r["toxic"]): r["count"] for r in used.groupBy("half", "toxic").count().collect()}
    seeds = {"=" + w: SEED_WEIGHT for w in SEED_INSULTS.split()}
    if not all(sizes.get((h, t)) for h in (0, 1) for t in (False, True)):
        return Model(seeds, DEFAULT_WEIGHTS)

    def weight(t: Column, c: Column, halves: tuple[int, ...]) -> Column:
        toxic, clean = (sum(sizes[h, kind] for h in halves) for kind in (True, False))
        odds = F.log(((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1)))
        bound = odds - CAUTION * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        return F.when((t >= LEAST_TOXIC) & (bound >= LEAST_WEIGHT), bound)

    parts = ["t0", "c0", "t1", "c1"]
    counted = used.mapInArrow(
        _evidence, "item string, " + ", ".join(f"{c} bigint" for c in parts)
    ).groupBy("item").agg(*[F.sum(c).alias(c) for c in parts])
    weighed = counted.select(
        "item",
        weight(F.col("t0"), F.col("c0"), (0,)).alias("first"),
        weight(F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1"), (0, 1)).alias("both"),
    ).filter("first is not null or both is not null")
    if lexicon_size is not None:
        weighed = weighed.orderBy(F.desc(F.greatest("first", "both")), "item").limit(lexicon_size)
    rows = weighed.collect()
    half = {r["item"]: r["first"] for r in rows if r["first"]}
    lexicon = {r["item"]: r["both"] for r in rows if r["both"]}
    if not half or not lexicon:
        return Model(seeds, DEFAULT_WEIGHTS)

    def score(batches):
        import pyarrow as pa

        scorer = Scorer(half)
        for batch in batches:
            values = [scorer.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"]
            )

    # A handful of numbers for each of at most fit_rows rows.
    points = used.filter("half = 1").select("text", "toxic")
    points = points.mapInArrow(score, "x array<double>, toxic boolean").collect()
    labels = [r["toxic"] for r in points]
    if len(set(labels)) < 2:
        return Model(lexicon, DEFAULT_WEIGHTS)
    points = sorted((r["x"], r["toxic"]) for r in points)
    weights = fit_weights([p[0] for p in points], [p[1] for p in points])
    return Model(lexicon, np.round(weights, 6).tolist())


def score_toxicity(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text",
    threshold: float = 0.7,
) -> DataFrame:
    """(doc_id, score, predicted) of every row; only the text is read.

    Null and empty texts have no clauses and the lowest score. Repeated rows are scored each.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        scorer, weights = Scorer(model.lexicon), np.array(model.weights)
        for batch in batches:
            x = np.array([scorer.features(t) for t in batch.column("text").to_pylist()])
            x = x.reshape(-1, len(weights))
            scores = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            arrays = [batch.column("doc_id"), pa.array(scores),
                      pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "predicted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def score_column(model: Model, text: Column) -> Column:
    """Score of a text as a column, for filters that keep the other columns where they are."""
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        scorer, weights = Scorer(model.lexicon), np.array(model.weights)
        for some in texts:
            x = np.array([scorer.features(t) for t in some]).reshape(-1, len(weights))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))

    return F.pandas_udf(run, "double")(text)
