"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five small transducers read the words of a clause. The insult transducer weighs a word by the longest learned pattern
that matches it, a whole word or a stem; the threat, target, negation and reported-speech transducers know word lists.
Their product reads a clause once and gives each insult or threat a kind: aimed (the clause addresses someone), plain,
negated or reported. A text's score is a logistic function of the weights of its clauses by kind.

Patterns come from one half of at most ``SAMPLE_PER_CLASS`` labelled rows of each class (least hash of the id), the
coefficients from the other half, weighted so that classes count as among all learning labels. Every text is scored
whole. Null and empty texts have no clause and get the score of a text without findings; without labels of both kinds
the score is 0; equal rows get equal scores; an empty table gives an empty result; further columns are ignored by
``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import crc_fold, hash_place, least_placed, map_batches, staged

SAMPLE_PER_CLASS = 10_000
#: Rows whose crc32 of the id is 0 modulo FOLDS are held out.
FOLDS = 5
#: Lengths of stems, least number of toxic texts behind a pattern, least log odds of an insult, patterns kept at most.
STEMS, LEAST_TEXTS, LEAST_WEIGHT, PATTERNS = range(3, 9), 3, 2.0, 20_000
#: Pattern counts held by a task before it hands them on, and words remembered with their symbol.
HELD, MEMO_WORDS = 200_000, 200_000

#: Word lists of the grammar in English, German, French and Spanish.
THREATS = "kill hurt destroy beat burn shoot stab murder töten umbringen verletzen schlagen tuer frapper brûler matar golpear quemar".split()
TARGETS = "you your yours yourself u du dich dir dein ihr euch sie tu toi te vous votre tú ti usted ustedes vosotros".split()
NEGATIONS = "not no never none without isn't aren't don't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún sin".split()
REPORTS = "said says told tells wrote called claimed quoted sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")

#: Input symbols.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


@dataclass(frozen=True)
class Transducer:
    """Moves by (state, symbol); what is not listed stays, and in a fading machine falls back by one."""

    states: int
    moves: dict
    fades: bool = False

    def next(self, state: int, symbol: int) -> int:
        return self.moves.get((state, symbol), max(0, state - 1) if self.fades else state)


#: A negation reaches three words ahead; a target or a reporting verb the rest of the clause.
NEGATING = Transducer(4, {(s, NEGATION): 3 for s in range(4)}, fades=True)
AIMING = Transducer(2, {(0, TARGET): 1})
REPORTING = Transducer(2, {(0, REPORT): 1})
#: Output kinds of an insult or a threat.
AIMED, PLAIN, NEGATED, REPORTED = range(4)


def compose() -> dict[tuple[int, int], tuple[int, int]]:
    """The product machine: (state, symbol) to (state, output); output is a kind for insults, 4 + kind for threats, else -1."""
    machines = (NEGATING, AIMING, REPORTING)
    states = list(product(*(range(m.states) for m in machines)))
    number = {s: k for k, s in enumerate(states)}
    table = {}
    for s in states:
        negated, aimed, reported = s
        kind = REPORTED if reported else NEGATED if negated else AIMED if aimed else PLAIN
        for symbol in range(6):
            to = number[tuple(m.next(x, symbol) for m, x in zip(machines, s))]
            table[number[s], symbol] = (to, kind + 4 * (symbol == THREAT) if symbol in (INSULT, THREAT) else -1)
    return table


MACHINE = compose()
#: States in which the clause has a target.
AIMED_STATES = {k for k, s in enumerate(product(range(4), range(2), range(2))) if s[1]}
FINDINGS = 8
FEATURES = FINDINGS + 3


def patterns_of(word: str) -> list[str]:
    """Patterns that match a word, most specific first: the word itself, then its stems with a star."""
    return [word, *[word[:k] + "*" for k in reversed(STEMS) if k <= len(word)]]


class Lexicon(dict):
    """Symbol and weight of each word met in a task, from learned patterns and the fixed lists."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights
        self.listed = {w: s for words, s in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words}

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        known = next((self.weights[p] for p in patterns_of(word) if p in self.weights), 0.0)
        symbol = INSULT if known >= LEAST_WEIGHT else self.listed.get(word, OTHER)
        self[word] = out = (symbol, known if symbol == INSULT else 1.0)
        return out


def findings(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Feature vector of a text: weight by kind of finding, clauses with any, the strongest clause, findings by word."""
    out = np.zeros(FEATURES)
    words = _WORD.findall(text.lower()) if text else []
    if not any(lexicon[w][0] in (INSULT, THREAT) for w in set(words)):
        return out
    for clause in _CLAUSE.split(text.lower()):
        read = [lexicon[w] for w in _WORD.findall(clause)]
        if not any(s in (INSULT, THREAT) for s, _ in read):
            continue
        state, sums = 0, np.zeros(FINDINGS)
        for symbol, weight in read:
            state, kind = MACHINE[state, symbol]
            if kind >= 0:
                sums[kind] += weight
        if state in AIMED_STATES:  # the target may come after the insult
            for base in (0, 4):
                sums[base + AIMED] += sums[base + PLAIN]
                sums[base + PLAIN] = 0
        out[:FINDINGS] += sums
        out[FINDINGS] += 1
        out[FINDINGS + 1] = max(out[FINDINGS + 1], sums.sum())
    out[FINDINGS + 2] = 100 * out[:FINDINGS].sum() / len(words)
    return np.log1p(out)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    coefficients: np.ndarray  # intercept first; empty: no labels to learn from

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.coefficients):
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + x @ self.coefficients[1:], -30, 30)))


def _pattern_counts(batches):
    toxic, clean = Counter(), Counter()

    def out():
        keys = list(toxic.keys() | clean.keys())
        part = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["pattern", "toxic", "clean"])
        toxic.clear()
        clean.clear()
        return part

    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            found = set()
            for w in set(_WORD.findall(text.lower())) if text else ():
                found.update(patterns_of(w))
            (toxic if label == 1 else clean).update(found)
            if len(toxic) + len(clean) > HELD:
                yield out()
    yield out()


def _learn_patterns(rows: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log odds of the patterns that mark toxic texts, and of those inside them that don't."""
    counts = map_batches(rows, _pattern_counts, "pattern string, toxic long, clean long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 0.3) / (n_toxic + 1)) - F.log((F.col("clean") + 0.3) / (n_clean + 1))
    counts = staged(counts.where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS).withColumn("weight", weight), "toxic-patterns")
    marks = counts.where((F.col("toxic") >= LEAST_TEXTS) & (F.col("weight") >= LEAST_WEIGHT)).orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "pattern").limit(PATTERNS)
    kept = {r.pattern: r.weight for r in marks.select("pattern", "weight").collect()}
    stems = sorted({p for p in kept if p.endswith("*")})
    if not stems:
        return kept
    stem = counts.sparkSession.createDataFrame([(p,) for p in stems], "stem string")
    inner = [F.concat(F.substring("pattern", 1, k), F.lit("*")) for k in STEMS]
    rest = counts.where(F.col("weight") < LEAST_WEIGHT).select("pattern", "weight", F.explode(F.array_distinct(F.array(*inner))).alias("stem")).join(F.broadcast(stem), "stem", "left_semi")
    # All exceptions of a kept stem stay; stems whose exceptions don't fit go, those with the most first.
    sizes = sorted((r["count"], r["stem"]) for r in rest.groupBy("stem").count().collect())
    fit = np.cumsum([n for n, _ in sizes]) <= PATTERNS
    for ok, (_, name) in zip(fit, sizes):
        if not ok:
            del kept[name]
    rest = rest.where(F.col("stem").isin([name for ok, (_, name) in zip(fit, sizes) if ok]))
    return kept | {r.pattern: r.weight for r in rest.select("pattern", "weight").distinct().collect()}


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps with halving; the intercept is hardly held back."""
    x = np.hstack((np.ones((len(x), 1)), x))
    hold = np.full(x.shape[1], ridge)
    hold[0] = 1e-3
    beta = np.zeros(x.shape[1])

    def loss(b):
        z = x @ b
        return (w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (hold * b * b).sum()

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (w * (y - p)) - hold * beta)
        size = 1.0
        while loss(beta + size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return beta


def _featured(lexicon_weights: dict[str, float]):
    def run(batches):
        lexicon = Lexicon(lexicon_weights)
        for b in batches:
            x = [findings(t, lexicon).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learns from labelled rows whose id is not held out; ``labels`` has doc_id and toxic (0 or 1)."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where("__id is not null and toxic in (0, 1)")
    known = known.where(crc_fold(F.col("__id"), FOLDS) != 0).groupBy("__id").agg(F.max("toxic").alias("toxic"))
    size = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return Model({}, np.zeros(0))
    place = hash_place(F.lit("toxicity"), F.col("__id"))
    part = lambda c: least_placed(known.where(F.col("toxic") == c), place, "__id", SAMPLE_PER_CLASS, size[c])
    picked = F.broadcast(part(0).union(part(1)))  # at most twice SAMPLE_PER_CLASS ids
    rows = docs.select(F.col(doc_id).alias("__key"), F.col(text).alias("text")).join(picked, F.col("__key") == F.col("__id"))
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("__id")), F.lit(2))
    n = {r.toxic: r["count"] for r in rows.where(half == 0).groupBy("toxic").count().collect()}
    weights = _learn_patterns(rows.where(half == 0).select("text", "toxic"), n.get(1, 0), n.get(0, 0))
    seen = map_batches(rows.where(half == 1).select("text", "toxic"), _featured(weights), "toxic int, x array<double>").collect()
    y, x = np.array([r.toxic for r in seen], float), np.array([r.x for r in seen]).reshape(-1, FEATURES)
    if len(set(y.tolist())) < 2:
        return Model(weights, np.zeros(0))
    share = {c: size[c] / sum(size.values()) / (y == c).mean() for c in (0, 1)}
    return Model(weights, _logistic(x, y, np.where(y == 1, share[1], share[0])))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * PATTERNS weights
    rows = docs.select(F.col(doc_id).alias("doc_id"), (crc_fold(F.col(doc_id), FOLDS) == 0).alias("held_out"), F.col(text).alias("text"))

    def run(batches):
        lexicon = Lexicon(shared.value.weights)
        for b in batches:
            s = shared.value.score(np.array([findings(t, lexicon) for t in b.column("text").to_pylist()]).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, score double, predicted int").fields])
    return map_batches(rows, run, schema)


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that score below one half, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        lexicon = Lexicon(shared.value.weights)
        for b in batches:
            s = shared.value.score(np.array([findings(t, lexicon) for t in b.column(text).to_pylist()]).reshape(-1, FEATURES))
            yield b.filter(pa.array(s < 0.5))

    return map_batches(docs, run, docs.schema)
