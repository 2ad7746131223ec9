"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insults in three grades of weight, threats, targets, negations,
verbs of reported speech, anything else. Five letter transducers read a clause of
symbols, each rewriting what the one before it wrote, and are composed into one machine:

* negation turns an insult or threat shortly after a negation into its negated form,
* reported speech turns what follows a verb of saying into its reported form,
* threat keeps a threat open until a target follows and then writes a directed threat,
* target writes a directed insult when a target stands close before it,
* insult adds the weight of the insult's grade.

A document's evidence is what its matched clauses hold: how often each form occurs and
the weights the machine added. A regularised logistic model turns it into a score.

The insult lexicon starts from a short fixed list and is extended from labelled rows:
words, word beginnings and repeated word beginnings that toxic documents have and clean
ones don't, if that can't be chance among all that were tested, and then those that
explain the toxic documents still unexplained. A beginning that only tells documents
apart when it is repeated becomes an insult of the lowest grade.

Defined results: null text is an empty text; a text without a match gets the model's
lowest score; with no labelled rows the fixed list and default weights apply; repeated
rows give repeated results; very long texts are read in parts, and a clause that one part
leaves open goes on in the next, so the size of parts changes nothing. The fit uses at most
`per_class` labelled documents of each class, and equal texts among them count once.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import ENTRY_BYTES, cuts, held_out, labelled_sample, materialize, ready, settle, slices

# Fixed word lists.
INSULTS = (
    "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns imbecile fool "
    "dumb jerk pig coward vermin filth garbage freak retard bastard arschloch trottel idiota imbécil crétin connard"
).split()
THREATS = "kill murder hurt strangle stab shoot destroy umbringen töten tuer matar".split()
TARGETS = "you your yours yourself u du dich dir ihr toi vous tú te usted ustedes they them him her people".split()
NEGATIONS = "not no never isn't aren't don't doesn't nicht kein keine niemals pas jamais nunca jamás".split()
REPORTS = "said says told wrote called claimed reported according quoted sagte schrieb déclaré écrit dijo escribió".split()

#: Symbols: insults by grade, threat, target, negation, report, other.
GRADES = "123"
NEGATED = dict(zip("123h", "456k", strict=True))
REPORTED = dict(zip("123456hk", "789789pp", strict=True))
DIRECTED = dict(zip("123", "abc", strict=True))
EVENTS = "123456789abchkpH"
GRADE_WEIGHT = {"1": 1.0, "2": 2.0, "3": 4.0}
_ALPHABET = "123htnro456k789pabcH"
_EDGES = re.compile(r"^\W+|\W+$")
_CLAUSE_ENDS = frozenset(".,;:!?|")
_PREFIXES = range(3, 9)
#: The evidence besides the events: added weights, matched clauses, two and three weak insults, densities.
_MORE = 6
_WEAK, _STRONG = "147a", "235689bcH"


@dataclass
class Transducer:
    """A letter transducer: at each state, a symbol read gives a symbol written, a weight and the next state.

    Symbols without an arc are copied at no weight and lead to the state's default.
    """

    arcs: dict[tuple[int, str], tuple[str, float, int]] = field(default_factory=dict)
    default: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[str, float, int]:
        return self.arcs.get((state, symbol)) or (symbol, 0.0, self.default.get(state, state))

    def compose(self, other: Transducer) -> Transducer:
        """The transducer that hands what this one writes to the other."""
        number, todo, made = {(0, 0): 0}, [(0, 0)], Transducer()
        for pair in todo:
            made.default[number[pair]] = 0
            for symbol in _ALPHABET:
                between, first, left = self.step(pair[0], symbol)
                written, second, right = other.step(pair[1], between)
                if (left, right) not in number:
                    number[left, right] = len(number)
                    todo.append((left, right))
                made.arcs[number[pair], symbol] = (written, first + second, number[left, right])
        return made

    def run(self, clause: str) -> tuple[str, float]:
        state, out, total = 0, [], 0.0
        for symbol in clause:
            written, weight, state = self.step(state, symbol)
            out.append(written)
            total += weight
        return "".join(out), total


def _countdown(trigger: str, reach: int, rewrite: dict[str, str]) -> Transducer:
    """After the trigger, the next `reach` symbols are rewritten; states count down."""
    t = Transducer(default={s: max(s - 1, 0) for s in range(reach + 1)})
    for state in range(reach + 1):
        t.arcs[state, trigger] = (trigger, 0.0, reach)
        if state:
            t.arcs.update({(state, a): (b, 0.0, state - 1) for a, b in rewrite.items()})
    return t


def grammar(reach: int = 4) -> Transducer:
    """The five transducers, composed."""
    negation = _countdown("n", 3, NEGATED)
    report = Transducer({(0, "r"): ("r", 0.0, 1)})
    report.arcs.update({(1, a): (b, 0.0, 1) for a, b in REPORTED.items()})
    threat = Transducer(default={s: max(s - 1, 0) for s in range(reach + 1)})
    for state in range(reach + 1):
        threat.arcs[state, "h"] = ("h", 1.0, reach)
        if state:
            threat.arcs[state, "t"] = ("H", 2.0, 0)
    target = _countdown("t", reach, DIRECTED)
    insult = Transducer()
    for i, grade in enumerate(GRADES):
        for symbol, share in ((grade, 1.0), ("456"[i], 0.25), ("789"[i], 0.25), ("abc"[i], 1.5)):
            insult.arcs[0, symbol] = (symbol, GRADE_WEIGHT[grade] * share, 0)
    return negation.compose(report).compose(threat).compose(target).compose(insult)


def bare(token: str) -> str:
    return _EDGES.sub("", token.lower())


@dataclass
class ToxicityModel:
    """insults: grade by word ("=word") or word beginning; weights of the evidence, the last one the intercept.

    trained_on: how many distinct clean and toxic texts both were learned from.
    """

    insults: dict[str, str]
    weights: np.ndarray
    trained_on: tuple[int, int] = (0, 0)

    def key(self) -> str:
        return hashlib.sha256(repr(sorted(self.insults.items())).encode() + self.weights.tobytes()).hexdigest()


class Reader(dict):
    """Symbols by token (";" follows where a clause ends), worked out once for each distinct token."""

    def __init__(self, insults: dict[str, str], remembered: int = 80 << 20):
        self.insults, self.remembered, self.held, self.machine = insults, remembered, 0, grammar()
        self.fixed = {w: s for words, s in ((REPORTS, "r"), (NEGATIONS, "n"), (TARGETS, "t"), (THREATS, "h")) for w in words}

    def __missing__(self, token: str) -> str:
        word = bare(token)
        found = self.insults.get(f"={word}") or max((self.insults.get(word[:k], "") for k in _PREFIXES if len(word) >= k), default="")
        symbol = found or self.fixed.get(word, "o")
        self.held += len(token) + ENTRY_BYTES
        self[token] = symbol = symbol + ";" if token[-1] in _CLAUSE_ENDS else symbol
        return symbol

    def evidence(self, text: str | None, part_chars: int = 1 << 20) -> np.ndarray:
        """Logarithms of each event's count, the added weights and the matched clauses; repeats and densities."""
        events, added, clauses, words, still_open = Counter(), 0.0, 0, 0, ""
        for part in itertools.chain(cuts(text or "", part_chars), (None,)):
            if self.held > self.remembered:
                self.clear()
                self.held = 0
            tokens = [] if part is None else part.split()
            words += len(tokens)
            symbols = ";" if part is None else "".join(map(self.__getitem__, tokens))
            whole, end, rest = symbols.rpartition(";")
            if not end:
                still_open += rest
                continue
            whole, still_open = still_open + whole, rest
            if any(s in whole for s in "123h"):
                for clause in whole.split(";"):
                    if any(s in clause for s in "123h"):
                        written, weight = self.machine.run(clause)
                        events.update(c for c in written if c in EVENTS)
                        added += weight
                        clauses += 1
        weak, strong = (sum(events[e] for e in kind) for kind in (_WEAK, _STRONG))
        counts = np.log1p(np.array([*(events[e] for e in EVENTS), added, clauses], dtype=float))
        dense = np.log1p(np.array([weak, strong]) * 1000 / max(words, 1))
        return np.concatenate([counts, [weak >= 2, weak >= 3], dense])


def default_weights() -> np.ndarray:
    return np.array([*[0.0] * len(EVENTS), 2.0, 0.5, *[0.0] * (_MORE - 2), -3.0])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, rounds: int = 60) -> np.ndarray:
    """Weights, the intercept last, by Newton's method; the default weights are the prior's mean."""
    prior = default_weights()
    x1, w = np.hstack([x, np.ones((len(x), 1))]), prior.copy()
    lam = penalty * len(x) / 10 + 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (p - y) + lam * (w - prior)
        curve = (x1 * (p * (1 - p))[:, None]).T @ x1 + lam * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def word_features(text: str | None) -> set[str]:
    """The distinct words ("=word"), word beginnings and beginnings that occur again ("beginning+") of a text."""
    words = Counter()
    for token, n in Counter((text or "").split()).items():
        words[bare(token)] += n
    starts = Counter()
    for word, n in words.items():
        for k in range(_PREFIXES.start, min(len(word) + 1, _PREFIXES.stop)):
            starts[word[:k]] += n
    again = {f"{w}+" for w, n in starts.items() if n > 1 and len(w) > _PREFIXES.start}
    return {f"={w}" for w in words if w} | again | starts.keys()


def _significance(toxic: Column, clean: Column, share: float) -> Column:
    """Minus the log of a bound on the chance of as many toxic documents (Chernoff)."""
    n, q = toxic + clean, toxic / (toxic + clean)
    rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - share))).otherwise(0.0)
    return F.when(q > share, n * (q * F.log(q / share) + rest)).otherwise(0.0)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 4000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """Learn the lexicon and the weights from labelled rows outside the held-out fold."""
    ready(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, per_class, id_col, text_col).select("label", "text")
    return _fit(materialize(sample))  # at most 2 * per_class texts; each is read again several times


def _fit(sample: DataFrame) -> ToxicityModel:
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = totals.get(0, 0), totals.get(1, 0)
    insults = {f"={w}": "2" for w in INSULTS}
    if not (n_clean and n_toxic):
        return ToxicityModel(insults, default_weights(), (n_clean, n_toxic))

    def count(batches):
        found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in slices(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for feature in word_features(text):
                    found[feature][label] += 1
                if len(found) > 200_000:
                    yield _counts(found)
                    found.clear()
        yield _counts(found)

    counted = sample.mapInArrow(count, "feature string, clean long, toxic long")
    counted = counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rare = F.col("clean") * n_toxic <= F.lit(0.03) * F.col("toxic") * n_clean
    strength = _significance(F.col("toxic"), F.col("clean"), n_toxic / (n_toxic + n_clean))
    candidates = materialize(counted.filter((F.col("toxic") >= 3) & rare).withColumn("strength", strength))
    # What is too telling to be chance, and the fixed words: this is the lexicon itself.
    telling = F.col("strength") > log(1e10)
    strong = candidates.filter(telling | F.col("feature").isin(*insults)).withColumn("telling", telling).collect()
    chosen = {r["feature"] for r in strong if r["telling"]}
    counts = {r["feature"]: (r["toxic"], r["clean"]) for r in strong}
    explained = frozenset(counts)

    def unexplained(batches):
        for batch in slices(batches):
            own = [(t, word_features(t)) for t in batch.column(0).to_pylist()]
            own = [(hashlib.md5((t or "").encode()).hexdigest(), sorted(features)) for t, features in own if explained.isdisjoint(features)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in own], pa.string()), pa.array([x for _, x in own], pa.list_(pa.string()))], names=["doc", "features"])

    # What three or more of the toxic documents that these leave unexplained have in common.
    left_open = sample.filter("label = 1").select("text").mapInArrow(unexplained, "doc string, features array<string>")
    pairs = left_open.select("doc", F.explode("features").alias("feature")).join(candidates.select("feature", "toxic", "clean"), "feature")
    pairs = materialize(pairs)
    often = pairs.groupBy("feature").agg(F.count("*").alias("n")).filter("n >= 3").select("feature")
    left: dict[str, set[str]] = defaultdict(set)
    for r in pairs.join(often, "feature", "left_semi").collect():
        left[r["feature"]].add(r["doc"])
        counts[r["feature"]] = (r["toxic"], r["clean"])
    while left:
        feature = max(left, key=lambda f: (len(left[f]), -counts[f][1], len(f), f))
        if len(left[feature]) < 3:
            break
        chosen.add(feature)
        met = left.pop(feature)
        left = {f: rest for f, docs in left.items() if (rest := docs - met)}
    chosen -= {p for f in chosen for p in _beginnings(f) if p in chosen and counts[f][0] >= 0.95 * counts[p][0]}
    for feature, (toxic, clean) in counts.items():
        odds = log((toxic + 0.5) / (n_toxic + 1)) - log((clean + 0.5) / (n_clean + 1))
        if feature in chosen or feature in insults:
            word, again = feature.rstrip("+"), feature.endswith("+")
            grade = "1" if again else "3" if odds > 4 else "2"
            insults[word] = max(grade, insults.get(word, ""))
    reader_model = ToxicityModel(insults, default_weights())

    def evidence(batches):
        reader = Reader(reader_model.insults)
        for batch in slices(batches):
            rows = [reader.evidence(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])

    rows = sample.mapInArrow(evidence, "label int, x array<double>").collect()  # at most 2 * per_class short rows
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)
    order = np.lexsort((*x.T, y))
    return ToxicityModel(insults, logistic(x[order], y[order]), (n_clean, n_toxic))


def _beginnings(feature: str) -> list[str]:
    """The shorter beginnings, of the same kind, that are there wherever this word or beginning is."""
    again, word = "+" * feature.endswith("+"), feature.strip("=+")
    longest = len(word) + feature.startswith("=")
    return [word[:k] + again for k in range(_PREFIXES.start, min(longest, _PREFIXES.stop))]


def _counts(found: dict[str, list[int]]) -> pa.RecordBatch:
    values = np.array(list(found.values()), dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.string()), pa.array(values[:, 0].copy()), pa.array(values[:, 1].copy())],
        names=["feature", "clean", "toxic"],
    )


_READERS: dict[str, Reader] = {}


def _reader(model: ToxicityModel) -> Reader:
    if (key := model.key()) not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(model.insults)
    return _READERS[key]


def score(
    docs: DataFrame, model: ToxicityModel, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Return (id, held_out, score, predicted, matched_clauses) for each row."""
    ready(docs.sparkSession)
    picked = docs.select(
        docs[id_col].alias("id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text")
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        settle(_READERS.clear)
        model = shared.value
        reader = _reader(model)
        for batch in slices(batches):
            x = np.array([reader.evidence(t) for t in batch.column(2).to_pylist()]).reshape(-1, len(model.weights) - 1)
            found = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
            clauses = np.rint(np.expm1(x[:, len(EVENTS) + 1])).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= least).astype(np.int32)), pa.array(clauses)],
                names=[id_col, "held_out", "score", "predicted", "matched_clauses"],
            )

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(
        run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, matched_clauses long"
    )
