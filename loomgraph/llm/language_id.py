"""Language identification by segmentation-marginalised unigrams.

A model holds, for each language, a probability for every piece of a fixed public
vocabulary. A word's probability in a language is the sum over all its segmentations
into pieces of the product of their probabilities; the forward algorithm gives it
without listing them. Probabilities come from expectation maximisation: expected piece
counts over all segmentations of the training words.

Texts are scored whole: lower-cased, cut into runs of letters, each marked as a word
start, however long. The forward algorithm runs over distinct words of one length at once,
with the vocabulary looked up by rolling hashes; it keeps as many prefixes as a piece is
long and scales them up now and then, so no word is too long for it. Words a worker has
scored are remembered in a table of bounded size.

Defined results: a null text, or one without letters, is `und` with score 0; ties go to
the language that sorts first; with no training rows every text is `und`; repeated rows
give repeated results. Learning uses all words of at most `per_language` distinct texts of
each language, those that hash smallest. More than `most_languages` different values of the
language column are an error: a model has a column for each.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_sample, by_bytes, cuts, held_out, public_vocabulary, ready, settle, slices, weight

UNDETERMINED = "und"
MARK = "▁"
LONGEST_PIECE = 16
#: Letters of a word that are looked up at once, and letters of words that are scored side by side.
AT_ONCE, SIDE_BY_SIDE = 4096, 1 << 17
_LETTERS = re.compile(r"[^\W\d_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_SLOT_BITS = 19


def _hashes(codes: np.ndarray, longest: int = LONGEST_PIECE):
    """For l = 1, 2, ...: hashes of all substrings of length l of equally long words (rows of codes)."""
    codes = codes.astype(np.uint64) + np.uint64(1)
    h = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for size in range(1, min(longest, codes.shape[1]) + 1):
        h = h[:, :-1] * _BASE + codes[:, size - 1 :] * _MULTIPLIER
        yield h ^ (h >> np.uint64(29))


def _codes(words: list[str]) -> np.ndarray:
    return np.array(words, dtype=f"U{len(words[0])}").view(np.uint32).reshape(len(words), -1)


class Vocabulary:
    """Ids of pieces by the hash of their characters, for whole arrays of substrings."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        by_length = defaultdict(list)
        for i, piece in enumerate(pieces):
            by_length[len(piece)].append((piece, i))
        slots = 1 << _SLOT_BITS
        self.keys = np.zeros(slots + 64, np.uint64)
        self.ids = np.full(slots + 64, self.size, np.int32)
        self.probes = 1
        for length, group in by_length.items():
            *_, whole = _hashes(_codes([p for p, _ in group]), length)
            first = whole[:, 0] * _MULTIPLIER >> np.uint64(64 - _SLOT_BITS)
            for key, slot, (_, i) in zip(whole[:, 0], first.tolist(), group, strict=True):
                probe = 0
                while self.ids[slot + probe] != self.size and self.keys[slot + probe] != key:
                    probe += 1
                self.keys[slot + probe], self.ids[slot + probe] = key, i
                self.probes = max(self.probes, probe + 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, `size` where there is none."""
        slot = (hashes * _MULTIPLIER >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        found = np.where(self.keys[slot] == hashes, self.ids[slot], np.int32(self.size))
        for probe in range(1, self.probes):
            miss = np.nonzero(found == self.size)
            at = slot[miss] + probe
            found[miss] = np.where(self.keys[at] == hashes[miss], self.ids[at], np.int32(self.size))
        return found

    def lattice(self, codes: np.ndarray) -> list[np.ndarray]:
        """For equally long words: ids[l - 1][w, i], the piece that is l characters of word w from i on."""
        return [self.find(h) for h in _hashes(codes)]


@functools.lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    """The pieces of a sentencepiece file that can stand for text, lower-cased ones only."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    usable = {p for i, p in enumerate(pieces) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return Vocabulary(sorted(p for p in usable if p == p.lower() and len(p) <= LONGEST_PIECE))


def _forward(vocabulary: Vocabulary, codes: np.ndarray, prob: np.ndarray, floor: float, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For j = 0, 1, ...: (alpha, scale), both (words, languages).

    alpha * exp(scale) is the probability of the first j characters of each of the equally long words,
    over all segmentations.
    """
    words, length = codes.shape
    alpha, scale = np.ones((words, prob.shape[1])), np.zeros((words, prob.shape[1]))
    yield alpha, scale
    before = deque([alpha], maxlen=LONGEST_PIECE)
    for at in range(0, length, at_once):
        low = max(0, at - LONGEST_PIECE + 1)
        lattice = vocabulary.lattice(codes[:, low : at + at_once])
        some = [(ids < vocabulary.size).any(axis=0) for ids in lattice]
        for j in range(at + 1, min(at + at_once, length) + 1):
            # A character that is no piece costs the same in every language.
            alpha = before[-1] * np.maximum(prob[lattice[0][:, j - 1 - low]], floor)
            for size in range(2, min(len(before), len(lattice)) + 1):
                if some[size - 1][j - size - low]:
                    piece = lattice[size - 1][:, j - size - low]
                    there = np.flatnonzero(piece < vocabulary.size)
                    alpha[there] += before[-size][there] * prob[piece[there]]
            before.append(alpha)
            yield alpha, scale
            if j % LONGEST_PIECE == 0:
                scale = scale + np.log(alpha)
                before = deque((a / alpha for a in before), maxlen=LONGEST_PIECE)


def _side_by_side(words: list[str]) -> Iterator[list[str]]:
    """Parts of equally long words, so that a part's letters are not too many."""
    step = max(1, SIDE_BY_SIDE // len(words[0]))
    for at in range(0, len(words), step):
        yield words[at : at + step]


def by_length(words) -> dict[int, list[str]]:
    groups = defaultdict(list)
    for word in words:
        groups[len(word)].append(word)
    return groups


def words_of(token: str) -> list[str]:
    """The marked lower-case words of a token: its runs of letters."""
    runs = _LETTERS.findall(token.lower())
    return [MARK + (run if run.isalpha() else "".join(c for c in run if c.isalpha())) for run in runs if any(map(str.isalpha, run))]


@dataclass
class LanguageModel:
    """languages: sorted; prob: a row for each piece and a last one of zeros, a column for each language."""

    path: str
    languages: list[str]
    prior: np.ndarray
    prob: np.ndarray
    floor: float = 1e-7

    def word_scores(self, words: list[str]) -> dict[str, np.ndarray]:
        """Log-probability of marked words in each language."""
        vocabulary, scores = load_vocabulary(self.path), {}
        for group in by_length(words).values():
            for part in _side_by_side(group):
                ((alpha, scale),) = deque(_forward(vocabulary, _codes(part), self.prob, self.floor), maxlen=1)
                scores.update(zip(part, np.log(alpha) + scale, strict=True))
        return scores


def train(path: str, counts: dict[str, Counter[str]], prior: dict[str, float], rounds: int = 4) -> LanguageModel:
    """Fit piece probabilities from word counts of each language by expectation maximisation."""
    vocabulary, languages = load_vocabulary(path), sorted(counts)
    prob = np.full((vocabulary.size + 1, len(languages)), 1 / vocabulary.size)
    prob[-1] = 0
    model = LanguageModel(path, languages, np.log([prior[x] for x in languages]), prob)
    for _ in range(rounds if languages else 0):
        expected = np.zeros_like(prob)
        for k, language in enumerate(languages):
            for group in by_length(counts[language]).values():
                for part in _side_by_side(group):
                    times = np.array([counts[language][w] for w in part], dtype=float)
                    _expect(vocabulary, _codes(part), model.prob[:, k : k + 1], model.floor, times, expected[:, k])
        expected[-1] = 0
        smooth = expected + 0.1
        smooth[-1] = 0
        model.prob = smooth / smooth.sum(axis=0)
    return model


def _expect(vocabulary: Vocabulary, codes: np.ndarray, prob: np.ndarray, floor: float, times: np.ndarray, into: np.ndarray) -> None:
    """Add the expected uses of each piece over all segmentations of words that occur so many times."""
    length = codes.shape[1]
    forward = [(alpha[:, 0], scale[:, 0]) for alpha, scale in _forward(vocabulary, codes, prob, floor, length)]
    lattice = vocabulary.lattice(codes)
    whole, whole_scale = forward[length]
    share, scale = times / whole, np.zeros_like(whole)
    after = deque([np.ones_like(whole)], maxlen=LONGEST_PIECE)  # beta of the positions behind this one, the nearest first
    for i in range(length - 1, -1, -1):
        alpha, own_scale = forward[i]
        reach = alpha * share * np.exp(own_scale + scale - whole_scale)
        beta = np.zeros_like(whole)
        for size in range(1, min(len(after), len(lattice)) + 1):
            piece = lattice[size - 1][:, i]
            p = prob[piece, 0]
            if size == 1:
                p = np.maximum(p, floor)
            flow = p * after[size - 1]
            beta += flow
            np.add.at(into, piece, reach * flow)
        after.appendleft(beta)
        if i % LONGEST_PIECE == 0:
            scale = scale + np.log(beta)
            after = deque((b / beta for b in after), maxlen=LONGEST_PIECE)


def fit(
    docs: DataFrame,
    path: str | None = None,
    per_language: int = 300,
    most_languages: int = 500,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """Learn from the text and language of rows outside the held-out fold."""
    path = path or public_vocabulary("piece_bpe_32k.model")
    ready(docs.sparkSession)
    rows = docs.select(
        docs[id_col].alias("id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")
    ).filter(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    rows = rows.select("lang", "text")
    prior = {r["lang"]: float(r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(prior) > most_languages:
        raise ValueError(f"{lang_col} has more than {most_languages} values")
    sample = bounded_sample(rows, per_language, ["text"], "lang", most_languages)

    def count(batches):
        tokens: dict[str, Counter] = defaultdict(Counter)
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in cuts(text or "", 1 << 20):
                    tokens[lang].update(part.split())
        rows = Counter()
        for lang, found in tokens.items():
            for token, n in found.items():
                for word in words_of(token):
                    rows[lang, word] += n
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in rows], pa.string()),
                pa.array([k[1] for k in rows], pa.string()),
                pa.array(list(rows.values()), pa.int64()),
            ],
            names=["lang", "word", "n"],
        )

    found = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    found = found.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter[str]] = defaultdict(Counter)
    for language, word, n in sorted(zip(*found.toArrow().to_pydict().values(), strict=True)):  # the sample's words
        counts[language][word] = n
    total = sum(prior.values())
    return train(path, counts, {k: v / total for k, v in prior.items()})


class Scorer:
    """Scores texts with a model; tokens seen before are remembered up to a bound in bytes."""

    def __init__(self, model: LanguageModel, remembered: int = 64 << 20):
        self.model, self.remembered = model, remembered
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.held = 0
        self.scores = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, bool)

    def _learn(self, tokens: list[str]) -> None:
        self.held += weight(tokens) + 8 * len(tokens) * len(self.model.languages)
        words = [words_of(t) for t in tokens]
        scores = self.model.word_scores(list({w for ws in words for w in ws}))
        new = np.zeros((len(tokens), len(self.model.languages)))
        for i, ws in enumerate(words):
            for w in ws:
                new[i] += scores[w]
        self.at.update(zip(tokens, range(len(self.scores), len(self.scores) + len(tokens)), strict=True))
        self.scores = np.concatenate([self.scores, new])
        self.letters = np.concatenate([self.letters, [bool(ws) for ws in words]])

    def add(self, totals: np.ndarray, lettered: np.ndarray, group: list[tuple[int, str]]) -> None:
        """Add the scores of (row, part of its text) items to the rows' totals."""
        if self.held > self.remembered:
            self.clear()
        split = [(row, part.split()) for row, part in group]
        new = list(set().union(*(tokens for _, tokens in split)).difference(self.at))
        if new:
            self._learn(new)
        rows = np.repeat([row for row, _ in split], [len(tokens) for _, tokens in split]).astype(np.int64)
        at = np.fromiter((self.at[t] for _, tokens in split for t in tokens), np.int64, len(rows))
        for k in range(totals.shape[1]):
            totals[:, k] += np.bincount(rows, self.scores[at, k], len(totals))
        lettered |= np.bincount(rows, self.letters[at], len(lettered)) > 0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        languages = self.model.languages
        totals, lettered = np.zeros((len(texts), len(languages))), np.zeros(len(texts), bool)
        if languages:
            parts = ((i, part) for i, t in enumerate(texts) for part in cuts(t or "", 1 << 18))
            for group in by_bytes(parts, 1 << 20):
                self.add(totals, lettered, group)
        if not languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        totals += self.model.prior
        odds = np.exp(totals - totals.max(axis=1, keepdims=True))
        best = totals.argmax(axis=1)
        names = [languages[b] if x else UNDETERMINED for b, x in zip(best, lettered, strict=True)]
        return names, np.where(lettered, 1 / odds.sum(axis=1), 0.0)


_SCORERS: dict[str, Scorer] = {}


def _scorer(key: str, model: LanguageModel) -> Scorer:
    """A worker's scorer for this model; an older model's is let go."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def _key(model: LanguageModel) -> str:
    import hashlib

    return hashlib.sha256(model.prob.tobytes() + model.prior.tobytes() + repr(model.languages).encode()).hexdigest()


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, held_out, lang_pred, score) for each row; the score is the language's posterior probability."""
    ready(docs.sparkSession)
    key, shared = _key(model), docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(
        docs[id_col].alias("id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text")
    )

    def run(batches):
        settle(_SCORERS.clear)
        scorer = _scorer(key, shared.value)
        for batch in slices(batches):
            names, score = scorer.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)],
                names=[id_col, "held_out", "lang_pred", "score"],
            )

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is determined with at least this probability."""
    ready(docs.sparkSession)
    key, shared, at = _key(model), docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        settle(_SCORERS.clear)
        scorer = _scorer(key, shared.value)
        for batch in slices(batches):
            names, score = scorer.predict(batch.column(at).to_pylist())
            keep = [n != UNDETERMINED and s >= least for n, s in zip(names, score, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
