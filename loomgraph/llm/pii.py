"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions.

Base spans are what the fixed patterns and their checks accept. The model adds spans of
the same kinds that the patterns miss; base spans always stay.

All kinds hold a digit or an at sign, so only characters near one can be in a span: the
text around them is cut into overlapping windows, every window is decoded, and the
windows' spans are reconciled over the whole text. Where two windows overlap, a span
counts if the window that holds it farther from its edges has it. A model's span must also pass its
kind's check, be sure enough and touch no base span and no letter or digit. A span that can
pass has at most LONGEST characters, and at most CONTEXT between its digits; every such span
of a text lies whole in a window, with CONTEXT characters on both sides, so nothing that could
be found lies outside of what is decoded.

The network is trained in numpy from labelled spans: windows of a bounded sample of the
corpus, labelled by the base patterns, and windows made by a fixed rule with the same
kinds in more notations, and with numbers that are no personal data. Training uses a
fixed seed and order, so equal input gives an equal model.

Defined results: null text is an empty text, without spans; offsets are in code points,
ends exclusive; repeated rows give repeated results; very long texts are read in windows,
so memory grows with the number of spans only.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_sample, nothing, ready, settle, slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
#: A match can only start where a run of digits starts: a match before it has taken whole runs.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
LONGEST_LOCAL_STEP = 256


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def passes(kind: int, text: str) -> bool:
    """The check of a kind on matched text."""
    if kind == 0:
        return True
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    digits = _NOT_DIGIT.sub("", text)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind, then start."""
    found: list[Span] = []
    before, at = 0, text.find("@")
    while at >= 0:
        # The match starts at the run of characters before the sign, but not in a match before it.
        start, step = at, LONGEST_LOCAL_STEP
        while True:
            low = max(before, at - step)
            start = _LOCAL_END.search(text[low:at]).start() + low if low < at else at
            if start > low or low == before:
                break
            step *= 4
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            found.append((0, start, domain.end()))
            before = domain.end()
        at = text.find("@", max(at + 1, before))
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if passes(kind, m.group())]
    return found


# ---- windows

#: An address has at most 254 characters: windows overlap by that many, with context on both sides.
LONGEST, CONTEXT, WINDOW = 254, 12, 640
STRIDE = WINDOW - LONGEST - 2 * CONTEXT
#: Examples for training are shorter.
SAMPLE_WINDOW, SAMPLE_STRIDE = 64, 40
_BLANK, _RUN_BEFORE = re.compile(r"\s"), re.compile(r"\S*\Z")
_ANCHORS = re.compile("[0-9@]+")


def windows(text: str, width: int = WINDOW, stride: int = STRIDE) -> Iterator[tuple[int, int]]:
    """(start, end) of the windows that cover the surroundings of all digits and at signs.

    Those of an at sign reach over the whole run without blanks, as far as an address can.
    """
    low = high = None
    for m in _ANCHORS.finditer(text):
        start, end = m.span()
        first, last = text.find("@", start, end), text.rfind("@", start, end)
        if first >= 0:
            left, right = max(0, first - LONGEST), min(len(text), last + 1 + LONGEST)
            start = min(start, left + _RUN_BEFORE.search(text[left:first]).start())
            blank = _BLANK.search(text, last, right)
            end = max(end, blank.start() if blank else right)
        a, b = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
        if high is not None and a <= high:
            low, high = min(low, a), max(high, b)
            continue
        if high is not None:
            yield from _cut(low, high, width, stride)
        low, high = a, b
    if high is not None:
        yield from _cut(low, high, width, stride)


def _cut(low: int, high: int, width: int, stride: int) -> Iterator[tuple[int, int]]:
    while high - low > width:
        yield low, low + width
        low += stride
    yield low, high


# ---- the network

#: Letters and digits count by class, punctuation of ASCII by itself.
_PLAIN = {c: i for i, c in enumerate("\x20\n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", start=6)}
N_SYMBOLS = 6 + len(_PLAIN)
_CODES = np.full(0x250, 5, np.int8)
for _c in range(0x250):
    _s = chr(_c)
    if _s in _PLAIN:
        _CODES[_c] = _PLAIN[_s]
    elif "0" <= _s <= "9":
        _CODES[_c] = 1
    elif _s.isascii() and _s.isalpha():
        _CODES[_c] = 2 if _s.islower() else 3
    elif _s.isalpha():
        _CODES[_c] = 4
TAGS = 1 + 2 * len(KINDS)  # outside; then begin and inside of each kind


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths) of windows; codes are padded with 0."""
    lengths = np.array([len(t) for t in texts])
    codes = np.zeros((len(texts), max(lengths, default=0)), np.int8)
    for row, text in zip(codes, texts, strict=True):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        row[: len(points)] = np.where(points < 0x250, _CODES[np.minimum(points, 0x24F)], 5)
    return codes, lengths


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Tagger:
    """Two LSTMs over characters, a linear layer on both and CRF transitions; parameters by name."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(hidden: int = 20, seed: int = 7) -> Tagger:
        r = np.random.default_rng(seed)
        p = {}
        for side in "fb":
            p[f"x{side}"] = r.normal(0, 0.3, (N_SYMBOLS, 4 * hidden)).astype(np.float32)
            p[f"x{side}"][:, hidden : 2 * hidden] += 1  # the forget gates start open
            p[f"h{side}"] = r.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype(np.float32)
        p["out"] = r.normal(0, 0.2, (2 * hidden, TAGS)).astype(np.float32)
        p["bias"] = np.zeros(TAGS, np.float32)
        p["trans"] = np.zeros((TAGS, TAGS), np.float32)
        p["start"] = np.zeros(TAGS, np.float32)
        return Tagger(p)

    def _lstm(self, side: str, codes: np.ndarray, mask: np.ndarray, keep: bool):
        """Hidden states (time, rows, hidden) in the order of the text, and what backward() needs."""
        rows, steps = codes.shape
        wx, wh = self.p[f"x{side}"], self.p[f"h{side}"]
        n = wh.shape[0]
        h = c = np.zeros((rows, n), np.float32)
        states, memory = np.zeros((steps, rows, n), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            gates = wx[codes[:, t]] + h @ wh
            gates[:, : 3 * n] = _sigmoid(gates[:, : 3 * n])
            gates[:, 3 * n :] = np.tanh(gates[:, 3 * n :])
            i, f, o, g = (gates[:, k * n : (k + 1) * n] for k in range(4))
            new_c = f * c + i * g
            squashed = np.tanh(new_c)
            m = mask[:, t, None]
            if keep:
                memory.append((t, h, c, gates, squashed))
            c = np.where(m, new_c, c)
            h = np.where(m, o * squashed, h)
            states[t] = h
        return states, memory

    def emissions(self, codes: np.ndarray, mask: np.ndarray, keep: bool = False):
        forward, fm = self._lstm("f", codes, mask, keep)
        backward, bm = self._lstm("b", codes, mask, keep)
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.p["out"] + self.p["bias"], (both, fm, bm)

    def _lstm_gradient(self, side: str, codes, mask, memory, d_states, grads) -> None:
        wh = self.p[f"h{side}"]
        n = wh.shape[0]
        dh = np.zeros_like(memory[0][1])
        dc = np.zeros_like(dh)
        for t, h, c, gates, squashed in reversed(memory):
            m = mask[:, t, None]
            i, f, o, g = (gates[:, k * n : (k + 1) * n] for k in range(4))
            total = d_states[t] + dh
            on = np.where(m, total, 0)
            d_new = np.where(m, dc, 0) + on * o * (1 - squashed**2)
            d = np.concatenate(
                [d_new * g * i * (1 - i), d_new * c * f * (1 - f), on * squashed * o * (1 - o), d_new * i * (1 - g**2)], axis=1
            )
            np.add.at(grads[f"x{side}"], codes[:, t], d)
            grads[f"h{side}"] += h.T @ d
            dh = d @ wh.T + np.where(m, 0, total)
            dc = d_new * f + np.where(m, 0, dc)

    def loss_gradient(self, codes: np.ndarray, lengths: np.ndarray, tags: np.ndarray):
        """Mean negative log-likelihood of tag sequences, and its gradient."""
        rows, steps = codes.shape
        mask = np.arange(steps) < lengths[:, None]
        e, (both, fm, bm) = self.emissions(codes, mask, keep=True)
        e = e.astype(np.float64)
        trans, start = self.p["trans"].astype(np.float64), self.p["start"].astype(np.float64)
        alpha, beta, log_z = self._sums(e, mask)
        marginal = np.exp(alpha + beta - log_z[None, :, None]) * mask.T[:, :, None]
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        row = np.arange(rows)
        gold = start[tags[:, 0]] + e[0, row, tags[:, 0]]
        d_e, d_trans, d_start = marginal.copy(), np.zeros_like(trans), marginal[0].sum(0)
        d_e[0, row, tags[:, 0]] -= 1
        np.add.at(d_start, tags[:, 0], -1)
        for t in range(1, steps):
            on = mask[:, t]
            both_tags = alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - log_z[:, None, None]
            d_trans += np.exp(both_tags[on]).sum(0)
            a, b = tags[on, t - 1], tags[on, t]
            np.add.at(d_trans, (a, b), -1)
            d_e[t, row[on], b] -= 1
            gold[on] += trans[a, b] + e[t, row[on], b]
        d_e = (d_e / rows).astype(np.float32)
        grads["trans"] += (d_trans / rows).astype(np.float32)
        grads["start"] += (d_start / rows).astype(np.float32)
        grads["bias"] += d_e.sum((0, 1))
        grads["out"] += np.einsum("trh,trk->hk", both, d_e)
        d_both = d_e @ self.p["out"].T
        n = self.p["hf"].shape[0]
        self._lstm_gradient("f", codes, mask, fm, d_both[:, :, :n], grads)
        self._lstm_gradient("b", codes, mask, bm, d_both[:, :, n:], grads)
        return float((log_z - gold).mean()), grads

    def _sums(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log-sums over all tag sequences, and their total for each row."""
        steps, rows, _ = e.shape
        trans, start = self.p["trans"].astype(np.float64), self.p["start"].astype(np.float64)
        alpha, beta = np.zeros((steps, rows, TAGS)), np.zeros((steps, rows, TAGS))
        alpha[0] = start + e[0]
        for t in range(1, steps):
            step = _log_sum(alpha[t - 1][:, :, None] + trans, 1) + e[t]
            alpha[t] = np.where(mask[:, t, None], step, alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            step = _log_sum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[:, t + 1, None], step, beta[t + 1])
        return alpha, beta, _log_sum(alpha[-1], 1)

    def _posterior(self, e: np.ndarray, mask: np.ndarray) -> np.ndarray:
        alpha, beta, log_z = self._sums(e, mask)
        return np.exp(alpha + beta - log_z[None, :, None])

    def decode(self, texts: list[str], group: int = 2048) -> list[list[tuple[int, int, int, float]]]:
        """Viterbi spans (kind, start, end, least posterior probability of their tags) of each window."""
        found: list = [[] for _ in texts]
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        for part in _alike(order, texts, group * SAMPLE_WINDOW):
            codes, lengths = symbols([texts[i] for i in part])
            if not codes.shape[1]:
                continue
            mask = np.arange(codes.shape[1]) < lengths[:, None]
            e, _ = self.emissions(codes, mask)
            tags = self._viterbi(e, mask)
            hits = np.flatnonzero((tags * mask).any(1))
            if not len(hits):
                continue
            posterior = self._posterior(e[:, hits].astype(np.float64), mask[hits])
            sure = np.take_along_axis(posterior, tags[hits].T[:, :, None], 2)[:, :, 0].T
            for r, probabilities in zip(hits, sure, strict=True):
                found[part[r]] = _spans_of(tags[r, : lengths[r]].tolist(), probabilities)
        return found

    def _viterbi(self, e: np.ndarray, mask: np.ndarray) -> np.ndarray:
        steps, rows, _ = e.shape
        trans = self.p["trans"] + _FORBIDDEN
        best = self.p["start"] + e[0] + np.where(np.arange(TAGS) % 2 == 0, np.where(np.arange(TAGS) > 0, -1e4, 0), 0)
        back = np.zeros((steps, rows, TAGS), np.int8)
        stay = np.broadcast_to(np.arange(TAGS, dtype=np.int8), (rows, TAGS))
        for t in range(1, steps):
            scores = best[:, :, None] + trans
            arg = scores.argmax(1)
            m = mask[:, t, None]
            back[t] = np.where(m, arg, stay)
            best = np.where(m, np.take_along_axis(scores, arg[:, None, :], 1)[:, 0] + e[t], best)
        tags = np.zeros((rows, steps), np.int64)
        tags[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t, np.arange(rows), tags[:, t]]
        return tags


#: An inside tag follows the begin or inside tag of its kind only.
_FORBIDDEN = np.zeros((TAGS, TAGS), np.float32)
for _k in range(len(KINDS)):
    _FORBIDDEN[:, 2 + 2 * _k] = -1e4
    _FORBIDDEN[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = 0


def _alike(order: list[int], texts: list[str], most: int) -> Iterator[list[int]]:
    """Parts of the order, which is by length, with at most so many characters when padded, or one text."""
    part: list[int] = []
    for i in order:
        if part and (len(part) + 1) * len(texts[i]) > most:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _spans_of(tags: list[int], sure: np.ndarray) -> list[tuple[int, int, int, float]]:
    spans, at = [], 0
    while at < len(tags):
        if tags[at] % 2 == 1:
            end = at + 1
            while end < len(tags) and tags[end] == tags[at] + 1:
                end += 1
            spans.append(((tags[at] - 1) // 2, at, end, float(sure[at:end].min())))
            at = end
        else:
            at += 1
    return spans


# ---- labelled spans and training


def made_examples(n: int = 1200, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Windows made by a fixed rule: each kind in several notations, and numbers that are no personal data."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeinorstlchduéñü") for _ in range(r.randint(2, 9)))
    name = lambda: r.choice((word(), word().title(), f"{word()}.{word()}", f"{word()}{digits(2)}"))

    def positive() -> tuple[int, str]:
        kind = r.randrange(4)
        if kind == 0:
            return 0, f"{name()}@{word()}.{r.choice(('com', 'org', 'net', 'example.com', word()))}"
        if kind == 1:
            return 1, ".".join(str(r.randint(0, 255)) for _ in range(4))
        if kind == 2:
            sep = r.choice(("", "", " ", "-", ".", "/"))
            return 2, sep.join(digits(4) for _ in range(4))
        a, b, c = digits(3), digits(3), digits(4)
        return 3, r.choice(
            (f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a}/{b}{c}")
        )

    def negative() -> str:
        return r.choice(
            (
                f"{r.randint(1, 9)}.{r.randint(0, 9)}", f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
                f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"',
                f"{r.randint(1900, 2040)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}",
                digits(r.randint(1, 9)), f"{digits(2)},{digits(2)}", f"@{word()}", f"{digits(5)}-{digits(3)}", digits(24),
            )
        )

    examples = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(0, 3))), []
        for _ in range(r.randint(1, 2)):
            text += r.choice((" ", "\n", ": ", "(", ' "')) if text else ""
            if r.random() < 0.6:
                kind, value = positive()
                spans.append((kind, len(text), len(text) + len(value)))
            else:
                value = negative()
            text += value + r.choice(("", "", ".", ",", ")", "!!", "***", ";"))
        text += " " + word() if r.random() < 0.8 else ""
        kept = [s for s in spans if s[2] <= SAMPLE_WINDOW]
        examples.append((text[:SAMPLE_WINDOW] if len(kept) == len(spans) else text[: min(s[1] for s in spans if s[2] > SAMPLE_WINDOW)], kept))
    return [(t, s) for t, s in examples if t]


def train(examples: list[tuple[str, list[Span]]], rounds: int = 260, batch: int = 64, rate: float = 0.012, seed: int = 5) -> Tagger:
    """Adam on minibatches drawn in a fixed order."""
    tagger, r = Tagger.new(), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    second = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    for step in range(1, rounds + 1):
        chosen = [examples[i] for i in r.integers(0, len(examples), batch)]
        codes, lengths = symbols([t for t, _ in chosen])
        tags = np.zeros(codes.shape, np.int64)
        for row, (_, spans) in zip(tags, chosen, strict=True):
            for kind, start, end in spans:
                row[start:end] = 2 + 2 * kind
                row[start] = 1 + 2 * kind
        _, grads = tagger.loss_gradient(codes, lengths, tags)
        size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        now = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 5 / max(size, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            tagger.p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return tagger


def fit(docs: DataFrame, sample_docs: int = 2000, sample_windows: int = 1200, text_col: str = "text") -> Tagger:
    """Train on windows of at most `sample_docs` distinct texts (at most `sample_windows`) and on made ones."""
    ready(docs.sparkSession)
    texts = docs.select(docs[text_col].cast("string").alias("text")).filter(F.col("text").isNotNull())
    drawn = bounded_sample(texts, sample_docs, ["text"])

    def cut(batches):
        for batch in slices(batches):
            found = []
            for text in batch.column(0).to_pylist():
                spans = shapes(text)
                for a, b in windows(text, SAMPLE_WINDOW, SAMPLE_STRIDE):
                    inside = [s for s in spans if s[1] >= a and s[2] <= b]
                    if not any(s[1] < b and s[2] > a for s in spans if s not in inside):
                        found.append((text[a:b], [x - a if i else x for s in inside for i, x in enumerate(s)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], pa.list_(pa.int32()))], names=["w", "spans"]
            )

    cut_windows = drawn.mapInArrow(cut, "w string, spans array<int>").distinct()
    sample = cut_windows.orderBy(F.xxhash64("w"), "w").limit(sample_windows).collect()
    examples = [(r["w"], [tuple(r["spans"][i : i + 3]) for i in range(0, len(r["spans"]), 3)]) for r in sample]
    return train(examples + made_examples())


def shapes(text: str) -> list[Span]:
    """Base spans, and what only failed a check of its digits: for a network both look alike."""
    found = base_spans(text)
    taken = [(s[1], s[2]) for s in found]
    for m in _CARD.finditer(text):
        if 13 <= len(_NOT_DIGIT.sub("", m.group())) <= 19 and not any(a < m.end() and b > m.start() for a, b in taken):
            found.append((2, m.start(), m.end()))
    return found


# ---- finding and hiding


_DIGITS = re.compile(rf"[+(]?[0-9](?:[\x20()./-]{{0,{CONTEXT}}}[0-9])+")


def _plausible(kind: int, text: str, span: tuple[int, int]) -> bool:
    """The check on a model's span: as for base spans, in more notations, and not part of a longer word."""
    start, end = span
    value = text[start:end]
    if end - start > LONGEST:
        return False
    if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return False
    if kind == 0:
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]*\w", value) is not None
    if kind == 1:
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", value) is not None and passes(1, value)
    if not _DIGITS.fullmatch(value):
        return False
    return passes(kind, value) and (kind == 2 or re.search(r"[^0-9]", value) is not None)


#: How sure the model must be, by kind: less where a check of the value (Luhn, ranges) speaks for it too.
LEAST = (0.5, 0.3, 0.1, 0.5)


def find_spans(texts: list[str], tagger: Tagger, least: tuple[float, ...] = LEAST) -> list[tuple[list[Span], list[Span]]]:
    """For each text, its base spans and the spans that the model adds."""
    base = [base_spans(t) for t in texts]
    cut = [(i, a, b) for i, t in enumerate(texts) for a, b in windows(t)]
    distinct: dict[str, int] = {}
    which = [distinct.setdefault(texts[i][a:b], len(distinct)) for i, a, b in cut]
    decoded = tagger.decode(list(distinct))
    proposed: list[dict[Span, tuple[int, float]]] = [{} for _ in texts]
    for (i, a, b), w in zip(cut, which, strict=True):
        for kind, start, end, sure in decoded[w]:
            span = (kind, a + start, a + end)
            # Context to the nearer edge; the text's own ends count as far away.
            room = min(start if a else WINDOW, b - a - end if b < len(texts[i]) else WINDOW)
            if span not in proposed[i] or room > proposed[i][span][0]:
                proposed[i][span] = (room, sure)
    found = []
    for text, own, more in zip(texts, base, proposed, strict=True):
        taken, added = [(s[1], s[2]) for s in own], []
        for span, (_, sure) in sorted(more.items(), key=lambda x: (-x[1][0], -x[1][1], x[0])):
            kind, start, end = span
            if sure >= least[kind] and not any(a < end and b > start for a, b in taken) and _plausible(kind, text, (start, end)):
                taken.append((start, end))
                added.append(span)
        found.append((own, added))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def personal_data(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, counts of base spans by kind, base_sha256, spans, n_added) for each row."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches):
        settle(nothing)
        for batch in slices(batches):
            found = find_spans([t or "" for t in batch.column(1).to_pylist()], shared.value)
            counts = [pa.array([sum(s[0] == k for s in own) for own, _ in found], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(joined(own).encode()).hexdigest() for own, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *counts, pa.array(digests, pa.string()),
                    pa.array([joined(own + added) for own, added in found], pa.string()),
                    pa.array([len(added) for _, added in found], pa.int64()),
                ],
                names=names,
            )

    kind = picked.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return picked.mapInArrow(run, schema)


def hide(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, longest counts."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if start < at:
            if end > at:  # the rest of a span that overlaps one already hidden
                at = end
            continue
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def hidden(docs: DataFrame, tagger: Tagger, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows, with all their columns, personal data replaced in the text; null texts stay null.

    If there is a column `chars_col`, it gets the new text's length.
    """
    ready(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(tagger), docs.columns.index(text_col)
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        settle(nothing)
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            found = find_spans([t or "" for t in texts], shared.value)
            new = [None if t is None else hide(t, own + added) for t, (own, added) in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if chars_at is not None:
                old = columns[chars_at].to_pylist()
                lengths = [n if t is None else len(t) for t, n in zip(new, old, strict=True)]
                columns[chars_at] = pa.array(lengths, batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
