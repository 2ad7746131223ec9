"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of whole texts (lengths, repetition, symbols, capitals, ...) are square-root or
logarithm transformed. Each class has its own mean and a covariance shrunk towards the
diagonal of the pooled one; the score is the posterior that follows from the difference of
the two Gaussian log-densities, computed from Mahalanobis distances with the inverted
Cholesky factors that the model keeps.

Defined results: null text is an empty text and gets a score like any other; if either
class has no labelled row, every score is 0.5; a document that has both labels counts for
both; repeated rows give repeated results. The fit uses at most `per_class` labelled
documents of each class, and equal texts of a class count once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cuts, held_out, labelled_sample, nothing, ready, settle, slices

#: Bytes of ASCII punctuation that prose is not made of; bars and exclamation marks have their own statistics.
_SYMBOLS = np.frombuffer(b"#$%&*+<=>@[\\]^_`{}~/", np.uint8)
_UPPER, _LOWER = slice(65, 91), slice(97, 123)
_DIGITS, _BEYOND_ASCII = slice(48, 58), slice(128, 256)
STATISTICS = (
    "words", "word_length", "repeats", "variety", "symbols", "bars", "shouts", "capitals", "digits", "lines", "same_lines",
)


def statistics(text: str | None, part_chars: int = 1 << 20) -> list[float]:
    """The transformed statistics of a whole text, in the order of STATISTICS."""
    counts, words, repeats, last = np.zeros(256, np.int64), 0, 0, None
    distinct: set[int] = set()
    lines = text.split("\n") if text else []
    for part in cuts(text or "", part_chars):
        counts += np.bincount(np.frombuffer(part.encode(), np.uint8), minlength=256)
        tokens = part.split()
        if tokens:
            repeats += sum(map(str.__eq__, tokens, tokens[1:])) + (tokens[0] == last)
            last = tokens[-1]
            words += len(tokens)
            distinct.update(map(hash, tokens))
    n, size = max(words, 1), max(int(counts.sum()), 1)
    upper, lower = int(counts[_UPPER].sum()), int(counts[_LOWER].sum() + counts[_BEYOND_ASCII].sum())
    return [
        np.log1p(words),
        np.log1p(size / n),
        np.sqrt(repeats / n),
        np.log1p(len(distinct)) / np.log1p(n),
        np.sqrt(int(counts[_SYMBOLS].sum()) / size),
        np.sqrt(min(int(counts[124]) / n, 4)),
        np.sqrt(min(int(counts[33]) / n, 4)),
        np.sqrt(upper / max(upper + lower, 1)),
        np.sqrt(int(counts[_DIGITS].sum()) / size),
        np.sqrt(min(len(lines) / n, 1)),
        np.sqrt(1 - len(set(lines)) / max(len(lines), 1)) if lines else 0.0,
    ]


@dataclass
class QualityModel:
    """For each class: mean, inverted Cholesky factor of the covariance, log-density's constant."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row of statistics."""
        if len(self.means) < 2:
            return np.full(len(x), 0.5)
        density = [
            c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1)
            for m, f, c in zip(self.means, self.factors, self.constants, strict=True)
        ]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def discriminant(
    n: list[float], sums: list[np.ndarray], squares: list[np.ndarray], shrink: float = 0.1, ridge: float = 1e-4
) -> QualityModel:
    """The model for classes 0 and 1 from their counts, sums and sums of outer products."""
    if not (n[0] and n[1]):
        return QualityModel([], [], [])
    means = [s / k for s, k in zip(sums, n, strict=True)]
    covariances = [q / k - np.outer(m, m) for q, k, m in zip(squares, n, means, strict=True)]
    total = sum(sums) / sum(n)
    pooled = np.diag(sum(squares) / sum(n) - np.outer(total, total)).clip(ridge)
    model = QualityModel(means, [], [])
    for k, covariance in zip(n, covariances, strict=True):
        shrunk = (1 - shrink) * covariance + shrink * np.diag(pooled)
        factor = np.linalg.cholesky(shrunk)
        model.factors.append(np.linalg.inv(factor))
        model.constants.append(float(np.log(k / sum(n)) - np.log(np.diag(factor)).sum()))
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 10_000,
    shrink: float = 0.1,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> QualityModel:
    """Learn from labelled rows outside the held-out fold."""
    ready(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, per_class, id_col, text_col).select("label", "text")
    width = len(STATISTICS)

    def sums(batches):
        found = np.zeros((2, 1 + width + width * width))
        for batch in slices(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.array(statistics(text))
                found[label] += np.concatenate([[1], x, np.outer(x, x).ravel()])
        label, at = np.nonzero(np.ones_like(found))
        yield pa.RecordBatch.from_arrays(
            [pa.array(label.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(found.ravel())],
            names=["label", "at", "value"],
        )

    found = np.zeros((2, 1 + width + width * width))
    added = sample.mapInArrow(sums, "label int, at int, value double").groupBy("label", "at")
    for row in added.agg(F.sum("value").alias("value")).collect():  # a few hundred sums
        found[row["label"], row["at"]] = row["value"]
    n, x, xx = found[:, 0], found[:, 1 : 1 + width], found[:, 1 + width :].reshape(2, width, width)
    return discriminant(list(n), list(x), list(xx), shrink)


def score(
    docs: DataFrame, model: QualityModel, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Return (id, held_out, score, predicted) for each row."""
    ready(docs.sparkSession)
    picked = docs.select(
        docs[id_col].alias("id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text")
    )

    def run(batches):
        settle(nothing)
        for batch in slices(batches):
            found = _scores(model, batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= least).astype(np.int32))],
                names=[id_col, "held_out", "score", "predicted"],
            )

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is at least `least`."""
    ready(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        settle(nothing)
        for batch in slices(batches):
            yield batch.filter(pa.array(_scores(model, batch.column(at)) >= least))

    return docs.mapInArrow(run, docs.schema)


def _scores(model: QualityModel, texts: pa.Array) -> np.ndarray:
    return model.score(np.array([statistics(t) for t in texts.to_pylist()]).reshape(-1, len(STATISTICS)))
