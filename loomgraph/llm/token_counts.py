"""Token counts: lengths only, from batch encoding inside Arrow functions.

Batches are balanced by bytes, not rows, and long texts are split at blanks, tabs and line
ends, which no token of a tokenizer that drops white space can cross. Words that a batch
repeats are encoded once; what the worker has counted before is remembered in a
table of bounded size. A word is encoded whole, however long it is.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows give
repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.common import by_bytes, cuts, public_vocabulary, ready, settle, slices, weight

#: Separators that Python's split() takes for blanks but the tokenizers' pattern doesn't.
_ODD_SEPARATORS = re.compile("[\x1c-\x1f]")


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer, single-threaded: Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordLengths:
    """Token counts of texts by way of their distinct words."""

    def __init__(self, path: str, remembered: int = 80 << 20):
        self.tokenizer = load_tokenizer(path)
        self.remembered, self.held = remembered, 0
        self.known: dict[str, int] = {}

    def add(self, totals: list[int], group: list[tuple[int, str]]) -> None:
        """Add the token counts of (row, part of its text) items to the rows' totals."""
        if self.held > self.remembered:
            self.known.clear()
            self.held = 0
        split = []
        for row, part in group:
            if _ODD_SEPARATORS.search(part):
                split.append((row, re.split(r"[ \n]+", part)))
            else:
                split.append((row, part.split()))
        new = set().union(*(words for _, words in split)).difference(self.known)
        if new:
            fresh = list(new)
            encoded = self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)
            self.held += weight(fresh)
            self.known.update(zip(fresh, map(len, encoded), strict=True))
        length = self.known.__getitem__
        for row, words in split:
            totals[row] += sum(map(length, words))


@functools.lru_cache(maxsize=2)
def _lengths(path: str) -> WordLengths:
    return WordLengths(path)


def _forget() -> None:
    _lengths.cache_clear()
    load_tokenizer.cache_clear()


def token_counts(
    docs: DataFrame,
    path: str | None = None,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_chars: int = 1 << 18,
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """Return (id, n_bytes, n_tokens, over_limit) for each row.

    The tokenizer must drop white space (as word_bpe_49k.json does); special strings inside
    a text are handled as the library does by default.
    """
    path = path or public_vocabulary("word_bpe_49k.json")
    ready(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        settle(_forget)
        lengths = _lengths(path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            totals = [0] * len(texts)
            parts = ((i, part) for i, t in enumerate(texts) for part in cuts(t, part_chars))
            for group in by_bytes(parts, batch_bytes):
                lengths.add(totals, group)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()),
                    pa.array(totals, pa.int64()),
                    pa.array([n > limit for n in totals], pa.bool_()),
                ],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
