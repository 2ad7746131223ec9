"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Each document is encoded and closed with an end id; only documents longer than a
sequence are cut. The packing needs no more than how many pieces there are of each
length, a table of at most `size` rows whatever the corpus holds, so the bins are
planned on the driver from that histogram and the pieces then find their places by
rank: one pass over the text, one shuffle of short rows, no group that grows.

A bin is filled greedily (the longest piece that still fits, again and again); then, if
more room is left than is worth wasting, its smallest piece is replaced by the two
unpacked pieces that fill the widened gap best (the most even two of equal sums), as
long as that leaves less room. Replacing for a few tokens would use up the short pieces
that later bins need: measured, bins with up to 1/128 of room are best left alone. The
same choice is made again as long as the same pieces remain, so a plan is a short list
of (contents, how many times).

Defined results: null text is an empty text, one piece holding only the end id;
repeated rows are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize, public_vocabulary, ready, settle, slices
from loomgraph.llm.token_counts import load_tokenizer

#: Characters on which both libraries split alike; texts with others take the reference library.
_ALIKE = re.compile("[^\x00-ɏ‐-‧€]")
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of byte-level BPE as the tokenizers library gives them.

    The same vocabulary as ranks is several times faster in tiktoken; it serves all texts
    whose characters both libraries split alike.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str, special_id: int):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = load_tokenizer(path)
        self.special_id = special_id

    def ids(self, text: str) -> np.ndarray:
        if _ALIKE.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if _SPECIAL not in text:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        found = []
        for i, part in enumerate(text.split(_SPECIAL)):
            if i:
                found.append(np.array([self.special_id], dtype="<u4"))
            found.append(self.fast.encode_to_numpy(part, disallowed_special=()).astype("<u4", copy=False))
        return np.concatenate(found)


@functools.lru_cache(maxsize=2)
def _encoder(path: str, ranks_path: str) -> Encoder:
    import public_tokenizers

    return Encoder(path, ranks_path, public_tokenizers.PATTERN, 50256)


def _forget() -> None:
    _encoder.cache_clear()
    load_tokenizer.cache_clear()


def piece_bounds(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: the first takes what doesn't fill a sequence."""
    first = n if n <= size else n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def plan_bins(counts: np.ndarray, size: int, waste: int | None = None) -> list[tuple[list[int], int]]:
    """Best-two-fit over counts[length]: (lengths in a bin, longest first; number of such bins).

    waste: the room up to which a bin is left as it is, by default 1/128 of a bin.
    """
    waste = size // 128 if waste is None else waste
    left = counts.astype(np.int64).copy()
    plan = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return plan
        used: Counter[int] = Counter()
        gap = size
        while gap:
            fitting = there[: np.searchsorted(there, gap, side="right")]
            pick = next((int(n) for n in fitting[::-1] if left[n] > used[int(n)]), 0)
            if not pick:
                break
            used[pick] += 1
            gap -= pick
        while gap > waste and (better := _two_for(min(used), gap + min(used), left, used)):
            smallest = min(used)
            used[smallest] -= 1
            used += Counter(better)  # also drops what is no longer used
            gap += smallest - sum(better)
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= times * k
        plan.append((sorted(used.elements(), reverse=True), times))


def _two_for(smallest: int, gap: int, left: np.ndarray, used: Counter[int]) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum over `smallest` and within `gap`, the most even ones of equals."""
    free = [int(n) for n in np.flatnonzero(left[:gap]) if left[n] > used[int(n)]]
    low, high, most, best = 0, len(free) - 1, smallest, None
    while low <= high:
        both = free[low] + free[high]
        if both > gap:
            high -= 1
            continue
        alone = low == high and left[free[low]] - used[free[low]] < 2
        if not alone and (both > most or (best and both == most)):
            most, best = both, (free[low], free[high])
        low += 1
    return best


class Places:
    """Where the r-th piece of a length goes, for all lengths and ranks of a plan."""

    def __init__(self, plan: list[tuple[list[int], int]]):
        entries, taken, sequence = [], Counter(), 0
        for lengths, times in plan:
            offset = 0
            for n, k in sorted(Counter(lengths).items(), reverse=True):
                entries.append((self.key(n, taken[n]), sequence, k, offset, n))
                taken[n] += times * k
                offset += n * k
            sequence += times
        self.table = np.array(sorted(entries), dtype=np.int64).reshape(-1, 5)
        self.sequences = sequence

    @staticmethod
    def key(length, rank):
        return length * (1 << 46) + rank

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.key(length.astype(np.int64), rank.astype(np.int64))
        start, sequence, k, offset, n = self.table[np.searchsorted(self.table[:, 0], key, side="right") - 1].T
        t = key - start
        return sequence + t // k, offset + t % k * n


def pack(
    docs: DataFrame,
    size: int = 1024,
    end_id: int = 2,
    path: str | None = None,
    ranks_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Return (id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row."""
    path = path or public_vocabulary("byte_bpe_50k.json")
    ranks_path = ranks_path or public_vocabulary("byte_bpe_50k.tiktoken")
    ready(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def encode(batches):
        settle(_forget)
        encoder, part, seen = _encoder(path, ranks_path), TaskContext.get().partitionId(), Counter()
        for batch in slices(batches):
            rows, columns = [], [[] for _ in range(6)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
                for piece, (start, length) in enumerate(piece_bounds(len(ids), size)):
                    rows.append(i)
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for column, value in zip(columns, (piece, start, length, crc, part, seen[length]), strict=True):
                        column.append(value)
                    seen[length] += 1
            arrays = [pa.array(c, pa.int32() if i in (0, 4) else pa.int64()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *arrays],
                names=["id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    pieces = materialize(
        picked.mapInArrow(
            encode, f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long"
        )
    )
    # A row for each length and part of the input: ranks start where the parts before have ended.
    found = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = found.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = np.zeros(size + 1, dtype=np.int64)
    for row in found.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        counts[row["length"]] = row["n"]
    places = Places(plan_bins(counts, size))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = places.find(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(first, ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(
        place,
        f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
