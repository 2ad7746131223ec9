"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text's blanks become marks and the text is cut before each run of marks, around line
ends, and between letters and the punctuation behind them; no piece of the vocabulary
crosses such a cut, which is checked when it is loaded, by the same definition of a letter
that cuts. Very long texts are cut before runs of blanks only. The distinct marked words of a batch are sorted, which
orders them as a depth-first walk of their trie, and the forward scores of a prefix are
kept while words share it, so each trie node is scored once: a node keeps the best of all
pieces that may end there, and following these back from a word's node gives its pieces.

The model is one of merges: a piece's score is the rank of the merge that makes it. The
path score of a prefix adds piece scores over the transitions that the merge order
allows; a transition between two pieces is allowed if merging their characters gives just
these two pieces, and costs minus infinity otherwise. A sequence whose neighbours are all
allowed is what the merges make of the whole word, so the best path gives the same ids as
the library. Characters outside the vocabulary are spelled as bytes.

Defined results: null text is an empty text, with no ids; decoding gives the text again,
except that a mark in the text itself comes back as a blank, as in the library; ids that
are no pieces decode to nothing; repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.common import by_bytes, cuts, public_vocabulary, ready, settle, slices, weight

MARK = "▁"
_PUNCTUATION = ".,;:!?|*%&#$)\"'"
#: What counts as a letter, in patterns and outside of them; it includes characters such as "²" that are letters to neither Unicode nor isalpha().
_LETTER = r"[^\W\d_]"


class Pieces:
    """The vocabulary of a sentencepiece file: pieces, their scores, and bytes for other characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.scores.append(model.get_score(i))
            if model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            elif model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            else:
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        #: Length of the longest piece by its last three characters.
        self.longest: dict[str, int] = {}
        for piece in self.ids:
            if len(piece) >= 3:
                self.longest[piece[-3:]] = max(len(piece), self.longest.get(piece[-3:], 3))
        #: By the piece before, what may follow it.
        self.allowed: dict[str, dict[str, bool]] = {}
        self.compared = 0
        self.whole: dict[str, bool] = {}
        self.words = self._word_pattern()

    def _word_pattern(self) -> re.Pattern:
        """Words as runs of characters between places that no piece crosses."""
        pairs = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        if any(a != MARK and b == MARK for a, b in pairs):
            raise ValueError("a piece holds a mark behind another character")
        letter = re.compile(_LETTER)
        behind_letters = {b for a, b in pairs if letter.match(a)}
        safe = "".join(c for c in _PUNCTUATION if c not in behind_letters)
        alone = "" if any("\n" in pair for pair in pairs) else "\n"
        cut = re.escape(safe + alone)
        first = f"{MARK}*{_LETTER}+(?=[{cut}])|" if cut else ""
        return re.compile(f"{first}{MARK}*[^{MARK}{alone}]+" + (f"|{MARK}*{alone}+" if alone else "") + f"|{MARK}+")

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i, pair in enumerate(zip(parts, parts[1:], strict=False)):
                found = self.ids.get(pair[0] + pair[1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stands(self, piece: str) -> bool:
        """Whether merging a piece's characters gives the piece."""
        if (known := self.whole.get(piece)) is None:
            known = self.whole[piece] = self.merged(piece) == [piece]
        return known

    def follows(self, first: str, second: str) -> bool:
        """Whether merging the characters of both gives just the two."""
        after = self.allowed.get(first)
        if after is None:
            after = self.allowed[first] = {}
        if (known := after.get(second)) is None:
            known = after[second] = self.merged(first + second) == [first, second]
            self.compared += 1
            if self.compared > 1_000_000:
                self.allowed, self.compared = {}, 0
        return known

    def spelled(self, character: str) -> list[int]:
        return [self.byte_ids[b] for b in character.encode()]


class Lattice:
    """Forward scores along the current path of the trie, kept for the prefix that the next word shares."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.word = ""
        self.score: list[float] = [0.0]
        self.last: list[str] = [""]

    def encode(self, word: str) -> list[int]:
        """Ids of a word; words should come in sorted order."""
        pieces, score, last = self.pieces, self.score, self.last
        shared = 0
        for a, b in zip(self.word, word, strict=False):
            if a != b:
                break
            shared += 1
        del score[shared + 1 :], last[shared + 1 :]
        ids_of, scores, longest, follows = pieces.ids, pieces.scores, pieces.longest, pieces.follows
        for end in range(shared + 1, len(word) + 1):
            best, piece = -np.inf, word[end - 1]
            for start in range(max(0, end - longest.get(word[max(0, end - 3) : end], 2)), end):
                part = word[start:end]
                found = ids_of.get(part)
                if found is None and start < end - 1:
                    continue
                path = score[start] + (scores[found] if found is not None else 0.0)
                if path > best and (follows(last[start], part) if start else end == 1 or pieces.stands(part)):
                    best, piece = path, part
            score.append(best)
            last.append(piece)
        self.word = word
        path, end = [], len(word)
        while end:
            piece = last[end]
            found = ids_of.get(piece)
            path += [found] if found is not None else pieces.spelled(piece)[::-1]
            end -= len(piece)
        return path[::-1]


class Encoder:
    """Encodes batches of texts; ids of words seen before are remembered up to a bound in bytes."""

    def __init__(self, path: str, remembered: int = 64 << 20):
        self.pieces = Pieces(path)
        self.remembered, self.held = remembered, 0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found: list[list[bytes]] = [[] for _ in texts]
        parts = ((i, part) for i, t in enumerate(texts) for part in _marked(t))
        for group in by_bytes(parts, 1 << 21):
            if self.held > self.remembered:
                self.known, self.older, self.held = {}, self.known, 0
            split = [(i, self.pieces.words.findall(part)) for i, part in group]
            new = set().union(*(words for _, words in split)).difference(self.known)
            self.known.update((w, self.older[w]) for w in new.intersection(self.older))
            self.held += weight(new)
            lattice = Lattice(self.pieces)
            for word in sorted(new.difference(self.older)):
                self.known[word] = array("I", lattice.encode(word)).tobytes()
            for i, words in split:
                found[i].append(b"".join(map(self.known.__getitem__, words)))
        return [np.frombuffer(b"".join(parts), np.uint32) for parts in found]

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.pieces.bytes_of.__getitem__, ids.tolist()))
        return out.decode("utf-8", errors="replace").removeprefix(" ")


def _marked(text: str, size: int = 1 << 18):
    """The marked text in parts that end before a run of marks."""
    if text:
        for i, part in enumerate(cuts(text.replace(" ", MARK), size, MARK)):
            yield part if i else MARK + part


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True
) -> DataFrame:
    """Return (id, n_bytes, n_tokens, ids_crc32, round_trip) and, if kept, the ids of each row's text.

    round_trip: whether decoding the ids gives the text again.
    """
    path = path or public_vocabulary("piece_bpe_32k.model")
    ready(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    names = [id_col, "n_bytes", "n_tokens", "ids_crc32", "round_trip", *["ids"] * keep_ids]

    def run(batches):
        settle(_encoder.cache_clear)
        encoder = _encoder(path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = encoder.encode(texts)
            arrays = [
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                pa.array([encoder.decode(x) == t for x, t in zip(found, texts, strict=True)], pa.bool_()),
                *[pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))] * keep_ids,
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, ids_crc32 long, round_trip boolean"
    return picked.mapInArrow(run, schema + ", ids array<int>" * keep_ids)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Return (id, text) for rows of ids; null ids give null text."""
    path = path or public_vocabulary("piece_bpe_32k.model")
    ready(encoded.sparkSession)
    picked = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].cast("array<int>").alias("ids"))

    def run(batches):
        settle(_encoder.cache_clear)
        encoder = _encoder(path)
        for batch in slices(batches):
            rows = batch.column(1).to_pylist()
            top = len(encoder.pieces.bytes_of)
            texts = [None if r is None else encoder.decode(np.array([i for i in r if i is not None and 0 <= i < top], np.int64)) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return picked.mapInArrow(run, f"`{id_col}` {picked.schema['id'].dataType.simpleString()}, text string")
