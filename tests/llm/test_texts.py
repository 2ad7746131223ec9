"""Token counts, packing, pieces and media against plain uses of the libraries."""

import hashlib
import random
import wave
import zlib
from collections import Counter, defaultdict
from io import BytesIO

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomgraph.llm import media, packing, pieces, queries, token_counts
from loomgraph.llm.common import cuts
from tests.llm.cases import ROWS, empty, table

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
ODD = st.text(st.sampled_from("aäbcdeinrst ' 'sdll1.,!|<>endoftx\n\t\x1c\x85\xa0é日½ﬁ́") | st.characters(exclude_categories=["Cs"]), max_size=60)


@given(st.text(st.sampled_from("ab \n\t"), max_size=200), st.integers(1, 50))
def test_cuts_join_to_the_text(text, size):
    parts = list(cuts(text, size))
    assert "".join(parts) == text
    assert all(a[-1] not in " \n\t\r" and b[0] in " \n\t\r" for a, b in zip(parts, parts[1:], strict=False))


def plain_counts(texts):
    tokenizer = Tokenizer.from_file(WORD)
    return [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=4))
def test_word_lengths_are_the_librarys(texts):
    totals = [0] * len(texts)
    lengths = token_counts._lengths(WORD)
    lengths.add(totals, list(enumerate(texts)))
    assert totals == plain_counts(texts)


def test_token_counts(spark):
    got = Counter(map(tuple, token_counts.token_counts(table(spark), part_chars=1000).collect()))
    texts = [r[1] or "" for r in ROWS]
    want = Counter((r[0], len(t.encode()), n, n > 2048) for r, t, n in zip(ROWS, texts, plain_counts(texts), strict=True))
    assert got == want
    assert token_counts.token_counts(empty(spark)).count() == 0


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_encoder_gives_the_librarys_ids(text):
    encoder = packing._encoder(BYTE, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert encoder.ids(text).tolist() == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids


def check_packing(rows, docs, size=1024):
    """Every piece is there, in its place; returns how many sequences there are."""
    tokenizer = Tokenizer.from_file(BYTE)
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        n = len(ids)
        first = n if n <= size else n % size or size
        bounds = [(0, first), *((a, size) for a in range(first, n, size))]
        want.update((doc_id, i, a, k, zlib.crc32(ids[a : a + k].tobytes())) for i, (a, k) in enumerate(bounds))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_packing(spark):
    rows = packing.pack(table(spark)).collect()
    check_packing(rows, [(r[0], r[1]) for r in ROWS])
    assert packing.pack(empty(spark)).count() == 0


def test_packing_query_is_tight(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = queries.op4_best_two_fit_packing(spark, small).collect()
    bins = check_packing(rows, docs)
    assert bins <= -(-sum(r.length for r in rows) // 1024) * 1.01 + 1


def one_by_one(counts, size):
    """Best-two-fit, one bin after another, over a list of lengths."""
    left = sorted(n for n, k in enumerate(counts) for _ in range(k))
    bins = []
    while left:
        own = []
        while fitting := [n for n in left if n <= size - sum(own)]:
            left.remove(fitting[-1])
            own.append(fitting[-1])
        while size > sum(own):
            small, gap = min(own), size - sum(own) + min(own)
            pairs = [(a + b, a - b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= gap]
            if not pairs:
                break
            *_, a, b = max(pairs)
            own.remove(small)
            left.remove(a)
            left.remove(b)
            left = sorted([*left, small])
            own += [a, b]
        bins.append(sorted(own, reverse=True))
    return sorted(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=25))
def test_plan_is_best_two_fit(lengths):
    counts = np.bincount(lengths, minlength=21)
    plan = packing.plan_bins(counts, 20)
    bins = sorted(b for b, times in plan for _ in range(times))
    assert bins == one_by_one(counts, 20)
    places = packing.Places(plan)
    taken = set()
    for n in np.flatnonzero(counts):
        sequence, offset = places.find(np.full(counts[n], n), np.arange(counts[n]))
        for s, o in zip(sequence, offset, strict=True):
            span = {(int(s), int(o) + i) for i in range(n)}
            assert not span & taken
            taken |= span
    assert places.sequences == len(bins)


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_pieces_are_the_librarys(text):
    import sentencepiece

    encoder = pieces._encoder(PIECE)
    (ids,) = encoder.encode([text])
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert ids.tolist() == model.encode(text)
    assert encoder.decode(ids) == model.decode(model.encode(text)) == text.replace("▁", " ")


def test_every_piece_alone_and_beside_others():
    import sentencepiece

    encoder = pieces._encoder(PIECE)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    own = [p.replace("▁", " ") for p in encoder.pieces.ids]
    texts = [f"{before}{p}{after}" for p in own for before, after in (("", ""), ("a", "."), ("m", "x"), ("7", ","), ("é", "1"), (".", "²."), ("²", ")"))]
    got = encoder.encode(texts)
    wrong = [t for t, ids in zip(texts, got, strict=True) if ids.tolist() != model.encode(t)]
    assert wrong == []


def test_odd_letters_before_punctuation():
    import sentencepiece

    encoder, r = pieces._encoder(PIECE), random.Random(11)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = ["".join(r.choice("abm²³½¼①ªº߁٣ⅷ日.,;:!?)'\"|*%&#$ _-\n") for _ in range(r.randint(1, 25))) for _ in range(20_000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == model.encode(text), text


def test_the_best_path_is_the_only_one_allowed():
    found, r = pieces._encoder(PIECE).pieces, random.Random(12)
    for _ in range(300):
        word = "▁" * r.randint(0, 2) + "".join(r.choice("aeinorstlchdué²日.19") for _ in range(r.randint(1, 14)))
        lattice = pieces.Lattice(found)
        lattice.encode(word)
        for end in range(1, len(word) + 1):
            ends = []
            for start in range(end):
                part = word[start:end]
                if part in found.ids or start == end - 1:
                    if found.follows(lattice.last[start], part) if start else end == 1 or found.stands(part):
                        ends.append((lattice.score[start] + (found.scores[found.ids[part]] if part in found.ids else 0.0), part))
            assert max(ends) == (lattice.score[end], lattice.last[end]) and len(ends) == 1


def test_runs_of_blanks_across_a_cut():
    import sentencepiece

    encoder, r = pieces._encoder(PIECE), random.Random(13)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for _ in range(300):
        text = "".join(r.choice(("a", "be", ".", "\n", " ", "  ", " " * 9, " " * 20)) for _ in range(r.randint(1, 60)))
        for size in (1, 5, 16):
            words = [w for part in pieces._marked(text, size) for w in encoder.pieces.words.findall(part)]
            assert [i for w in words for i in pieces.Lattice(encoder.pieces).encode(w)] == model.encode(text)
    text = "a" * ((1 << 18) - 4) + " " * 9 + "b"
    assert encoder.encode([text])[0].tolist() == model.encode(text)


def test_pieces_of_table(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    encoded = pieces.encode(table(spark))
    rows = encoded.collect()
    assert sorted((str(r.doc_id), r.ids) for r in rows) == sorted((str(r[0]), model.encode(r[1] or "")) for r in ROWS)
    assert all(r.round_trip for r in rows)
    back = pieces.decode(encoded).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1] or "") for r in ROWS)
    assert pieces.encode(empty(spark)).count() == 0


def test_pieces_query_on_all_documents(spark, small):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op5_shared_prefix_pieces(spark, small).collect()
    assert len(got) == len(docs) and all(r.round_trip for r in got)
    for r in got:
        ids = np.array(model.encode(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def brute_pairs(samples):
    """Peak pairs, frame by frame."""
    frames = [samples[i : i + media.BLOCK].astype(np.float32) - 128 for i in range(0, len(samples) - media.BLOCK + 1, media.HOP)]
    sizes = [np.abs(np.fft.rfft(f * np.hanning(media.BLOCK).astype(np.float32))) for f in frames]
    peaks = []
    for t, size in enumerate(sizes):
        for low, high in zip(media.BANDS, media.BANDS[1:], strict=False):
            b = low + int(size[low:high].argmax())
            around = [sizes[u][low:high].max() for u in (t - 1, t + 1) if 0 <= u < len(sizes)]
            if size[b] > 0 and all(size[b] >= a for a in around):
                peaks.append((t, b))
    out = []
    for i, (t, b) in enumerate(peaks):
        for u, c in peaks[i + 1 : i + 1 + media.NEXT_PEAKS]:
            if u - t <= media.MOST_FRAMES_APART:
                out.append(t << 26 | b << 16 | c << 6 | (u - t))
    return sorted(out)


def test_fingerprint_matches_brute_force():
    r = random.Random(4)
    for n in (1, 2, 5, 40):
        samples = np.array([r.randrange(256) for _ in range(n * media.BLOCK)], np.uint8)
        assert media.fingerprint(samples).tolist() == brute_pairs(samples)


def test_media(spark):
    rows = media.media_columns(table(spark)).collect()
    texts = Counter((r[0], r[1] or "") for r in ROWS)
    assert len(rows) == len(ROWS)
    for (doc_id, text), n in texts.items():
        data = text.encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        same = [r for r in rows if r.doc_id == doc_id and r.payload_sha256 == hashlib.sha256(payload).hexdigest()]
        assert len(same) == n
        r = same[0]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-32:]))
        with wave.open(BytesIO(r.media)) as sound:
            assert sound.readframes(sound.getnframes()) == payload
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert r.fingerprint == media.fingerprint(np.frombuffer(payload, np.uint8)).tolist()
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.payload_sha256].add(r.feature)
    assert all(len(f) == 1 for f in by_text.values())
    assert media.media_columns(empty(spark)).count() == 0


@pytest.mark.parametrize("query", ["op6_media_columns", "op8_token_counts"])
def test_queries_cover_all_documents(spark, small, query):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = queries.queries()[query](spark, small)
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
