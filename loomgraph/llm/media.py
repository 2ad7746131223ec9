"""Media columns: texts as WAV audio, and spectral-peak pair fingerprints of what is read back.

The bytes of a text become 8-bit samples of a mono WAV file, written and read by the
wave module. A short-time Fourier transform of the samples gives, for each frame and
frequency band, the strongest bin; a bin that is no weaker than the same band's in the
frames beside it is a peak, and each peak is paired with the next few. A pair is stored
as one number that holds its time and both frequencies, so a fingerprint is an array in
the order of time.

Defined results: null text is an empty text (payload of one block of 255s); equal texts
give equal values; repeated rows give repeated results; long payloads are transformed in
blocks of frames, so memory doesn't grow with the spectrum.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.common import nothing, ready, settle, slices

BLOCK = 576
HOP = BLOCK // 2
RATE = 8000
PAD = b"\xff"
#: First bins of the frequency bands; the lowest bins hold the mean level only.
BANDS = (2, 24, 72, BLOCK // 2 + 1)
NEXT_PEAKS = 3
MOST_FRAMES_APART = 63
_WINDOW = np.hanning(BLOCK).astype(np.float32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, filled up to a positive multiple of the block, and how many there were."""
    data = (text or "").encode()
    short = -len(data) % BLOCK if data else BLOCK
    return data + PAD * short, len(data)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as sound:
        sound.setnchannels(1)
        sound.setsampwidth(1)
        sound.setframerate(RATE)
        sound.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as sound:
        return sound.readframes(sound.getnframes())


def _levels(samples: np.ndarray, frames: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of frames, the strongest bin of each band and its magnitude."""
    windows = np.lib.stride_tricks.sliding_window_view(samples, BLOCK)[::HOP]
    for at in range(0, len(windows), frames):
        part = (windows[at : at + frames].astype(np.float32) - np.float32(128)) * _WINDOW
        size = np.abs(np.fft.rfft(part, axis=1))
        bins = [size[:, a:b].argmax(axis=1) + a for a, b in zip(BANDS, BANDS[1:], strict=False)]
        bins = np.stack(bins, axis=1)
        yield bins, np.take_along_axis(size, bins, axis=1)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Peak pairs as integers: time of the first peak, its bin, the other's bin, frames between them."""
    found = list(_levels(samples))
    bins = np.concatenate([b for b, _ in found])
    level = np.concatenate([m for _, m in found])
    around = np.pad(level, ((1, 1), (0, 0)), constant_values=-1)
    peak = (level > 0) & (level >= around[:-2]) & (level >= around[2:])
    time, band = np.nonzero(peak)
    bin_at = bins[time, band].astype(np.int64)
    time = time.astype(np.int64)
    pairs = []
    for k in range(1, NEXT_PEAKS + 1):
        apart = time[k:] - time[:-k]
        near = apart <= MOST_FRAMES_APART
        pairs.append(((time[:-k] << 26) | (bin_at[:-k] << 16) | (bin_at[k:] << 6) | apart)[near])
    return np.sort(np.concatenate(pairs))


def media_columns(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True
) -> DataFrame:
    """Return for each row its payload's and medium's sizes and digests, the fingerprint and, if kept, the medium.

    `feature` is a digest of the fingerprint: the number of its pairs and a hash of them.
    """
    ready(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    names += ["feature", "fingerprint", *["media"] * keep_media]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    kinds += [pa.list_(pa.int64()), *[pa.binary()] * keep_media]

    def run(batches):
        settle(nothing)
        for batch in slices(batches, 256, 1 << 22):
            rows = []
            for text in batch.column(1).to_pylist():
                payload, n_bytes = payload_of(text)
                media = to_wav(payload)
                back = from_wav(media)
                pairs = fingerprint(np.frombuffer(back, np.uint8))
                digest = hashlib.sha256(pairs.astype("<i8").tobytes()).hexdigest()
                row = [n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media)]
                row += [hashlib.sha256(media).hexdigest(), f"{len(pairs)}:{digest[:32]}", pairs]
                rows.append((*row, *[media] * keep_media))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    schema = (
        f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, fingerprint array<long>"
    )
    return picked.mapInArrow(run, schema + ", media binary" * keep_media)
