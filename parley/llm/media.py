"""Media columns: texts as WAV payloads, their spectra, and spectral-peak pair fingerprints.

A text's UTF-8 bytes are padded with blanks to a positive multiple of 192 and written as 8-bit mono
samples by the ``wave`` module; the stored bytes are read back by it, and all values come from what
was read. Short-time Fourier transforms (192 samples, hop 96, Hann window) give spectra; a peak is
a cell that no other within ``REACH`` exceeds and that is twice its frame's mean; a peak and each of
the next ``FAN`` peaks within ``MOST_FRAMES`` frames make a code (two frequencies and a distance)
at the first peak's frame.

Cases: a null text counts as empty (one frame of blanks, no peaks); texts are taken whole, long ones
block by block; every document is computed by itself, so equal texts give equal values; further
columns, whatever their names, are not read.
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
from pyspark.sql import functions as F

from parley.llm.common import small_batches

UNIT, HOP, RATE = 192, 96, 8000
REACH = (1, 4)  # frames, frequencies
FAN, MOST_FRAMES = 3, 32
BLOCK = 8192  # frames transformed at once

_WINDOW = np.hanning(UNIT + 1)[:-1].astype(np.float32)


def padded(raw: bytes) -> bytes:
    """The payload: ``raw`` and blanks up to a positive multiple of 192."""
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def to_wav(payload: bytes) -> bytes:
    """The payload as the 8-bit samples of a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(stored), "rb") as f:
        return f.readframes(f.getnframes())


def spectra(samples: np.ndarray) -> np.ndarray:
    """Magnitudes by frame and frequency."""
    x = (samples.astype(np.float32) - 128) / 128
    frames = np.lib.stride_tricks.sliding_window_view(x, UNIT)[::HOP]
    return np.abs(np.fft.rfft(frames * _WINDOW, axis=1)).astype(np.float32)


def highest(m: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """The largest value within ``reach`` along an axis."""
    out = m.copy()
    for d in range(1, reach + 1):
        low, high = (np.s_[:-d], np.s_[d:]) if axis == 0 else (np.s_[:, :-d], np.s_[:, d:])
        np.maximum(out[high], m[low], out=out[high])
        np.maximum(out[low], m[high], out=out[low])
    return out


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequencies of the peaks, by frame; block by block with a margin of ``REACH`` frames."""
    frames = len(samples) // HOP - 1
    at, freq = [], []
    for start in range(0, frames, BLOCK):
        low, high = max(0, start - REACH[0]), min(frames, start + BLOCK + REACH[0])
        m = spectra(samples[low * HOP : high * HOP + HOP])
        top = highest(highest(m, REACH[1], 1), REACH[0], 0)
        t, f = np.nonzero((m == top) & (m > 2 * m.mean(axis=1, keepdims=True)))
        inside = (t + low >= start) & (t + low < start + BLOCK)
        at.append(t[inside] + low)
        freq.append(f[inside])
    return np.concatenate(at), np.concatenate(freq)


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and codes of the peak pairs, by time and code."""
    t, f = peaks(np.frombuffer(payload, np.uint8))
    times, codes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        near = gap <= MOST_FRAMES
        times.append(t[:-k][near])
        codes.append((f[:-k][near] << 14) | (f[k:][near] << 6) | gap[near])
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype("<i4"), codes[order].astype("<i4")


def media(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_media: bool = True, with_pairs: bool = True) -> DataFrame:
    """Per row: ``keep``, the stored form's and payload's sizes and digests, feature; if wanted media, times, codes."""
    small_batches(docs.sparkSession)
    inner = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    width = len(keep)
    own = ["n_bytes long", "payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string"]
    own += ["media binary"] * with_media + ["times array<int>", "codes array<int>"] * with_pairs
    schema = ", ".join([*(f"k{i} {t}" for i, (_, t) in enumerate(inner.dtypes[:-1])), *own])
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}

    def row(text: str) -> list:
        raw = text.encode("utf-8")
        stored = to_wav(padded(raw))
        payload = from_wav(stored)
        times, codes = fingerprint(payload)
        digest = hashlib.sha1(times.tobytes() + codes.tobytes()).hexdigest()
        out = [len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{len(codes)}:{digest}"]
        return out + [stored] * with_media + [times, codes] * with_pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = [row(x.as_py() or "") for x in part.column(width)]
                columns = [pa.array([r[i] for r in rows], kinds[x.split(" ")[1]]) for i, x in enumerate(own)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(width)), *columns], names=names)

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names[width:])
