"""Audio kernels on samples, in numpy, and the Spark functions that apply them to columns."""

from __future__ import annotations

import io
import math
import struct
import wave
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 16_000


def from_s16le(raw: bytes) -> np.ndarray:
    """Little-endian 16-bit samples as floats; an odd last byte is left out."""
    return np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768


def to_s16le(samples: np.ndarray) -> bytes:
    """Floats as little-endian 16-bit samples, clamped, halves away from zero."""
    x = np.clip(np.asarray(samples, np.float64), -1, 1) * 32767
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype("<i2").tobytes()


def mono(samples: np.ndarray, channels: int) -> np.ndarray:
    """The mean of interleaved channels; an incomplete last frame is dropped."""
    return samples[: len(samples) // channels * channels].reshape(-1, channels).mean(axis=1) if channels > 1 else samples


@lru_cache(maxsize=16)
def _taps(up: int, down: int, zeros: int = 16, rolloff: float = 0.9) -> tuple[np.ndarray, int]:
    """Blackman-windowed sinc for each of ``up`` phases, and its reach in input samples."""
    cutoff = rolloff * min(1.0, up / down)
    reach = math.ceil(zeros / cutoff)
    t = np.arange(-reach, reach + 1)[None, :] - (np.arange(up) / up)[:, None]
    w = np.clip(t / (reach + 1), -1, 1)
    taps = cutoff * np.sinc(cutoff * t) * (0.42 + 0.5 * np.cos(np.pi * w) + 0.08 * np.cos(2 * np.pi * w))
    return taps / taps.sum(axis=1, keepdims=True), reach


def resample(samples: np.ndarray, rate_in: int, rate_out: int = RATE, block: int = 65_536) -> np.ndarray:
    """Samples at another rate: exact rational positions, ceil(n * out / in) of them."""
    if rate_in == rate_out or not len(samples):
        return np.asarray(samples, np.float32)
    ratio = Fraction(rate_out, rate_in)
    up, down = ratio.numerator, ratio.denominator
    _, reach = _taps(up, down)
    padded = np.pad(np.asarray(samples, np.float64), reach)
    n = -(-len(samples) * up // down)
    out = np.empty(n, np.float32)
    for a in range(0, n, block):  # memory stays bounded for long recordings
        out[a : a + block] = _filtered(padded, 0, a, min(n, a + block), up, down)
    return out


def _filtered(padded: np.ndarray, first: int, a: int, b: int, up: int, down: int) -> np.ndarray:
    """Output samples a to before b from inputs that begin ``reach`` places before input number ``first``."""
    taps, reach = _taps(up, down)
    k = np.arange(a, b, dtype=np.int64) * down
    at = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)[k // up - first]
    return (at * taps[k % up]).sum(axis=1).astype(np.float32)


def resampled_range(read, n_in: int, rate_in: int, a: int, b: int, rate_out: int = RATE) -> np.ndarray:
    """Samples a to before b of ``resample``'s result; ``read(x, y)`` gives those inputs x to before y that are needed."""
    if rate_in == rate_out:
        return np.asarray(read(a, b), np.float32)
    ratio = Fraction(rate_out, rate_in)
    up, down = ratio.numerator, ratio.denominator
    _, reach = _taps(up, down)
    first, last = a * down // up, (b - 1) * down // up
    low, high = max(0, first - reach), min(n_in, last + reach + 1)
    part = np.pad(np.asarray(read(low, high), np.float64), (low - (first - reach), last + reach + 1 - high))
    return _filtered(part, first, a, b, up, down)


class SampleDecoder:
    """Decodes parts of a stream of little-endian 16-bit samples; an odd byte waits for the next part."""

    def __init__(self) -> None:
        self.rest = b""

    def feed(self, raw: bytes) -> np.ndarray:
        raw = self.rest + raw
        self.rest = raw[len(raw) // 2 * 2 :]
        return from_s16le(raw)


def wav_shape(header: bytes) -> tuple[int, int, int, int]:
    """Kind, channels, rate and bytes a sample of a format chunk; ValueError for others than integers and floats."""
    kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", header[:16])
    kind = int.from_bytes(header[24:26], "little") if kind == 0xFFFE and len(header) >= 26 else kind
    width = (bits + 7) // 8
    if not channels or not rate or (kind, width) not in {(1, 1), (1, 2), (1, 3), (1, 4), (3, 4), (3, 8)}:
        raise ValueError(f"WAV format {kind} of {bits} bits")
    return kind, channels, rate, width


def pcm(raw: bytes, kind: int, width: int) -> np.ndarray:
    """Stored samples as floats; an incomplete last one is left out."""
    raw = raw[: len(raw) // width * width]
    if kind == 3:
        return np.frombuffer(raw, f"<f{width}").astype(np.float64)
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    return np.frombuffer(raw, f"<i{width}").astype(np.float64) / float(1 << (8 * width - 1))


def read_wav(stored: bytes) -> np.ndarray:
    """A WAV file of any rate, width (integers or floats) and channels as 16 kHz mono floats; ValueError if it is none."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    shape, raw, at = None, None, 12
    while at + 8 <= len(stored) and raw is None:
        name, size = stored[at : at + 4], int.from_bytes(stored[at + 4 : at + 8], "little")
        body = stored[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            shape = wav_shape(body)
        elif name == b"data":
            raw = body
        at += 8 + size + size % 2
    if shape is None or raw is None:
        raise ValueError("a WAV file without format or data")
    kind, channels, rate, width = shape
    return resample(mono(pcm(raw, kind, width), channels), rate)


class WavWriter:
    """Writes mono 16-bit samples and silence part by part; ``finish`` gives the file."""

    def __init__(self, rate: int = RATE) -> None:
        self.out = io.BytesIO()
        self.file = wave.open(self.out, "wb")
        self.file.setnchannels(1)
        self.file.setsampwidth(2)
        self.file.setframerate(rate)

    def write(self, samples: np.ndarray) -> None:
        self.file.writeframes(to_s16le(samples))

    def silence(self, n_samples: int) -> None:
        for n in range(n_samples, 0, -65_536):  # memory stays bounded
            self.file.writeframes(bytes(2 * min(n, 65_536)))

    def finish(self) -> bytes:
        self.file.close()
        return self.out.getvalue()


def write_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """Mono samples as a 16-bit WAV file."""
    writer = WavWriter(rate)
    writer.write(samples)
    return writer.finish()


@lru_cache(maxsize=4)
def _mel(bins: int, size: int, rate: int) -> np.ndarray:
    """Triangles of equal width on the mel scale (2595 log10(1 + f / 700)), by bin and frequency."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bins + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, size // 2 + 1)
    rise = (f - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(samples: np.ndarray, bins: int = 64, size: int = 320, hop: int = 160) -> np.ndarray:
    """Log mel energies by bin and frame of 16 kHz samples; values that are not finite are 0."""
    x = np.asarray(samples, np.float64)
    if len(x) < size:
        return np.zeros((bins, 0), np.float32)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * window, axis=1)) ** 2
    out = np.log(np.clip(power @ _mel(bins, size, RATE).T, 1e-9, 1e9)).T
    return np.where(np.isfinite(out), out, 0).astype(np.float32)


def voiced(samples: np.ndarray, frame: int = 480) -> np.ndarray:
    """The frames louder than three times the 20th percentile and a floor, one after another."""
    n = len(samples) // frame
    if not n:
        return np.empty(0, np.float32)
    frames = np.asarray(samples[: n * frame], np.float64).reshape(n, frame)
    level = np.sqrt((frames**2).mean(axis=1))
    return frames[level > max(3 * np.sort(level)[n // 5], 0.004)].reshape(-1).astype(np.float32)


def collapsed(frames: np.ndarray, blank: int) -> list[int]:
    """Greedy CTC: each frame's largest output (the first of equals) without repeats and blanks."""
    best = np.asarray(frames).argmax(axis=1)
    keep = np.concatenate([[True], best[1:] != best[:-1]]) & (best != blank)
    return best[keep].tolist()


def active_level(samples: np.ndarray, frame: int = 320, below_db: float = 40.0) -> float:
    """Root mean square over the 20 ms frames that lie within 40 dB of the loudest."""
    n = len(samples) // frame
    power = (np.asarray(samples[: n * frame], np.float64).reshape(n, frame) ** 2).mean(axis=1) if n else np.zeros(1)
    return float(np.sqrt(power[power >= power.max() * 10 ** (-below_db / 10)].mean()))


def quietest(samples: np.ndarray, hop: int = 160, hops: int = 10) -> int:
    """The middle of the quietest stretch of ``hops`` hops, the latest of equals."""
    n = len(samples) // hop
    if n < hops:
        return len(samples) // 2
    energy = (np.asarray(samples[: n * hop], np.float64).reshape(n, hop) ** 2).sum(axis=1)
    sums = np.convolve(energy, np.ones(hops), "valid")
    at = len(sums) - 1 - int(np.isclose(sums[::-1], sums.min(), rtol=1e-9, atol=1e-15).argmax())
    return at * hop + hops * hop // 2


def snapped(samples: np.ndarray, cuts: list[int], least: int, reach_ms: int = 300, frame: int = 320) -> list[int]:
    """Cuts moved, one after another, to the middle of the quietest 20 ms within reach (steps of half a frame, the first of equals).

    Pieces stay ``least`` samples long; a cut without room stays where it is.
    """
    power = np.concatenate([[0.0], np.cumsum(np.asarray(samples, np.float64) ** 2)])
    out, before = list(cuts), 0
    for i, cut in enumerate(cuts):
        after = cuts[i + 1] if i + 1 < len(cuts) else len(samples)
        low, high = max(cut - reach_ms * 16, 0, before + least), min(cut + reach_ms * 16, after - least)
        at = np.arange(low, high - frame + 1, frame // 2)
        if len(at):
            out[i] = int(at[(power[at + frame] - power[at]).argmin()]) + frame // 2
        before = out[i]
    return out


def noise_floor(powers: np.ndarray, rise: float = 1.0023, least: float = 1e-10) -> np.ndarray:
    """The floor of frame powers after each: smoothed, down at once and up by a factor; powers below ``least`` do not count."""
    out, smooth, floor = np.full(len(powers), np.nan), None, None
    for i, p in enumerate(np.asarray(powers, np.float64)):
        if p >= least:
            smooth = p if smooth is None else 0.7 * smooth + 0.3 * p
            floor = floor * rise if floor is not None and smooth >= floor else smooth
        out[i] = np.nan if floor is None else floor
    return out


def gains(levels: np.ndarray, release: float = 0.985, target: float = 0.08, most: float = 10.0) -> np.ndarray:
    """The gain for each window's level: an envelope with instant attack is lifted to the target, by 1 to ``most``."""
    out, envelope = np.empty(len(levels)), 0.0
    for i, x in enumerate(levels):
        envelope = max(float(x), envelope * release)
        out[i] = min(max(target / max(envelope, 1e-9), 1.0), most)
    return out


def hangover(active: np.ndarray, frames: int = 100) -> np.ndarray:
    """Whether each frame, or one of the ``frames`` before it, is active."""
    at = np.where(active, np.arange(len(active)), -frames - 1)
    return np.arange(len(active)) - np.maximum.accumulate(at) <= frames if len(active) else np.zeros(0, bool)


class Ring:
    """The last ``seconds`` of a stream of 16 kHz samples: short gaps are filled with zeros, longer ones start anew."""

    def __init__(self, seconds: int = 60, gap_ms: int = 5_000) -> None:
        self.size, self.gap_ms, self.start_ms, self.samples = seconds * RATE, gap_ms, 0, np.empty(0, np.float32)

    def feed(self, start_ms: int, samples: np.ndarray) -> None:
        gap = start_ms - (self.start_ms + len(self.samples) * 1000 // RATE)
        if not len(self.samples) or gap > self.gap_ms:
            self.start_ms, self.samples, gap = start_ms, self.samples[:0], 0
        fill = np.zeros(max(gap, 0) * RATE // 1000, np.float32)
        self.samples = np.concatenate([self.samples, fill, np.asarray(samples, np.float32)])
        if (over := len(self.samples) - self.size) > 0:
            self.start_ms, self.samples = self.start_ms + over * 1000 // RATE, self.samples[over:]

    def slice(self, start_ms: int, end_ms: int) -> np.ndarray:
        """What is kept of a span of time."""
        a, b = ((x - self.start_ms) * RATE // 1000 for x in (start_ms, end_ms))
        return self.samples[max(a, 0) : max(b, 0)]


def alignment(reference: np.ndarray, signal: np.ndarray, most: int, least: float = 0.4, lead: float = 0.08, apart: int = 8) -> int | None:
    """The delay, up to ``most``, at which two energy curves agree best; None if not clearly so."""
    scores = np.full(most + 1, -1.0)
    for lag in range(most + 1):
        a, b = reference[: len(reference) - lag], signal[lag : len(reference)]
        n = min(len(a), len(b))
        if n > 2 and a[:n].std() > 0 and b[:n].std() > 0:
            scores[lag] = float(np.corrcoef(a[:n], b[:n])[0, 1])
    best = int(scores.argmax())
    others = np.abs(np.arange(most + 1) - best) > apart
    second = scores[others].max() if others.any() else -1.0
    return best if scores[best] >= least and scores[best] - second >= lead else None


def energy(x: np.ndarray) -> float:
    """Sum of squares."""
    return float((np.asarray(x, np.float64) ** 2).sum())


def echo_loss(before: np.ndarray, after: np.ndarray) -> float:
    """How far cancellation lowered the energy, in decibels."""
    return 10 * math.log10(max(energy(before), 1e-12) / max(energy(after), 1e-12))


def si_sdr(estimate: np.ndarray, target: np.ndarray) -> float:
    """Scale-invariant signal-to-distortion ratio in decibels."""
    e, t = np.asarray(estimate, np.float64), np.asarray(target, np.float64)
    part = (e @ t) / max(t @ t, 1e-12) * t
    return 10 * math.log10(max(energy(part), 1e-12) / max(energy(e - part), 1e-12))


def wav_column(content: Column) -> Column:
    """Samples of WAV files (as read by Spark's binaryFile source); null for a file that is none."""

    def samples(x: bytes | None) -> np.ndarray | None:
        try:
            return None if x is None else read_wav(bytes(x))
        except ValueError:
            return None

    @F.pandas_udf("array<float>")
    def run(files: pd.Series) -> pd.Series:
        return files.map(samples)

    return run(content)


def log_mel_column(samples: Column) -> Column:
    """Log mel energies of sample arrays."""

    @F.pandas_udf("array<array<float>>")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda x: None if x is None else log_mel(x).tolist())

    return run(samples)


def array_function(kernel, kind: str = "array<float>"):
    """A kernel on one array as a function of a column; null stays null."""

    def apply(column: Column) -> Column:
        @F.pandas_udf(kind)
        def run(arrays: pd.Series) -> pd.Series:  # these follow a state from value to value
            return arrays.map(lambda x: None if x is None else np.asarray(kernel(np.asarray(x))).tolist())

        return run(column)

    return apply


voiced_column = array_function(voiced)
noise_floor_column = array_function(noise_floor, "array<double>")
gains_column = array_function(gains, "array<double>")
hangover_column = array_function(lambda x: hangover(x.astype(bool)), "array<boolean>")
