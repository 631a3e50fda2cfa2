"""A data source of WAV recordings that reads them by byte ranges.

Headers are read when the read is planned; a recording becomes partitions of whole chunks of samples, and a
partition reads only the bytes of its chunks, and the few around them that resampling needs, some chunks at a time.
So a recording may be of any length, and its partitions are computed alone, again if need be.

Cases: any rate, width and number of channels that ``audio.read_wav`` takes, with the same samples; a data chunk that
is longer than the file ends with the file; an incomplete last frame is left out; an empty recording has no
chunks; a file that is no WAV file raises an error that names it. Files are opened by pyarrow (a path, or a URI
of a file system that it knows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from parley.functions.audio import RATE, mono, pcm, resampled_range, wav_shape

CHUNK = 512
PARTITION_BYTES = 32 << 20
CHUNKS_AT_ONCE = 256
SCHEMA = "path string, n long, start_ms long, samples array<float>"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def wav_paths(path: str) -> list[str]:
    """The WAV file, or all below a folder, by name."""
    system, own = _opened(path)
    info = system.get_file_info(own)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [path]
    prefix = path[: -len(own)] if path.endswith(own) else ""
    found = system.get_file_info(fs.FileSelector(own, recursive=True))
    return sorted(prefix + f.path for f in found if f.is_file and f.path.lower().endswith(".wav"))


@dataclass
class Recording:
    """Where a recording's samples are, and what they are."""

    path: str
    start: int
    frames: int
    kind: int
    channels: int
    rate: int
    width: int

    @property
    def samples(self) -> int:
        """At ``RATE``."""
        return -(-self.frames * RATE // self.rate)


def header(path: str) -> Recording:
    """Reads a recording's chunk headers, but not its samples."""
    system, own = _opened(path)
    with system.open_input_file(own) as f:
        size = f.size()
        top = f.read(12)
        if top[:4] != b"RIFF" or top[8:12] != b"WAVE":
            raise ValueError(f"{path}: not a WAV file")
        shape, at = None, 12
        while at + 8 <= size:
            f.seek(at)
            head = f.read(8)
            name, length = head[:4], int.from_bytes(head[4:], "little")
            if name == b"fmt " and length >= 16:
                try:
                    shape = wav_shape(f.read(min(length, 40)))
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from None
            elif name == b"data":
                if shape is None:
                    break
                kind, channels, rate, width = shape
                return Recording(path, at + 8, min(length, size - at - 8) // (width * channels), kind, channels, rate, width)
            at += 8 + length + length % 2
    raise ValueError(f"{path}: a WAV file without format or data")


@dataclass
class Chunks(InputPartition):
    """Chunks ``first`` to before ``end`` of a recording."""

    recording: Recording
    first: int
    end: int
    size: int


class WavReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = options.get("path") or ""
        self.size = int(options.get("chunk", CHUNK))
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def partitions(self) -> list[Chunks]:
        out = []
        for path in wav_paths(self.paths):
            r = header(path)
            chunks = -(-r.samples // self.size)
            stored = self.size * r.rate * r.width * r.channels / RATE  # bytes of a chunk
            step = max(1, int(self.bytes / stored))
            out += [Chunks(r, k, min(chunks, k + step), self.size) for k in range(0, chunks, step)]
        return out

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        r, size = partition.recording, partition.size
        system, own = _opened(r.path)
        frame = r.width * r.channels
        with system.open_input_file(own) as f:

            def samples(x: int, y: int) -> np.ndarray:
                f.seek(r.start + x * frame)
                return mono(pcm(f.read((y - x) * frame), r.kind, r.width), r.channels)

            for first in range(partition.first, partition.end, CHUNKS_AT_ONCE):
                end = min(partition.end, first + CHUNKS_AT_ONCE)
                x = resampled_range(samples, r.frames, r.rate, first * size, min(end * size, r.samples))
                cuts = [*range(0, len(x), size), len(x)]
                n = np.arange(first, end, dtype=np.int64)
                values = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([r.path] * len(n)), pa.array(n), pa.array(n * size * 1000 // RATE), values], names=["path", "n", "start_ms", "samples"])


class WavSource(DataSource):
    """``spark.read.format("wav")`` with options path, chunk and partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(dict(self.options))


def recorded_chunks(spark: SparkSession, path: str, chunk: int = CHUNK, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """path, n, start_ms, samples (16 kHz mono): the chunks of the WAV file, or of all below a folder."""
    spark.dataSource.register(WavSource)
    return spark.read.format("wav").option("chunk", chunk).option("partitionBytes", partition_bytes).load(path)


def interleaved(mic: DataFrame, system: DataFrame) -> DataFrame:
    """Chunks of two recordings on one clock: place (their order), source, n, start_ms, samples; the microphone's first.

    No sort is needed to know a chunk's place; a recording that is longer goes on alone.
    """
    side = lambda df, name, k: df.select((F.col("n") * 2 + k).alias("place"), F.lit(name).alias("source"), "n", "start_ms", "samples")
    return side(mic, "mic", 0).unionByName(side(system, "system", 1))
