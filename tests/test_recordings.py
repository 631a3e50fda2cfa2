"""Recordings by byte ranges against the whole file."""

import struct
import wave

import numpy as np
import pytest

from parley.functions import audio
from parley.sources import recordings


def pcm_file(path, rng, frames, rate, channels, width):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(rng.bytes(frames * channels * width))


def float_file(path, rng, frames, rate, extra=b"", claimed=None):
    raw = rng.normal(size=frames).astype("<f4").tobytes() + extra
    body = b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<IHHIIHH", 16, 3, 1, rate, rate * 4, 4, 32) + b"data" + struct.pack("<I", len(raw) if claimed is None else claimed) + raw
    path.write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)


def joined(df, path):
    rows = sorted((r for r in df.collect() if r.path.endswith(path)), key=lambda r: r.n)
    assert [r.n for r in rows] == list(range(len(rows))) and all(r.start_ms == r.n * 512 * 1000 // 16_000 for r in rows)
    assert all(len(r.samples) == 512 for r in rows[:-1])
    return np.array([x for r in rows for x in r.samples], np.float32)


@pytest.mark.parametrize("rate, channels, width", [(16_000, 1, 2), (44_100, 2, 3), (8_000, 1, 1), (48_000, 3, 4)])
def test_parts_are_the_whole(spark, tmp_path, rate, channels, width):
    path = tmp_path / "a.wav"
    pcm_file(path, np.random.default_rng(1), 30_011, rate, channels, width)
    df = recordings.recorded_chunks(spark, str(path), partition_bytes=20_000)
    assert df.rdd.getNumPartitions() >= 30_011 * channels * width // 20_000
    assert np.array_equal(joined(df, "a.wav"), audio.read_wav(path.read_bytes()))


def test_a_folder_of_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    (tmp_path / "in").mkdir()
    float_file(tmp_path / "in" / "f.wav", rng, 5_000, 22_050)
    float_file(tmp_path / "in" / "cut.WAV", rng, 700, 16_000, extra=b"\1\2", claimed=1 << 31)
    float_file(tmp_path / "empty.wav", rng, 0, 16_000)
    (tmp_path / "notes.txt").write_text("no recording")
    df = recordings.recorded_chunks(spark, f"file://{tmp_path}")
    assert np.array_equal(joined(df, "f.wav"), audio.read_wav((tmp_path / "in" / "f.wav").read_bytes()))
    assert len(joined(df, "cut.WAV")) == 700 and not len(joined(df, "empty.wav"))


def test_only_the_needed_bytes_are_read(tmp_path, monkeypatch):
    path = tmp_path / "long.wav"
    pcm_file(path, np.random.default_rng(3), 400_000, 48_000, 2, 2)
    read = []
    plain = audio.pcm
    monkeypatch.setattr(recordings, "pcm", lambda raw, kind, width: read.append(len(raw)) or plain(raw, kind, width))
    reader = recordings.WavReader({"path": str(path), "partitionbytes": "100000"})
    parts = reader.partitions()
    assert len(parts) > 15
    for p in parts[:3]:
        read.clear()
        assert sum(b.num_rows for b in reader.read(p)) == p.end - p.first
        assert sum(read) < 110_000
    monkeypatch.setattr(recordings, "CHUNKS_AT_ONCE", 2)
    read.clear()
    list(reader.read(parts[1]))
    assert max(read) < 13_000


def test_broken_files_are_named(spark, tmp_path):
    for name, raw in {"x.wav": b"RIFF", "y.wav": b"RIFF\0\0\0\0WAVEdata\0\0\0\0", "z.wav": b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 7, 1, 8000, 8000, 1, 8)}.items():
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(ValueError, match=name):
            recordings.header(str(tmp_path / name))
    with pytest.raises(Exception, match="nowhere"):
        recordings.recorded_chunks(spark, str(tmp_path / "nowhere.wav")).collect()


def test_two_recordings_on_one_clock(spark, tmp_path):
    rng = np.random.default_rng(4)
    pcm_file(tmp_path / "mic.wav", rng, 3_000, 16_000, 1, 2)
    pcm_file(tmp_path / "call.wav", rng, 12_000, 48_000, 2, 2)
    both = recordings.interleaved(recordings.recorded_chunks(spark, str(tmp_path / "mic.wav")), recordings.recorded_chunks(spark, str(tmp_path / "call.wav"))).orderBy("place").collect()
    assert [(r.source, r.start_ms) for r in both[:4]] == [("mic", 0), ("system", 0), ("mic", 32), ("system", 32)]
    assert len([r for r in both if r.source == "mic"]) == 6 and both[-1].source == "system" and sum(len(r.samples) for r in both) == 7_000
