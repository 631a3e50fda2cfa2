"""Kernels of clustering, change detection, echo suppression and audio on hand-made inputs."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from parley.functions import audio
from parley.operators import change, clustering, echo
from parley.streaming.voice import Segmenter


def axis(i, tilt=0.0, other=5, n=16):
    v = np.zeros(n)
    v[i], v[other] = math.sqrt(1 - tilt**2), tilt
    return v.tolist()


def labels(rows, prefix="mic", **kw):
    online = clustering.Online(prefix, **kw)
    return [online.assign(e, a, b) for e, a, b in rows]


def turns(*items, gap=5000, ms=4000):
    return [(e, i * (ms + gap), i * (ms + gap) + ms) for i, e in enumerate(items)]


def test_three_voices_are_numbered_by_appearance():
    a, b, c = axis(0), axis(1), axis(2)
    assert labels(turns(a, axis(0, 0.3), b, a, c, axis(1, 0.2))) == ["mic:1", "mic:1", "mic:2", "mic:1", "mic:3", "mic:2"]


def test_voiceprint_is_me():
    me = axis(0)
    near, far = axis(0, 0.6), axis(0, math.sqrt(1 - 0.55**2))
    assert labels(turns(axis(1), near, far), voiceprint=me) == ["mic:1", "me", "mic:2"]


def test_short_rows_inherit_and_never_open():
    a, b = axis(0), axis(1)
    rows = [(a, 0, 4000), (None, 5000, 5500), (b, 6000, 7000), (b, 12_000, 13_000), (b, 20_000, 24_000)]
    assert labels(rows, prefix="sys") == ["sys:1", "sys:1", "sys:1", None, "sys:2"]


def test_merge_keeps_the_heavier_and_aliases():
    online = clustering.Online("mic", clustering.Knobs(join=0.9, merge=0.7))
    got = [online.assign(e, i * 9000, i * 9000 + 8000) for i, e in enumerate([axis(0), axis(0, 0.6), axis(0, 0.3)])]
    assert got[0] == "mic:1" and got[1] in ("mic:1", "mic:2") and len(online.voices) == 1


def test_agglomeration_and_its_cap():
    x = np.array([axis(i // 3, 0.1, 5 + i % 3) for i in range(9)])
    w = np.ones(9)
    assert clustering.agglomerate(x @ x.T, w, 0.5).tolist() == [0] * 3 + [1] * 3 + [2] * 3
    assert len(set(clustering.agglomerate(np.eye(12), np.ones(12), 1.01))) == 12
    assert len(set(clustering.agglomerate(np.eye(12), np.ones(12), 1.01, most=3))) == 3


def greedy_linkage(s, w, limit, most=None):
    parts = [[i] for i in range(len(w))]

    def between(a, b):
        return sum(w[i] * w[j] * s[i, j] for i in a for j in b) / sum(w[i] * w[j] for i in a for j in b)

    while len(parts) > 1:
        value, a, b = max((between(x, y), i, j) for i, x in enumerate(parts) for j, y in enumerate(parts[:i]))
        if value < limit and (most is None or len(parts) <= most):
            break
        parts[b] += parts.pop(a)
    out = np.empty(len(w), int)
    for k, part in enumerate(sorted(parts, key=min)):
        out[part] = k
    return out.tolist()


def test_chains_join_as_the_greedy_order():
    rng = np.random.default_rng(2)
    for n, limit, most in ((1, 0.5, None), (2, 0.0, None), (14, 0.2, None), (18, 0.4, 5), (18, 0.9, 2), (16, -1.0, None)):
        x = rng.normal(size=(n, 6)) + 2 * rng.normal(size=(3, 6))[rng.integers(0, 3, n)]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        w = rng.uniform(0.5, 10, n)
        assert clustering.agglomerate(x @ x.T, w, limit, most).tolist() == greedy_linkage(x @ x.T, w, limit, most)


def test_recluster_repairs_and_is_idempotent():
    a, b, c = axis(0), axis(1), axis(2)
    e = [a, axis(0, 0.2), b, axis(0, 0.1), b, c]
    ms = np.full(6, 6000)
    got = clustering.recluster(e, ms, ["mic:1", "mic:1", "mic:2", "mic:4", "mic:2", "mic:3"], "mic")
    assert got == ["mic:1", "mic:1", "mic:2", "mic:1", "mic:2", "mic:3"]
    assert clustering.recluster(e, ms, got, "mic") == got


def test_recluster_keeps_names_and_follows_majorities():
    a, b = axis(0), axis(1)
    assert clustering.recluster([a, b, a, b, b], np.full(5, 8000), ["sys:7", "sys:3", "sys:7", "sys:3", "sys:3"], "sys") == ["sys:7", "sys:3", "sys:7", "sys:3", "sys:3"]
    assert clustering.recluster([a, a, None], np.array([8000, 8000, 300]), ["mic:1", "mic:2", "mic:2"], "mic")[2] in ("mic:1", "mic:2")
    assert clustering.recluster([None, []], np.array([1, 2]), ["x", None], "mic") == ["x", None]


@pytest.mark.parametrize("shape", [(3, 3), (2, 5), (5, 2), (1, 1), (6, 6)])
def test_assignment_is_optimal(shape):
    rng = np.random.default_rng(shape[0] * 10 + shape[1])
    for _ in range(20):
        g = rng.integers(0, 20, shape).astype(float)
        got = clustering.assign_best(g)
        total = sum(g[i, j] for i, j in enumerate(got) if j is not None)
        r, c = shape
        best = max(sum(g[i, j] for i, j in zip(range(r), p)) for p in itertools.permutations(range(c), r)) if r <= c else max(sum(g[i, j] for j, i in zip(range(c), p)) for p in itertools.permutations(range(r), c))
        assert total == best and len({j for j in got if j is not None}) == min(shape)


def test_assignment_examples_and_error_rate():
    assert clustering.assign_best(np.array([[9.0, 8], [8, 1]])) == [1, 0]
    assert clustering.assign_best(np.array([[1.0, 5, 2]])) == [1]
    assert clustering.assign_best(np.array([[1.0], [5], [2]])) == [None, 0, None]
    rows = pd.DataFrame([("x", "A", 2), ("y", "A", 1), (None, "B", 1), ("z", "B", 2)], columns=["label", "speaker", "weight"])
    got = clustering.error_rate(rows)
    assert math.isclose(got["error_rate"], 2 / 6) and math.isclose(got["unlabelled"], 1 / 6)


def test_change_points_between_two_voices():
    starts = np.arange(0, 160_000 - 24_000 + 1, 8000)
    e = np.array([axis(0) if s + 12_000 < 80_000 else axis(1) for s in starts])
    cuts = change.change_points(starts, e, 24_000, 1600, 160_000)
    assert len(cuts) == 1 and abs(cuts[0] - 80_000) <= 16_000
    assert change.change_points(starts, np.array([axis(0)] * len(starts)), 24_000, 1600, 160_000) == []
    assert change.pieces([100, 30, 500], 1000, 150) == [500] or change.pieces([100, 30, 500], 1000, 150)[-1] == 500
    assert change.spaced(np.array([10, 14, 30]), np.array([0.3, 0.1, 0.2]), 8, 0, 40) == [14, 30]


def seg(id_, source, a, b, text, final=True):
    return {"meeting_id": 1, "id": id_, "source": source, "start_ms": a, "end_ms": b, "text": text, "is_final": final}


def log(*items):
    rows = [{"kind": "audio", "arrival_ms": t, "rms": 0.1, **seg("", "system", x[0], x[1], "")} if kind == "audio" else {"kind": "segment", "arrival_ms": t, "rms": 0.0, **x} for t, kind, x in items]
    return pd.DataFrame(rows)


CALL = "сегодня мы обсудим план выпуска и сроки"


def test_guard_drops_or_blanks_echoes():
    sound = (1000, "audio", (1000, 5000))
    partial = (4000, "segment", seg("mic-1", "mic", 1200, 3000, "сегодня мы", False))
    mic = (5200, "segment", seg("mic-1", "mic", 1200, 4900, CALL))
    call = (6000, "segment", seg("system-1", "system", 1000, 5000, CALL + "!"))
    got = echo.replay(log(sound, partial, mic, call))
    assert list(zip(got.id, got.text))[1:] == [("system-1", CALL + "!"), ("mic-1", "")]
    assert echo.replay(log(sound, mic, call)).id.tolist() == ["system-1"]


def test_guard_keeps_own_words_in_order():
    sound = (1000, "audio", (1000, 5000))
    own = (5200, "segment", seg("mic-1", "mic", 1200, 4900, "я возьму это на себя до пятницы"))
    later = (5300, "segment", seg("mic-2", "mic", 9000, 9500, "да"))
    call = (6000, "segment", seg("system-1", "system", 1000, 5000, CALL))
    got = echo.replay(log(sound, own, later, call))
    assert got.id.tolist() == ["system-1", "mic-1", "mic-2"] and got.emitted_ms.tolist()[1] == 6000
    waited = echo.replay(log(sound, own, (8000, "segment", seg("mic-3", "mic", 20_000, 21_000, "ещё слово"))))
    assert waited.id.tolist() == ["mic-1", "mic-3"] and waited.emitted_ms.tolist() == [8000, 8000]
    assert echo.replay(log(own)).emitted_ms.tolist() == [5200]


def test_containment_rule():
    assert echo.contained("план", "план") == 1 and echo.contained("", "x") == 0
    assert echo.contained("мы обсудим план", CALL) > 0.9 and echo.contained("совсем другое", CALL) < 0.4
    assert echo.repeats("план", CALL) and not echo.repeats("пла", CALL)


def feed(kernel, flags, level=lambda i: 0.1):
    return [s for i, f in enumerate(flags) for s in kernel.feed((i + 1) * 32, f, level(i))] + kernel.finish()


def test_utterances():
    one = feed(Segmenter(), [False] * 20 + [True] * 60 + [False] * 40)
    # the flag rises two windows and 150 ms late and falls 500 ms late; 250 ms before and 150 ms after are kept
    assert one == [(21 * 32 - 64 - 150 - 250, 81 * 32 - 500 + 150)]
    two = feed(Segmenter(), ([False] * 20 + [True] * 30 + [False] * 20) * 2)
    assert len(two) == 2 and two[0][1] <= two[1][0]
    soft = feed(Segmenter(longest_ms=6_000), [False] * 20 + [True] * 120 + [False] * 20)
    assert soft == [(21 * 32 - 464, 141 * 32 - 100 + 50)]  # over half the longest a short silence is enough
    long = feed(Segmenter(longest_ms=12_000), [True] * 1000, lambda i: 0.0 if i in (339, 340, 341) else 0.1)
    assert len(long) >= 2 and all(a[1] == b[0] for a, b in zip(long, long[1:])) and long[0][1] == 341 * 32 - 16
    assert all(b - a <= 12_000 + 32 for a, b in long)
    # after a minute without a pause the detector begins anew, and 800 ms later the rest is closed
    stopped = feed(Segmenter(), [True] * 1880 + [False] * 100)
    assert stopped[-1][1] <= 1880 * 32 + 800 + 32 and stopped[-2][1] == stopped[-1][0]
    assert feed(Segmenter(), [False] * 50) == [] and feed(Segmenter(), [True] * 40)[-1][1] == 40 * 32


def test_audio_round_trips():
    t = np.arange(16_000) / 16_000
    x = (0.5 * np.sin(2 * np.pi * 440 * t)).astype(np.float32)
    assert np.abs(audio.read_wav(audio.write_wav(x)) - x).max() < 1 / 30_000
    assert len(audio.from_s16le(b"\x00\x80\xff")) == 1 and audio.from_s16le(b"\x00\x80")[0] == -1
    up = audio.resample(x, 16_000, 48_000)
    back = audio.resample(up, 48_000, 16_000)
    assert len(up) == 48_000 and np.abs(back[200:-200] - x[200:-200]).max() < 0.01
    assert len(audio.resample(x[:1001], 44_100, 16_000)) == math.ceil(1001 * 160 / 441)
    m = audio.log_mel(x[:1600])
    assert m.shape == (64, 9) and np.isfinite(m).all()
    assert audio.log_mel(np.zeros(1600)).max() == pytest.approx(math.log(1e-9), rel=1e-5)
    assert audio.collapsed(np.eye(3)[[0, 0, 2, 1, 1, 2, 1]], blank=2) == [0, 1, 1]


def test_wav_of_all_kinds_and_broken_ones():
    import io
    import struct
    import wave

    def wav(kind, bits, raw, channels=1, rate=16_000):
        shape = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
        return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<I", 16) + shape + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(raw)) + raw

    x = np.array([0, 0.5, -0.25, -1], np.float32)
    assert np.allclose(audio.read_wav(wav(3, 32, x.astype("<f4").tobytes())), x) and np.allclose(audio.read_wav(wav(3, 64, x.astype("<f8").tobytes())), x)
    assert np.allclose(audio.read_wav(wav(1, 32, (x * 2.0**31).astype("<i8").clip(-(2**31), 2**31 - 1).astype("<i4").tobytes())), x)
    assert np.allclose(audio.read_wav(wav(1, 16, (x * 32768).astype("<i2").tobytes(), channels=2)), [0.25, -0.625])
    for broken in (b"", b"RIFF", wav(1, 16, b"")[:30], wav(7, 8, b"abc"), b"x" * 100):
        with pytest.raises(ValueError):
            audio.read_wav(broken)
    writer = audio.WavWriter()
    for part in (x[:2], x[2:]):
        writer.write(part)
        writer.silence(3)
    with wave.open(io.BytesIO(writer.finish())) as f:
        assert f.getnframes() == 10 and audio.from_s16le(f.readframes(10))[[2, 3, 4, 7, 8, 9]].max() == 0
    decoder = audio.SampleDecoder()
    raw = (x * 32767).astype("<i2").tobytes()
    assert np.array_equal(np.concatenate([decoder.feed(raw[:3]), decoder.feed(raw[3:4]), decoder.feed(raw[4:])]), audio.from_s16le(raw))


def test_snapping_floors_gains_and_rings():
    x = np.full(32_000, 0.5)
    x[15_000:15_400] = 0
    assert audio.snapped(x, [16_000], 1_000) == [15_040 + 160] and audio.snapped(x, [16_000], 16_000) == [16_000]
    assert audio.snapped(x, [], 10) == []
    floor = audio.noise_floor(np.array([0.0, 1.0, 0.5, 1.0]))
    assert np.isnan(floor[0]) and np.allclose(floor[1:], [1.0, 0.85, 0.85 * 1.0023])
    assert np.allclose(audio.gains(np.array([0.008, 0.8, 0.0])), [10, 1, 1]) and audio.gains(np.array([0.04])).tolist() == [2]
    assert audio.hangover(np.array([0, 1, 0, 0, 0], bool), 2).tolist() == [False, True, True, True, False]
    ring = audio.Ring(seconds=1, gap_ms=100)
    ring.feed(0, np.ones(1600))
    ring.feed(150, np.ones(1600))
    assert len(ring.samples) == 4000 and ring.slice(100, 150).max() == 0 and len(ring.slice(-50, 50)) == 800
    ring.feed(5000, np.ones(1600))
    assert ring.start_ms == 5000 and len(ring.samples) == 1600
    ring.feed(5100, np.ones(16_000))
    assert ring.start_ms == 5100 and len(ring.samples) == 16_000


def test_audio_measures():
    rng = np.random.default_rng(0)
    noise = rng.normal(size=16_000) * 0.1
    x = np.concatenate([noise, np.zeros(4800), noise])
    assert len(audio.voiced(np.concatenate([noise * 0.001, noise]))) >= 15_000
    assert 16_000 <= audio.quietest(x) <= 20_800
    curve = rng.normal(size=400)
    assert audio.alignment(curve, np.concatenate([np.zeros(7), curve])[:400], 40) == 7
    assert audio.alignment(curve, rng.normal(size=400), 40) is None
    assert audio.echo_loss(noise, noise * 0.1) == pytest.approx(20, abs=1e-6)
    assert audio.si_sdr(noise * 3, noise) > 80


def test_rechunking_and_jumps():
    from parley.streaming.chunks import Rechunker

    k = Rechunker()
    steady = [c for i in range(10) for c in k.feed(100 + i * 100, [0.1] * 1600)]
    assert [a for a, _ in steady] == [i * 32 for i in range(31)] and all(len(s) == 512 for _, s in steady)
    jumped = [c for i in range(30) for c in k.feed(2100 + i * 100, [0.1] * 1600)]
    starts = [a for a, _ in jumped]
    assert starts[-1] > 4_800 and max(np.diff(starts)) >= 900 and starts == sorted(starts)
    assert len(k.finish()) <= 1


def test_errors_are_split_at_the_boundary():
    from parley.functions.distances import split_errors

    assert split_errors("a b c d".split(), "a x c".split(), 2) == (1, 1)
    assert split_errors("a b".split(), "a b z".split(), 1) == (0, 1)
    assert split_errors("a b".split(), [], 1) == (1, 1)
