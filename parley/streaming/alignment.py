"""A microphone and a call on one clock: frames of 10 ms, each with what the call played then.

Chunks of both sources are cut at the session clock's frame borders and put together to frames. A
microphone frame meets the call's frame of the same time, or silence where there is none: a left outer
join, of streams by two watermarks. It waits until the newest microphone frame is ``WAIT_MS`` past it;
a microphone that lags behind the call is waited for up to ``AHEAD_MS``. So the latency is bounded
even if the call stops, and a call's gap of any length becomes silence.

Cases: samples that a source gives twice count once, as in the chunk that began first; samples that a
frame lacks are silence, ``n_real`` says how many the microphone gave and ``first`` where they begin; a
chunk without samples or time takes no part; a source of neither name is left out; further columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE, FRAME = 16_000, 160
WAIT_MS, AHEAD_MS = 150, 5_000
#: Samples by which an echo canceller's output lags behind its input.
LATENCY = 288


def _position(ts: Column) -> Column:
    """A time as samples since the epoch, to the nearest."""
    return ((F.unix_micros(ts) * 16 + 500) / 1000).cast("long")


def _samples(pieces: Column) -> Column:
    """Start (in the frame) and samples of a frame from its pieces: earlier chunks first, gaps as silence."""
    silence = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)

    def add(done: Column, piece: Column) -> Column:
        end = done["first"] + F.size(done["samples"])
        gap = F.greatest(piece["offset"] - end, F.lit(0))
        told = F.greatest(end - piece["offset"], F.lit(0))  # samples of the piece that are there already
        rest = F.slice(piece["samples"], told + 1, F.greatest(F.size(piece["samples"]) - told, F.lit(0)))
        return F.struct(done["first"].alias("first"), F.concat(done["samples"], silence(gap), rest).alias("samples"), (done["real"] + F.size(rest)).alias("real"))

    ordered = F.array_sort(pieces)
    start = F.struct(ordered[0]["offset"].alias("first"), F.array().cast("array<float>").alias("samples"), F.lit(0).alias("real"))
    return F.aggregate(ordered, start, add)


def frames(chunks: DataFrame, source: str, delay: str) -> DataFrame:
    """One source's frames: meeting_id, frame_ts, frame, first, n_real, samples (``FRAME`` of them)."""
    at, n = F.col("position"), F.size("samples").cast("long")
    cut = (
        chunks.filter((F.col("source") == source) & F.col("ts").isNotNull() & (F.size("samples") > 0))
        .select("meeting_id", _position(F.col("ts")).alias("position"), F.col("samples").cast("array<float>").alias("samples"))
        .withColumn("frame", F.explode(F.sequence(F.floor(at / FRAME), F.floor((at + n - 1) / FRAME))))
    )
    low, high = F.greatest(at, F.col("frame") * FRAME), F.least(at + n, (F.col("frame") + 1) * FRAME)
    piece = F.struct(
        at.alias("position"),
        (low - F.col("frame") * FRAME).cast("int").alias("offset"),
        F.slice("samples", (low - at + 1).cast("int"), (high - low).cast("int")).alias("samples"),
    )
    placed = cut.select("meeting_id", "frame", F.timestamp_micros(F.col("frame") * 10_000).alias("frame_ts"), piece.alias("piece")).withWatermark("frame_ts", delay)
    joined = placed.groupBy("meeting_id", "frame_ts", "frame").agg(F.collect_list("piece").alias("pieces"))
    made = joined.withColumn("made", _samples(F.col("pieces")))
    zero = F.lit(0.0).cast("float")
    whole = F.concat(F.array_repeat(zero, F.col("made.first")), F.col("made.samples"), F.array_repeat(zero, FRAME - F.col("made.first") - F.size("made.samples")))
    return made.select("meeting_id", "frame_ts", "frame", F.col("made.first").alias("first"), F.col("made.real").alias("n_real"), whole.alias("samples"))


def aligned_chunks(chunks: DataFrame, wait_ms: int = WAIT_MS, ahead_ms: int = AHEAD_MS) -> DataFrame:
    """Microphone frames of ``chunks`` (meeting_id, source, ts, samples) with the call's: meeting_id, frame_ts, frame, first, n_real, samples, reference.

    A table or a stream. A stream's watermark is its sources' later one (``multipleWatermarkPolicy`` is set to max).
    """
    if chunks.isStreaming:
        chunks.sparkSession.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")
    near = frames(chunks, "mic", f"{wait_ms} milliseconds")
    # a table's frames meet by all keys that they were put together by, and so stay where they are; a stream's state keeps its keys
    keys = ["meeting_id", "frame_ts"] if chunks.isStreaming else ["meeting_id", "frame_ts", "frame"]
    far = frames(chunks, "system", f"{ahead_ms} milliseconds").select(*keys, F.col("samples").alias("reference"))
    silence = F.array_repeat(F.lit(0.0).cast("float"), FRAME)
    return near.join(far, keys, "left").withColumn("reference", F.coalesce("reference", silence))


def restamped(fed: DataFrame, outputs: DataFrame, keys: list[str], latency: int = LATENCY) -> DataFrame:
    """A canceller's outputs at the times of their inputs: keys, ordinal, frame, position, samples.

    ``fed`` holds the frames that went in (keys, ordinal from 0, frame, first, n_real), ``outputs`` the
    ``FRAME`` samples that came out at each ordinal, those of the padding that flushed the last ones included. Output
    sample k belongs to input sample k - ``latency``, so a frame's come from two outputs; what came of padding goes.
    """
    late, rest = divmod(latency, FRAME)
    head = outputs.select(*keys, (F.col("ordinal") - late).alias("ordinal"), F.slice("samples", rest + 1, FRAME - rest).alias("head"))
    tail = outputs.select(*keys, (F.col("ordinal") - late - 1).alias("ordinal"), F.slice("samples", 1, rest).alias("tail"))
    met = fed.join(head, [*keys, "ordinal"], "left").join(tail, [*keys, "ordinal"], "left")
    whole = F.concat("head", "tail") if rest else F.col("head")
    return met.select(*keys, "ordinal", "frame", (F.col("frame") * FRAME + F.col("first")).alias("position"), F.slice(whole, F.col("first") + 1, F.col("n_real")).alias("samples"))
