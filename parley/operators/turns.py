"""Turns, talk time, and windows over a transcript's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import clock, is_blank, label_order

ORDER = ("start_ms", "id")


def effective_label(mode: str = "me") -> Column:
    """The speaker, else ``me`` for the microphone in that mode, else none."""
    own = F.when((F.col("source") == "mic") & F.lit(mode == "me"), "me")
    return F.coalesce("speaker", own)


def runs(df: DataFrame, label: str, keys: list[str], order: tuple[str, ...] = ORDER) -> DataFrame:
    """``df`` with run: the number, from 1, of the stretch of equal labels (null is a label) in a key's order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"))
    return df.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(w)).drop("_changed")


def speaker_stats(segments: DataFrame, extra: DataFrame | None = None, label: str = "speaker") -> DataFrame:
    """meeting_id, label, talk_ms, turns, segments, first_ms; labels of ``extra`` without segments have zeros."""
    spoken = runs(segments.filter(~is_blank(F.col("text"))), label, ["meeting_id"])
    stats = spoken.groupBy("meeting_id", F.col(label).alias("label")).agg(
        F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("talk_ms"),
        F.countDistinct("run").alias("turns"),
        F.count(F.lit(1)).alias("segments"),
        F.min("start_ms").alias("first_ms"),
    )
    if extra is None:
        return stats
    silent = extra.select("meeting_id", "label").join(stats.select("meeting_id", "label"), ["meeting_id", "label"], "left_anti")
    zeros = silent.select("*", *[F.lit(0).cast("long").alias(c) for c in ("talk_ms", "turns", "segments")], F.lit(None).cast("long").alias("first_ms"))
    return stats.unionByName(zeros)


def display_order(stats: DataFrame) -> DataFrame:
    """Unlabelled last, most talk first, ties by the label's order."""
    return stats.orderBy("meeting_id", F.col("label").isNull(), F.desc("talk_ms"), label_order(F.col("label")))


def share_of_most(stats: DataFrame) -> DataFrame:
    """``stats`` with share: talk time over the meeting's largest."""
    most = F.greatest(F.max("talk_ms").over(Window.partitionBy("meeting_id")), F.lit(1))
    return stats.withColumn("share", F.col("talk_ms") / most)


def previous_of_same_speaker(segments: DataFrame, most_gap_ms: int = 10_000) -> DataFrame:
    """``segments`` with previous_text: of the row just before, if it has the same speaker and is near."""
    key = F.coalesce("speaker", F.concat(F.lit("?"), "source"))
    w = Window.partitionBy("meeting_id").orderBy(*ORDER)
    before = F.lag(F.struct(key.alias("key"), "end_ms", "text")).over(w)
    near = (before["key"] == key) & (F.col("start_ms") - before["end_ms"] <= most_gap_ms)
    return segments.withColumn("previous_text", F.when(near, before["text"]))


def transcript_lines(segments: DataFrame, name: Column) -> DataFrame:
    """Non-blank segments with line: ``[clock] name: text``."""
    return segments.filter(~is_blank(F.col("text"))).withColumn("line", F.concat(F.lit("["), clock(F.col("start_ms")), F.lit("] "), name, F.lit(": "), F.trim("text")))


def newest_within(df: DataFrame, keys: list[str], order: tuple[str, ...], line: str, most_chars: int, most_lines: int | None = None) -> DataFrame:
    """The newest lines of a key within a budget of characters (one more per line) and lines; one at least."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    place, size = F.row_number().over(w), F.sum(F.length(line) + 1).over(w)
    fits = size <= most_chars
    if most_lines is not None:
        fits = fits & (place <= most_lines)
    return df.withColumn("_keep", fits | (place == 1)).filter("_keep").drop("_keep")


def text_of(df: DataFrame, keys: list[str], order: tuple[str, ...], line: str, name: str = "text") -> DataFrame:
    """One text per key, lines in order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(line).alias("_line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["_line"]), "\n").alias(name))


def unanswered(segments: DataFrame, wait_ms: int = 2_500) -> DataFrame:
    """Segments after which nobody else's speech begins for ``wait_ms``."""
    spoken = segments.filter(~is_blank(F.col("text")))
    w = Window.partitionBy("meeting_id").orderBy(*ORDER)
    return spoken.withColumn("_next", F.lead("start_ms").over(w)).filter(F.coalesce(F.col("_next") - F.col("end_ms") >= wait_ms, F.lit(True))).drop("_next")


def count_windows(df: DataFrame, keys: list[str], order: tuple[str, ...], value: str, size: int) -> DataFrame:
    """Root mean square of every full window of ``size`` values, by window number from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("window", F.floor((F.row_number().over(w) - 1) / size))
    squares = numbered.groupBy(*keys, "window").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value) * F.col(value)).alias("_s"))
    return squares.filter(F.col("n") == size).select(*keys, "window", F.sqrt(F.col("_s") / size).alias("rms"))


def smoothed(df: DataFrame, keys: list[str], order: tuple[str, ...], value: Column, start: float, keep: float, name: str) -> DataFrame:
    """Exponentially weighted mean of a key's values in order: keep * old + (1 - keep) * new."""
    rows = F.sort_array(F.collect_list(F.struct(*order, value.cast("double").alias("_v"))))
    return df.groupBy(*keys).agg(F.aggregate(rows, F.lit(start), lambda s, r: F.lit(keep) * s + F.lit(1 - keep) * r["_v"]).alias(name))
