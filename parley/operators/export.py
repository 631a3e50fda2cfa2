"""Meetings and results as Markdown, one row per document, written by Spark's text writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.display import date_and_time
from parley.functions.text import is_blank
from parley.operators import store, turns


def meeting_markdown(meetings: DataFrame, segments: DataFrame, notes: DataFrame, name: Column) -> DataFrame:
    """id, text: title, date, the final summary (else the rolling one) and the transcript of each meeting.

    ``name`` gives a segment's speaker.
    """
    lines = turns.transcript_lines(segments, name).withColumn("line", F.concat("line", F.lit("  ")))
    transcript = turns.text_of(lines, ["meeting_id"], turns.ORDER, "line", "transcript")
    last = store.latest_notes(notes.filter(F.col("kind").isin("final", "summary") & ~is_blank(F.col("content"))))
    text = lambda kind: F.max(F.when(F.col("kind") == kind, F.trim("content")))
    summaries = last.groupBy("meeting_id").agg(text("final").alias("final"), text("summary").alias("rolling"))
    joined = meetings.select(F.col("id").alias("meeting_id"), "title", "started_at").join(transcript, "meeting_id", "left").join(summaries, "meeting_id", "left")
    title = F.concat(F.lit("# "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Встреча")))
    date = F.concat(F.lit("_"), date_and_time(F.try_to_timestamp("started_at")), F.lit("_"))
    summary = F.coalesce("final", F.concat(F.lit("## Резюме по ходу встречи\n\n"), F.col("rolling")))
    said = F.concat(F.lit("## Расшифровка\n\n"), F.col("transcript"))
    return joined.select(F.col("meeting_id").alias("id"), F.concat(F.concat_ws("\n\n", title, date, summary, said), F.lit("\n")).alias("text"))


def write_results(results: DataFrame, path: str) -> None:
    """Write result rows as JSON, a folder for each model, replacing those of the models at hand only."""
    results.withColumn("folder", F.col("model")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("folder").json(path)


def result_table(items: DataFrame, row: str, column: str, columns: list[str], value: Column) -> DataFrame:
    """place, line of a Markdown table: a row per ``row``, the listed columns, a dash where nothing was measured."""
    cells = items.groupBy(row).pivot(column, columns).agg(F.first(value))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(row), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("–")) for c in columns]), F.lit(" |"))
    head = items.sparkSession.createDataFrame([(0, "", f"| {row} | {' | '.join(columns)} |"), (1, "", "|" + "-|" * (len(columns) + 1))], "place int, name string, line string")
    return head.unionByName(cells.select(F.lit(2).alias("place"), F.col(row).alias("name"), line.alias("line"))).orderBy("place", "name").select("place", "line")
