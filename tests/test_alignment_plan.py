"""Frames of a table are dealt out once a source, and odd meetings keep their frames."""

import datetime

from parley.streaming import alignment

CHUNKS = "meeting_id long, source string, ts timestamp, samples array<float>"
START = datetime.datetime(2024, 5, 1, 9, 0, 0)


def test_frames_of_a_table_are_shuffled_once_a_source(spark):
    rows = [(1, s, START, [1.0] * 400) for s in ("mic", "system")]
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = alignment.aligned_chunks(spark.createDataFrame(rows, CHUNKS))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in plan


def test_meetings_without_id_hear_silence_and_repeated_chunks_count_once(spark):
    later = START + datetime.timedelta(milliseconds=10)
    rows = [(m, s, t, [v] * 160) for m in (None, 1) for s, t, v in (("mic", START, 1.0), ("mic", START, 1.0), ("mic", later, 2.0), ("system", START, 3.0), ("system", START, 3.0))]
    found = alignment.aligned_chunks(spark.createDataFrame(rows, CHUNKS).repartition(3))
    assert found.columns == ["meeting_id", "frame_ts", "frame", "first", "n_real", "samples", "reference"]
    got = sorted((r.meeting_id or 0, r.frame_ts, r.first, r.n_real, r.samples, r.reference) for r in found.collect())
    assert got == [(m, t, 0, 160, [v] * 160, [w] * 160) for m, t, v, w in ((0, START, 1.0, 0.0), (0, later, 2.0, 0.0), (1, START, 1.0, 3.0), (1, later, 2.0, 0.0))]
