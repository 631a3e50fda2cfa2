"""Counts of the log of requests come from running counts; rollovers that keep all lines meet none of them one by one."""

from parley.operators import conversation


def test_rollovers_that_keep_all_lines_are_not_paired_with_them(spark, monkeypatch):
    paired, pairs = [], conversation.seed_lines
    monkeypatch.setattr(conversation, "seed_lines", lambda s, n, r, parents, b: paired.append({x.n for x in parents.filter("kind = 'rollover'").collect()}) or pairs(s, n, r, parents, b))
    segments = spark.createDataFrame([(1, 10 * k, f"s{k}", "sys:1" if k % 2 else "sys:2", 1000 * k, "word", True) for k in range(1, 40)], "meeting_id long, at long, id string, label string, start_ms long, text string, is_final boolean")
    names = spark.createDataFrame([(1, 105, "sys:1", "Ann"), (1, 225, "sys:3", "Bo")], "meeting_id long, at long, label string, name string")
    relabels = spark.createDataFrame([(1, 115, "s2", "sys:3")], "meeting_id long, at long, id string, label string")
    asked = [(1, 51, "live", None), (2, 101, "rollover", 1 << 30), (3, 151, "rollover", 40), (4, 201, "rollover", 1 << 30), (5, 251, "live", None)]
    requests = spark.createDataFrame([(1, n, at, at + 1, kind, True, "t", "r", None, most) for n, at, kind, most in asked], "meeting_id long, n long, at long, done_at long, kind string, ok boolean, task string, reply string, summary string, most_chars long")
    got = {r.n: (r.parent, r.epoch, r.lines, r.dropped, r.notes) for r in conversation.request_counts(segments, names, relabels, requests).collect()}
    assert got == {1: (None, 0, 5, 0, 0), 2: (1, 0, 10, 0, 0), 3: (2, 1, 1, 14, 0), 4: (3, 2, 20, 0, 0), 5: (4, 3, 5, 0, 1)}
    assert paired == [{3}]
