"""What the assistant decides: automatic hints, due tasks, budgets, and checked suggestions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import default_name, label_order, tokens
from parley.functions.questions import question_reason

LEAST_WORDS, NAMED_LEAST_WORDS = 3, 2
WAIT_MS, NAMED_WAIT_MS = 20_000, 8_000


def observed(segments: DataFrame) -> DataFrame:
    """``segments`` with words and reason, so that the decisions need no text."""
    return segments.withColumn("words", F.size(tokens(F.col("text"))).cast("long")).withColumn("reason", question_reason(F.col("text")))


def decide(row: dict, last_ms: int | None) -> tuple[str, str]:
    """fire, wait or skip, and why, for one final (columns mode, own, busy, words, reason, named_here, named_before, vocative)."""
    question = row["reason"] is not None
    gone = float("inf") if last_ms is None else row["end_ms"] - last_ms
    if row["mode"] == "off":
        return "skip", "off"
    if row["own"]:
        return "skip", "own speech"
    if row["mode"] == "addressed":
        if (row["named_here"] or row["named_before"]) and (question or row["vocative"]):
            if row["words"] < NAMED_LEAST_WORDS and not row["named_before"]:
                return "skip", "too short"
            if row["busy"]:
                return "skip", "busy"
            return ("fire", "named") if gone >= NAMED_WAIT_MS else ("skip", "too soon")
        if row["words"] < LEAST_WORDS:
            return "skip", "too short"
        if not question:
            return "skip", "not a question"
        return ("wait", "silence") if gone >= WAIT_MS else ("skip", "too soon")
    if row["words"] < LEAST_WORDS:
        return "skip", "too short"
    if not question:
        return "skip", "not a question"
    if row["busy"]:
        return "skip", "busy"
    return ("fire", "question") if gone >= WAIT_MS else ("skip", "too soon")


def hints(finals: DataFrame) -> DataFrame:
    """meeting_id, id, decision, why of all finals: a fold, as each decision depends on the last hint fired."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        last, out = None, []
        for row in rows.sort_values(["start_ms", "id"]).to_dict("records"):
            row["reason"] = row["reason"] if isinstance(row["reason"], str) else None
            decision = decide(row, last)
            last = row["end_ms"] if decision[0] == "fire" else last
            out.append((row["meeting_id"], row["id"], *decision))
        return pd.DataFrame(out, columns=["meeting_id", "id", "decision", "why"])

    kind = dict(finals.dtypes)["meeting_id"]
    return finals.groupBy("meeting_id").applyInPandas(run, f"meeting_id {kind}, id string, decision string, why string")


def debounced(times: Column, apart_ms: int) -> Column:
    """Of sorted times those that are ``apart_ms`` after the last one kept."""
    start = F.array().cast("array<bigint>")
    return F.aggregate(times, start, lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) >= apart_ms), F.array_append(kept, t)).otherwise(kept))


def summary_due(now_ms: Column, last_ms: Column, fresh: Column, every_minutes: int, least_fresh: int = 1) -> Column:
    """Whether a rolling summary is due: so many minutes after the last one, with something new."""
    return (F.lit(every_minutes) > 0) & (fresh >= least_fresh) & (now_ms - F.coalesce(last_ms, F.lit(0)) >= every_minutes * 60_000)


def context_state(turns: DataFrame, window: int, start_ratio: float = 0.5, prepare: float = 0.55, roll: float = 0.7) -> DataFrame:
    """Per turn (meeting_id, n, chars, real_tokens or null) the estimated tokens and whether to prepare or roll over.

    The ratio of tokens to characters is the last response's.
    """
    w = Window.partitionBy("meeting_id").orderBy("n")
    known = F.last(F.when(F.col("real_tokens").isNotNull() & (F.col("chars") > 0), F.col("real_tokens") / F.col("chars")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    estimate = F.ceil(F.sum("chars").over(w) * F.coalesce(known, F.lit(start_ratio)))
    state = F.when(estimate > roll * window, "roll").when(estimate > prepare * window, "prepare").otherwise("keep")
    return turns.withColumn("tokens", estimate).withColumn("state", state)


def outer_json(reply: Column) -> Column:
    """The reply if it is JSON, else what stands between its first and last brace, else null."""
    inner = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.when(F.get_json_object(reply, "$").isNotNull(), reply).when((inner != "") & F.get_json_object(inner, "$").isNotNull(), inner)


SUGGESTIONS = "suggestions array<struct<label:string,name:string,evidence:string,confidence:double>>"


def suggestions(replies: DataFrame, allowed: DataFrame, rejected: DataFrame, least: float = 0.6) -> DataFrame:
    """meeting_id, label, name, evidence, confidence: the best valid name for each allowed label.

    A name is one to 40 letters, blanks, dots, dashes or apostrophes that begin with a letter, not a default name, and not rejected for the label.
    """
    rows = replies.select("meeting_id", F.posexplode(F.from_json(outer_json(F.col("reply")), SUGGESTIONS)["suggestions"]).alias("pos", "s")).select("meeting_id", "pos", "s.*")
    name = F.trim(F.regexp_replace("name", r"(?U)\s+", " "))
    ok = name.rlike(r"^\p{L}[\p{L} .'’-]{0,39}$") & (name != default_name(F.col("label"))) & ~name.rlike(r"^(?:Участник|Зал|Я)(?: \d+)?$")
    fine = rows.withColumn("name", name).withColumn("confidence", F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).filter(ok & (F.col("confidence") >= least))
    fine = fine.join(allowed, ["meeting_id", "label"], "left_semi")
    no = rejected.select("meeting_id", "label", F.lower("name").alias("_no"))
    fine = fine.join(no, (fine.meeting_id == no.meeting_id) & (fine.label == no.label) & (F.lower(fine.name) == F.col("_no")), "left_anti")
    w = Window.partitionBy("meeting_id", "label").orderBy(F.desc("confidence"), "pos")
    best = fine.withColumn("_place", F.row_number().over(w)).filter("_place = 1")
    return best.orderBy("meeting_id", label_order(F.col("label"))).select("meeting_id", "label", "name", "evidence", "confidence")


def merged_settings(saved: Column, defaults: dict[str, str]) -> Column:
    """A JSON object over defaults: saved keys win, unknown ones stay; what is no object counts as empty."""
    given = F.from_json(F.when(F.trim(saved).startswith("{"), saved), "map<string,string>")
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    known = F.map_filter(base, lambda k, _: ~F.coalesce(F.map_contains_key(given, k), F.lit(False)))
    return F.map_concat(known, F.coalesce(given, F.create_map().cast("map<string,string>")))
