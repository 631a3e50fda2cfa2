"""The log of requests about a meeting: what each request adds, when requests fail, fork, or start the log anew.

A live request that is answered, and a rollover, are versions; a request that fails leaves none. A request's parent
is the last version finished before it. Versions cover ranges of the meeting's clock, so what a request adds is a
join of ranges: the lines after its parent began and up to itself, with labels and names as they were then, and a note
for every label that the log has named otherwise. A fork adds the same to its parent but is no version, so its lines
and notes come again; lines of a request that failed do so too. A rollover's seed is the newest lines that fit.

Tables, all with meeting_id and whole-number times ``at`` that differ within a meeting: segments (at, id, label,
start_ms, text, is_final), names (at, label, name; blank takes the name away), relabels (at, id, label) and requests
(n, at, done_at, kind live, fork or rollover, ok, task, reply; of rollovers summary and most_chars).

Cases: only the first final with text of an id is a line; a request that is never done is no version; null
labels are shown as unknown and never noted; an id relabelled before it is a line keeps its own label; a meeting without lines has requests without updates; rows
without meeting or time take no part; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.display import rename_note
from parley.functions.text import default_name, is_blank, label_order
from parley.operators.intervals import overlap_join
from parley.operators.ranks import running_total
from parley.operators.turns import transcript_lines

KEYS = ["meeting_id", "n"]
# The tags and sentences of the parts of a request.
UPDATE_TAG, NAMES_TAG, EARLIER_TAG, RECENT_TAG, SUMMARY_TAG = "transcript_update", "speaker_names", "earlier_in_meeting", "recent_transcript", "summary_so_far"
LONG_AGO = "Встреча идёт давно. Начало разговора сжато, чтобы уместиться в контекст: сначала резюме, потом последние реплики до этого момента."
UNDER_WAY = "Встреча уже идёт. Ниже — расшифровка до этого момента."
NO_SUMMARY = "Резюме ранней части нет; более ранние реплики сюда не вошли."
NOTHING_YET = "(пока пусто)"


def tagged(tag: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>\n"), text, F.lit(f"\n</{tag}>"))


def lines_of(segments: DataFrame) -> DataFrame:
    """meeting_id, id, at, label, start_ms, text: the first final with text of each id."""
    finals = segments.filter(F.col("is_final") & ~is_blank(F.col("text")) & F.col("at").isNotNull() & F.col("meeting_id").isNotNull())
    first = finals.groupBy("meeting_id", "id").agg(F.min(F.struct("at", "label", "start_ms", "text")).alias("s"))
    return first.select("meeting_id", "id", "s.*")


def with_parents(requests: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """``requests`` with parent (n) and parent_at of the version that each continues, and epoch, the rollovers before it; parent_x for each (whole-number) x carried."""
    own = requests.filter(F.col("at").isNotNull() & F.col("meeting_id").isNotNull())
    rollover = F.col("kind") == "rollover"
    fields = ["n", "at", *carried]
    version, kind = F.struct(*fields), f"struct<{','.join(f'{c}:long' for c in fields)}>"
    asked = own.withColumns({"_time": F.struct(F.col("at").alias("t"), F.lit(1).alias("o")), "_version": F.lit(None).cast(kind), "_rolled": F.lit(0)})
    kept = own.filter(rollover | ((F.col("kind") == "live") & F.col("ok") & F.col("done_at").isNotNull()))
    done = kept.select("meeting_id", F.struct(F.when(rollover, F.col("at")).otherwise(F.col("done_at")).alias("t"), F.when(rollover, 2).otherwise(0).alias("o")).alias("_time"), version.alias("_version"), rollover.cast("int").alias("_rolled"))
    w = Window.partitionBy("meeting_id").orderBy("_time").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(done.withColumn("_version", F.col("_version").cast(kind)), allowMissingColumns=True)
    seen = both.withColumns({"_parent": F.last("_version", ignorenulls=True).over(w), "epoch": F.sum("_rolled").over(w)})
    return seen.filter(F.col("_version").isNull()).select(*requests.columns, F.col("_parent.n").alias("parent"), *[F.col(f"_parent.{c}").alias(f"parent_{c}") for c in fields[1:]], "epoch")


def as_of(points: DataFrame, events: DataFrame, keys: list[str], at: Column, value: str, name: str) -> DataFrame:
    """``points`` with ``name``: the value of the last event of their keys at or before ``at``; one sort, no range join."""
    told = events.dropna(subset=[*keys, "at"]).select(*keys, F.col("at").alias("_t"), F.lit(0).alias("_o"), F.struct(F.col(value).alias("x")).alias("_told"))
    asked = points.select(*keys, at.alias("_t"), F.lit(1).alias("_o"), F.struct(*points.columns).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    seen = told.unionByName(asked, allowMissingColumns=True).withColumn("_told", F.last("_told", ignorenulls=True).over(w))
    return seen.filter("_o = 1").select("_row.*", F.col("_told.x").alias(name))


def shown_name(points: DataFrame, names: DataFrame, at: Column, name: str) -> DataFrame:
    """``points`` (meeting_id, label) with ``name``, what the label was called at a time."""
    given = as_of(points, names, ["meeting_id", "label"], at, "name", "_given")
    return given.withColumn(name, F.coalesce(F.nullif(F.trim("_given"), F.lit("")), default_name(F.col("label")))).drop("_given")


def labelled(lines: DataFrame, relabels: DataFrame, at: Column) -> DataFrame:
    """``lines`` with label as it was at a time."""
    now = as_of(lines, relabels.select("meeting_id", "id", "at", F.struct("label", F.col("at").alias("told")).alias("to")), ["meeting_id", "id"], at, "to", "_to")
    return now.withColumn("label", F.when(F.col("_to.told") >= F.col("at"), F.col("_to.label")).otherwise(F.col("label"))).drop("_to")


def rendered(lines: DataFrame, names: DataFrame, relabels: DataFrame, at: Column) -> DataFrame:
    """``lines`` with label, name and line as they were at a time."""
    return transcript_lines(shown_name(labelled(lines, relabels, at), names, at, "name"), F.col("name"))


def update_lines(segments: DataFrame, names: DataFrame, relabels: DataFrame, parents: DataFrame, bucket: int = 10_000) -> DataFrame:
    """meeting_id, n, id, start_ms, label, line: the lines that each live request or fork adds to its parent."""
    asked = parents.filter("kind <> 'rollover'").select("meeting_id", "n", F.col("at").alias("asked_at"), (F.coalesce("parent_at", F.lit(-1)) + 1).alias("since"))
    own = lines_of(segments)
    met = overlap_join(own, asked, ["meeting_id"], (F.col("at"), F.col("at")), (F.col("since"), F.col("asked_at")), bucket)
    return rendered(met, names, relabels, F.col("asked_at")).select(*KEYS, "id", "start_ms", "label", "line")


def seed_lines(segments: DataFrame, names: DataFrame, relabels: DataFrame, parents: DataFrame, bucket: int = 10_000) -> DataFrame:
    """meeting_id, n, id, start_ms, label, line, carried: all lines up to each rollover, and whether its seed has them."""
    rolled = parents.filter("kind = 'rollover'").select("meeting_id", "n", F.col("at").alias("asked_at"), F.coalesce("most_chars", F.lit(0)).alias("most_chars"))
    met = overlap_join(lines_of(segments), rolled, ["meeting_id"], (F.col("at"), F.col("at")), (F.lit(0), F.col("asked_at")), bucket)
    sized = rendered(met, names, relabels, F.col("asked_at"))
    size = (F.length("line") + 1).cast("long")
    used = running_total(sized, KEYS, [F.desc("start_ms"), F.desc("id")], size, "_used")
    return used.select(*KEYS, "id", "start_ms", "label", "line", ((F.col("_used") <= F.col("most_chars")) | (F.col("_used") == size)).alias("carried"))


def with_lines_before(requests: DataFrame, own: DataFrame, names: DataFrame, relabels: DataFrame) -> DataFrame:
    """``requests`` with upto, how many lines there are by then, and most_size, which all of them do not exceed whatever their labels are called."""
    called = names.select("meeting_id", F.length(F.trim("name")).alias("l"))
    for rows in (own, relabels):
        called = called.unionByName(rows.select("meeting_id", F.length(default_name(F.col("label"))).alias("l")))
    longest = called.groupBy("meeting_id").agg(F.max("l").alias("_longest"))
    sized = transcript_lines(own, F.lit("")).join(longest, "meeting_id").select("meeting_id", F.col("at").alias("_t"), F.lit(0).alias("_o"), (F.length("line") + 1 + F.coalesce("_longest", F.lit(0))).cast("long").alias("_size"))
    asked = requests.filter("at IS NOT NULL AND meeting_id IS NOT NULL").select("meeting_id", F.col("at").alias("_t"), F.lit(1).alias("_o"), F.struct(*requests.columns).alias("_row"))
    w = Window.partitionBy("meeting_id").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    seen = sized.unionByName(asked, allowMissingColumns=True).withColumns({"upto": F.count("_size").over(w), "most_size": F.coalesce(F.sum("_size").over(w), F.lit(0))})
    return seen.filter("_o = 1").select("_row.*", "upto", "most_size")


def label_spans(own: DataFrame, relabels: DataFrame) -> DataFrame:
    """meeting_id, label, since, until: when lines have which label; the last label of a line has no end."""
    given = own.select("meeting_id", "id", "at", "label", F.lit(0).alias("_o"))
    told = relabels.dropna(subset=["meeting_id", "id", "at"]).join(own.select("meeting_id", "id", F.col("at").alias("_since")), ["meeting_id", "id"]).filter(F.col("at") >= F.col("_since"))
    w = Window.partitionBy("meeting_id", "id").orderBy("at", "_o")
    both = given.unionByName(told.select("meeting_id", "id", "at", "label", F.lit(1).alias("_o"))).withColumn("until", F.lead("at").over(w))
    return both.filter("label IS NOT NULL AND (until IS NULL OR until > at)").select("meeting_id", "label", F.col("at").alias("since"), "until")


def first_told(own: DataFrame, relabels: DataFrame, parents: DataFrame, seeds: DataFrame, bucket: int = 10_000) -> DataFrame:
    """meeting_id, label, told_at: when the first version that names a label began.

    Live versions meet the lines they add, ``seeds`` are the lines of rollovers that drop some. A rollover with all lines
    names each label that a line has at its time, so of each span of a label only the next such rollover counts.
    """
    live = parents.filter("kind = 'live' AND ok AND done_at IS NOT NULL").select("meeting_id", F.col("at").alias("asked_at"), (F.coalesce("parent_at", F.lit(-1)) + 1).alias("since"))
    lines = own.select("meeting_id", "id", "at", "label")
    added = labelled(overlap_join(lines, live, ["meeting_id"], (F.col("at"), F.col("at")), (F.col("since"), F.col("asked_at")), bucket), relabels, F.col("asked_at")).select("meeting_id", "label", F.col("asked_at").alias("told_at"))
    part = seeds.filter("carried").join(parents.select(*KEYS, F.col("at").alias("told_at")), KEYS).select("meeting_id", "label", "told_at")
    spans = label_spans(own, relabels).select("meeting_id", F.col("since").alias("_t"), F.lit(0).alias("_o"), "label", "until")
    rolled = parents.filter("whole").select("meeting_id", F.col("at").alias("_t"), F.lit(1).alias("_o"), F.col("at").alias("told_at"))
    w = Window.partitionBy("meeting_id").orderBy(F.desc("_t"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0)
    next_one = spans.unionByName(rolled, allowMissingColumns=True).withColumn("told_at", F.last("told_at", ignorenulls=True).over(w))
    whole = next_one.filter("_o = 0 AND told_at IS NOT NULL AND (until IS NULL OR told_at < until)").select("meeting_id", "label", "told_at")
    return added.unionByName(part).unionByName(whole).filter("label IS NOT NULL").groupBy("meeting_id", "label").agg(F.min("told_at").alias("told_at"))


def update_notes(told: DataFrame, names: DataFrame, parents: DataFrame) -> DataFrame:
    """meeting_id, n, label, note: labels that a request's parent or an earlier version named otherwise than they are called now."""
    asked = parents.filter("kind <> 'rollover' AND parent_at IS NOT NULL").select("meeting_id", "n", F.col("at").alias("asked_at"), "parent_at")
    met = asked.join(told, "meeting_id").filter(F.col("told_at") <= F.col("parent_at"))
    both = shown_name(shown_name(met, names, F.col("parent_at"), "before"), names, F.col("asked_at"), "after")
    return both.filter(F.col("before") != F.col("after")).select(*KEYS, "label", rename_note(F.col("before"), F.col("after"), F.col("after") == default_name(F.col("label"))).alias("note"))


def _text(rows: DataFrame, order: list[Column], line: str, name: str) -> DataFrame:
    """One text of a request's lines in order."""
    listed = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(line).alias("line"))))
    return rows.groupBy(*KEYS).agg(F.array_join(F.transform(listed, lambda r: r["line"]), "\n").alias(name))


def counted(segments: DataFrame, names: DataFrame, relabels: DataFrame, requests: DataFrame, bucket: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """``requests`` with parent, parent_at, epoch, lines, dropped and notes, and the notes themselves; without any text.

    Numbers of lines are differences of running counts. Only rollovers whose lines may not all fit meet them one by one.
    """
    own = lines_of(segments).filter("at >= 0")
    parents = with_parents(with_lines_before(requests, own, names, relabels), ("upto",))
    parents = parents.withColumn("whole", (F.col("kind") == "rollover") & (F.col("most_size") <= F.coalesce("most_chars", F.lit(0))))
    seeds = seed_lines(segments, names, relabels, parents.filter("NOT whole"), bucket)
    notes = update_notes(first_told(own, relabels, parents, seeds, bucket), names, parents)
    cut = seeds.groupBy(*KEYS).agg(F.count_if("carried").alias("_cut"), F.count_if(~F.col("carried")).alias("dropped"))
    noted = notes.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("notes"))
    added = F.when(F.col("kind") == "rollover", F.col("upto")).otherwise(F.col("upto") - F.coalesce("parent_upto", F.lit(0)))
    found = parents.join(cut, KEYS, "left").join(noted, KEYS, "left").withColumn("lines", F.coalesce("_cut", added)).na.fill(0, ["dropped", "notes"])
    return found.select(*requests.columns, "parent", "parent_at", "epoch", "lines", "dropped", "notes"), notes


def request_counts(segments: DataFrame, names: DataFrame, relabels: DataFrame, requests: DataFrame, bucket: int = 10_000) -> DataFrame:
    """``requests`` with parent, parent_at, epoch, lines, dropped and notes, as ``conversation`` has them."""
    return counted(segments, names, relabels, requests, bucket)[0]


def conversation(segments: DataFrame, names: DataFrame, relabels: DataFrame, requests: DataFrame, context_chars: int = 0, bucket: int = 10_000) -> DataFrame:
    """``requests`` with parent, epoch, text (of a live request or fork its turn, of a rollover the seed), lines, dropped, notes and prompt_chars.

    prompt_chars counts the context, the epoch's earlier turns and replies up to the parent, and the request's own text.
    """
    parents, notes = counted(segments, names, relabels, requests, bucket)
    updates = update_lines(segments, names, relabels, parents, bucket)
    seeds = seed_lines(segments, names, relabels, parents, bucket)
    order = [F.col("start_ms"), F.col("id")]
    texts = _text(updates, order, "line", "_lines").unionByName(_text(seeds.filter("carried"), order, "line", "_lines"))
    whole = parents
    for part in (texts, _text(notes, [label_order(F.col("label"))], "note", "_notes")):
        whole = whole.join(part, KEYS, "left")
    summary = F.nullif(F.trim("summary"), F.lit(""))
    turn = F.concat_ws("\n", F.when(F.col("_notes").isNotNull(), tagged(NAMES_TAG, F.col("_notes"))), F.when(F.col("_lines").isNotNull(), tagged(UPDATE_TAG, F.col("_lines"))), F.col("task"))
    seed = F.concat_ws(
        "\n",
        F.when(F.col("dropped") > 0, LONG_AGO).otherwise(UNDER_WAY),
        F.when(summary.isNotNull(), tagged(SUMMARY_TAG, summary)),
        F.when((F.col("dropped") > 0) & summary.isNull(), NO_SUMMARY),
        tagged(RECENT_TAG, F.coalesce("_lines", F.lit(NOTHING_YET))),
    )
    told = whole.withColumn("text", F.when(F.col("kind") == "rollover", tagged(EARLIER_TAG, seed)).otherwise(turn)).drop("_lines", "_notes")
    kept = (F.col("kind") == "rollover") | ((F.col("kind") == "live") & F.col("ok") & F.col("done_at").isNotNull())
    epoch = F.col("epoch") + (F.col("kind") == "rollover").cast("int")  # a rollover begins the next one
    sizes = told.filter(kept).select("meeting_id", "n", "at", epoch.alias("e"), (F.length("text") + F.when(F.col("kind") == "live", F.coalesce(F.length(F.trim("reply")), F.lit(0))).otherwise(0)).cast("long").alias("size"))
    history = sizes.select("meeting_id", F.col("n").alias("parent"), F.sum("size").over(Window.partitionBy("meeting_id", "e").orderBy("at")).alias("_history"))
    asked = told.join(history, ["meeting_id", "parent"], "left")
    own = F.length("text") + context_chars
    return asked.withColumn("prompt_chars", F.when(F.col("kind") == "rollover", own).otherwise(own + F.coalesce("_history", F.lit(0))).cast("long")).drop("_history")
