"""The state of a running meeting as views over its event log, and what is due next.

Logs have a sequence column ``_seq`` in order of arrival. Every view is a window or an aggregate over
a meeting or an utterance, so meetings spread over the cluster and an utterance is one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import clean, default_name, folded, has_kazakh_letters, is_blank, is_skip, may_be_skip

SUGGEST_MINUTES, SUGGEST_FINALS = 4, 4


def without_noise(segments: DataFrame) -> DataFrame:
    """Segments whose text is cleared if it is one character at most and they last under 800 ms."""
    noise = (F.length(clean(F.col("text"))) <= 1) & (F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)) < 800)
    return segments.withColumn("text", F.when(noise, "").otherwise(F.col("text")))


def with_headset(segments: DataFrame, mode: str = "me") -> DataFrame:
    """In a headset's mode the microphone is always the user."""
    return segments.withColumn("speaker", F.when((F.col("source") == "mic") & F.lit(mode == "me"), "me").otherwise(F.col("speaker")))


def is_own(label: Column, custom_name: Column, my_names: Column) -> Column:
    """Whether a label is the user's: by itself, or by a custom name that is one of the user's."""
    mine = F.exists(my_names, lambda n: folded(n) == folded(custom_name))
    return F.coalesce(label == "me", F.lit(False)) | F.coalesce((custom_name != "") & mine, F.lit(False))


def is_renamable(label: Column) -> Column:
    return F.coalesce((label != "") & (label != "me"), F.lit(False))


def unnamed_labels(segments: DataFrame, names: DataFrame, label: str = "speaker") -> DataFrame:
    """meeting_id, label: who spoke, may be named and has no name yet."""
    spoke = segments.filter(is_renamable(F.col(label))).select("meeting_id", F.col(label).alias("label")).distinct()
    return spoke.join(names.select("meeting_id", "label"), ["meeting_id", "label"], "left_anti")


def changed_partials(log: DataFrame) -> DataFrame:
    """The partials that show something new: with text, and other text than the utterance's last shown."""
    said = log.filter(~F.col("is_final") & ~is_blank(F.col("text")))
    text = clean(F.col("text"))
    w = Window.partitionBy("meeting_id", "id").orderBy("_seq")
    return said.withColumn("_new", ~text.eqNullSafe(F.lag(text).over(w))).filter("_new").drop("_new")


def finals(log: DataFrame) -> DataFrame:
    """The first final with text of each utterance."""
    rest = [c for c in log.columns if c not in ("meeting_id", "id", "_seq")]
    first = log.filter(F.col("is_final") & ~is_blank(F.col("text"))).groupBy("meeting_id", "id").agg(F.min(F.struct("_seq", *rest)).alias("_first"))
    return first.select("meeting_id", "id", "_first.*").select(*log.columns)


def open_partials(log: DataFrame) -> DataFrame:
    """The last partial of each utterance, if it has text and no final came after it."""
    rest = [c for c in log.columns if c not in ("meeting_id", "id", "_seq")]
    last = log.groupBy("meeting_id", "id").agg(F.max(F.struct("_seq", *rest)).alias("_last"))
    return last.select("meeting_id", "id", "_last.*").select(*log.columns).filter(~F.col("is_final") & ~is_blank(F.col("text")))


def reattached(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """All finals known to one who comes back: stored segments, then the log's, each utterance once."""
    return finals(snapshot.withColumn("_seq", F.lit(-1).cast("long")).withColumn("is_final", F.lit(True)).unionByName(log, allowMissingColumns=True).select(*log.columns))


def session_now(log: DataFrame, clock_ms: Column | int = 0) -> DataFrame:
    """meeting_id, now_ms: the latest end of what is shown, or the wall clock if it is ahead."""
    shown = finals(log).unionByName(open_partials(log))
    return shown.groupBy("meeting_id").agg(F.max("end_ms").alias("_end")).select("meeting_id", F.greatest("_end", F.lit(clock_ms) if isinstance(clock_ms, int) else clock_ms).alias("now_ms"))


def recap_lines(segments: DataFrame, now_ms: Column, minutes: int) -> DataFrame:
    """The segments of the last minutes."""
    return segments.filter(F.col("start_ms") >= F.greatest(now_ms - minutes * 60_000, F.lit(0)))


def lines_to_translate(finals: DataFrame, partials: DataFrame, window: int = 20, kazakh: int = 10, others: int = 6) -> DataFrame:
    """Of the last finals and all partials with text: the last ones with Kazakh letters, else the last ones."""
    newest = Window.partitionBy("meeting_id").orderBy(F.desc("start_ms"), F.desc("id"))
    recent = finals.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= window).drop("_n").withColumn("_part", F.lit(0))
    pool = recent.unionByName(partials.filter(~is_blank(F.col("text"))).withColumn("_part", F.lit(1)))
    pool = pool.withColumn("_kk", has_kazakh_letters(F.col("text")).cast("int"))
    pool = pool.withColumn("_any", F.max("_kk").over(Window.partitionBy("meeting_id"))).filter("_kk = _any")
    last = Window.partitionBy("meeting_id").orderBy(F.desc("_part"), F.desc("start_ms"), F.desc("id"))
    kept = pool.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= F.when(F.col("_any") == 1, kazakh).otherwise(others))
    return kept.drop("_n", "_part", "_kk", "_any")


def suggestions_due(now_ms: Column, since_ms: Column, fresh: Column, unnamed: Column, every_minutes: Column, busy: Column) -> Column:
    """Whether names may be suggested: someone unnamed, four new lines, and the interval (four minutes if it is off) gone."""
    minutes = F.when(every_minutes > 0, every_minutes).otherwise(SUGGEST_MINUTES)
    return ~busy & (unnamed >= 1) & (fresh >= SUGGEST_FINALS) & (now_ms - since_ms >= minutes * 60_000)


def fired(attempts: Column, apart_ms: int) -> Column:
    """Of attempts (structs at, skipped, in order) the times that fire: so long after the last one that was not skipped."""
    start = F.struct(F.array().cast("array<bigint>").alias("all"), F.lit(None).cast("bigint").alias("last"))

    def step(state: Column, a: Column) -> Column:
        fires = state["last"].isNull() | (a["at"] - state["last"] >= apart_ms)
        then = F.struct(F.array_append(state["all"], a["at"]).alias("all"), F.when(a["skipped"], state["last"]).otherwise(a["at"]).alias("last"))
        return F.when(fires, then).otherwise(state)

    return F.aggregate(attempts, start, step, lambda s: s["all"])


def piece_ids(pieces: DataFrame, used: DataFrame) -> DataFrame:
    """Pieces (meeting_id, source, utterance, k, id, text) with ids: the first keeps its utterance's, others get fresh ones.

    Empty later pieces, and a first one that has no id, are left out; fresh numbers go on from ``used`` (meeting_id, source, n).
    """
    kept = pieces.filter(~is_blank(F.col("text")) | ((F.col("k") == 0) & F.col("id").isNotNull()))
    fresh = (~((F.col("k") == 0) & F.col("id").isNotNull())).cast("int")
    w = Window.partitionBy("meeting_id", "source").orderBy("utterance", "k")
    numbered = kept.withColumn("_fresh", fresh).withColumn("_n", F.sum("_fresh").over(w))
    joined = numbered.join(used.withColumnRenamed("n", "_used"), ["meeting_id", "source"], "left")
    own = F.concat(F.col("source"), F.lit("-"), (F.coalesce("_used", F.lit(0)) + F.col("_n")).cast("string"))
    return joined.withColumn("id", F.when(F.col("_fresh") == 1, own).otherwise(F.col("id"))).select(*pieces.columns)


def whole_percents(progress: DataFrame, keys: list[str], order: str, share: str) -> DataFrame:
    """The rows at which the whole percent rises above all before."""
    percent = F.floor(F.col(share) * 100)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return progress.withColumn("_before", F.max(percent).over(w)).filter(F.col("_before").isNull() | (percent > F.col("_before"))).drop("_before")


def cards(notes: DataFrame, most: int = 30) -> DataFrame:
    """A meeting's saved hints as cards, newest first: kind, label, detail and whether they came by themselves."""
    t = F.coalesce("trigger", F.lit(""))
    after = lambda prefix: F.nullif(F.trim(F.substr(t, F.lit(len(prefix) + 1))), F.lit(""))
    minutes = F.regexp_extract(t, r"^recap:\s*(\d+)m$", 1)
    # The cards' labels.
    card = lambda kind, label, detail, auto=False: F.struct(F.lit(kind).alias("card"), (label if isinstance(label, Column) else F.lit(label)).alias("label"), detail.cast("string").alias("detail"), F.lit(auto).alias("auto"))
    none = F.lit(None)
    meta = (
        F.when(t == "manual", card("hint", "Что ответить?", none))
        .when(t.startswith("auto:"), card("hint", "Подсказка (авто)", after("auto:"), True))
        .when(t.startswith("ask:"), card("ask", "Вопрос ассистенту", after("ask:")))
        .when(t.startswith("explain:"), card("explain", "Объяснение", after("explain:")))
        .when(t == "translate", card("translate", "Перевод", none))
        .when(minutes != "", card("recap", F.concat(F.lit("Кратко: "), minutes, F.lit(" мин")), none))
        .otherwise(card("hint", "Подсказка", F.nullif(t, F.lit(""))))
    )
    w = Window.partitionBy("meeting_id").orderBy(F.desc("created_at"), "_seq")
    newest = notes.filter(F.col("kind") == "hint").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    return newest.select("meeting_id", "place", meta.alias("m"), "content", "created_at").select("meeting_id", "place", "m.*", "content", "created_at")


def mic_modes(segments: DataFrame, otherwise: str = "me") -> DataFrame:
    """meeting_id, mic_mode: a meeting with a label of the room was recorded in one."""
    room = F.coalesce(F.bool_or(F.startswith("speaker", F.lit("mic:"))), F.lit(False))
    return segments.groupBy("meeting_id").agg(room.alias("r")).select("meeting_id", F.when(F.col("r"), "room").otherwise(otherwise).alias("mic_mode"))


def device_order(devices: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Devices with place, from 1: by kind, the default first, else as they were listed."""
    w = Window.partitionBy(*keys).orderBy("kind", F.desc("is_default"), position)
    return devices.withColumn("place", F.row_number().over(w))


def aligned(frames: DataFrame, reference: DataFrame, keys: list[str], samples: str = "samples", size: int = 480) -> DataFrame:
    """Microphone frames with the call's frame of the same number, silence where there is none."""
    other = reference.select(*keys, "frame", F.col(samples).alias("reference"))
    return frames.join(other, [*keys, "frame"], "left").withColumn("reference", F.coalesce("reference", F.array_repeat(F.lit(0.0), size).cast("array<float>")))


def regions_of(segments: DataFrame, regions: DataFrame, keys: list[str], slack_ms: int = 300, bucket: int = 60_000) -> DataFrame:
    """Segments with the first region (column n orders them) that their middle lies in, give or take the slack; null if in none."""
    from parley.operators.intervals import overlap_join

    middle = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    wide = regions.select(*keys, "n", "kind", (F.col("start_ms") - slack_ms).alias("r_low"), (F.col("end_ms") + slack_ms).alias("r_high"))
    met = overlap_join(segments.select(*keys, "id", "start_ms", "end_ms"), wide, keys, (middle, middle), (F.col("r_low"), F.col("r_high")), bucket)
    first = met.groupBy(*keys, "id").agg(F.min_by("kind", "n").alias("region"))
    return segments.join(first, [*keys, "id"], "left")


def runnable(requirements: DataFrame, files: DataFrame) -> DataFrame:
    """model, available, missing_mb: whether all files that a model needs are present, and what is to be loaded."""
    joined = requirements.join(files.select("path").distinct().withColumn("_here", F.lit(True)), "path", "left")
    gone = F.col("_here").isNull()
    return joined.groupBy("model").agg((F.count_if(gone) == 0).alias("available"), F.ceil(F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0)) / 1e6).alias("missing_mb"))


def evaluation_set(rows: DataFrame, key: str, text: str, seconds: str, low: float, high: float, used: DataFrame) -> DataFrame:
    """One row per key (the first sentence by text) without digits, of a fitting length, not used before, each sentence once."""
    fit = rows.filter(~F.col(text).rlike(r"\d") & F.col(seconds).between(low, high)).join(used.select(key), key, "left_anti")
    by_text = fit.withColumn("_n", F.row_number().over(Window.partitionBy(text).orderBy(key))).filter("_n = 1").drop("_n")
    return by_text.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(text))).filter("_n = 1").drop("_n")


def weighted_objective(scores: DataFrame, weights: dict[str, float], condition: str, value: str, keys: list[str]) -> DataFrame:
    """keys, objective: the weighted mean of a value over conditions."""
    w = F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col(condition))
    return scores.groupBy(*keys).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("objective"))


def voiced_levels(frames: DataFrame, keys: list[str], pause: int = 8, margin: int = 5) -> DataFrame:
    """Frames (columns n, db) with voiced: above the threshold of their key, with short pauses and a margin around."""
    from parley.operators import ranks

    bounds = ranks.percentiles(frames, keys, "db", {"high": 0.95, "low": 0.1}, between=True)
    bounds = bounds.select(*keys, F.greatest(F.col("high") - 30, F.col("low") + 8, F.lit(-55.0)).alias("_t"))
    loud = frames.join(bounds, keys) if keys else frames.withColumn("_t", bounds.scalar())
    loud = loud.withColumn("_l", F.when(F.col("db") > F.col("_t"), F.col("n")))
    back = Window.partitionBy(*keys).orderBy("n")
    last, following = F.last("_l", ignorenulls=True).over(back), F.first("_l", ignorenulls=True).over(back.rowsBetween(0, Window.unboundedFollowing))
    inside = (following - last - 1 <= pause) & last.isNotNull() & following.isNotNull()
    near = (F.col("n") - last <= margin) | (following - F.col("n") <= margin)
    return loud.withColumn("voiced", F.coalesce(inside, F.lit(False)) | F.coalesce(near, F.lit(False))).drop("_t", "_l")


def card_states(log: DataFrame) -> DataFrame:
    """meeting_id, card, status, text, hidden: each card's last event; hidden until its text cannot be a skip, gone if it is one."""
    last = log.groupBy("meeting_id", "card").agg(F.max(F.struct("_seq", "status", "text")).alias("_l")).select("meeting_id", "card", "_l.status", "_l.text")
    skipped = (F.col("status") == "done") & is_skip(F.coalesce("text", F.lit("")))
    hidden = F.col("status").isin("queued", "streaming") & may_be_skip(F.coalesce("text", F.lit("")))
    return last.filter(~skipped).withColumn("hidden", hidden)


def outdated_summaries(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """The last final summary of each meeting whose speakers were relabelled after it (``changes`` has meeting_id and at)."""
    final = notes.filter(F.col("kind") == "final").groupBy("meeting_id").agg(F.max(F.struct("created_at", "_seq", "content")).alias("_n"))
    later = changes.groupBy("meeting_id").agg(F.max("at").alias("changed_at"))
    return final.join(later, "meeting_id").filter(F.col("changed_at") > F.col("_n.created_at")).select("meeting_id", "_n.content", "_n.created_at", "changed_at")


def rolling_summaries(runs: DataFrame) -> DataFrame:
    """``runs`` (meeting_id, n, status, text) with previous, the summary that each updates, and shown, the text on screen after it.

    A run that fails leaves the summary before it on screen.
    """
    w = Window.partitionBy("meeting_id").orderBy("n")
    done = F.when(F.col("status") == "done", F.col("text"))
    told = runs.withColumn("previous", F.last(done, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return told.withColumn("shown", F.coalesce(done, "previous", F.when(F.col("status") == "streaming", F.col("text")), F.lit("")))


def enrollments(recordings: DataFrame, least_ms: int = 4_000) -> DataFrame:
    """``recordings`` (samples at 16 kHz) with speech, their voiced frames, speech_ms, and ok, whether they are speech enough for a voiceprint."""
    from parley.functions.audio import voiced_column

    heard = recordings.withColumn("speech", voiced_column(F.col("samples")))
    return heard.withColumn("speech_ms", F.floor(F.size("speech") / 16).cast("long")).withColumn("ok", F.col("speech_ms") >= least_ms)


def renames(states: DataFrame) -> DataFrame:
    """meeting_id, n, label, before, after, reset: what changes from one snapshot of names (meeting_id, n, label, name; null: none) to the next.

    A label that a snapshot lacks has its default name there; new labels with default names are no change.
    """
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), default_name(F.col("label")))
    w = Window.partitionBy("meeting_id", "label").orderBy("n")
    named = states.withColumn("after", name).withColumn("before", F.coalesce(F.lag("after").over(w), default_name(F.col("label"))))
    changed = named.filter(F.col("before") != F.col("after"))
    return changed.select("meeting_id", "n", "label", "before", "after", (F.col("after") == default_name(F.col("label"))).alias("reset"))


def transcript_updates(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """Lines (meeting_id, _seq, line) with the first committed request (meeting_id, n, _seq, ok) at or after them; null while none has them.

    A request that failed commits nothing: its lines go with the next one.
    """
    told = requests.filter("ok").select("meeting_id", F.col("_seq").alias("_at"), F.col("n").alias("request"))
    rows = lines.withColumn("_at", F.col("_seq")).withColumn("request", F.lit(None).cast(dict(requests.dtypes)["n"])).withColumn("_line", F.lit(True))
    both = rows.unionByName(told, allowMissingColumns=True)
    w = Window.partitionBy("meeting_id").orderBy("_at", F.col("_line").isNull()).rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("request", F.first("request", ignorenulls=True).over(w)).filter("_line").drop("_at", "_line")
