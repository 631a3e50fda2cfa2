"""What the meeting screens print: durations, counts, costs, dates, models, audio setups, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import clean, label_order

# Weekdays from Sunday on, and the months' names in dates.
WEEKDAYS = ["воскресенье", "понедельник", "вторник", "среда", "четверг", "пятница", "суббота"]
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]


def _text(x: Column) -> Column:
    return x.cast("string")


def duration_label(start: Column, end: Column) -> Column:
    """Rounded minutes, from an hour on hours and minutes; null while open or if it ends before it begins."""
    ms = F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
    m = F.floor(ms / 60_000 + 0.5).cast("long")
    long = F.concat(_text(F.floor(m / 60)), F.lit(" ч "), _text(m % 60), F.lit(" мин"))
    return F.when(ms >= 0, F.when(m < 60, F.concat(_text(m), F.lit(" мин"))).otherwise(long))


def _short(x: Column) -> Column:
    """At most one decimal below ten, none from ten on, with a decimal comma."""
    one = F.regexp_replace(F.format_string("%.1f", F.round(x, 1)), r"\.0$", "")
    return F.when(x < 10, F.replace(one, F.lit("."), F.lit(","))).otherwise(_text(F.round(x, 0).cast("long")))


def count_label(n: Column) -> Column:
    """A count of tokens: whole below a thousand, then thousands (K) or millions (M)."""
    n = n.cast("double")
    return F.when(n >= 1e6, F.concat(_short(n / 1e6), F.lit("M"))).when(n >= 1e3, F.concat(_short(n / 1e3), F.lit("K"))).otherwise(_text(F.floor(n + 0.5).cast("long")))


def cost_label(usd: Column) -> Column:
    """Dollars: two decimals below ten, one from ten on, rounded from the double's exact value (3.635 is a little less)."""
    usd = usd.cast("double")
    shown = lambda pattern: F.call_function("format_number", usd, F.lit(pattern))  # noqa: E731 (format_string would round 3.635 itself, and up)
    return F.when(usd <= 0, "$0").when(usd < 0.01, "<$0.01").otherwise(F.concat(F.lit("$"), F.when(usd < 10, shown("0.00")).otherwise(shown("0.0"))))


def iso_seconds(at: Column) -> Column:
    """A time in UTC, to the second."""
    return F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parsed_time(text: Column, otherwise: Column) -> Column:
    """The time that a text states, else another."""
    return F.coalesce(F.try_to_timestamp(text), otherwise.cast("timestamp"))


def iso_date(at: Column) -> Column:
    return F.date_format(at.cast("timestamp"), "yyyy-MM-dd")


def meeting_date(at: Column) -> Column:
    """Date and weekday."""
    return F.concat(iso_date(at), F.lit(", "), F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(at.cast("timestamp"))))


def date_and_time(at: Column) -> Column:
    """Day, month and time as a sentence has them."""
    t = at.cast("timestamp")
    return F.concat(_text(F.dayofmonth(t)), F.lit(" "), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(t)), F.lit(" в "), F.date_format(t, "HH:mm"))


def _version(model: Column) -> tuple[Column, Column]:
    """Family and version of a model id; a date behind the version is none."""
    m = F.lower(F.trim(model))
    part = lambda k: F.regexp_extract(m, r"^claude-(opus|sonnet|haiku|fable|mythos)-(\d+)(?:-(\d+))?", k)
    minor = F.coalesce(part(3).try_cast("int"), F.lit(0))
    return part(1), F.coalesce(part(2).try_cast("int"), F.lit(0)) * 10 + F.when(minor >= 100, 0).otherwise(minor)


def context_window(model: Column) -> Column:
    """Tokens that a model reads at once; the least for ids that are not known."""
    family, version = _version(model)
    wide = family.isin("fable", "mythos") | (family.isin("opus", "sonnet") & (version >= 46))
    return F.when(wide, 1_000_000).otherwise(200_000)


def model_abilities(model: Column) -> Column:
    """Whether a model thinks adaptively, takes an effort, a very high one, server fallbacks, and an output schema."""
    family, v = _version(model)
    old = F.lower(F.trim(model)).rlike("^claude-(3|2|instant)")

    def ability(opus: int | None, sonnet: int | None, haiku: int | None, newest: int | None, other: bool) -> Column:
        since = lambda least: F.lit(False) if least is None else v >= least
        known = F.when(family == "opus", since(opus)).when(family == "sonnet", since(sonnet)).when(family == "haiku", since(haiku)).otherwise(since(newest))
        return F.when(family != "", known).otherwise(~old & F.lit(other))

    return F.struct(
        ability(46, 46, 50, 0, True).alias("adaptive_thinking"),
        ability(45, 46, 50, 0, True).alias("effort"),
        ability(47, 50, None, 0, True).alias("very_high"),
        ability(50, None, None, 51, False).alias("fallbacks"),
        ability(41, 45, 45, 0, True).alias("schema"),
    )


def request_budget(route: Column, hint_effort: Column, summary_effort: Column) -> Column:
    """effort and max_tokens of a request: live, fork (with room for a summary) or final."""
    live = F.when(hint_effort == "high", 16_000).when(hint_effort == "medium", 12_000).otherwise(8_000)
    final = F.when(summary_effort == "xhigh", 64_000).otherwise(32_000)
    tokens = F.when(route == "final", final).when(route == "fork", F.greatest(live, F.lit(12_000))).otherwise(live)
    return F.struct(F.when(route == "final", summary_effort).otherwise(hint_effort).alias("effort"), tokens.alias("max_tokens"))


def meeting_format(mic: Column, system: Column, mode: Column) -> Column:
    """The format with exactly this audio setup, null if none."""
    return F.when(mic & system & (mode == "me"), "online").when(mic & ~system & (mode == "room"), "room").when(mic & system & (mode == "room"), "hybrid")


def setup_text(mic: Column, system: Column, mode: Column, voiceprint: Column) -> Column:
    """One line on how the audio is recorded and what the labels mean."""
    # The lines as the assistant gets them.
    own = F.when(voiceprint, "реплики пользователя узнаются по образцу его голоса и подписаны «Я»").otherwise("образца голоса пользователя нет, поэтому его реплики тоже попадают в «Зал N» — узнавай его по смыслу и по обращениям к нему")
    return (
        F.when(mic & system & (mode == "me"), "онлайн-звонок, пользователь в наушниках: «Я» — микрофон пользователя, «Участник N» — голоса остальных из звонка")
        .when(mic & ~system & (mode == "room"), F.concat(F.lit("очная встреча в зале: один микрофон слышит всех в комнате, «Зал N» — разные голоса; "), own))
        .when(mic & system, F.concat(F.lit("гибридная встреча: микрофон в комнате слышит тех, кто в зале («Зал N»), удалённые участники звучат из звонка («Участник N»); "), own))
        .when(mic, "пишется только микрофон пользователя («Я»); остальных почти не слышно")
        .when(system, "пишется только звук звонка («Участник N»); микрофон пользователя выключен")
        .otherwise("звук не записывается")
    )


def rename_note(before: Column, after: Column, reset: Column) -> Column:
    """What the log says when a speaker's name changes."""
    return F.when(reset, F.concat(before, F.lit(" — снова "), after, F.lit(" (имя снято)."))).otherwise(F.concat(before, F.lit(" теперь зовут "), after, F.lit(".")))


def names_in(text: Column, most: int = 10, longest: int = 40) -> Column:
    """The names of a list parted by commas, semicolons or line ends: clean, each once whatever its case, ten at most."""
    given = F.filter(F.transform(F.split(text, "[,;\n]"), lambda x: F.substr(clean(x), F.lit(1), F.lit(longest))), lambda x: x != "")
    lower = F.transform(given, F.lower)
    first = F.filter(F.transform(given, lambda x, i: F.struct(x.alias("x"), (F.array_position(lower, F.lower(x)) == i + 1).alias("first"))), lambda s: s["first"])
    return F.slice(F.transform(first, lambda s: s["x"]), 1, most)


def is_shortcut(text: Column) -> Column:
    """Whether a text is a usable shortcut: modifiers, not only Shift, and one key."""
    return text.rlike(r"^(?:(?:CommandOrControl|Control|Ctrl|Alt|Shift|Super)\+)+[A-Za-z0-9]+$") & text.rlike(r"(?:^|\+)(?:CommandOrControl|Control|Ctrl|Alt|Super)\+")


USAGE_KEYS = ["requests", "input", "cacheRead", "cacheWrite", "output", "cost", "unpriced", "rollovers", "peakPrompt"]


def usage_of(json: Column) -> Column:
    """Stored usage totals as a struct of doubles; null unless all nine are finite numbers from zero on."""
    given = F.from_json(json, ", ".join(f"{k} double" for k in USAGE_KEYS), {"allowNonNumericNumbers": "false"})
    fine = given.isNotNull()
    for k in USAGE_KEYS:
        fine = fine & F.coalesce(given[k] >= 0, F.lit(False)) & ~F.get_json_object(json, f"$.{k}").rlike('^"') & ~F.isnan(given[k])
    return F.when(fine, given)


def names_snapshot(labels: Column, names: Column) -> Column:
    """Names by label as a map whose entries are in the labels' order."""
    pairs = F.arrays_zip(labels.alias("label"), names.alias("name"))
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct(label_order(p["label"]).alias("o"), p["label"].alias("label"), p["name"].alias("name"))))
    return F.map_from_entries(F.transform(ordered, lambda p: F.struct(p["label"], p["name"])))


NOT_SAID = "(не указано)"


def context_block(title: Column, date: Column, setup: Column, my_names: Column, profile: Column, agenda: Column) -> Column:
    """A meeting's fixed context, as the first part of every request."""
    or_none = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit(NOT_SAID))
    names = F.array_join(F.filter(F.transform(my_names, clean), lambda n: n != ""), ", ")
    called = F.when(names != "", F.concat(names, F.lit(" — так к пользователю («Я») обращаются на встрече"))).otherwise(NOT_SAID)
    tagged = lambda tag, x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))
    lines = [tagged("meeting_title", or_none(clean(title))), tagged("meeting_date", date), tagged("meeting_format", setup), tagged("user_names", called)]
    for tag, x in (("user_profile", profile), ("agenda_and_notes", agenda)):
        lines += [F.lit(f"<{tag}>"), or_none(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), F.lit(f"</{tag}>")]
    return F.concat_ws("\n", F.lit("<meeting_context>"), *lines, F.lit("</meeting_context>"))
