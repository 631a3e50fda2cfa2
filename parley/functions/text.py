"""Text functions on transcript columns, as Column expressions only."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kazakh letters and their Russian look-alikes for name matching.
KAZAKH = "әғқңөұүһі"
FOLDED_FROM, FOLDED_TO = "әғқңөұүһіё", "агкноуухие"


def clean(text: Column) -> Column:
    """White space of any kind collapsed to single blanks, and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_blank(text: Column) -> Column:
    """No character but white space."""
    return ~text.rlike(r"(?U)\S")


def normalized(text: Column) -> Column:
    """Lower-cased, ё as е, every run of other than letters and digits one blank, trimmed."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ё"), F.lit("е")), r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    """Words of Latin, Russian and Kazakh letters and digits, lower-cased, ё as е."""
    lowered = F.replace(F.lower(text), F.lit("ё"), F.lit("е"))
    return F.filter(F.split(lowered, f"[^a-zа-я{KAZAKH}0-9]+"), lambda w: w != "")


def trigrams(text: Column) -> Column:
    """Three-character windows of the text with one blank at either end."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def containment(part: Column, whole: Column) -> Column:
    """Share of the first text's trigrams that the second has too, as multisets; 0 if either is empty or null.

    Its time is linear in the texts, which may be of any length.
    """

    @F.pandas_udf("double")
    def run(parts: pd.Series, wholes: pd.Series) -> pd.Series:
        def counts(text: str) -> Counter[str]:
            padded = f" {text} "
            return Counter(padded[i : i + 3] for i in range(len(text))) if text else Counter()

        found = []
        for a, b in zip(parts, wholes):
            mine = counts(a) if a is not None and b is not None else Counter()
            found.append((mine & counts(b)).total() / mine.total() if mine else 0.0)
        return pd.Series(found, dtype="float64")

    return run(part, whole)


def is_echo(mic: Column, call: Column, least: float = 0.6) -> Column:
    """Whether normalised microphone text repeats the call's: one word exactly, more by containment."""
    words = F.split(mic, " ")
    return F.when((mic == "") | (call == ""), False).when(F.size(words) == 1, F.array_contains(F.split(call, " "), mic)).otherwise(containment(mic, call) >= least)


def folded(text: Column) -> Column:
    """Lower-cased with Kazakh letters as their Russian look-alikes, for matching names."""
    return F.translate(F.lower(text), FOLDED_FROM, FOLDED_TO)


def has_kazakh_letters(text: Column) -> Column:
    """Whether a letter occurs that Kazakh has and Russian lacks."""
    return F.lower(text).rlike(f"[{KAZAKH}]")


def label_number(label: Column) -> Column:
    """The number of ``mic:N`` or ``sys:N``, else null."""
    return F.regexp_extract(label, r"^(?:sys|mic):(\d+)$", 1).try_cast("long")


def label_order(label: Column) -> Column:
    """Sorts me, then the call's by number, then the room's, then others by name, then none."""
    rank = F.when(label == "me", 0).when(label.rlike(r"^sys:\d+$"), 1).when(label.rlike(r"^mic:\d+$"), 2).when(label.isNotNull(), 3).otherwise(4)
    return F.struct(rank.alias("rank"), F.coalesce(label_number(label), F.lit(0)).alias("number"), F.coalesce(label, F.lit("")).alias("raw"))


def default_name(label: Column) -> Column:
    """The display name of an unnamed speaker."""
    number = label_number(label).cast("string")
    return (
        F.when(label.isNull(), "?")
        .when(label == "me", "Я")
        .when(label.startswith("sys:") & number.isNotNull(), F.concat(F.lit("Участник "), number))
        .when(label.startswith("mic:") & number.isNotNull(), F.concat(F.lit("Зал "), number))
        .otherwise(label)
    )


def speaker_name(name: Column, most: int = 40) -> Column:
    """A name as it is stored: collapsed, at most 40 characters, trimmed."""
    return F.rtrim(F.substr(clean(name), F.lit(1), F.lit(most)))


def clock(ms: Column) -> Column:
    """``MM:SS`` from the session's start, ``H:MM:SS`` from an hour on."""
    s = F.greatest(ms, F.lit(0)).cast("long") / 1000
    s = F.floor(s).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes, seconds = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    short = F.concat(two(minutes), F.lit(":"), two(seconds))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), short)).otherwise(short)


def talk_time(ms: Column) -> Column:
    """Seconds; minutes and seconds; or hours and minutes, in Russian."""
    s = F.floor(ms / 1000 + 0.5).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    m = F.floor(s / 60)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" с")))
        .when(m < 60, F.concat(m.cast("string"), F.lit(" мин "), two(s % 60), F.lit(" с")))
        .otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit(" ч "), two(m % 60), F.lit(" мин")))
    )


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Russian plural form for a count."""
    return F.when((n % 10 == 1) & (n % 100 != 11), one).when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), few).otherwise(many)


def slug(title: Column, otherwise: str = "meeting", most: int = 60) -> Column:
    """A file name: letters and digits, runs of others as one dash."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substr(dashed, F.lit(1), F.lit(most)), F.lit("")), F.lit(otherwise))


def quote(text: Column, most: int = 240) -> Column:
    """At most so many characters, the last an ellipsis if any were cut."""
    return F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most - 1)), F.lit("…"))).otherwise(text)


def _unmarked(reply: Column) -> Column:
    """A reply without the marks that it begins with."""
    return F.regexp_replace(F.trim(reply), r"^[\s*_`\"'«»“”.,:;!-]+", "")


def is_skip(reply: Column, most: int = 160) -> Column:
    """Whether a model's reply says that there is nothing to say."""
    bare = _unmarked(reply)
    return (F.length(bare) <= most) & bare.rlike(r"(?i)^skip\b")


def may_be_skip(reply: Column) -> Column:
    """Whether a reply that is still written could become one that says nothing."""
    bare = F.lower(_unmarked(reply))
    return F.startswith(F.lit("skip"), bare) | F.startswith(bare, F.lit("skip"))


def palette_index(text: Column, colours: int = 12) -> Column:
    """A stable colour number: a polynomial hash of base 31 modulo 2^32, modulo the colours."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return (F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % F.lit(1 << 32)) % colours).cast("int")


def card_kind(trigger: Column) -> Column:
    """kind and minutes of the card that a note's trigger stands for."""
    minutes = F.regexp_extract(trigger, r"^recap:\s*(\d+)m$", 1)
    kind = F.when(trigger.isNull(), "hint").when(minutes != "", "recap").when(trigger.startswith("auto"), "auto").when(trigger.startswith("ask"), "ask").otherwise("hint")
    return F.struct(kind.alias("kind"), minutes.try_cast("int").alias("minutes"))
