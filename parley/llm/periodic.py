"""Periodic runs of words, found by Lyndon words under two orders, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q, of at least ``least_exponent`` * q
and ``least_words`` words, that no neighbouring word extends. Every run holds a Lyndon word of q
words that is the longest one at its place under one of two opposite orders of the words. A stack
scanned from right to left (each place points to the first smaller suffix) gives these for all
places; those that repeat at once (one does in three periods or more) are extended to both sides. Suffixes are compared and runs
extended by binary search over rolling hashes; what the hashes call equal is compared word by word,
and where it is not, the words decide. What was found equal at a distance is not compared again.

A text is worked on as a whole by one task, in memory linear in its words; texts do not depend on
each other, so nothing is shuffled and a lost task starts again from its texts.

Cases: a null or empty text has no words and no runs and collapses to the empty text; equal rows
give equal values; words are maximal stretches without blanks (``[^\\x20\\x09-\\x0D]+``), kept as they
are; an empty table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import _powers, mixed, small_batches, text_slices, tidy

DIRECT = 8  # words compared one by one before hashes are asked


class Words:
    """A text's words by number, with common extensions to both sides."""

    def __init__(self, words: list[bytes]) -> None:
        numbers: dict[bytes, int] = {}
        self.at = [numbers.setdefault(w, len(numbers)) for w in words]
        self.n = len(words)
        self.codes = np.array(self.at, np.int32)
        self.raw = b""
        self.sums: list[int] = []
        self.known: dict[int, tuple[int, int]] = {}  # by distance: words from the first to before the second number repeat, and no further

    def _hash(self) -> None:
        self.raw = self.codes.tobytes()
        up, _ = _powers(self.n + 1)
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mixed(self.codes.astype(np.uint64) + np.uint64(1)) * up[: self.n], out=sums[1:])
        self.sums, self.powers = sums.tolist(), up.tolist()

    def _equal(self, i: int, j: int, length: int) -> bool:
        """Whether the hashes of ``length`` words from i and from j > i are equal."""
        s = self.sums
        return not ((s[i + length] - s[i]) * self.powers[j - i] - s[j + length] + s[j]) & 0xFFFFFFFFFFFFFFFF

    def _same(self, i: int, j: int, length: int) -> bool:
        """Whether the words themselves are equal."""
        return self.raw[4 * i : 4 * (i + length)] == self.raw[4 * j : 4 * (j + length)]

    def _longest(self, i: int, j: int, least: int, most: int, forward: bool) -> int:
        """The most words from (or before) i that are equal to those at j; at least ``least`` are."""
        if not self.sums and self.n:
            self._hash()

        def hashed(length: int) -> bool:
            return self._equal(i, j, length) if forward else self._equal(i - length, j - length, length)

        low, step = least, 2 * DIRECT
        while low + step <= most and hashed(low + step):
            low, step = low + step, 2 * step
        high = min(most, low + step)  # all are equal, or it ends before
        while low < high:
            middle = (low + high + 1) // 2
            if hashed(middle):
                low = middle
            else:
                high = middle - 1
        return low

    def _first_difference(self, i: int, j: int, most: int) -> int:
        """Equal words from i and j, by the words alone."""
        differ = np.flatnonzero(self.codes[i : i + most] != self.codes[j : j + most])
        return int(differ[0]) if len(differ) else most

    def after(self, i: int, j: int) -> int:
        """How many words from i on are equal to those from j on, i < j."""
        w, most, far = self.at, self.n - j, j - i
        low, high = self.known.get(far, (self.n, self.n))
        if low <= i < high:
            return high - i
        length = 0
        while length < most and length < DIRECT and i + length != low and w[i + length] == w[j + length]:
            length += 1
        if i + length == low and low < high:
            length = high - i
        elif length == DIRECT and length < most:
            length = self._longest(i, j, length, most, True)
            checked = min(length, low - i) if low < high and i < low else length
            if not self._same(i, j, checked):
                length = self._first_difference(i, j, checked)
            elif low < high and i < low <= i + length:
                length = high - i
            elif i + length < self.n - far and w[i + length] == w[j + length]:
                length += self._first_difference(i + length, j + length, most - length)
        if length > DIRECT:
            self.known[far] = (i, i + length)
        return length

    def before(self, i: int, j: int) -> int:
        """How many words before i are equal to those before j, i < j."""
        w, length = self.at, 0
        while length < i and length < DIRECT and w[i - length - 1] == w[j - length - 1]:
            length += 1
        if length == DIRECT and length < i:
            length = self._longest(i, j, length, i, False)
            if not self._same(i - length, j - length, length):
                differ = np.flatnonzero(self.codes[i - length : i] != self.codes[j - length : j])
                length -= int(differ[-1]) + 1
            else:
                while length < i and w[i - length - 1] == w[j - length - 1]:
                    length += 1
        return length

    def next_smaller(self, order: list[int]) -> np.ndarray:
        """For every place, where its longest Lyndon word under ``order`` ends: the first smaller suffix."""
        n, after = self.n, self.after
        end = [n] * (n + 1)
        self.known.clear()
        for i in range(n - 1, -1, -1):
            x, j = order[i], i + 1
            while j < n:
                y = order[j]
                if x > y:
                    break
                if x == y:
                    same = after(i, j)
                    if j + same >= n or order[i + same] > order[j + same]:
                        break
                j = end[j]
            end[i] = j
        return np.array(end[:n], np.int64)

    def runs(self, least_exponent: int, least_words: int) -> list[tuple[int, int, int]]:
        """Start, length and period of all runs, by start and period."""
        n = self.n
        if n < max(least_words, 2):
            return []
        starts, places = [], np.arange(n)
        for order in (self.at, (-self.codes).tolist()):
            period = self.next_smaller(order) - places
            twice = np.flatnonzero(places + 2 * period <= n)
            p = period[twice]
            twice = twice[(self.codes[twice] == self.codes[twice + p]) & (self.codes[twice + p - 1] == self.codes[twice + 2 * p - 1])]
            starts.append(np.stack([period[twice], twice]))
        found, reached = set(), {}
        period, start = np.unique(np.concatenate(starts, axis=1), axis=1)
        self.known.clear()
        for p, i in zip(period.tolist(), start.tolist()):
            if i + 2 * p <= reached.get(p, 0):
                continue  # within the run found last
            self.known.clear()
            to = i + p + self.after(i, i + p)
            if to - i < 2 * p:
                continue
            reached[p] = to
            first = i - self.before(i, i + p)
            if to - first >= max(least_words, least_exponent * p):
                found.add((first, to - first, p))
        return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return b" ".join(map(words.__getitem__, np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), least_exponent: int = 4, least_words: int = 6) -> DataFrame:
    """Per row: ``keep``, n_words, runs (start, length, period; by start and period) and the collapsed text."""
    if least_exponent < 3:
        raise ValueError("runs of less than three periods are not looked for")  # their Lyndon words need not repeat at once
    small_batches(docs.sparkSession)
    inner = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    width = len(keep)
    schema = ", ".join([*(f"k{i} {t}" for i, (_, t) in enumerate(inner.dtypes[:-1])), "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"])
    names = [*(f"k{i}" for i in range(width)), "n_words", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, width):
                counts, runs, texts = [], [], []
                for text in part.column(width).cast(pa.binary()):
                    words = (text.as_py() or b"").split()  # bytes are split at exactly the six blanks
                    found = Words(words).runs(least_exponent, least_words)
                    counts.append(len(words))
                    runs.append([{"start": s, "length": length, "period": p} for s, length, p in found])
                    texts.append(collapsed(words, found))
                columns = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(width)), *columns], names=names)

    out = inner.mapInArrow(tidy(run), schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names[width:])


def planted(text: Column, doc_id: Column) -> Column:
    """``text``; for ids whose crc32 is divisible by ten, its words from a place on repeat with a period (see ``op11_periodic``)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.when((h % 10 == 0) & F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), _repeated(words, F.floor(h / 10).cast("long"))).otherwise(text)


def _repeated(words: Column, g: Column) -> Column:
    n = F.greatest(F.size(words), F.lit(1))
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.concat_ws(" ", F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a))


def digests(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``periodic_runs`` rows with their longest run and digests in place of arrays and texts."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    top = found.withColumn("_top", longest)
    return top.select(
        *keep,
        "n_words",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_top.s")).alias("start"),
        F.col("_top.length").alias("length"),
        (-F.col("_top.p")).alias("period"),
        F.expr("(_top.length * 1000) div (-_top.p)").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
