"""Edit distances of long sequences, a column of the table at a time as bits.

A column of edit distances is two bit vectors of its steps up and down, and the next column follows by
a few operations on whole integers, so a pair of n and m items costs n * m / 64 word operations and memory for
one column, whatever the items are. Where an alignment is needed, columns are computed again from a middle one:
first the right half, then the left, so memory grows with the logarithm of the columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HELD = 64  # columns whose steps are held at once

Steps = tuple[int, int, int, int]  # by row: one up or one down from the row before; one up or one down from the column before


def places(rows: Sequence) -> dict:
    """The rows of each item as bits."""
    found: dict[object, list[int]] = {}
    for i, x in enumerate(rows):
        found.setdefault(x, []).append(i)
    bits = {}
    for x, at in found.items():
        raw = bytearray(at[-1] // 8 + 1)
        for i in at:
            raw[i >> 3] |= 1 << (i & 7)
        bits[x] = int.from_bytes(raw, "little")
    return bits


def columns(at: dict, n: int, items: Sequence, up: int, down: int) -> Iterator[Steps]:
    """The columns of ``items`` after the one with steps ``up`` and ``down``, for n rows with items at ``at``."""
    full = (1 << n) - 1
    for x in items:
        same = at.get(x, 0)
        level = (((same & up) + up) ^ up) | same
        right_up = down | (full & ~(level | up))
        right_down = up & level
        moved_up, moved_down = (right_up << 1 | 1) & full, right_down << 1 & full
        met = same | down
        up, down = moved_down | (full & ~(met | moved_up)), moved_up & met
        yield up, down, right_up, right_down & full


def distance(left: Sequence, right: Sequence) -> int:
    """Insertions, deletions and replacements from one sequence to the other."""
    if len(left) < len(right):
        left, right = right, left
    n = len(left)
    if not right:
        return n
    last, total = 1 << (n - 1), n
    for _, _, up, down in columns(places(left), n, right, (1 << n) - 1, 0):
        total += bool(up & last) - bool(down & last)
    return total


def split_errors(reference: Sequence, hypothesis: Sequence, boundary: int) -> tuple[int, int]:
    """Errors of the best alignment before and from a place of the reference; insertions count where they stand.

    Of equally good alignments, read from the end, the one that pairs first, then drops a reference item, then inserts.
    """
    n, m = len(reference), len(hypothesis)
    total = distance(reference, hypothesis)
    if boundary >= n:
        return total, 0
    if boundary <= 0:
        return 0, total
    at, row, later, done = places(reference), n, 0, False

    def back(first: int, end: int, up: int, down: int) -> None:
        """Walk back from column ``end`` to ``first``, whose steps are given, until the boundary is left upwards."""
        nonlocal row, later, done
        if end - first > HELD:
            middle = (first + end) // 2
            for step in columns(at, n, hypothesis[first:middle], up, down):
                pass
            back(middle, end, *step[:2])
            if not done:
                back(first, middle, up, down)
            return
        held = list(columns(at, n, hypothesis[first:end], up, down))
        for j in range(end, first, -1):
            v_up, v_down, h_up, h_down = held[j - first - 1]
            while True:
                bit = 1 << (row - 1)
                equal = reference[row - 1] == hypothesis[j - 1]
                rise = bool(v_up & bit) - bool(v_down & bit)
                across = 1 if row == 1 else bool(h_up & bit >> 1) - bool(h_down & bit >> 1)
                pairs = equal or rise + across == 1
                if row == boundary and (pairs or rise == 1):
                    done = True
                    return
                later += not (pairs and equal)
                row -= pairs or rise == 1
                if pairs or rise != 1:
                    break

    back(0, m, (1 << n) - 1, 0)
    if not done:
        later += row - boundary
    return total - later, later


def word_distance(left: Column, right: Column) -> Column:
    """The distance in words of two arrays of words; null if one is."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:  # no built-in form
        return pd.Series([None if x is None or y is None else distance(list(x), list(y)) for x, y in zip(a, b)], dtype="Int32")

    return run(left, right)


def word_and_letter_distances(left: Column, right: Column) -> Column:
    """Struct words, letters: distances of two arrays of words, and of the words joined by blanks; null if one is."""

    @F.pandas_udf("words int, letters int")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [(None, None) if x is None or y is None else (distance(list(x), list(y)), distance(" ".join(x), " ".join(y))) for x, y in zip(a, b)]
        return pd.DataFrame(found, columns=["words", "letters"]).astype("Int32")

    return run(left, right)
