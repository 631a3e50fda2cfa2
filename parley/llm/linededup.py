"""Line dedup by an exact set-similarity join.

A line is the set of its words (A-Z lowered, known by 64-bit hashes), and lines with one set are one
class. Words are ordered by rarity, counted over all lines in ``RARITY_BUCKETS`` buckets by hash (any
fixed order is right; the rarer its first words, the faster it is). Sets with a Jaccard similarity of
4/5 or more share a word of their prefixes, the rarest fifth and one. Classes meet at such words,
and pairs that their lengths, the word's positions, or parities of their words rule out are dropped:
each word turns over one of 128 bits, shared words cancel out, so two sets differ in at least as many
words as bits. A line goes if its class, or one similar to it, has an earlier line anywhere.

Classes meet in blocks of words, where each later class sends its likeliest earlier candidates,
``TRIES`` at most, and these are verified on the sets themselves. Where a class had more at a word and
none of the sent ones was similar, the sets of it and of the word's unsent candidates meet there whole.
Where a word has very many lines of one length, a class stops asking once it has candidates enough; should none of them
be similar, it meets all classes of the word whole. So nothing is missed, and groups of near copies, or lines of one
template, never make all their pairs.
A word that ``HOT_LINES`` lines or more have is no place to meet: its lines meet at its pairs with
another word of the prefix, which is one longer then (such sets share two words of these).

Order and places: documents by id (null first; ids that are not whole numbers by their 64-bit hash),
different texts of one id by their texts' hash, then line numbers from 0. Rows of one id and one text
share their place, so repeated rows are treated alike.

Cases: a null text stays null and has no lines; lines with fewer than ``min_words`` different words
stay, blank ones always; a line of any length is judged; a line without white space, as in Chinese or
Thai, is one word; empty and very long lines and texts are taken whole; an empty table gives no rows;
all other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import fresh, hashed_words, mixed, place_of, scaled_partitions, settle, shuffles_freed, SLICES, slices_of, small_batches, split_by_keys, stored, summed_slices, text_slices, tidy

MIN_WORDS = 1
RARITY_BUCKETS = 1 << 22
FILTER_BITS = 1 << 26  # a filter that is full passes more rows than needed, never fewer
HOT_LINES = 1 << 15
TRIES = 4
SURE = -36  # nine times the bits: one candidate is enough where four bits more would still do
WALK = 64  # neighbours at a word that are compared before rows with enough candidates stop asking
SHORT = "<u2"  # of the words of lines that meet whole
MEET = 4  # sets of fewer words are similar to equal ones only
PLACE = ["place", "mark", "line"]


def rarity_class(counts: np.ndarray) -> np.ndarray:
    """Eight bits that rise with the counts: no lines and one line 0, two lines 8, then eight steps a doubling."""
    return ((np.maximum(counts, 1).astype(np.float32).view(np.uint32) >> 20) - (127 << 3)).astype(np.uint8)


class Lines:
    """The lines of some rows (place, hash, text) that have words, as sets of word hashes by rarity."""

    def __init__(self, rows: pa.RecordBatch, shared: np.ndarray, rarity: np.ndarray | None = None):
        hashes, doc, start, raw = hashed_words(rows.column(2))
        breaks = np.cumsum(raw == 10, dtype=np.int32)
        number = breaks[start]  # line breaks before the word, over all texts
        new = np.ones(len(start), bool)
        new[1:] = (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        owner = (np.cumsum(new) - 1).astype(np.uint64)
        # by line, rarity and hash at once; the exact order only where these bits do not tell
        rare = rarity[(hashes & np.uint64(RARITY_BUCKETS - 1)).astype(np.int64)] if rarity is not None else np.zeros(len(hashes), np.uint8)
        both = owner << np.uint64(44) | rare.astype(np.uint64) << np.uint64(36) | hashes >> np.uint64(28)
        order = np.argsort(both, kind="stable")
        words, both = hashes[order], both[order]
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (both[1:] == both[:-1])
        if len(first) >= 1 << 20 or bool((both[1:] == both[:-1])[~again[1:]].any()):
            order = np.lexsort((hashes, rare, owner))
            words = hashes[order]
            again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        keep = ~again
        self.owner, self.words, self.rare = owner[keep].astype(np.int64), words[keep], rare[order][keep]
        self.size = np.bincount(self.owner, minlength=len(first))
        self.starts = np.cumsum(self.size) - self.size
        key = np.add.reduceat(mixed(self.words + np.uint64(1)), self.starts) if len(first) else np.empty(0, np.uint64)
        self.key = mixed(key ^ self.size.astype(np.uint64)).view(np.int64)
        at = doc[first]
        lengths = np.array([x or 0 for x in pc.binary_length(rows.column(2)).to_pylist()], np.int64)
        before = np.concatenate([[0], breaks])[np.cumsum(lengths) - lengths]  # breaks before the text
        self.place, self.hash = (rows.column(k).to_numpy(zero_copy_only=False)[at] for k in (0, 1))
        self.mark = np.where(passes(shared, spread(self.place)), self.hash, 0)
        self.line = (number[first] - before[at]).astype(np.int32)

    def at(self, line: int) -> np.ndarray:
        """The words of a line."""
        return self.words[self.starts[line] : self.starts[line] + self.size[line]]


def lines_in(batches: Iterator[pa.RecordBatch], *how) -> Iterator[Lines]:
    """The batches' lines, some hundred kilobytes of text at a time."""
    for batch in batches:
        for part in text_slices(batch, 2, 1 << 19):
            yield Lines(part, *how)


def spread(*values: np.ndarray) -> np.ndarray:
    """One 64-bit hash of some columns."""
    out = np.uint64(0)
    for v in values:
        out = mixed(v.astype(np.int64).view(np.uint64) + out + np.uint64(1))
    return out.view(np.int64)


NOTHING = np.zeros(1, np.uint8)


def key_filter(keys: DataFrame, columns: list[str]) -> np.ndarray:
    """A map of truth values by hash that holds for all rows of ``columns`` (and few others)."""
    count = keys.count()
    if not count:
        return NOTHING
    size = min(FILTER_BITS, max(1 << 16, 1 << (16 * count).bit_length()))
    width = size // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(spread(*(c.to_numpy(zero_copy_only=False) for c in batch.columns)) & (size - 1))
            yield slices_of(bits, np.ones(len(bits)), width)

    bits = summed_slices(keys.select(*columns).mapInArrow(tidy(run), "slice int, blob binary"), width, np.zeros(size, bool))
    return np.packbits(bits, bitorder="little")


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _survey(inner: DataFrame, min_words: int, shared) -> DataFrame:
    """Of every line its place and class (place, hash, mark, line, key); and partial counts of words (slice, blob)."""
    width = RARITY_BUCKETS // SLICES
    names = ["place", "hash", "mark", "line", "key", "slice", "blob"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: np.ndarray | None = None
        held: list[np.ndarray] = []

        def add() -> np.ndarray:
            more = np.bincount(np.concatenate(held), minlength=RARITY_BUCKETS).astype(np.uint32)
            held.clear()
            return more if counts is None else counts + more

        for lines in lines_in(batches, shared.value):
            ok = lines.size >= min_words
            n = int(ok.sum())
            if n:
                values = (lines.place, lines.hash, lines.mark, lines.line, lines.key)
                yield pa.RecordBatch.from_arrays([*(pa.array(v[ok], t) for v, t in zip(values, types)), *(pa.nulls(n, t) for t in types[5:])], names=names)
                held.append((lines.words & np.uint64(RARITY_BUCKETS - 1)).astype(np.int32))
                if sum(map(len, held)) > 2_000_000:
                    counts = add()
        if held:
            counts = add()
        if counts is not None:
            at = np.flatnonzero(counts)
            rows = slices_of(at, counts[at], width)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(rows.num_rows, t) for t in types[:5]), *rows.columns], names=names)

    return inner.mapInArrow(tidy(run), "place long, hash long, mark long, line int, key long, slice int, blob binary")


ROW = np.dtype([("word", "<u8"), ("key", "<u4"), ("place", "<i8"), ("mark", "<i8"), ("m0", "<u8"), ("m1", "<u8"), ("line", "<i4"), ("size", "<i4"), ("at", "<i4")])


def meeting_words(lines: Lines, use: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines ``use`` may meet similar ones: each row's place among the lines' words, and its word.

    Words that one line has are left out. A word of rarity ``hot`` or more gives one row for each
    later word of the prefix and one more.
    """
    at = np.arange(len(lines.words)) - lines.starts[lines.owner]
    size = lines.size[lines.owner]
    prefix = size - (4 * size + 4) // 5 + 1
    ok = use[lines.owner] & (lines.rare > 0)
    own = ok & (at < prefix)
    alone = np.flatnonzero(own & (lines.rare < hot))
    first = np.flatnonzero(own & (lines.rare >= hot))
    if not len(first):
        return alone, lines.words[alone]
    more = prefix[first] - at[first]  # words after it up to the longer prefix's end, which every such set has
    i = np.repeat(first, more)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more) - more, more)
    fits = (j < len(lines.words)) & (lines.owner[np.minimum(j, len(lines.words) - 1)] == lines.owner[i])
    i, j = i[fits], j[fits]
    return np.concatenate([alone, i]), np.concatenate([lines.words[alone], mixed(lines.words[i] + mixed(lines.words[j]))])


def prefix_rows(lines: Lines, min_words: int, hot: int) -> np.ndarray:
    """Of the earliest line of every class here, a row for each word where it may meet others."""
    order = np.lexsort((lines.line, lines.mark, lines.place, lines.key))
    use = np.zeros(len(order), bool)
    use[order[np.concatenate([[True], lines.key[order[1:]] != lines.key[order[:-1]]])[: len(order)]]] = True
    place, word = meeting_words(lines, use & (lines.size >= max(min_words, MEET)), hot)
    owner = lines.owner[place]
    rows = np.empty(len(place), ROW)
    rows["word"], rows["key"] = word, (lines.key[owner] >> 32).astype(np.uint32)
    for name in PLACE:
        rows[name] = getattr(lines, name)[owner]
    rows["size"], rows["at"] = lines.size[owner], place - lines.starts[owner]
    bit = np.uint64(1) << ((lines.words >> np.uint64(3)) & np.uint64(63))
    for k, name in enumerate(("m0", "m1")):
        turned = np.where((lines.words & np.uint64(1)) == k, bit, np.uint64(0))
        rows[name] = np.bitwise_xor.reduceat(turned, lines.starts)[owner] if len(turned) else 0
    return rows


def packed(rows: np.ndarray) -> bytes:
    """Rows sorted by word, by columns, words as differences, compressed."""
    columns = [np.diff(rows["word"], prepend=np.uint64(0)), *(rows[c] for c in ROW.names[1:])]
    parts = []
    for c in columns:
        split = np.empty((c.itemsize, len(c)), np.uint8)  # bytes of one place together, so that small numbers' zeros are
        split[:] = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T
        parts.append(split)
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(parts).reshape(-1).data)


def unpacked(blob: bytes) -> np.ndarray:
    """The rows of ``packed``."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at = len(raw) // ROW.itemsize, 0
    rows = np.empty(n, ROW)
    for name in ROW.names:
        width = ROW[name].itemsize
        split = np.empty((n, width), np.uint8)
        split[:] = raw[at : at + n * width].reshape(width, n).T
        rows[name] = split.reshape(-1).view(ROW[name])
        at += n * width
    rows["word"] = np.cumsum(rows["word"])
    return rows


def _prefixes(inner: DataFrame, min_words: int, hot: int, shared, rarity, buckets: int) -> DataFrame:
    """bucket, blob: packed rows by bucket of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def out() -> pa.RecordBatch:
            rows = np.concatenate(held)
            held.clear()
            bucket = (rows["word"] >> np.uint64(23)).astype(np.int64) % buckets
            order = np.argsort(rows["word"], kind="stable")
            order = order[np.argsort(bucket[order].astype(np.int32), kind="stable")]
            rows, bucket = rows[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([packed(rows[cuts[b] : cuts[b + 1]]) for b in full], pa.binary())], names=["bucket", "blob"])

        for lines in lines_in(batches, shared.value, rarity.value):
            held.append(prefix_rows(lines, min_words, hot))
            if sum(map(len, held)) > 400_000:
                yield out()
        if sum(map(len, held)):
            yield out()

    return inner.mapInArrow(tidy(run), "bucket int, blob binary")


def one_a_class(rows: np.ndarray) -> np.ndarray:
    """Of a class's rows at a word the earliest (now and then another too, which does no harm), by word and size."""
    rows = rows[np.argsort((rows["word"] & ~np.uint64((1 << 24) - 1)) | (rows["key"] >> np.uint32(8)), kind="stable")]
    same = np.zeros(len(rows), bool)
    same[1:] = True
    for name in ("word", "key", "size", "m0", "m1"):
        same[1:] &= rows[name][1:] == rows[name][:-1]
    if same.any():
        run = np.cumsum(~same)
        copied = np.flatnonzero(same | np.append(same[1:], False))
        order = copied[np.lexsort((rows["line"][copied], rows["mark"][copied], rows["place"][copied], run[copied]))]
        first = order[np.concatenate([[True], run[order[1:]] != run[order[:-1]]])]
        alone = np.ones(len(rows), bool)
        alone[copied] = False
        alone[first] = True
        rows = rows[alone]
    high = rows["word"] >> np.uint64(20)
    order = np.argsort(high << np.uint64(20) | np.minimum(rows["size"], (1 << 20) - 1).astype(np.uint64), kind="stable")
    high, word = high[order], rows["word"][order]
    if len(rows) and (rows["size"].max() >= 1 << 20 or ((high[1:] == high[:-1]) & (word[1:] != word[:-1])).any()):
        order = np.lexsort((rows["size"], rows["word"]))
    return rows[order]


def candidates(rows: np.ndarray, tries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of later and earlier classes that are sent; and rows of later and of earlier ones that are not."""
    word, size, at, m0, m1 = (np.ascontiguousarray(rows[c]) for c in ("word", "size", "at", "m0", "m1"))
    open_, found = np.arange(max(0, len(rows) - 1)), []
    least = tries + 1
    unsent = np.zeros(len(rows), bool)
    none = np.empty(0, np.int64)

    def likeliest() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, cost = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((rows["line"][b], rows["mark"][b], rows["place"][b], cost, a))
        a, b, cost = a[order], b[order], cost[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < least
        unsent[b[~keep]] = True
        return a[keep], b[keep], cost[keep]

    def near(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs, i before j, of one word whose sizes do not rule them out; they rise within a word."""
        inside = (i >= 0) & (j < len(rows))
        i, j = i[inside], j[inside]
        keep = (word[i] == word[j]) & (5 * size[i] >= 4 * size[j])
        return i[keep], j[keep]

    def fitting(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Later and earlier rows of the pairs that nothing rules out, and nine times the bits above the most allowed."""
        total = size[i] + size[j]
        share = np.minimum(at[i], at[j]) + np.minimum(size[i] - at[i], size[j] - at[j])
        apart = np.bitwise_count(m0[i] ^ m0[j]).astype(np.int64) + np.bitwise_count(m1[i] ^ m1[j])
        fits = (9 * share >= 4 * total) & (9 * (total - apart) >= 8 * total)
        i, j, cost = i[fits], j[fits], 9 * apart[fits] - total[fits]
        later = np.ones(len(i), bool)
        for name in reversed(PLACE):
            x, y = rows[name][i], rows[name][j]
            later = np.where(x == y, later, x > y)
        return np.where(later, i, j), np.where(later, j, i), cost

    for d in range(1, WALK):  # each row and the d-th after it
        open_, j = near(open_, open_ + d)
        if not len(open_):
            break
        found.append(fitting(open_, j))
    early = none
    low, high = near(open_, open_ + WALK) if len(open_) else (none, none)
    if len(low):  # crowded words: rows that have candidates enough stop asking
        times, best = np.zeros(len(rows), np.int64), np.full(len(rows), 1 << 40)
        shut = np.zeros(len(rows), bool)

        def note(a: np.ndarray, cost: np.ndarray) -> None:
            np.add.at(times, a, 1)
            np.minimum.at(best, a, cost)
            shut[a] = (times[a] >= least) | (best[a] <= SURE)

        for a, _, cost in found:
            note(a, cost)
        early = np.unique(np.concatenate([low, high]))
        early = early[shut[early]]
        up, down, d = low[~shut[low]], high[~shut[high]], WALK
        while len(up) or len(down):
            i, j = near(up, up + d)
            up = i
            i2, j2 = near(down - d, down)
            down = j2
            once = shut[i2]  # the others are asked from below
            a, b, cost = fitting(np.concatenate([i, i2[once]]), np.concatenate([j, j2[once]]))
            asks = ~shut[a]
            a, b, cost = a[asks], b[asks], cost[asks]
            if len(a):
                found.append((a, b, cost))
                note(a, cost)
                done = np.unique(a[shut[a]])
                early = np.concatenate([early, done])
                up, down = up[~shut[up]], down[~shut[down]]
                if len(found) > 64:
                    found = [likeliest()]
            d += 1
        if len(early):  # what they did not come to meets there whole if what is sent is not similar
            unsent |= np.isin(word, np.unique(word[early]))
    if not sum(len(f[0]) for f in found):
        return none, none, none, none
    a, b, cost = likeliest()
    first = np.searchsorted(a, a)
    sent = np.arange(len(a)) - first < np.where(cost[first] <= SURE, 1, tries)
    unsent[b[~sent]] = True
    return a[sent], b[sent], np.unique(np.concatenate([a[~sent], early])), np.flatnonzero(unsent)


def _pairs(prefixes: DataFrame, tries: int) -> DataFrame:
    """Later and earlier places to verify; null earlier: later had more at the word; null later: a candidate not sent there."""
    names = [*(f"later_{x}" for x in PLACE), *(f"earlier_{x}" for x in PLACE)]
    types = [pa.int64(), pa.int64(), pa.int32()]

    def run(table: pa.Table) -> pa.Table:
        rows = one_a_class(np.concatenate([unpacked(x) for x in table["blob"].to_pylist()]))
        a, b, more, unsent = candidates(rows, tries)
        columns = []
        for parts in ((a, more, len(unsent)), (b, len(more), unsent)):
            for name, t in zip(PLACE, types):
                columns.append(pa.concat_arrays([pa.nulls(p, t) if isinstance(p, int) else pa.array(rows[name][p], t) for p in parts]))
        words = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(rows["word"][np.concatenate([more, unsent])].view(np.int64))])
        return pa.table([*columns, words], names=[*names, "word"])

    kinds = ", ".join(f"{n} {t}" for n, t in zip(names, 2 * ["long", "long", "int"]))
    return prefixes.groupBy("bucket").applyInArrow(run, f"{kinds}, word long").distinct()


def _side(pairs: DataFrame, side: str) -> DataFrame:
    return pairs.select(*(F.col(f"{side}_{x}").alias(x) for x in PLACE))


def _sets(inner: DataFrame, shared, places: DataFrame, short: str | None = None) -> DataFrame:
    """place, mark, line, words (a blob of sorted hashes) of these lines (and few others); short: the hashes' low bytes, of this type."""
    context = inner.sparkSession.sparkContext
    rows, wanted = context.broadcast(key_filter(places.select("place").distinct(), ["place"])), context.broadcast(key_filter(places, PLACE))
    kinds = {"words": "<u8"} | ({"short": short} if short else {})

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(rows.value, spread(batch.column(0).to_numpy(zero_copy_only=False)))))
            if batch.num_rows:
                yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in lines_in(few(batches), shared.value):
            use = np.flatnonzero(passes(wanted.value, spread(lines.place, lines.mark, lines.line)))
            if len(use):
                blobs = [pa.array([np.sort(lines.at(i).astype(kind)).tobytes() for i in use.tolist()], pa.binary()) for kind in kinds.values()]
                yield pa.RecordBatch.from_arrays([*(pa.array(getattr(lines, n)[use]) for n in PLACE), *blobs], names=[*PLACE, *kinds])

    schema = ", ".join(["place long, mark long, line int", *(f"{name} binary" for name in kinds)])
    return inner.mapInArrow(tidy(run), schema).groupBy(*PLACE).agg(*(F.max(name).alias(name) for name in kinds))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The later places of the pairs whose sets have a Jaccard similarity of 4/5 or more."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(3), batch.column(4)):
                a, b = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                keep.append(9 * int((b[at] == a).sum()) >= 4 * (len(a) + len(b)))
            yield pa.RecordBatch.from_arrays(batch.columns[:3], names=PLACE).filter(pa.array(keep, pa.bool_()))

    for side, name in (("later", "a"), ("earlier", "b")):
        pairs = pairs.join(sets.select(*(F.col(x).alias(f"{side}_{x}") for x in PLACE), F.col("words").alias(name)), [f"{side}_{x}" for x in PLACE])
    both = pairs.select(*(F.col(f"later_{x}").alias(x) for x in PLACE), "a", "b")
    return both.mapInArrow(tidy(similar), "place long, mark long, line int").distinct()


def _compared(meeting: DataFrame, sets: DataFrame, column: str, kind: str) -> DataFrame:
    """Of the rows (word, place, mark, line, asks) that ask, each with the most similar earlier one at the word, if one is similar enough.

    The sets in ``column``, of this type, meet whole. Where they are low bytes, words may be taken for others, so a pair
    may be less similar than it seems, and no similar one is passed over.
    """
    names = [*(f"later_{x}" for x in PLACE), *(f"earlier_{x}" for x in PLACE)]
    types = [pa.int64(), pa.int64(), pa.int32()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            sets = [np.frombuffer(r[column], kind) for r in held]
            size = np.array([len(s) for s in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            found = []
            for k, r in enumerate(held):
                if r["asks"]:
                    a, b = np.searchsorted(flat, sets[k]), np.searchsorted(flat, sets[k], "right")
                    both = np.zeros(len(sets), np.int64)
                    for x, y in zip(a.tolist(), b.tolist()):
                        both[owner[x:y]] += 1
                    over = 9 * both - 4 * (size + size[k])
                    near = np.flatnonzero(over >= 0)
                    near = [j for j in near[np.argsort(-over[near], kind="stable")].tolist() if [held[j][n] for n in PLACE] < [r[n] for n in PLACE]]
                    if near:
                        found.append((r, held[near[0]]))
            held.clear()
            columns = [pa.array([pair[side][n] for pair in found], t) for side in (0, 1) for n, t in zip(PLACE, types)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for r in batch.to_pylist():
                if held and held[-1]["word"] != r["word"]:
                    yield out()
                held.append(r)
        if held:
            yield out()

    by_word = meeting.join(sets.select(*PLACE, column), PLACE).repartition("word").sortWithinPartitions("word")
    return by_word.mapInArrow(tidy(compare), ", ".join(f"{n} {t}" for n, t in zip(names, 2 * ["long", "long", "int"]))).distinct()


def _met(meeting: DataFrame, inner: DataFrame, shared) -> DataFrame:
    """The places of the rows (word, place, mark, line, asks) that ask and are similar to an earlier one at the word.

    Low bytes of the words' hashes meet, a fourth of the whole, and what they find is verified on the whole sets; lines
    of which that was not similar meet by whole hashes.
    """
    sets = stored(_sets(inner, shared, meeting.select(*PLACE).distinct(), SHORT), "line-meets")
    alike = stored(_compared(meeting, sets, "short", SHORT), "line-alike")
    _, some = split_by_keys(sets, _side(alike, "later").union(_side(alike, "earlier")), PLACE)  # most lines are in no pair
    similar = settle(_verified(alike, some))
    doubtful = settle(_side(alike, "later").distinct().join(similar, PLACE, "left_anti"))
    if doubtful.isEmpty():
        return similar
    asking = doubtful.withColumn("doubt", F.lit(True))
    rows = meeting.join(asking, PLACE, "left").withColumn("asks", F.col("asks") & F.col("doubt").isNotNull()).drop("doubt")
    words = rows.filter("asks").select("word").distinct()
    rows = settle(rows.join(words, "word", "left_semi"))
    _, some = split_by_keys(sets, rows, PLACE)
    return similar.union(_side(_compared(rows, some, "words", "<u8"), "later")).distinct()


def _inner(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(place_of(docs, id_col).alias("place"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))


def _gone(docs: DataFrame, *how) -> DataFrame:
    """place, hash (of the text), lines: the sorted numbers of the lines that go, of each text that loses any.

    They are stored, and each step before frees its shuffle files, so that the texts' shuffle has the disk for itself.
    """
    with shuffles_freed(docs.sparkSession):
        return stored(_found(docs, *how), "lines-gone")


def _found(docs: DataFrame, min_words: int, id_col: str, text_col: str, tries: int, hot_lines: int) -> DataFrame:
    """The rows of ``_gone``."""
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    inner = _inner(docs, id_col, text_col)
    hot = int(rarity_class(np.array([hot_lines]))[0])
    several = inner.groupBy("place").agg(F.min("hash").alias("x"), F.max("hash").alias("y")).filter("x <> y").select("place")
    shared = context.broadcast(key_filter(several, ["place"]))
    survey = stored(_survey(inner, min_words, shared), "lines")
    counts = survey.filter("slice is not null").select("slice", "blob")
    rarity = context.broadcast(rarity_class(summed_slices(counts, RARITY_BUCKETS // SLICES, np.zeros(RARITY_BUCKETS, np.uint32))))
    lines = survey.filter("slice is null").select("place", "hash", "mark", "line", "key")
    buckets = scaled_partitions(docs.sparkSession, 3)
    tried = stored(_pairs(_prefixes(inner, min_words, hot, shared, rarity, buckets), tries), "line-pairs")
    pairs = tried.filter("later_line is not null and earlier_line is not null")
    sets = stored(_sets(inner, shared, _side(pairs, "later").union(_side(pairs, "earlier")).distinct()), "line-sets")
    matched = settle(_verified(pairs, sets))
    again = settle(_side(tried.filter("earlier_line is null"), "later").join(matched, PLACE, "left_anti"))
    if not again.isEmpty():  # the few of which none that was sent is similar
        places = lambda side: [F.col(f"{side}_{x}").alias(x) for x in PLACE]
        asking = tried.filter("earlier_line is null").select("word", *places("later")).join(again, PLACE, "left_semi")
        others = tried.filter("later_line is null").select("word", *places("earlier")).join(asking.select("word").distinct(), "word", "left_semi")
        both = asking.withColumn("asks", F.lit(True)).unionByName(others.withColumn("asks", F.lit(False)))
        meeting = settle(both.groupBy("word", *PLACE).agg(F.max("asks").alias("asks")))
        matched = matched.union(_met(meeting, inner, shared)).distinct()
    first = lines.groupBy("key").agg(F.min(F.struct("place", "hash", "line", "mark")).alias("f")).select("f.*")
    kept = first.join(matched, PLACE, "left_anti").select("place", "hash", "line", F.lit(True).alias("kept"))
    both = lines.select("place", "hash", "line", F.lit(False).alias("kept")).union(kept)
    numbers = {k: F.collect_list(F.when(F.col("kept") == F.lit(k), F.col("line"))) for k in (False, True)}
    return both.groupBy("place", "hash").agg(F.sort_array(F.array_except(numbers[False], numbers[True])).alias("lines")).filter(F.size("lines") > 0)


def _with_gone(docs: DataFrame, gone: DataFrame, id_col: str, text_hash: Column, lines: str) -> DataFrame:
    """``docs`` with the column ``lines``, null where no line goes."""
    place, mark = fresh(docs, "place"), fresh(docs, "hash")
    keyed = docs.withColumns({place: place_of(docs, id_col), mark: text_hash})
    return keyed.join(gone.select(F.col("place").alias(place), F.col("hash").alias(mark), F.col("lines").alias(lines)), [place, mark], "left")


def removals(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", tries: int = TRIES, hot_lines: int = HOT_LINES) -> DataFrame:
    """Per row: its id, n_lines, and removed, the sorted numbers of its lines that go."""
    gone = _gone(docs, min_words, id_col, text_col, tries, hot_lines)
    counted = docs.select(F.col(id_col), F.coalesce(F.size(F.split(text_col, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), F.xxhash64(text_col).alias("hash of text"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return _with_gone(counted, gone, id_col, F.col("hash of text"), "removed").select(id_col, "n_lines", removed.alias("removed"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", tries: int = TRIES, hot_lines: int = HOT_LINES) -> DataFrame:
    """``docs`` with the same columns, without the lines that repeat or resemble earlier ones."""
    gone = _gone(docs, min_words, id_col, text_col, tries, hot_lines)
    lines = fresh(docs, "lines")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda _, i: ~F.array_contains(lines, i))
    cleaned = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return _with_gone(docs, gone, id_col, F.xxhash64(text_col), lines).withColumn(text_col, cleaned).select(*docs.columns)
