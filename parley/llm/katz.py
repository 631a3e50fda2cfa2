"""Language-model scores: Katz backoff over word bigrams with Good-Turing discounts.

Tokens are words (A-Z lowered, white space dropped) and one end per text; a word is known by its
64-bit hash. All words and all bigrams of the training texts are counted into a table of buckets and
none is pruned, so the model grows with its texts. A seen bigram has its discounted probability; any
other token backs off to its unigram probability times the history's weight, which is chosen so that
the probabilities after every history add up to one exactly. Unigram probabilities are Good-Turing
discounted and leave the rest to one unknown word.

Words with at least the share ``MIN_SHARE`` of all tokens are common: at most 1 / ``MIN_SHARE`` of
them exist at any size, so their counts and backoff weights are broadcast and they go by their place
there. All else meets in buckets, of which there are as many as ``BUCKET_TOKENS`` wants. A bigram of common words is dealt by its history, and a history
by its share of tokens to as many buckets as it needs; any other bigram by its rarer word (the second
if both are rare), so that the word's own count is known in its bucket, too. A slice of texts sends each bucket
one sorted and compressed list of the bigrams asked for; a bucket sends each slice one list of sums.
What a bigram of two rare words needs from its history's bucket is joined to it when the model is
built, and its backoff weight is asked for besides. The share only decides what goes where, never a
result. Logs are summed as whole multiples of 2^-34, so no order of sums changes a score.

Cases: a null text counts as empty (one token, its end); an empty training set knows no word, and
the unknown word then has probability one; texts are scored whole; repeated rows are scored each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import hashed_words, scaled_partitions, small_batches, stored, text_slices, tidy, tidy_group

MIN_SHARE = 2.0**-22
GT_MOST = 5  # counts up to this one are discounted
SLICE = 2000  # texts that ask together; their places fit 16 bits
BUCKET_TOKENS = 1 << 20  # training tokens a bucket, about
HELD = 1_000_000  # bigrams counted in a task before they go out
#: Codes of common words are their places; START follows. Rarer words go by their hashes, whose top bit is set.
START, BACKOFF, RARE_FIRST = 1 << 22, 1 << 25, 1 << 24
PLACES = np.uint64(23)
TOP = np.uint64(1) << np.uint64(63)
END = TOP  # not the hash of a word
UNIT = 2.0**34


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' hashes, and each text's first token and the end of the last."""
    words, doc, _, _ = hashed_words(texts)
    words = words | TOP
    words[words == END] += np.uint64(1)
    starts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)) + 1)])
    out = np.full(starts[-1], END)
    out[np.arange(len(words)) + doc] = words
    return out, starts


def slices_of_texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut to ``SLICE`` texts and some megabytes."""
    for batch in batches:
        for part in text_slices(batch, column, 2 << 20):
            for at in range(0, part.num_rows, SLICE):
                yield part.slice(at, SLICE)


def unigram_counts(train: DataFrame) -> DataFrame:
    """w, c of all tokens in the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            w, c = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(w, kind="stable")
            w = w[order]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            return w[first], np.add.reduceat(c[order], first)

        def out() -> pa.RecordBatch:
            w, c = held[0]
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], names=["w", "c"])

        for part in slices_of_texts(batches, 0):
            held.append(np.unique(tokens_of(part.column(0))[0], return_counts=True))
            size += len(held[-1][0])
            if size > HELD:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield out()
                    held, size = [], 0
        if size:
            held[:] = [merged()]
            yield out()

    small_batches(train.sparkSession)
    return train.select("text").mapInArrow(tidy(run), "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """Katz' factors for the counts 0 to ``GT_MOST`` (index 0 is unused); 1 where Good-Turing is undefined."""
    n = [counts_of_counts.get(r, 0) for r in range(GT_MOST + 2)]
    out = np.ones(GT_MOST + 1)
    if n[1] == 0:
        return out
    common = (GT_MOST + 1) * n[GT_MOST + 1] / n[1]
    for r in range(1, GT_MOST + 1):
        if n[r] and n[r + 1] and common < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            out[r] = d if 0 < d <= 1 else 1.0
    return out


@dataclass
class Unigrams:
    """Discounted unigram probabilities by count, and the unknown word's."""

    total: int
    distinct: int
    factors: np.ndarray
    scale: float
    unknown: float

    @classmethod
    def of(cls, total: int, distinct: int, counts_of_counts: dict[int, int]) -> Unigrams:
        factors = discounts(counts_of_counts)
        if not total:
            return cls(0, 0, factors, 1.0, 1.0)
        freed = sum((1 - factors[r]) * r * counts_of_counts.get(r, 0) for r in range(1, GT_MOST + 1)) / total
        least = 1 / (total + 1)
        if freed >= least:
            return cls(total, distinct, factors, 1.0, freed)
        scale = (1 - least) / (1 - freed)
        return cls(total, distinct, factors, scale, least)

    def p(self, count: np.ndarray) -> np.ndarray:
        """Probability of a word with this count; 0 stands for the unknown word."""
        d = np.where(count > GT_MOST, 1.0, self.factors[np.minimum(count, GT_MOST)])
        return np.where(count > 0, self.scale * d * count / max(self.total, 1), self.unknown)


def factor(factors: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The discount factors of these counts."""
    return np.where(count > GT_MOST, 1.0, factors[np.minimum(count, GT_MOST)])


@dataclass
class Model:
    """Common words by hash, with their counts and, as histories, totals and backoff weights; and the discounts.

    ``totals`` and ``backoff_log`` have one entry more than the words: the last is the text's start.
    """

    words: np.ndarray
    counts: np.ndarray
    unigrams: Unigrams
    totals: np.ndarray
    backoff_log: np.ndarray
    factors: np.ndarray
    buckets: int

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's place among the common words, itself if it is rarer."""
        if not len(self.words):
            return hashes
        some, at = np.unique(hashes, return_inverse=True)
        place = np.minimum(np.searchsorted(self.words, some), len(self.words) - 1)
        return np.where(self.words[place] == some, place.astype(np.uint64), some)[at]

    def place(self, history: np.ndarray) -> np.ndarray:
        """Where a common history's total and weight are."""
        return np.minimum(history, np.uint64(len(self.words))).astype(np.int64)

    def mass(self) -> np.ndarray:
        """The tokens after all histories before each one, and all at the end."""
        return np.concatenate([[0.0], np.cumsum(self.totals)])

    def bucket(self, major: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """The bucket of pairs: it rises with the major within the common and within the rarer ones."""
        common = major < TOP
        h = self.place(major >> PLACES)
        at = mass[h] + self.totals[np.minimum(h, len(self.totals) - 1)] * ((major & np.uint64((1 << 23) - 1)).astype(float) / (1 << 23))
        spread = at / max(mass[-1], 1.0)
        spread = np.where(common, spread, ((major & ~TOP) >> np.uint64(10)).astype(float) / 2.0**53)
        return np.minimum((spread * self.buckets).astype(np.int32), self.buckets - 1)


def pairs_of(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token its bigram as (major, minor): of common words (both places, 0), else the rarer word and the other.

    (w, h) has a common h, (h, RARE_FIRST + w) a common w, and (w, h) with a hash h no common word.
    """
    before = np.concatenate([[np.uint64(START)], codes[:-1]])[: len(codes)]
    before[starts[:-1]] = START
    rare_h, rare_w = before >= TOP, codes >= TOP
    major = np.where(rare_w, codes, np.where(rare_h, before, before << PLACES | codes))
    minor = np.where(rare_w, before, np.where(rare_h, codes + np.uint64(RARE_FIRST), np.uint64(0)))
    return major, minor


def sort_of(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """An order by major, then minor; the minor counts for rarer words only."""
    rare = np.flatnonzero(major >= TOP)
    common = np.flatnonzero(major < TOP)
    return np.concatenate([common[np.argsort(major[common], kind="stable")], rare[np.lexsort((minor[rare], major[rare]))]])


def packed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned 64-bit values, the first as differences, bytes of one place together, compressed."""
    parts = []
    for k, c in enumerate(columns):
        c = np.ascontiguousarray(c).astype(np.uint64, copy=False)
        c = np.diff(c, prepend=np.uint64(0)) if k == 0 else c
        split = np.empty((8, len(c)), np.uint8)
        split[:] = np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T
        parts.append(split.reshape(-1))
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(parts).data)


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    """The columns of ``packed``."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, 8, -1)
    out = [np.ascontiguousarray(c.T).reshape(-1).view(np.uint64) for c in raw]
    out[0] = np.cumsum(out[0])
    return out


def by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """The rows of each bucket, packed; rows of one bucket keep their order."""
    order = np.argsort(bucket.astype(np.int16 if bucket.max(initial=0) < 1 << 15 else np.int32), kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if y > x:
            yield int(bucket[x]), packed(*(c[x:y] for c in columns))


def summed_pairs(major: np.ndarray, minor: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, in order, with the sum of its counts."""
    order = sort_of(major, minor)
    major, minor = major[order], minor[order]
    first = np.flatnonzero(np.concatenate([[True], (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])])[: len(major)])
    return major[first], minor[first], np.add.reduceat(count[order], first) if len(first) else count[:0]


def bigram_table(train: DataFrame, model: Model) -> DataFrame:
    """bucket, blob (major, minor, count of its bigrams), few (how many occur once, twice, ... ``GT_MOST`` + 1 times)."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, mass = shared.value, shared.value.mass()
        held, size = [], 0

        def out() -> pa.RecordBatch:
            pairs = summed_pairs(*(np.concatenate(x) for x in zip(*held)))
            rows = list(by_bucket(model.bucket(pairs[0], mass), list(pairs)))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "blob"])

        for part in slices_of_texts(batches, 0):
            hashes, starts = tokens_of(part.column(0))
            major, minor = pairs_of(model.codes(hashes), starts)
            held.append(summed_pairs(major, minor, np.ones(len(major), np.uint64)))
            size += len(held[-1][0])
            if size > HELD:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def add(table: pa.Table) -> pa.Table:
        major, minor, count = summed_pairs(*(np.concatenate(x) for x in zip(*(unpacked(b, 3) for b in table["blob"].to_pylist()))))
        few = np.bincount(np.minimum(count, GT_MOST + 2).astype(np.int64), minlength=GT_MOST + 3)[1 : GT_MOST + 2]
        return pa.table({"bucket": table["bucket"].slice(0, 1), "blob": pa.array([packed(major, minor, count)], pa.binary()), "few": pa.array([few.tolist()], pa.list_(pa.int64()))})

    partial = train.select("text").mapInArrow(tidy(run), "bucket int, blob binary")
    return stored(partial.groupBy("bucket").applyInArrow(tidy_group(add), "bucket int, blob binary, few array<long>"), "bigrams")


@dataclass
class Bucket:
    """A bucket's bigrams, with the counts of their words."""

    major: np.ndarray
    minor: np.ndarray
    count: np.ndarray

    def __post_init__(self):
        self.common = self.major < TOP
        self.after_rare = ~self.common & (self.minor >= RARE_FIRST) & (self.minor < TOP)  # by a rare history, whose count is not here
        of_word = ~self.common & ~self.after_rare
        words, first = np.unique(self.major[of_word], return_index=True)
        self.words = words
        self.word_counts = np.add.reduceat(self.count[of_word], first).astype(np.int64) if len(words) else np.empty(0, np.int64)

    def counts_of(self, words: np.ndarray) -> np.ndarray:
        """The counts of rarer words of this bucket; 0 if unknown."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.word_counts[at], 0)

    def second(self, model: Model, major: np.ndarray, minor: np.ndarray) -> np.ndarray:
        """The counts of the second words of pairs of this bucket."""
        common = major < TOP
        place = np.where(common, major & np.uint64((1 << 23) - 1), minor - np.uint64(RARE_FIRST))
        known = common | ((minor >= RARE_FIRST) & (minor < TOP))
        out = self.counts_of(major)
        if len(model.words):
            out = np.where(known, model.counts[np.where(known, np.minimum(place, np.uint64(len(model.words) - 1)), np.uint64(0)).astype(np.int64)], out)
        return out


def freed(kept: np.ndarray, total: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals, by one more where nothing was freed, and the logs of the backoff weights."""
    total = total + (kept > total * (1 - 1e-9))
    return total, np.log10((1 - kept / np.maximum(total, 1)) / np.maximum(1 - lower, 1e-300))


def fit(train: DataFrame, min_share: float = MIN_SHARE) -> tuple[Model, DataFrame]:
    """The model of the texts in the column text, and its table of buckets.

    Its rows are (bucket, blob), the bigrams, or (bucket, major, minor, v, t): what a bigram of rare
    words adds, or the backoff log and the total of a rare history (minor ``BACKOFF``).
    """
    spark = train.sparkSession
    unigrams = stored(unigram_counts(train), "unigrams")
    by_count = unigrams.groupBy(F.least("c", F.lit(GT_MOST + 2)).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("t")).collect()
    total, distinct = sum(r.t for r in by_count), sum(r.n for r in by_count)
    base = Unigrams.of(total, distinct, {r.r: r.n for r in by_count})
    least = max(1, math.ceil(min_share * total))
    common = unigrams.filter(F.col("c") >= least).toArrow()  # at most 1 / min_share rows
    words, counts = common["w"].to_numpy().view(np.uint64), common["c"].to_numpy()
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    texts = unigrams.filter(F.col("w") == F.lit(int(END.view(np.int64)))).agg(F.sum("c")).first()[0] or 0
    model = Model(words, counts, base, np.append(counts, texts).astype(float), np.zeros(len(words) + 1), np.ones(GT_MOST + 1), max(scaled_partitions(spark), math.ceil(total / BUCKET_TOKENS)))
    model.totals[:-1][words == END] = 0  # nothing follows an end
    bigrams = bigram_table(train, model)
    few = bigrams.select(F.posexplode("few").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()
    model.factors = discounts({r.r + 1: r.n for r in few})
    shared = spark.sparkContext.broadcast(model)
    names = ["kind", "h", "w", "kept", "lower", "t"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of histories what is kept and the lower probabilities of seen words; kind 0 common, 1 rare, 2 rare before a rare word."""
        model = shared.value

        def rows(kind: int, h: np.ndarray, w: np.ndarray, kept: np.ndarray, lower: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(w.view(np.int64)), pa.array(kept.astype(float)), pa.array(lower.astype(float)), pa.array(t.astype(np.int64))], names=names)

        def added(h: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
            some, at = np.unique(h, return_inverse=True)
            return some, *[np.bincount(at, v, len(some)) for v in values]

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                b = Bucket(*unpacked(blob, 3))
                count = b.count.astype(np.int64)
                kept = factor(model.factors, count) * count
                lower = model.unigrams.p(b.second(model, b.major, b.minor))
                first = ~b.common & ~b.after_rare & (b.minor < TOP)
                use = b.common | first
                h, k, low = added(np.where(b.common, b.major >> PLACES, b.minor)[use], kept[use], lower[use])
                yield rows(0, h, np.zeros(len(h), np.uint64), k, low, np.zeros(len(h)))
                h, k, low = added(np.concatenate([b.words, b.major[b.after_rare]]), np.concatenate([np.zeros(len(b.words)), kept[b.after_rare]]), np.concatenate([np.zeros(len(b.words)), lower[b.after_rare]]))
                yield rows(1, h, np.zeros(len(h), np.uint64), k, low, b.counts_of(h))
                both = ~b.common & (b.minor >= TOP)
                yield rows(2, b.minor[both], b.major[both], kept[both], lower[both], np.zeros(int(both.sum())))

    parts = stored(bigrams.select("blob").mapInArrow(tidy(sums), "kind int, h long, w long, kept double, lower double, t long"), "histories")
    seen = parts.filter("kind = 0").groupBy("h").agg(F.sum("kept").alias("kept"), F.sum("lower").alias("lower")).toArrow()  # at most 1 / min_share rows and the start
    place = model.place(seen["h"].to_numpy().astype(np.uint64))
    model.totals[place], model.backoff_log[place] = freed(seen["kept"].to_numpy(), model.totals[place], seen["lower"].to_numpy())

    rare = parts.filter("kind > 0").groupBy("h").agg(F.sum("kept").alias("kept"), F.sum("lower").alias("lower"), F.sum("t").cast("double").alias("t"))
    more = F.col("t") + (F.col("kept") > F.col("t") * (1 - 1e-9)).cast("double")
    weighed = rare.filter("kept > 0").select("h", more.alias("t"), F.log10((1 - F.col("kept") / more) / (1 - F.col("lower"))).alias("b"))
    weights = stored(weighed, "weights")
    both = parts.filter("kind = 2").drop("t").join(weights, "h").select("h", "w", (F.log10(F.col("kept") / F.col("t")) - F.col("b")).alias("v"))
    buckets = model.buckets

    def of(major):  # the same as Model.bucket for rarer words
        bits = F.shiftrightunsigned(F.col(major).bitwiseAND(F.lit((1 << 63) - 1)), 10).cast("double")
        return F.least(F.floor(bits / F.lit(2.0**53) * F.lit(buckets)), F.lit(buckets - 1)).cast("int").alias("bucket")

    extra = both.select(of("w"), F.col("w").alias("major"), F.col("h").alias("minor"), "v", F.lit(0.0).alias("t"))
    extra = extra.union(weights.select(of("h"), F.col("h").alias("major"), F.lit(BACKOFF).cast("long").alias("minor"), "b", "t"))
    return model, bigrams.select("bucket", "blob").unionByName(extra, allowMissingColumns=True)


class Index:
    """Pairs, to be looked up."""

    def __init__(self, major: np.ndarray, minor: np.ndarray):
        self.major, self.minor = major, minor
        mix = self.mix(major, minor)
        self.order = np.argsort(mix, kind="stable")
        self.sorted = mix[self.order]

    @staticmethod
    def mix(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
        return major + minor * np.uint64(0x9E3779B97F4A7C15)

    def find(self, major: np.ndarray, minor: np.ndarray) -> np.ndarray:
        """The pairs' places; -1 where they are not."""
        if not len(self.order):
            return np.full(len(major), -1)
        at = self.order[np.minimum(np.searchsorted(self.sorted, self.mix(major, minor)), len(self.order) - 1)]
        return np.where((self.major[at] == major) & (self.minor[at] == minor), at, -1)


class Answers:
    """What a bucket knows about asked pairs: ``extra`` are its rows (major, minor, v, t)."""

    def __init__(self, model: Model, bucket: Bucket, extra: list[np.ndarray], below: float):
        self.model, self.bucket, self.below = model, bucket, below
        self.pairs, self.extra = Index(bucket.major, bucket.minor), Index(extra[0], extra[1])
        self.v, self.t = np.append(extra[2], 0.0), np.append(extra[3], 0.0)  # the last stands for what is not there
        self.count = np.append(bucket.count.astype(np.int64), 0)

    def of(self, major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The logs that pairs add to the score and to the base score, and whether they are a known rarer word."""
        model = self.model
        common, weight = major < TOP, ~(major < TOP) & (minor == BACKOFF)
        after_rare = ~common & (minor >= RARE_FIRST) & (minor < BACKOFF)
        of_word = ~common & ~after_rare & ~weight
        both = of_word & (minor >= TOP)
        by_common = common | (of_word & ~both)
        h = model.place(np.where(by_common, np.where(common, major >> PLACES, minor), np.uint64(0)))
        own = self.extra.find(major, np.full(len(major), BACKOFF, np.uint64))  # the rare history's weight
        back = np.where(by_common, model.backoff_log[h], np.where(after_rare | weight, self.v[own], 0.0))
        total = np.where(by_common, model.totals[h], self.t[own])
        times = self.bucket.counts_of(major)
        second = np.log10(np.maximum(model.unigrams.p(np.where(weight, 1, self.bucket.second(model, major, minor))), 1e-300))
        count = self.count[self.pairs.find(major, minor)]
        direct = np.log10(np.maximum(factor(model.factors, count) * count, 1e-300) / np.maximum(total, 1))
        more = self.extra.find(major, minor)
        score = np.where(weight, back, back + second)
        score = np.where((count > 0) & ~both, direct, score)
        score = np.where(both & (more >= 0), self.v[more], score)
        return score, np.where(of_word, np.log10(times + 0.1) - self.below, 0.0), of_word & (times > 0)


def whole_units(logs: np.ndarray) -> np.ndarray:
    return np.rint(logs * UNIT).astype(np.int64)


def score(docs: DataFrame, model: Model, table: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Per row: ``keep``, n_tokens, n_known, train_tokens, base_score, score."""
    base = model.unigrams
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("kept"), F.col(text_col).alias("text"))
    kept_type = inner.schema["kept"].dataType.simpleString()
    below = math.log10(base.total + 0.1 * (base.distinct + 1))
    own_type = f"struct<kept:{kept_type},n_tokens:long,known:long,base:long>"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, mass = shared.value, shared.value.mass()
        word_base = np.append(whole_units(np.log10(model.counts + 0.1) - below), 0)
        names = ["bucket", "slice", "blob", "place", "own"]
        next_slice = TaskContext.get().partitionId() << 32
        for part in slices_of_texts(batches, 1):
            hashes, starts = tokens_of(part.column(1))
            codes, n = model.codes(hashes), part.num_rows
            common = codes < TOP
            sums = lambda x: np.add.reduceat(x, starts[:-1])  # noqa: E731  every text has its end
            own = pa.StructArray.from_arrays(
                [part.column(0), pa.array(np.diff(starts)), pa.array(sums(common.astype(np.int64))), pa.array(sums(word_base[np.where(common, codes, np.uint64(len(model.words))).astype(np.int64)]))],
                names=["kept", "n_tokens", "known", "base"],
            )
            slices = pa.array(np.full(n, next_slice))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, next_slice % model.buckets), pa.int32()), slices, pa.nulls(n, pa.binary()), pa.array(np.arange(n), pa.int32()), own], names=names)
            major, minor = pairs_of(codes, starts)
            doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(starts))
            both = np.flatnonzero((major >= TOP) & (minor >= TOP))
            major, minor, doc = np.concatenate([major, minor[both]]), np.concatenate([minor, np.full(len(both), BACKOFF, np.uint64)]), np.concatenate([doc, doc[both]])
            order = sort_of(major, minor)
            major, minor, doc = major[order], minor[order], doc[order]
            rows = list(by_bucket(model.bucket(major, mass), [major, minor, doc]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in rows], pa.int32()), pa.array(np.full(len(rows), next_slice)), pa.array([x for _, x in rows], pa.binary()), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), own.type)], names=names
            )
            next_slice += 1

    def answer(rows: pa.Table) -> pa.Table:
        model = shared.value
        asks, has_blob = rows["slice"].is_valid(), rows["blob"].is_valid()
        bigrams = rows.filter(pc.and_(pc.invert(asks), has_blob))["blob"].to_pylist()
        bucket = Bucket(*unpacked(bigrams[0], 3)) if bigrams else Bucket(*(np.empty(0, np.uint64),) * 3)
        extra = rows.filter(rows["major"].is_valid())
        values = [extra[c].to_numpy().view(np.uint64) if c in ("major", "minor") else extra[c].to_numpy() for c in ("major", "minor", "v", "t")]
        know = Answers(model, bucket, values, below)
        own = rows.filter(rows["own"].is_valid()).select(["slice", "blob", "place", "own"])
        asked = rows.filter(pc.and_(asks, has_blob))
        blobs = []
        for x in asked["blob"]:
            major, minor, doc = unpacked(x.as_py(), 3)
            doc = doc.astype(np.int64)
            score, base_score, known = know.of(major, minor)
            some, at = np.unique(doc, return_inverse=True)
            sums = [np.bincount(at, v, len(some)).astype(np.int64) for v in (whole_units(score), whole_units(base_score), known)]
            blobs.append(packed(some.astype(np.uint64), *(np.abs(v).astype(np.uint64) * np.uint64(2) + (v < 0).astype(np.uint64) for v in sums)))
        n = len(blobs)
        sent = pa.table({"slice": asked["slice"], "blob": pa.array(blobs, pa.binary()), "place": pa.nulls(n, pa.int32()), "own": pa.nulls(n, own.schema.field("own").type)})
        return pa.concat_tables([own, sent.cast(own.schema)])

    def add(rows: pa.Table) -> pa.Table:
        own = rows.filter(rows["own"].is_valid()).combine_chunks()
        struct = own["own"].combine_chunks()
        if isinstance(struct, pa.ChunkedArray):
            struct = struct.chunk(0)
        place = own["place"].to_numpy()
        sums = np.zeros((3, SLICE), np.int64)
        for x in rows.filter(rows["blob"].is_valid())["blob"]:
            doc, *values = unpacked(x.as_py(), 4)
            for total, v in zip(sums, values):
                total[doc.astype(np.int64)] += np.where(v & np.uint64(1), -1, 1) * (v >> np.uint64(1)).astype(np.int64)
        known, based = (struct.field(k).to_numpy(zero_copy_only=False) for k in ("known", "base"))
        return pa.table(
            {
                "kept": struct.field("kept"),
                "n_tokens": struct.field("n_tokens"),
                "n_known": pa.array(known + sums[2][place]),
                "base_score": pa.array((based + sums[1][place]) / UNIT),
                "score": pa.array(sums[0][place] / UNIT),
            }
        )

    asked = inner.mapInArrow(tidy(ask), f"bucket int, slice long, blob binary, place int, own {own_type}")
    answered = asked.unionByName(table, allowMissingColumns=True).groupBy("bucket").applyInArrow(tidy_group(answer), f"slice long, blob binary, place int, own {own_type}")
    summed = answered.groupBy("slice").applyInArrow(tidy_group(add), f"kept {kept_type}, n_tokens long, n_known long, base_score double, score double")
    return summed.select(*[F.col("kept")[f"k{i}"].alias(c) for i, c in enumerate(keep)], "n_tokens", "n_known", F.lit(base.total).cast("long").alias("train_tokens"), "base_score", "score")
