"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import math
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='parley-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


BATCH_BYTES = 4 << 20


def tidy(run: Callable) -> Callable:
    """``run`` for mapInArrow, giving freed memory back to the system at its end: workers are used again."""

    def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return with_end


def tidy_group(run: Callable) -> Callable:
    """``run`` for applyInArrow, giving memory that the last group left back before each one."""

    def with_start(table: pa.Table) -> pa.Table:
        give_back()
        return run(table)

    return with_start


def give_back() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed blocks otherwise
        if trim is not None:
            trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, as texts may be long; a smaller bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1))) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What runs within it deletes its shuffle files when it ends; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(FREES, None)
    spark.conf.set(FREES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREES)
        else:
            spark.conf.set(FREES, before)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and go on from there."""
    checkpoint_folder(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan made before keeps the setting that it was made under


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back with its own schema."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_freed(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def place_of(docs: DataFrame, id_col: str) -> Column:
    """A long that orders rows by id: whole numbers themselves, other ids by their hash, null first."""
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.coalesce(F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)), F.lit(-(1 << 63)))


FILTER_WORDS = 1 << 18  # of 64 bits


def split_by_keys(df: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``columns`` (longs) are surely not among ``keys``, and all others, none of them shuffled.

    A map of ``FILTER_WORDS`` * 64 bits by hash is broadcast; where it is full, more rows are among the others.
    """
    bit = F.pmod(F.xxhash64(*columns), F.lit(FILTER_WORDS * 64))
    word, bits, flag = (fresh(df, f"filter {x}") for x in ("word", "bits", "flag"))
    marked = keys.select(F.shiftright(bit, 6).alias("w"), bit.alias("b")).selectExpr("w", "shiftleft(1L, cast(b & 63 AS int)) AS v").groupBy("w").agg(F.bit_or("v").alias("v"))
    joined = df.withColumns({word: F.shiftright(bit, 6), flag: bit}).join(F.broadcast(marked.select(F.col("w").alias(word), F.col("v").alias(bits))), word, "left")
    held = joined.withColumn(flag, F.expr(f"coalesce((shiftright(`{bits}`, cast(`{flag}` & 63 AS int)) & 1L) = 1L, false)"))
    return tuple(held.filter(c).select(*df.columns) for c in (~F.col(flag), F.col(flag)))


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def scaled_partitions(spark: SparkSession, times: int = 1) -> int:
    """Shuffle partitions of the session, times a small factor."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * times


def meet(left: DataFrame, right: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has each key once and in ``weight`` how many rows of ``left`` have it.

    Keys with a large share of the rows would crowd a task; they are at most four a partition, so they are broadcast.
    """
    share = 4 * scaled_partitions(left.sparkSession)
    total = right.agg(F.sum(weight).alias("n")).first().n or 1
    crowded = F.col(weight) * share >= total
    values = [c for c in right.columns if c not in left.columns]
    looked = left.join(F.broadcast(right.filter(crowded).select(*keys, *values)), keys, "left")
    few = looked.filter(F.col(weight).isNull()).select(*left.columns).join(right.filter(~crowded).select(*keys, *values), keys)
    return looked.filter(F.col(weight).isNotNull()).unionByName(few)


# Words by 64-bit hashes, all at once: a polynomial over the bytes, then mixed.
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers and their inverses, modulo 2^64."""
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and start byte of every word (A-Z lowered), and the texts' bytes.

    Different words have the same hash about as rarely as random 58-bit numbers.
    """
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n or data is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(offsets, wide)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    size = len(raw)
    inside = np.zeros(size + 2, bool)
    np.logical_and(raw != 0x20, raw - np.uint8(9) > 4, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2].copy(), edges[1::2].copy()
    if len(starts):  # a word does not go on in the next text
        between = np.unique(bounds[1:-1])
        word = np.searchsorted(starts, between) - 1
        cut = (word >= 0) & (between < ends[word])
        starts, ends = np.insert(starts, word[cut] + 1, between[cut]), np.insert(ends, word[cut], between[cut])
    up, down = _powers(size + 1)
    lower = raw + (raw - np.uint8(ord("A")) < 26) * np.uint8(32)
    sums = np.zeros(size + 1, np.uint64)
    np.multiply(lower, up[:size], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.repeat(np.arange(n), np.diff(np.searchsorted(starts, bounds))), starts, raw


def text_slices(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut into stretches of rows with about ``size`` bytes of text."""
    lengths = np.array([x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
    part = (np.cumsum(lengths) - lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


SLICES = 64


def slices_of(at: np.ndarray, n: np.ndarray, width: int) -> pa.RecordBatch:
    """Sorted places and their values as rows (slice, blob), cut into ``SLICES`` slices of ``width``."""
    cuts = np.searchsorted(at, np.arange(SLICES + 1) * width)
    full = np.flatnonzero(np.diff(cuts))
    press = zstandard.ZstdCompressor(level=1).compress
    blobs = []
    for s in full:
        a, b = cuts[s], cuts[s + 1]
        values = np.ascontiguousarray(n[a:b]).astype("<u8").view(np.uint8).reshape(-1, 8).T  # small numbers' zeros together
        blobs.append(press(np.diff(at[a:b] - s * width, prepend=0).astype("<u4").tobytes() + values.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "blob"])


def opened(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places within the slice and their values."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // 12
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 4 * n).reshape(8, n).T).reshape(-1).view("<u8")
    return np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64), values


def summed_slices(partial: DataFrame, width: int, out: np.ndarray) -> np.ndarray:
    """The sums of partial (slice, blob) rows, added to ``out``, which has SLICES * width places.

    Partial sums are added in two steps, so that a task has about the square root of them at once.
    """
    salts = max(1, math.isqrt(scaled_partitions(partial.sparkSession)))

    def add(table: pa.Table) -> pa.Table:
        sums = np.zeros(width, np.uint64)
        for blob in table["blob"]:
            at, n = opened(blob.as_py())
            sums[at] += n
        s, at = table["slice"][0].as_py(), np.flatnonzero(sums)
        return pa.Table.from_batches([slices_of(at + s * width, sums[at], width)])

    salted = partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    once = salted.groupBy("slice", "salt").applyInArrow(add, "slice int, blob binary")
    most = np.iinfo(out.dtype).max if out.dtype.kind in "iu" else np.inf
    for r in once.groupBy("slice").applyInArrow(add, "slice int, blob binary").collect():  # SLICES rows
        at, n = opened(r.blob)
        out[r.slice * width + at] = np.minimum(n, most) if out.dtype != bool else n > 0
    return out


def runs_within(df: DataFrame, keys: list[str], order: list, running: dict[str, tuple[str, str]], before: dict[str, str] | None = None, count: str = "count_") -> DataFrame:
    """``df`` with values that run along the rows of equal ``keys`` (longs, never null) in ``order``.

    ``running`` maps a new column to (kind, column of longs): "sum"; "last", the last value that is not null; "poly",
    the values as digits of a number modulo 2^64. ``before`` maps a further new column to one of these, as it was
    before the row. ``count`` numbers the rows of a key from 1. Rows are sorted over all partitions, so a key may
    go on over many of them; the driver sees one row per partition.
    """
    spark = df.sparkSession
    before = before or {}
    names = [*running, *before]
    sources = sorted({c for _, c in running.values()})
    given = df.columns
    placed = df.repartitionByRange(scaled_partitions(spark), *keys, *order).sortWithinPartitions(*keys, *order).withColumn("part_", F.spark_partition_id())
    width = len(df.columns)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "part_ int", "at_ long", "first_ boolean", f"`{count}` long", *(f"`{c}` long" for c in names)])
    at = {c: df.columns.index(c) for c in [*keys, *sources]}

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first_key, seen, total = None, None, 0, None
        state: dict[str, int | None] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [np.asarray(batch.column(at[k])) for k in keys]
            heads = tuple(int(c[0]) for c in columns)
            if first_key is None:
                first_key = heads
            new = np.zeros(n, bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            goes_on = heads == key
            new[0] = not goes_on
            place = np.arange(n)
            start = np.maximum.accumulate(np.where(new, place, 0))
            lead = np.cumsum(new) == 0  # rows of the key that the last batch ended with
            counts = place - start + 1 + np.where(lead, total or 0, 0)
            out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for name, (kind, source) in running.items():
                column = batch.column(at[source])
                valid = np.asarray(column.is_valid())
                x = np.asarray(column.fill_null(0)).astype(np.int64).view(np.uint64)
                old = state.get(name)
                if kind == "last":
                    last = np.maximum.accumulate(np.where(valid, place, -1))
                    none = last < start
                    value = x[np.maximum(last, 0)]
                    if old is not None:
                        value, none = np.where(none & lead, np.uint64(old), value), none & ~lead
                elif kind == "sum":
                    sums = np.cumsum(x)
                    value, none = sums - (sums[start] - x[start]) + np.where(lead, np.uint64(old or 0), np.uint64(0)), np.zeros(n, bool)
                else:
                    up, down = _powers(n + 1)
                    sums = np.cumsum(x * down[:n])
                    value = (sums - (sums[start] - x[start] * down[start])) * up[:n] + np.where(lead, np.uint64(old or 0), np.uint64(0)) * up[1:] * lead
                    none = np.zeros(n, bool)
                out[name] = value, none
            for name, of in before.items():
                value, none = out[of]
                old = state.get(of)
                initial = (np.uint64(old or 0), old is None) if goes_on else (np.uint64(0), running[of][0] == "last")
                value, none = np.concatenate([[initial[0]], value[:-1]]), np.concatenate([[initial[1]], none[:-1]])
                inner = new.copy()
                inner[0] &= not goes_on
                out[name] = np.where(inner, np.uint64(0), value), np.where(inner, running[of][0] == "last", none)
            firsts = np.ones(n, bool)
            for c, k in zip(columns, first_key):
                firsts &= c == k
            state = {name: None if out[name][1][-1] else int(out[name][0][-1]) for name in running}
            key, total = tuple(int(c[-1]) for c in columns), int(counts[-1])
            arrays = [pa.array(v.view(np.int64), mask=m) for v, m in out.values()]
            own = [pa.array(seen + place), pa.array(firsts), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(width + 1)), *own, *arrays], names=[*given, "part_", "at_", "first_", count, *names])
            seen += n

    found = stored(placed.mapInArrow(local, schema), "running")
    ends = found.groupBy("part_").agg(
        F.min_by(F.struct(*keys), "at_").alias("head"), F.max_by(F.struct(*keys), "at_").alias("tail"), F.max_by(F.struct("first_", count, *running), "at_").alias("end")
    )
    carried: dict[int, dict[str, int | None]] = {}
    key, held = None, {}
    wrap = (1 << 64) - 1
    for r in sorted(ends.collect(), key=lambda r: r.part_):
        end = {c: r.end[c] for c in [count, *running]}
        if tuple(r.head) == key:
            carried[r.part_] = held
            if r.end.first_:  # the whole partition goes on
                for name, (kind, _) in running.items():
                    value, add = end[name], held[name]
                    if kind == "last":
                        end[name] = add if value is None else value
                    else:
                        times = pow(_BASE, end[count], 1 << 64) if kind == "poly" else 1
                        end[name] = (value + add * times) & wrap
                end[count] += held[count]
        key, held = tuple(r.tail), end
    kept = [*df.columns, count, *names]
    if not carried:
        return found.select(*kept)
    place_of_column = {c: k for k, c in enumerate(found.columns)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            parts, firsts = np.asarray(columns["part_"]), np.asarray(columns["first_"])
            counts = np.asarray(columns[count]).copy()
            for p in set(np.unique(parts[firsts]).tolist()) & carried.keys():
                rows, more = firsts & (parts == p), carried[p]
                for name in names:
                    of = before.get(name, name)
                    kind, value = running[of][0], more[of]
                    if value is None:
                        continue
                    now = np.asarray(columns[name].fill_null(0)).astype(np.int64).view(np.uint64).copy()
                    null = ~np.asarray(columns[name].is_valid())
                    extra = np.uint64(value & wrap)
                    if kind == "last":
                        now[rows & null], null = extra, null & ~rows
                    elif kind == "sum":
                        now[rows] += extra
                    else:
                        steps = np.asarray(columns[count])[rows] - (name in before)
                        now[rows] += extra * np.array([pow(_BASE, int(s), 1 << 64) for s in steps], np.uint64)
                    columns[name] = pa.array(now.view(np.int64), mask=null)
                counts[rows] += more[count]
            columns[count] = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([columns[c] for c in place_of_column], names=list(place_of_column))

    return found.mapInArrow(add, found.schema).select(*kept)
