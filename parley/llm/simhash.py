"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint has a bit where more than half of its shingles' hashes have it. Equal
fingerprints are merged first, so copies cost nothing further. Pairs within a Hamming budget are
found by a self-join of binary tries: the fingerprint is cut into blocks; within the budget two
fingerprints agree in at least one block when there are more blocks than errors, so each block in
turn goes to the front, and the traversal starts below the node that both share. Node pairs are
walked together downwards, differing bits add up, and a pair is dropped once they exceed the
budget at their depth, or once all below it is known to be connected. Nodes with very many
fingerprints are cut into the pairs of their own descendants, which other tasks traverse. Only
spanning forests of the nearest pairs leave a task, never all pairs; components come from Spark
joins over their edges.

``near_duplicates`` links by differing bits alone. ``one_of_each`` takes wide fingerprints to find
pairs only, and links those whose sets of shingles have a Jaccard similarity of 0.8 or more: edges
are verified on the texts. Where one fails between groups that stay apart, the rows of these groups
are joined again and carry their sets, as 32-bit hashes: there every pair of two groups is compared in the
trie's leaves and only similar ones leave the task. So no similar pair that the tries meet is lost,
and a group of near copies never sends all its pairs.

Cases: a null text or one without words has fingerprint zero and links like any other (to
``one_of_each`` all such texts are copies); fewer words than a shingle make one shingle; texts are
taken whole; repeated rows get equal results, and ``one_of_each`` keeps one of them; rows without id
or with one id for several texts are each judged by their own text; an empty table gives no rows;
other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import fresh, hashed_words, mixed, place_of, scaled_partitions, settle, small_batches, split_by_keys, stored, text_slices, tidy

SEED = 42
BLOCK_ROWS = 1024  # fingerprints that have a block in common, about
LEAF = 64  # pairs of fingerprints below which node pairs are compared directly
FRONTIER = 1 << 18  # node pairs walked at once


def shingles_of(raw: bytes, size: int) -> Iterator[memoryview]:
    """Shingles of ``size`` words of the text with A-Z lowered, repeats included; one of all words if fewer."""
    words = raw.lower().split()  # bytes: A-Z and the six white-space bytes only
    if not words:
        return
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    for i in range(max(1, len(words) - size + 1)):
        yield joined[starts[i] : ends[min(i + size, len(words)) - 1]]


def fingerprint(text: str | None, size: int, words: int = 1) -> np.ndarray:
    """The fingerprint as ``words`` unsigned 64-bit integers, one per hash seed from 42 on."""
    out = np.zeros(words, np.uint64)
    parts = list(shingles_of((text or "").encode("utf-8"), size))
    for k in range(words if parts else 0):
        digest, seed = xxhash.xxh64_intdigest, SEED + k
        hashes = np.array([digest(p, seed) for p in parts], np.uint64)
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65_536):
            counts += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle_words: int = 4, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (``words`` longs) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), shingle_words, words) for x in batch.column(1)]
            flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            offsets = pa.array(np.arange(0, len(flat) + 1, words), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, fp array<long>")


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, the texts' numbers of shingles, and a hash of each text's words."""
    words, doc, _, _ = hashed_words(texts)
    n = np.bincount(doc, minlength=len(texts))
    ends = np.cumsum(n)
    counts = np.where(n > 0, np.maximum(1, n - size + 1), 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = (ends - n)[owner] + at
    out = np.zeros(len(owner), np.uint64)
    for k in range(size):
        word = first + k
        out = mixed(out + np.where(word < ends[owner], words[np.minimum(word, max(len(words) - 1, 0))], np.uint64(0)) + np.uint64(1)) if len(words) else out
    spread = mixed(words + np.uint64(0x9E3779B97F4A7C15) * (np.arange(len(words)) - (ends - n)[doc]).astype(np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread)])
    return out, counts, mixed(sums[ends] - sums[ends - n] + n.astype(np.uint64))


def wide_fingerprints(hashes: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """A row of ``words`` unsigned 64-bit integers per text, from its shingles' hashes."""
    out = np.zeros((len(counts), words), np.uint64)
    seeds = mixed(np.arange(1, words + 1, dtype=np.uint64))
    ends = np.cumsum(counts).tolist()
    for k, (end, n) in enumerate(zip(ends, counts.tolist())):
        if not n:
            continue
        sums = np.zeros(64 * words, np.int64)
        for a in range(end - n, end, 16_320):
            bits = np.unpackbits(mixed(hashes[a : min(a + 16_320, end), None] + seeds).view(np.uint8), axis=1, bitorder="little")
            for b in range(0, len(bits), 255):  # sums that fit a byte
                sums += bits[b : b + 255].sum(0, dtype=np.uint8)
        out[k] = np.packbits(2 * sums > n, bitorder="little").view("<u8")
    return out


def wide_nodes(docs: DataFrame, shingle_words: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """place and hash (of the text) of every row, and its node: the wide fingerprint and a hash of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 2, 1 << 19):
                hashes, counts, whole = shingle_hashes(part.column(2), shingle_words)
                whole[counts == 0] = 0
                nodes = np.column_stack([wide_fingerprints(hashes, counts, words), whole])
                offsets = pa.array(np.arange(0, nodes.size + 1, words + 1), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(nodes.reshape(-1).view(np.int64)))], names=["place", "hash", "node"])

    small_batches(docs.sparkSession)
    rows = docs.select(place_of(docs, id_col).alias("place"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "place long, hash long, node array<long>")


class Sets:
    """The shingle sets of some rows: sorted 32-bit hashes."""

    def __init__(self, blobs: list[bytes]):
        sets = [unpacked_set(x) for x in blobs]
        self.size = np.array([len(x) for x in sets], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        self.parity = np.zeros((len(sets), 4), np.uint64)  # each hash turns over one of 256 bits: shared ones cancel out
        np.bitwise_xor.at(self.parity, (owner, ((self.flat >> np.uint64(6)) & np.uint64(3)).astype(np.int64)), np.uint64(1) << (self.flat & np.uint64(63)))

    def similar(self, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
        """Whether pairs of rows have this Jaccard similarity; sizes and parities rule most others out."""
        total = self.size[i] + self.size[j]
        most = total * (1 - similarity) / (1 + similarity) + 1e-9  # members that only one of them may have
        apart = np.bitwise_count(self.parity[i] ^ self.parity[j]).sum(axis=1)
        open_ = np.flatnonzero((np.abs(self.size[i] - self.size[j]) <= most) & (apart <= most))
        out = np.zeros(len(i), bool)
        ends = np.cumsum(total[open_])
        start = 0
        while start < len(open_):  # some million members at once
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 21), "right")))
            at = open_[start:stop]
            members = []
            for side in (i[at], j[at]):
                n = self.size[side]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[side], n)
                members.append(np.repeat(np.arange(len(at), dtype=np.uint64), n) << np.uint64(32) | self.flat[place])
            both = np.sort(np.concatenate(members))
            twice = (both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64)
            shared = np.bincount(twice, minlength=len(at))
            out[at] = shared >= similarity * (total[at] - shared) - 1e-9
            start = stop
        return out


def packed_set(hashes: np.ndarray) -> bytes:
    """Sorted hashes of 32 bits as differences, compressed."""
    steps = np.diff(hashes, prepend=np.uint64(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked_set(blob: bytes) -> np.ndarray:
    """The hashes of ``packed_set``."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).reshape(-1).view("<u4").astype(np.uint64))


class Trie:
    """Runs of a sorted array of rotated fingerprints, taken as the nodes of binary tries.

    ``limits`` are the errors allowed after so many bits. Pairs within them, and similar where
    there are sets, grow a forest of the nearest ones; what ``known`` has alike is connected.
    """

    def __init__(self, fps: np.ndarray, limits: np.ndarray, known: np.ndarray, sets: Sets | None = None, similarity: float = 1.0):
        self.fps, self.limits, self.n, self.sets, self.similarity = fps, limits, len(fps), sets, similarity
        _, first, alike = np.unique(known, return_index=True, return_inverse=True)
        self.label = first[alike]  # smallest place of what each is known to be connected with
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def roots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the runs of equal keys that have two rows or more."""
        cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        low, high = np.concatenate([[0], cuts]), np.concatenate([cuts, [self.n]])
        many = high - low > 1
        return low[many], high[many]

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        """Merge the components of places a and b, all at once."""
        label = self.label
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up

    def connect(self, i: np.ndarray, j: np.ndarray, errors: np.ndarray) -> None:
        """Let the pairs that join two parts grow the forest, nearest first."""
        open_ = self.label[i] != self.label[j]
        i, j, errors = i[open_], j[open_], errors[open_]
        if self.sets is not None and len(i):
            fits = self.sets.similar(i, j, self.similarity)
            i, j, errors = i[fits], j[fits], errors[fits]
        while True:  # every part takes its nearest pair, until no pair joins two parts
            a, b = self.label[i], self.label[j]
            cross = np.flatnonzero(a != b)
            if not len(cross):
                return
            part, pair = np.concatenate([a[cross], b[cross]]), np.concatenate([cross, cross])
            order = np.lexsort((pair, errors[pair], part))
            best = np.unique(pair[order][np.concatenate([[True], part[order[1:]] != part[order[:-1]]])])
            self.merge(i[best], j[best])
            self.found.append((i[best], j[best]))

    def compare(self, al, ah, bl, bh) -> None:
        """Compare the fingerprints below node pairs and connect those within the budget."""
        na, nb = ah - al, bh - bl
        sizes = na * nb
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):  # at most about a million pairs at once, however many there are
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 20), "right")))
            s = slice(start, stop)
            owner = np.repeat(np.arange(start, stop), sizes[s])
            at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[s]) - sizes[s], sizes[s])
            i, j = al[owner] + at // nb[owner], bl[owner] + at % nb[owner]
            near = i < j  # a node with itself gives each pair once
            i, j = i[near], j[near]
            errors = np.zeros(len(i), np.int64)
            for k in range(self.fps.shape[1]):
                errors += np.bitwise_count(self.fps[i, k] ^ self.fps[j, k])
                near = errors <= self.limits[64 * (k + 1)]
                i, j, errors = i[near], j[near], errors[near]
            self.connect(i, j, errors)
            start = stop

    def join(self, al, ah, bl, bh, depth: int, errors) -> None:
        """Walk node pairs down from a bit; pairs of a node with itself stand for its own pairs."""
        stack = [(al, ah, bl, bh, depth, errors)]
        ones: dict[int, np.ndarray] = {}
        while stack:
            al, ah, bl, bh, depth, errors = stack.pop()
            if len(al) > FRONTIER:
                half = len(al) // 2
                stack += [tuple(x[s] if isinstance(x, np.ndarray) else x for x in (al, ah, bl, bh, depth, errors)) for s in (np.s_[half:], np.s_[:half])]
                continue
            label = self.label
            changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
            one = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (label[al] == label[bl])
            small = (ah - al) * (bh - bl) <= LEAF
            leaf = ~one & (small | (depth == 64))
            self.compare(al[leaf], ah[leaf], bl[leaf], bh[leaf])
            go = ~one & ~leaf
            if not go.any():
                continue
            al, ah, bl, bh, errors = (x[go] for x in (al, ah, bl, bh, errors))
            if depth not in ones:
                bits = (self.fps[:, 0] >> np.uint64(63 - depth)) & np.uint64(1)
                ones[depth] = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)
            count = ones[depth]
            am, bm = ah - (count[ah] - count[al]), bh - (count[bh] - count[bl])
            own = (al == bl) & (ah == bh)
            rest = ~own
            children = [
                (al, am, bl, bm, errors),
                (am, ah, bm, bh, errors),
                (al, am, bm, bh, errors + 1),
                (am[rest], ah[rest], bl[rest], bm[rest], errors[rest] + 1),
            ]
            cross = tuple(np.concatenate(x) for x in zip(*children[2:]))
            straight = tuple(np.concatenate(x) for x in zip(*children[:2]))
            for cl, ch, dl, dh, e in (cross, straight):  # what lies on the same side is walked first
                full = (ch > cl) & (dh > dl) & (e <= self.limits[depth + 1])
                if full.any():
                    stack.append((cl[full], ch[full], dl[full], dh[full], depth + 1, e[full]))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """The forest's pairs."""
        if not self.found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*self.found))


def rotated(fps: np.ndarray, bits: int) -> np.ndarray:
    """All words as one bit string, turned left by ``bits``."""
    fps = np.roll(fps, -(bits // 64), axis=1)
    if r := bits % 64:
        fps = (fps << np.uint64(r)) | (np.roll(fps, -1, axis=1) >> np.uint64(64 - r))
    return fps


def _keyed(words: int, blocks: int, width: int, cut: dict[int, int], budget: int):
    """Rows for the join: block and value, the pair of descendants if its node is cut, the node turned, what it is known by."""
    near = {s: [[b for b in range(1 << s) if (a ^ b).bit_count() <= budget] for a in range(1 << s)] for s in set(cut.values())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)
            flat, rest, known = nodes[:, :words], nodes[:, words:], batch.column(1).to_numpy(zero_copy_only=False)
            for block in range(blocks):
                turned = np.concatenate([rotated(flat, block * width), rest], axis=1)
                value = (turned[:, 0] >> np.uint64(64 - width)).astype(np.int64)
                key = value + (block << width)
                hot = np.isin(key, np.fromiter(cut, np.int64, len(cut)))
                at, pair = [np.flatnonzero(~hot)], [np.zeros((~hot).sum(), np.int64)]
                for i in np.flatnonzero(hot):  # few keys; each of their rows goes to a bounded number of pairs
                    s = cut[int(key[i])]
                    own = (int(turned[i, 0]) >> (64 - width - s)) & ((1 << s) - 1)
                    pair.append(np.array([1 + (min(own, b) << s) + max(own, b) for b in near[s][own]], np.int64))
                    at.append(np.full(len(pair[-1]), i))
                at, pair = np.concatenate(at), np.concatenate(pair)
                f = turned[at]
                columns = [pa.array(key[at]), pa.array(pair), *(pa.array(np.ascontiguousarray(f[:, i]).view(np.int64)) for i in range(f.shape[1])), pa.array(known[at])]
                names = ["key", "pair", *(f"f{i}" for i in range(f.shape[1])), "known"]
                for name in batch.schema.names[2:]:
                    columns.append(batch.column(name).take(pa.array(at)))
                    names.append(name)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def links(nodes: DataFrame, words: int, blocks: int, width: int, limits: np.ndarray, node_rows: int = 2048, more: int = 0, similarity: float = 1.0) -> DataFrame:
    """Edges (a, b: arrays of longs) that have the components of all pairs within the limits.

    ``nodes`` has the columns node (``words`` longs of fingerprint and ``more`` others), known (a number
    that connected nodes share, their own else) and perhaps set (``packed_set``): pairs must then have the
    similarity, too. With more blocks than errors no pair is missed; with fewer, a pair is found if it
    agrees in some block. A trie's node with more than ``node_rows`` fingerprints, or eight times the mean,
    is cut into pairs of descendants (see the module's text).
    """
    parts = scaled_partitions(nodes.sparkSession)
    budget = int(limits[-1])
    total = nodes.count()
    most = min(max(node_rows, 8 * total >> width), 1 << 20)
    columns = [f"f{i}" for i in range(words + more)]
    schema = "key long, pair long, " + ", ".join(f"{c} long" for c in [*columns, "known"])
    has_sets = "set" in nodes.columns
    own = nodes.select("node", "known", *["set"] * has_sets)
    keys = nodes.select("node", "known").mapInArrow(_keyed(words, blocks, width, {}, budget), schema)
    crowded = keys.groupBy("key").count().filter(F.col("count") > most).collect()  # at most blocks * 2^width rows
    cut = {r.key: min(6, int(np.ceil(np.log2(r["count"] / most)))) for r in crowded}
    rows = own.mapInArrow(_keyed(words, blocks, width, cut, budget), schema + ", set binary" * has_sets)
    sorted_rows = rows.repartition(parts, "key", "pair").sortWithinPartitions("key", "pair", *(F.col(c).bitwiseXOR(F.lit(-(1 << 63))) for c in columns[:words]))  # unsigned order
    numbers = 3 + words + more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blobs = np.empty((0, numbers), np.int64), []

        def out(rows: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
            keys, fps, rest = rows[:, :2], np.ascontiguousarray(rows[:, 2 : 2 + words]).view(np.uint64), rows[:, 2 + words : -1].view(np.uint64)
            trie = Trie(fps, limits, rows[:, -1], Sets(blobs) if has_sets else None, similarity)
            low, high = trie.roots(keys)
            trie.join(low, high, low, high, width, np.zeros(len(low), np.int64))
            a, b = trie.edges()
            sides = []
            for at in (a, b):
                back = np.empty((len(at), words + more), np.uint64)
                block = keys[at, 0] >> width
                for k in np.unique(block):
                    own = block == k
                    back[own, :words] = rotated(fps[at[own]], (64 * words - int(k) * width) % (64 * words))
                back[:, words:] = rest[at]
                sides.append(back.view(np.int64))
            larger = np.zeros(len(a), bool)  # b is the lesser one
            for k in reversed(range(words + more)):
                x, y = sides[0][:, k], sides[1][:, k]
                larger = np.where(x == y, larger, x > y)
            offsets = pa.array(np.arange(0, sides[0].size + 1, words + more), pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.where(larger[:, None], x, y).reshape(-1))) for x, y in (sides, sides[::-1])]
            return pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

        for batch in batches:
            new = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(numbers)], axis=1) if batch.num_rows else held[:0]
            held = np.concatenate([held, new])
            blobs += batch.column(numbers).to_pylist() if has_sets else []
            if len(held) > (20_000 if has_sets else 200_000):  # the last key may go on in the next batch
                ends = np.flatnonzero(np.any(held[1:, :2] != held[:-1, :2], axis=1))
                if len(ends):
                    cut = ends[-1] + 1
                    yield out(held[:cut], blobs[:cut])
                    held, blobs = held[cut:], blobs[cut:]
        if len(held):
            yield out(held, blobs)

    return sorted_rows.mapInArrow(tidy(run), "a array<long>, b array<long>").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for all nodes of the edges (a, b): the smallest node of each component.

    Alternating star contraction: every node's larger neighbours are linked to its smallest, then
    every node and its smaller neighbours to the smallest of these, until nothing changes.
    """
    edges = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = settle(small.filter("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle_words: int = 4, words: int = 1, blocks: int = 5, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest id reachable over links within the budget) of every row."""
    fps = settle(fingerprints(docs, shingle_words, words, id_col, text_col))
    classes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    width = min(64 * words // blocks, 16)
    edges = links(classes.select(F.col("fp").alias("node"), F.xxhash64("fp").alias("known")), words, blocks, width, np.full(64 * words + 1, budget))
    roots = components(edges)
    placed = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # each component's smallest id, then each fingerprint's: both tables hold distinct fingerprints only
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = placed.join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(of_fp, fps.fp == of_fp._fp).select("doc_id", "fp", "component_id")


def differing(similarity: float) -> float:
    """The probability that a bit differs between fingerprints of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def blocks_for(rows: int, similarity: float, missed: float = 0.005) -> tuple[int, int, int]:
    """words, blocks and width so that about ``BLOCK_ROWS`` of so many fingerprints have a block in common.

    There are as many blocks as find all pairs of this similarity but a share ``missed``. Widths end at 16, as
    the crowded values of all blocks are counted by the driver.
    """
    width = min(16, max(10, math.ceil(math.log2(max(rows, 1) / BLOCK_ROWS))))
    blocks = math.ceil(math.log(missed) / math.log(1 - (1 - differing(similarity)) ** width))
    return math.ceil(blocks * width / 64), blocks, width


def expected_limits(words: int, similarity: float, sigmas: float) -> np.ndarray:
    """Errors after each number of bits that a pair of this similarity exceeds with the odds of ``sigmas``."""
    share = differing(similarity)
    bits = np.arange(64 * words + 1)
    return np.floor(share * bits + sigmas * np.sqrt(share * (1 - share) * bits)).astype(np.int64)


def _texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, text of the nodes ``wanted`` (node, place, hash)."""
    rows = docs.select(place_of(docs, id_col).alias("place"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    _, some = split_by_keys(rows, wanted, ["place", "hash"])
    return some.join(wanted, ["place", "hash"]).groupBy("node").agg(F.max("text").alias("text"))


def _similar(edges: DataFrame, texts: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """The edges whose texts' sets of shingles have this Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                hashes, counts, _ = shingle_hashes(pa.array([x.as_py(), y.as_py()], pa.large_string()), shingle_words)
                a, b = np.unique(hashes[: counts[0]]), np.unique(hashes[counts[0] :])
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for side in ("a", "b"):
        edges = edges.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
    return edges.select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a array<long>, b array<long>")


def _with_sets(nodes: DataFrame, texts: DataFrame, shingle_words: int, salt: int) -> DataFrame:
    """``nodes`` with the column set: the hashes of their texts' shingles, others with another salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 2, 1 << 19):
                hashes, counts, _ = shingle_hashes(part.column(2), shingle_words)
                short = mixed(hashes + np.uint64(salt)) >> np.uint64(32)
                ends = np.cumsum(counts)
                sets = [packed_set(np.unique(short[e - n : e])) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())], names=["node", "known", "set"])

    return nodes.join(texts, "node").select("node", "known", "text").mapInArrow(tidy(run), "node array<long>, known long, set binary")


def similar_groups(docs: DataFrame, classes: DataFrame, shingle_words: int, words: int, blocks: int, width: int, sigmas: float, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """node, root of the nodes that are similar to others; ``classes`` has node, place and hash."""
    limits = expected_limits(words, similarity, sigmas)

    def verified(edges: DataFrame) -> DataFrame:
        ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = stored(_texts_of(docs, classes.join(ends, "node", "left_semi"), id_col, text_col), "near-texts")
        return settle(_similar(edges, texts, shingle_words, similarity))

    edges = stored(links(classes.select("node", F.xxhash64("node").alias("known")), words, blocks, width, limits, more=1), "near-edges")
    similar = verified(edges)
    roots = settle(components(similar))
    # a pair that the tries met was left out only where an edge failed to join two groups
    failed = edges.join(similar, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        failed = failed.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    own = {side: F.coalesce(f"root_{side}", side) for side in ("a", "b")}
    apart = settle(failed.filter(own["a"] != own["b"]).select(F.explode(F.array(own["a"], own["b"])).alias("root")).distinct())
    if apart.isEmpty():
        return roots
    known = classes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    nodes = settle(known.join(apart, "root", "left_semi").select("node", F.xxhash64("root").alias("known")))
    texts = stored(_texts_of(docs, classes.join(nodes.select("node"), "node", "left_semi"), id_col, text_col), "near-texts")
    salt = 0
    while True:
        edges = stored(links(_with_sets(nodes, texts, shingle_words, salt), words, blocks, width, limits, more=1, similarity=similarity), "near-edges")
        found = settle(_similar(edges, texts, shingle_words, similarity))
        similar = similar.union(found)
        if edges.count() == found.count():  # else different shingles had one hash, which another salt parts
            return settle(components(similar))
        salt += 1


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, shape: tuple[int, int, int] | None = None, sigmas: float = 4.0, similarity: float = 0.8) -> DataFrame:
    """``docs`` with the same columns and one document of each group: that of the smallest id, once.

    Groups are connected by pairs of documents with this Jaccard similarity of their sets of shingles.
    Pairs are found if their fingerprints agree in one block and nowhere exceed the limits. ``shape`` is the
    fingerprints' 64-bit words, blocks and bits of a block (by default ``blocks_for`` as many rows).
    """
    words, blocks, width = shape or blocks_for(docs.count(), similarity)
    rows = stored(wide_nodes(docs, shingle_words, words, id_col, text_col), "near-nodes")
    first = F.min(F.struct("place", "hash")).alias("first")
    classes = stored(rows.groupBy("node").agg(first).select("node", "first.place", "first.hash"), "near-classes")
    roots = similar_groups(docs, classes, shingle_words, words, blocks, width, sigmas, similarity, id_col, text_col)
    grouped = classes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(first)
    kept = grouped.select("first.place", "first.hash", F.lit(True).alias("kept"))
    judged = rows.groupBy("place", "hash").agg(F.count(F.lit(1)).alias("times")).join(kept, ["place", "hash"], "left")
    doubtful = settle(judged.filter(F.col("kept").isNull() | (F.col("times") > 1)).select("place", "hash", F.coalesce("kept", F.lit(False)).alias("kept")))
    place, mark, keep = fresh(docs, "place"), fresh(docs, "hash"), fresh(docs, "kept")
    keyed = docs.withColumns({place: place_of(docs, id_col), mark: F.xxhash64(text_col)})
    clear, some = split_by_keys(keyed, doubtful.select(F.col("place").alias(place), F.col("hash").alias(mark)), [place, mark])
    checked = some.join(doubtful.select(F.col("place").alias(place), F.col("hash").alias(mark), F.col("kept").alias(keep)), [place, mark], "left")
    alone = checked.filter(F.col(keep).isNull())
    once = checked.filter(F.col(keep)).dropDuplicates([place, mark])
    return clear.select(*docs.columns).union(alone.select(*docs.columns)).union(once.select(*docs.columns))
