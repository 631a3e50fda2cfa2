"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

Word pieces are counted over all documents. The most frequent ones are encoded once by exact
merging and compiled into an acyclic automaton with shared suffixes; a word's number, summed along
its path, points at its ids. The file is broadcast (its size is bounded by ``lexicon_words`` and
``MAX_WORD_BYTES``), memory-mapped by each Python worker, and every word that it lacks is merged
exactly by rank. The lexicon changes the speed only, never an id.

Cases: a null text counts as empty and gives no ids, zero tokens and an empty decoding; texts are
encoded whole at any length; equal texts give equal values; other columns of the input, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import struct
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import settle, small_batches, tidy

MAX_WORD_BYTES = 64
#: Words a worker remembers before it starts anew.
CACHE_WORDS = 150_000

# The piece pattern of the tokenizer file, the order of bytes as printable characters.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PIECES_AND_ENDS = regex.compile(r"\n|" + PIECE.pattern)
# Code points (first, last) that became letters or numbers after Unicode 16.0, the library's version.
NEWER_RANGES = [
    (0x0558, 0x0558), (0x058B, 0x058C), (0x088F, 0x088F), (0x0C5C, 0x0C5C), (0x0CDC, 0x0CDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
NEWER = frozenset(chr(c) for a, b in NEWER_RANGES for c in range(a, b + 1))
_NEWER = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER_RANGES) + "]"
OLDER_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--{_NEWER}]+|[\p{{N}}--{_NEWER}]|[[^\s\p{{L}}\p{{N}}]||{_NEWER}]+", regex.V1)
OLDER_PIECES_AND_ENDS = regex.compile(r"\n|" + OLDER_PIECE.pattern, regex.V1)
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


# Capitals that Unicode versions after 15.1 added, with the library's lower-case letters.
LOWER_LATER = {
    "\u1c89": "\u1c8a", "\ua7cb": "\u0264", "\ua7cc": "\ua7cd", "\ua7ce": "\ua7cf", "\ua7d2": "\ua7d3", "\ua7d4": "\ua7d5", "\ua7da": "\ua7db", "\ua7dc": "\u019b",
    **{chr(c): chr(c + 0x20) for c in range(0x10D50, 0x10D66)},
    **{chr(c): chr(c + 0x1B) for c in range(0x16EA0, 0x16EB9)},
}


def pieces_of(text: str, with_ends: bool = False) -> list[str]:
    """The pieces of a text without white space, with line ends between if wanted."""
    if text.isascii() or NEWER.isdisjoint(text):
        return (PIECES_AND_ENDS if with_ends else PIECE).findall(text)
    return (OLDER_PIECES_AND_ENDS if with_ends else OLDER_PIECE).findall(text)


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256."""
    taken, out, free = set(PRINTABLE), [], 256
    for b in range(256):
        out.append(chr(b) if b in taken else chr(free))
        free += b not in taken
    return out


class Merges:
    """Vocabulary and ranked merges of a tokenizer file; encodes one piece exactly."""

    def __init__(self, file: str | bytes):
        loaded = json.loads(open(file, encoding="utf-8").read() if isinstance(file, str) else file)
        model = loaded["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.ranks = {vocab[a] << 32 | vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.special = {x["content"]: x["id"] for x in loaded["added_tokens"]}
        self.names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.bytes = [vocab[c] for c in byte_characters()]
        self.last_bytes = [vocab[c + suffix] for c in byte_characters()]

    def encode(self, piece: str) -> list[int]:
        """Ids of a piece: again and again the leftmost pair of the lowest rank is merged."""
        raw = piece.encode("utf-8")
        parts = [self.bytes[b] for b in raw[:-1]] + [self.last_bytes[b] for b in raw[-1:]]
        if len(parts) > 64:
            return self._merge_long(parts)
        rank, none, merged = self.ranks.get, len(self.merged), self.merged
        waiting = [rank(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while waiting and (best := min(waiting)) < none:
            at = waiting.index(best)
            parts[at : at + 2] = [merged[best]]
            del waiting[at]
            if at < len(waiting):
                waiting[at] = rank(parts[at] << 32 | parts[at + 1], none)
            if at:
                waiting[at - 1] = rank(parts[at - 1] << 32 | parts[at], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges by a heap over a linked list, for pieces of any length."""
        n, rank = len(parts), self.ranks.get
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or rank(parts[i] << 32 | parts[j]) != best:
                continue  # one of the two has been merged since
            parts[i], alive[j], after[i] = self.merged[best], False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank(parts[a] << 32 | parts[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p, keep in zip(parts, alive) if keep]


class Batch:
    """Merges many pieces at once: each round joins every piece's pairs of its lowest rank."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.bytes, self.last = np.array(merges.bytes, np.uint32), np.array(merges.last_bytes, np.uint32)
        self.merged = np.array([*merges.merged, 0], np.uint32)
        self.none = len(merges.merged)
        pairs = np.array([(k >> 32, k & 0xFFFFFFFF) for k in merges.ranks], np.uint64).reshape(-1, 2)
        ranks = np.fromiter(merges.ranks.values(), np.int64, len(merges.ranks))
        self.keys = (pairs[:, 0] << np.uint64(32)) | pairs[:, 1]
        self.bits = max(4, int(4 * len(ranks)).bit_length())
        self.slots = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(1 << self.bits, self.none, np.int64)
        at, left = self.place(self.keys), np.arange(len(ranks))
        while len(left):  # open addressing: who finds a free slot first keeps it
            free = self.slots[at[left]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.slots[at[left[free]]] = self.keys[left[free]]
            done = self.slots[at[left]] == self.keys[left]
            self.ranks[at[left[done]]] = ranks[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        # a round is the same as merging one by one if no token joins at a lower rank than it is made
        made = np.full(int(max(merges.names)) + 1, -1)
        made[self.merged[ranks]] = np.maximum(made[self.merged[ranks]], 0)
        np.maximum.at(made, self.merged[ranks], ranks)
        self.usable = bool((np.maximum(made[pairs[:, 0].astype(int)], made[pairs[:, 1].astype(int)]) < ranks).all()) if len(ranks) else True

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``none`` where they do not merge."""
        at = self.place(keys)
        got = self.slots[at]
        out = np.where(got == keys, self.ranks[at], self.none)
        open_ = np.flatnonzero((got != keys) & (got != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(open_):
            at = (at if len(at) == len(open_) else at[open_]) + 1 & ((1 << self.bits) - 1)
            got, want = self.slots[at], keys[open_]
            hit = got == want
            out[open_[hit]] = self.ranks[at[hit]]
            go = ~hit & (got != np.uint64(0xFFFFFFFFFFFFFFFF))
            open_, at = open_[go], at[go]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (none may be empty), and where each piece's begin."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(lengths)
        ids = self.bytes[raw]
        ids[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(pieces)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            same = word[1:] == word[:-1]
            rank = np.full(len(ids), self.none)
            at = np.flatnonzero(same)
            rank[at] = self.rank(ids[at].astype(np.uint64) << np.uint64(32) | ids[at + 1])
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            over = best == self.none
            if over.any():
                done.append((word[over], ids[over]))
                ids, word, rank, best = ids[~over], word[~over], rank[~over], best[~over]
            hit = np.flatnonzero(rank == best)
            if not len(hit):
                break
            fresh = np.concatenate([[True], hit[1:] != hit[:-1] + 1])  # of overlapping pairs every second one
            place = np.arange(len(hit)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hit = hit[place % 2 == 0]
            ids[hit] = self.merged[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, word = ids[keep], word[keep]
        word = np.concatenate([w for w, _ in done]) if done else np.empty(0, np.int64)
        ids = np.concatenate([i for _, i in done]) if done else np.empty(0, np.uint32)
        order = np.argsort(word, kind="stable")
        return ids[order], np.searchsorted(word[order], np.arange(len(pieces) + 1))


def lowered(text: str) -> str:
    """The text composed and lower-cased letter by letter (so a final sigma is not special)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    if not LOWER_LATER.keys().isdisjoint(text):
        text = text.translate({ord(k): v for k, v in LOWER_LATER.items()})
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


def chunks_of(text: str) -> list[str]:
    """Lower-cased stretches between white space; no piece reaches over their ends."""
    text = lowered(text)
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split only
        return regex.split(r"\s+", text)
    return text.split()


def compile_lexicon(words: Iterable[tuple[str, list[int]]]) -> bytes:
    """A minimal acyclic automaton over the words' bytes, their ids found by the word's number.

    Layout: six lengths, then per state its first edge, per edge its target and the words it skips,
    the starts of the ids, the ids, per state whether a word ends there, per edge its byte.
    """
    entries = sorted((w.encode("utf-8"), ids) for w, ids in words)
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # of the last word: whether a word ends, edges already settled
    last = b""

    def settle_below(depth: int) -> None:
        while len(path) - 1 > depth:
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in known:
                known[key] = len(states)
                states.append(key)
            path[-1][1].append((last[len(path) - 1], known[key]))

    for word, _ in entries:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        settle_below(shared)
        path.extend([False, []] for _ in word[shared:])
        path[-1][0] = True
        last = word
    settle_below(0)
    root = (path[0][0], tuple(path[0][1]))
    states.append(root)
    below = [0] * len(states)
    for s, (final, edges) in enumerate(states):  # targets come before the states that lead to them
        below[s] = int(final) + sum(below[t] for _, t in edges)
    first, targets, skips, labels = [0], [], [], bytearray()
    for final, edges in states:
        passed = int(final)
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            skips.append(passed)
            passed += below[target]
        first.append(len(targets))
    starts = np.cumsum([0, *(len(ids) for _, ids in entries)])
    ids = np.array([i for _, x in entries for i in x], dtype="<i4")
    finals = bytes(final for final, _ in states)
    arrays = [np.array(x, dtype="<i4") for x in (first, targets, skips, starts)] + [ids]
    return struct.pack("<6i", *(len(x) for x in arrays), len(finals)) + b"".join(x.tobytes() for x in arrays) + finals + bytes(labels)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes, at, parts = struct.unpack("<6i", self.map[:24]), 24, []
        for n in sizes[:5]:
            parts.append(np.frombuffer(self.map, "<i4", n, at))
            at += 4 * n
        self.first, self.targets, self.skips, self.starts, self.ids = parts
        self.finals = np.frombuffer(self.map, np.uint8, sizes[5], at)
        labels = np.frombuffer(self.map, np.uint8, len(self.targets), at + sizes[5])
        self.root = sizes[5] - 1
        # the edges in order of (state, byte)
        self.edges = np.repeat(np.arange(sizes[5]), np.diff(self.first)) << 8 | labels

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 if the lexicon lacks it; all words walk together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        out = np.full(len(words), -1)
        going = np.arange(len(words))
        state, number, k = np.full(len(words), self.root), np.zeros(len(words), np.int64), 0
        while len(going):
            over = lengths[going] == k
            ended = going[over]
            out[ended] = np.where(self.finals[state[ended]] == 1, number[ended], -1)
            going = going[~over]
            if not len(going) or not len(self.edges):
                break
            want = state[going] << 8 | raw[begin[going] + k]
            edge = np.minimum(np.searchsorted(self.edges, want), len(self.edges) - 1)
            on = self.edges[edge] == want
            going, edge = going[on], edge[on]
            number[going] += self.skips[edge]
            state[going] = self.targets[edge]
            k += 1
        return out

    def ids_of(self, number: int) -> np.ndarray:
        """The ids of the word with a number."""
        return self.ids[self.starts[number] : self.starts[number + 1]]

    def find(self, word: bytes) -> list[int] | None:
        """The word's ids, or None if the lexicon lacks it."""
        number = int(self.numbers([word])[0])
        return None if number < 0 else self.ids_of(number).tolist()


class Encoder:
    """Encodes and decodes whole texts; words come from the lexicon or are merged, and are remembered.

    Two generations of remembered words bound the memory: once the newer one is full it becomes the
    older, and words still in use move over.
    """

    def __init__(self, merges: Merges, lexicon: Lexicon | None):
        self.merges, self.lexicon, self.batch = merges, lexicon, Batch(merges)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.names = [merges.names.get(i, "") for i in range(max(merges.names) + 1)]
        special = "|".join(regex.escape(x) for x in merges.special)
        self.split = regex.compile(f"({special})") if special else None
        self.hints = {x[:2] for x in merges.special}

    def forget(self) -> None:
        """Drop all remembered words."""
        self.new, self.old = {}, {}

    def learn(self, chunks: list[str]) -> None:
        """Remember the ids of new chunks: their words are looked up, then merged, all at once."""
        words: dict[bytes, int] = {}
        parts: list[list[int]] = [[]]
        for piece in pieces_of("\n".join(chunks), with_ends=True):
            if piece == "\n":
                parts.append([])
            else:
                parts[-1].append(words.setdefault(piece.encode("utf-8"), len(words)))
        listed = list(words)
        found: list[bytes | None] = [None] * len(listed)
        if self.lexicon:
            short = [i for i, w in enumerate(listed) if len(w) <= MAX_WORD_BYTES]
            for i, n in zip(short, self.lexicon.numbers([listed[i] for i in short]).tolist()):
                if n >= 0:
                    found[i] = self.lexicon.ids_of(n).tobytes()
        rest = [i for i, f in enumerate(found) if f is None and self.batch.usable and len(listed[i]) <= 256]
        if rest:
            ids, starts = self.batch.encode([listed[i] for i in rest])
            packed, at = ids.astype("<u4").tobytes(), (4 * starts).tolist()
            for k, i in enumerate(rest):
                found[i] = packed[at[k] : at[k + 1]]
        for i, f in enumerate(found):
            if f is None:
                ids_ = self.merges.encode(listed[i].decode("utf-8"))
                found[i] = struct.pack(f"<{len(ids_)}I", *ids_)
        for chunk, part in zip(chunks, parts):
            self.new[chunk] = found[part[0]] if len(part) == 1 else b"".join([found[i] for i in part])

    def prepare(self, texts: list[str]) -> None:
        """Learn at once what some texts hold that is not remembered."""
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        seen = set().union(*(chunks_of(part) for text in texts for part in self.stretches(text) if part not in self.merges.special))
        for chunk in seen:
            if chunk not in self.new and (ids := self.old.get(chunk)) is not None:
                self.new[chunk] = ids
        self.learn([c for c in seen if c not in self.new])

    def stretches(self, text: str) -> list[str]:
        """The text cut at special tokens."""
        return [text] if self.split is None or not any(h in text for h in self.hints) else self.split.split(text)

    def plain(self, text: str) -> bytes:
        """Ids of a stretch without special tokens."""
        chunks = chunks_of(text)
        try:
            return b"".join(map(self.new.__getitem__, chunks))
        except KeyError:
            self.learn(list({c: None for c in chunks if c not in self.new}))
            return b"".join(map(self.new.__getitem__, chunks))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the text decoded from them."""
        special = self.merges.special
        ids = b"".join(struct.pack("<I", special[part]) if part in special else self.plain(part) for part in self.stretches(text))
        return ids, " ".join(map(self.names.__getitem__, memoryview(ids).cast("I")))


def piece_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """piece, n: how often each word piece of at most ``MAX_WORD_BYTES`` bytes occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            pieces: Counter[str] = Counter()
            for chunk, n in found.items():
                for piece in pieces_of(chunk):
                    if len(piece.encode("utf-8")) <= MAX_WORD_BYTES:
                        pieces[piece] += n
            found.clear()
            return pa.RecordBatch.from_pydict({"piece": pa.array(pieces.keys(), pa.string()), "n": pa.array(pieces.values(), pa.int64())})

        for batch in batches:
            for text in batch.column(0):
                found.update(chunks_of(text.as_py() or ""))
                if len(found) > CACHE_WORDS:
                    yield out()
        yield out()

    small_batches(docs.sparkSession)
    partial = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(count), "piece string, n long")
    return partial.groupBy("piece").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer_file: str, lexicon_words: int = 131_072, text_col: str = "text") -> bytes:
    """The compiled lexicon of the corpus' most frequent pieces: those above the least count that few enough have."""
    counts = settle(piece_counts(docs, text_col).filter("n > 1"))
    steps = F.when(F.col("n") < 1000, F.col("n")).otherwise(F.floor(F.log2("n") * 8).cast("long") + 1000)
    least, total = None, 0
    for r in sorted(counts.groupBy(steps.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).collect(), key=lambda r: -r.n):
        total += r.words
        if total > lexicon_words:
            break
        least = r.n
    merges = Merges(tokenizer_file)
    frequent = counts.filter(F.col("n") >= least).collect() if least else []  # at most lexicon_words rows
    return compile_lexicon((r.piece, merges.encode(r.piece)) for r in frequent)


def encode(
    docs: DataFrame,
    tokenizer_file: str,
    lexicon: bytes | None = None,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    with_ids: bool = True,
    with_text: bool = True,
) -> DataFrame:
    """Per document: ``keep``, n_tokens, ids_sha256, decoded_sha256, and if wanted ids and decoded.

    The tokenizer file is read by the driver and broadcast with the lexicon, so that executors need
    neither. Memory per task: one Arrow batch of texts and a bounded word cache.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, "rb") as f:
        file = f.read()
    shared: Broadcast = spark.sparkContext.broadcast((file, lexicon))
    digest = hashlib.sha256(file).hexdigest() + hashlib.sha256(lexicon or b"").hexdigest()
    inner = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    fields = [f"k{i} {t}" for i, (_, t) in enumerate(inner.dtypes[:-1])]
    schema = ", ".join([*fields, "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *["ids array<int>"] * with_ids, *["decoded string"] * with_text])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, digest)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids, texts = [], []
                given = [x or "" for x in part.column(width).to_pylist()]
                encoder.prepare(given)
                for text in given:
                    i, t = encoder.encode(text)
                    ids.append(i)
                    texts.append(t)
                columns = [part.column(k) for k in range(width)]
                columns += [
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in texts]),
                ]
                if with_ids:
                    offsets = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                if with_text:
                    columns.append(pa.array(texts, pa.string()))
                names = [f.split(" ")[0] for f in schema.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        encoder.forget()  # the worker may go on to other work

    out = inner.mapInArrow(tidy(run), schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *out.columns[width:])


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared: Broadcast, digest: str) -> Encoder:
    """This worker's encoder for a broadcast tokenizer and lexicon, known by their digest."""
    if digest not in _ENCODERS:
        _ENCODERS.clear()
        file, lexicon = shared.value
        _ENCODERS[digest] = Encoder(Merges(file), Lexicon(lexicon) if lexicon else None)
    return _ENCODERS[digest]


def decode(encoded: DataFrame, tokenizer_file: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column decoded: the tokens' strings joined by a blank, special ones kept."""
    merges = Merges(tokenizer_file)
    names = np.full(max(merges.names) + 1, "", dtype=object)
    for i, name in merges.names.items():
        names[i] = name
    shared = encoded.sparkSession.sparkContext.broadcast(names.tolist())

    @F.pandas_udf("string")
    def text_of(ids):
        table = shared.value
        return ids.map(lambda x: None if x is None else " ".join(table[i] for i in x))

    return encoded.withColumn("decoded", text_of(F.col(ids_col)))
