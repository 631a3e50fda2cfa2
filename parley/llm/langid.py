"""Language ID: script ranges narrow the candidates, Viterbi labels spans of mixed-language text.

Words are stretches between white space. Each language is learned as smoothed frequencies of hashed
two- and three-letter sequences (with word ends) over all labelled training texts, and as its
shares of scripts. A word's candidates are the languages that write its main script; its scores are
the candidates' log probabilities of its sequences. Over a text's words, Viterbi finds the labels of
largest total score less ``SWITCH`` for each change of language; equal labels in a row are a span.
The text's language has the most letters, and the score is their share.

Cases: a null text or one without letters is ``und`` with score 0, as is every text where nothing
was learned; rows without a label train nothing; ties go to the first language by name; texts are
labelled whole; repeated rows get equal results; an empty table gives no rows; other columns are
not read. The model has languages x ``BUCKETS`` numbers, whatever the input's size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import small_batches, tidy

BUCKETS = 1 << 15
SWITCH = 10.0
LEAST_SHARE = 0.001  # of a language's letters in a script that it writes
WORST = -12.0  # a word counts against a language by so much at most
CACHE_WORDS = 200_000
SLICE_CHARS = 4 << 20  # characters labelled at once

# First code points of script ranges, and the script that holds from there.
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Indic"),
    (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0xFF66, "Kana"), (0xFFA0, "Other"),
    (0x20000, "Han"), (0x323B0, "Other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
_STARTS = np.array([a for a, _ in SCRIPT_STARTS], np.uint32)
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS])


def words_of(text: str | None) -> list[str]:
    """Lower-cased stretches between white space."""
    return (text or "").lower().split()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word number and bucket of each letter sequence; letters and main script (-1 without letters) per word."""
    letters = ["".join(filter(str.isalpha, w)) if not w.isalpha() else w for w in words]
    count = np.array([len(x) for x in letters], np.int64)
    code = np.frombuffer("".join(f"\2{x}\3" for x in letters).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), count + 2)
    two = word[1:] == word[:-1]
    pair = code[:-1] * np.uint64(0x1F35) + code[1:] * np.uint64(0x9E3779B1)
    three = word[2:] == word[:-2]
    triple = code[:-2] * np.uint64(0x85EBCA77) + code[1:-1] * np.uint64(0x2545F491) + code[2:] * np.uint64(0xC2B2AE3D)
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)  # noqa: E731  15 bits
    owner = np.concatenate([word[:-1][two], word[:-2][three]])
    bucket = np.concatenate([mix(pair[two]), mix(triple[three])])
    filled = count[owner] > 0
    own = code > 3
    script = _SCRIPT[np.searchsorted(_STARTS, code[own].astype(np.uint32), "right") - 1]
    table = np.bincount(word[own] * len(SCRIPTS) + script, minlength=len(words) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))
    return owner[filled], bucket[filled], count, np.where(count > 0, table.argmax(1), -1)


@dataclass
class Model:
    """Languages, log frequencies by bucket and language, and who writes which script."""

    languages: list[str]
    logs: np.ndarray
    writes: np.ndarray

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word: score by language, best 0 and worst ``WORST``; letters."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        if not words or not self.languages:
            return out, np.zeros(len(words), np.int64)
        owner, bucket, count, script = features(words)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, self.logs[bucket, k], len(words))
        allowed = self.writes[script] | ~self.writes[script].any(1, keepdims=True)
        out = np.where(allowed, out, -np.inf)
        out = np.maximum(out - out.max(1, keepdims=True), WORST).astype(np.float32)
        out[count == 0] = 0
        return out, count


def fit(train: DataFrame) -> Model:
    """The model of the labelled texts (columns text, lang); counts cover all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter[str]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counter in found.items():
                words, times = list(counter), np.fromiter(counter.values(), np.int64, len(counter))
                owner, bucket, count, script = features(words)
                n = np.bincount(bucket, times[owner], BUCKETS + len(SCRIPTS))
                has = count > 0
                n += np.bincount(BUCKETS + script[has], (times * count)[has], BUCKETS + len(SCRIPTS))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])
            found.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                found.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
                if sum(map(len, found.values())) > CACHE_WORDS:
                    yield from out()
        yield from out()

    small_batches(train.sparkSession)
    counts = train.filter("lang is not null and text is not null").select("text", "lang").mapInArrow(tidy(run), "lang string, bucket int, n long")
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x (BUCKETS + scripts) rows at most
    languages = sorted(table.lang.unique().tolist())
    n = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    n[table.bucket, [languages.index(x) for x in table.lang]] = table.n
    grams, scripts = n[:BUCKETS], n[BUCKETS:]
    logs = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    writes = scripts >= LEAST_SHARE * np.maximum(scripts.sum(0), 1)
    return Model(languages, logs, writes & (scripts > 0))


def viterbi(scores: np.ndarray, starts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word; texts are the stretches between ``starts``. All texts advance together."""
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = starts[:-1][order], lengths[order]
    came = np.zeros(scores.shape, np.int8 if scores.shape[1] < 128 else np.int16)
    label = np.zeros(len(scores), np.int64)
    if not len(scores) or not len(lengths):
        return label
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # texts longer than t
    value = np.zeros((len(lengths), scores.shape[1]), np.float64)
    own = np.arange(scores.shape[1])
    for t in range(lengths[0]):
        n = active[t]
        at, v = first[:n] + t, value[:n]
        best = v.argmax(1)
        change = v[np.arange(n), best] - (switch if t else 0.0)
        stay = v >= change[:, None]
        came[at] = np.where(stay, own, best[:, None])
        value[:n] = np.where(stay, v, change[:, None]) + scores[at]
    now = value.argmax(1)
    for t in range(lengths[0] - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        label[at] = now[:n]
        now[:n] = came[at, now[:n]]
    return label


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", with_spans: bool = True, prefix: str = "") -> DataFrame:
    """Per row: ``keep``, lang_pred, score, and if wanted spans (first word, words, lang), with a prefix to their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    width = len(keep)
    span = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
    own = "lang_pred string, score double" + ", spans array<struct<first:int,words:int,lang:string>>" * with_spans
    schema = ", ".join([*(f"k{i} {t}" for i, (_, t) in enumerate(inner.dtypes[:-1])), own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        place: dict[str, int] = {}
        scores, letters = np.zeros((0, len(model.languages)), np.float32), np.empty(0, np.int64)

        def learn(words: list[str]) -> None:
            nonlocal scores, letters
            s, n = model.scores(words)
            scores, letters = np.concatenate([scores, s]), np.concatenate([letters, n])
            place.update(zip(words, range(len(place), len(place) + len(words))))

        def label(part: pa.RecordBatch, texts: list[list[str]]) -> pa.RecordBatch:
            nonlocal scores, letters
            if len(place) > CACHE_WORDS:
                place.clear()
                scores, letters = scores[:0], letters[:0]
            learn(list({w: None for words in texts for w in words if w not in place}))
            starts = np.cumsum([0, *map(len, texts)])
            at = np.fromiter((place[w] for words in texts for w in words), np.int64, starts[-1])
            n_lang = len(model.languages)
            lang, score, spans = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            if n_lang and len(at):
                found = viterbi(scores[at], starts)
                doc = np.repeat(np.arange(len(texts)), np.diff(starts))
                share = np.bincount(doc * n_lang + found, letters[at], len(texts) * n_lang).reshape(-1, n_lang)
                total = share.sum(1)
                for d in np.flatnonzero(total):
                    k = int(share[d].argmax())
                    lang[d], score[d] = model.languages[k], share[d, k] / total[d]
                if with_spans:
                    cut = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])]))
                    for a, b in zip(cut, [*cut[1:], len(found)]):
                        if total[doc[a]]:
                            spans[doc[a]].append({"first": int(a - starts[doc[a]]), "words": int(b - a), "lang": model.languages[found[a]]})
            columns = [*(part.column(k) for k in range(width)), pa.array(lang, pa.string()), pa.array(score)] + [pa.array(spans, span)] * with_spans
            return pa.RecordBatch.from_arrays(columns, names=[x.strip().split(" ")[0] for x in schema.replace("first:int,words:int,lang:string", "").split(", ")])

        for batch in batches:
            start, size, texts = 0, 0, []
            for i in range(batch.num_rows):
                text = batch.column(width)[i].as_py()
                texts.append(words_of(text))
                size += len(text or "")
                if size > SLICE_CHARS or i + 1 == batch.num_rows:
                    yield label(batch.slice(start, i + 1 - start), texts)
                    start, size, texts = i + 1, 0, []

    out = inner.mapInArrow(tidy(run), schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(prefix + c) for c in out.columns[width:]])
