"""Speaker clustering: sequential and iterative kernels in numpy, one Spark group per meeting and stream.

A meeting's stream is bounded by the meeting's length; Spark spreads the meetings. The kernels are
plain functions, so a streaming query can call the same ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Knobs:
    """Thresholds of clustering; similarities are cosines of unit vectors."""

    join: float = 0.60
    user: float = 0.60
    merge: float = 0.70
    short_ms: int = 3_000
    short_relax: float = 0.1
    least_new_ms: int = 1_500
    most_speakers: int = 40
    context_gap_ms: int = 2_000
    group: float = 0.625
    split: float = 0.575
    split_least_ms: int = 5_000
    move: float = 0.1
    move_rounds: int = 3
    absorb_below_ms: int = 5_000
    absorb: float = 0.525
    most_items: int = 4_000


def unit(v) -> np.ndarray | None:
    """A vector at length one; None if empty, not finite or nearly zero."""
    if v is None or len(v) == 0:
        return None
    x = np.asarray(v, np.float64)
    n = np.sqrt((x * x).sum())
    return (x / n).astype(np.float32) if np.isfinite(n) and n > 1e-12 else None


def weight(ms: float) -> float:
    """Seconds between a half and ten."""
    return min(max(ms / 1000, 0.5), 10.0)


@dataclass
class Voice:
    """One speaker of a stream."""

    label: str
    number: int
    total: np.ndarray
    mass: float
    centre: np.ndarray
    user: bool = False


@dataclass
class Online:
    """Labels voices in order of arrival; labels given never change, only later rows see merges."""

    prefix: str
    knobs: Knobs = field(default_factory=Knobs)
    voiceprint: np.ndarray | None = None
    size: int | None = None
    voices: list[Voice] = field(default_factory=list)
    alias: dict[str, str] = field(default_factory=dict)
    following: int = 1
    last: tuple[int, str | None] | None = None

    def __post_init__(self) -> None:
        print_ = unit(self.voiceprint)
        if print_ is not None:
            self.voices.append(Voice("me", 0, np.zeros_like(print_, dtype=np.float64), 0.0, print_, True))

    def resolve(self, label: str | None) -> str | None:
        return self.alias.get(label, label)

    def usable(self, embedding) -> np.ndarray | None:
        e = unit(embedding)
        if e is None or self.size not in (None, len(e)):
            return None
        if self.size is None:
            self.size = len(e)
            self.voices = [v for v in self.voices if len(v.centre) == len(e)]
        return e

    def by_voice(self, e: np.ndarray, ms: int) -> str | None:
        k = self.knobs
        relax = k.short_relax if ms < k.short_ms else 0.0
        best, most = None, -np.inf
        for v in self.voices:
            margin = float(v.centre @ e) - ((k.user if v.user else k.join) - relax)
            if margin >= most:  # the last of equals
                best, most = v, margin
        if best is not None and most >= 0:
            return self.add(best, e, ms)
        if ms < k.least_new_ms:
            return None
        others = [v for v in self.voices if not v.user]
        if len(others) >= k.most_speakers:
            return self.add(max(reversed(others), key=lambda v: float(v.centre @ e)), e, ms)
        new = Voice(f"{self.prefix}:{self.following}", self.following, np.zeros(len(e)), 0.0, e)
        self.following += 1
        self.voices.append(new)
        return self.add(new, e, ms)

    def add(self, voice: Voice, e: np.ndarray, ms: int) -> str:
        w = weight(ms)
        voice.total, voice.mass = voice.total + w * e, voice.mass + w
        if not voice.user and (centre := unit(voice.total)) is not None:
            voice.centre = centre
        k = self.knobs
        while True:
            limit = lambda o: max(k.user, k.join) if o.user or voice.user else k.merge
            others = [v for v in self.voices if v is not voice]
            near = max(others, key=lambda v: float(v.centre @ voice.centre) - limit(v), default=None)
            if near is None or float(near.centre @ voice.centre) < limit(near):
                return voice.label
            keep, lose = sorted((voice, near), key=lambda v: (not v.user, -v.mass, v.number))
            keep.total, keep.mass = keep.total + lose.total, keep.mass + lose.mass
            if not keep.user and (centre := unit(keep.total)) is not None:
                keep.centre = centre
            self.alias = {a: keep.label if b == lose.label else b for a, b in self.alias.items()} | {lose.label: keep.label}
            self.voices.remove(lose)
            voice = keep

    def assign(self, embedding, start_ms: int, end_ms: int) -> str | None:
        """The label of the next row; without a voice of its own, the previous row's if that is near."""
        e, ms = self.usable(embedding), max(end_ms - start_ms, 0)
        label = self.by_voice(e, ms) if e is not None else None
        if label is None and self.last is not None and start_ms <= self.last[0] + self.knobs.context_gap_ms:
            label = self.resolve(self.last[1])
        self.last = (max(end_ms, start_ms), label)
        return label


def agglomerate(similarity: np.ndarray, weights: np.ndarray, limit: float, most: int | None = None) -> np.ndarray:
    """Clusters by weighted average linkage: the most similar pair is joined while it has ``limit`` or there are over ``most``.

    Ids are the smallest member's, made consecutive. All joins are found along chains of nearest
    neighbours, in quadratic time, and taken from the most similar on: with average linkage no join
    brings two clusters nearer than both its parts were, so these are the joins of the greedy order.
    Similarity is kept as one matrix, so the items are bounded by the caller.
    """
    n = len(weights)
    s, w = similarity.astype(np.float64).copy(), np.maximum(weights.astype(np.float64), 1e-3)
    np.fill_diagonal(s, -np.inf)
    alive, chain, joins = np.ones(n, bool), [], []
    while len(joins) < n - 1:
        if not chain:
            chain.append(int(alive.argmax()))
        i = chain[-1]
        j = int(s[i].argmax())
        if len(chain) < 2 or s[i, chain[-2]] < s[i, j]:
            chain.append(j)
            continue
        j = chain[-2]  # each is the other's nearest
        del chain[-2:]
        joins.append((s[i, j], i, j))
        i, j = min(i, j), max(i, j)
        row = (w[i] * s[i] + w[j] * s[j]) / (w[i] + w[j])
        row[[i, j]] = -np.inf
        s[i], s[:, i] = row, row
        s[j], s[:, j] = -np.inf, -np.inf
        w[i], alive[j] = w[i] + w[j], False
    of, clusters = np.arange(n), n
    for value, i, j in sorted(joins, key=lambda x: -x[0]):
        if value < limit and (most is None or clusters <= most):
            break
        a, b = of[i], of[j]
        of[of == max(a, b)] = min(a, b)
        clusters -= 1
    return np.unique(of, return_inverse=True)[1]


def assign_best(gain: np.ndarray) -> list[int | None]:
    """Row by row the column of the one-to-one assignment of largest total; None where rows exceed columns.

    Shortest augmenting paths with potentials, O(n^3).
    """
    rows, columns = gain.shape
    n = max(rows, columns)
    cost = np.zeros((n, n))
    cost[:rows, :columns] = -gain
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, n)
    for i in range(n):
        match[n], j = i, n
        least, came, used = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while match[j] != n:
            used[j] = True
            r = match[j]
            free = ~used[:n]
            reach = cost[r] - u[r] - v[:n]
            better = free & (reach < least)
            least[better], came[better] = reach[better], j
            nxt = int(np.where(free, least, np.inf).argmin())
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[free] -= step
            j = nxt
            if match[j] == n:
                break
        while j != n:
            match[j], j = match[came[j]], came[j]
    out: list[int | None] = [None] * rows
    for j in range(columns):
        if match[j] < rows:
            out[match[j]] = j
    return out


def recluster(embeddings: list, ms: np.ndarray, labels: list, prefix: str, knobs: Knobs = Knobs(), voiceprint=None) -> list[str | None]:
    """New labels for all rows of a finished stream, in row order (see the survey's seven steps)."""
    ms = np.maximum(np.asarray(ms, np.int64), 0)
    units = [unit(e) for e in embeddings]
    sizes = pd.Series([len(u) for u in units if u is not None]).value_counts()
    if not len(sizes):
        return list(labels)
    size = min(sizes.index[sizes == sizes.max()])
    has = np.array([u is not None and len(u) == size for u in units])
    rows = np.flatnonzero(has)
    e, d = np.stack([units[i] for i in rows]).astype(np.float64), ms[rows]
    w = np.array([weight(x) for x in d])
    online = [labels[i] for i in rows]
    anchor = d >= max(knobs.short_ms, knobs.least_new_ms)
    cluster = _groups(e, w, d, online, anchor, knobs)
    cluster = _split(cluster, e, w, d, anchor, knobs)
    cluster = _move(cluster, e, w, knobs)
    cluster = _absorb(cluster, e, w, d, knobs)
    names, centres = _centres(cluster, e, w)
    if len(names):
        loose = cluster < 0
        cluster[loose] = names[(e[loose] @ centres.T).argmax(1)] if loose.any() else cluster[loose]
    _, first, compact = np.unique(cluster, return_index=True, return_inverse=True)
    cluster = np.argsort(np.argsort(first))[compact]
    named = _names(cluster, e, w, d, online, [labels[i] for i in range(len(labels)) if not has[i]], prefix, knobs, unit(voiceprint))
    out = list(labels)
    for i, c in zip(rows, cluster):
        out[i] = named[c]
    votes: dict[str, dict[int, int]] = {}
    for label, c, x in zip(online, cluster, d):
        if label is not None:
            votes.setdefault(label, {}).setdefault(int(c), 0)
            votes[label][int(c)] += max(int(x), 1)
    for i in np.flatnonzero(~has):
        if labels[i] in votes:
            v = votes[labels[i]]
            out[i] = named[min(v, key=lambda c: (-v[c], c))]
    return out


def _centres(cluster: np.ndarray, e: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit centres of the clusters (id -1 is none)."""
    names = np.unique(cluster[cluster >= 0])
    sums = np.stack([(w[cluster == c, None] * e[cluster == c]).sum(0) for c in names]) if len(names) else np.zeros((0, e.shape[1]))
    lengths = np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return names, sums / lengths


def _groups(e, w, d, online, anchor, knobs) -> np.ndarray:
    """Online labels as groups, unlabelled anchors (or all rows, if nothing has a label) by themselves, the most similar joined."""
    none = all(x is None for x in online)
    order: dict[object, int] = {}
    group = np.array([order.setdefault(x if x is not None else ("row", i), len(order)) if x is not None or none or anchor[i] else -1 for i, x in enumerate(online)])
    singles = np.array([i for i, x in enumerate(online) if x is None and group[i] >= 0], int)
    if len(singles) > knobs.most_items:
        dropped = singles[np.argsort(-d[singles], kind="stable")[knobs.most_items :]]
        group[dropped] = -1
    names = np.unique(group[group >= 0])
    means = np.stack([np.average(e[group == g], axis=0, weights=w[group == g]) for g in names]) if len(names) else np.zeros((0, e.shape[1]))
    masses = np.array([w[group == g].sum() for g in names])
    joined = agglomerate(means @ means.T, masses, knobs.group, knobs.most_speakers) if len(names) else names
    out = np.full(len(group), -1)
    for g, c in zip(names, joined):
        out[group == g] = c
    return out


def _split(cluster, e, w, d, anchor, knobs) -> np.ndarray:
    """Clusters whose anchors fall into two long parts or more."""
    cluster, fresh = cluster.copy(), int(cluster.max(initial=-1)) + 1
    for c in np.unique(cluster[cluster >= 0]):
        at = np.flatnonzero((cluster == c) & anchor)
        at = np.sort(at[np.argsort(-d[at], kind="stable")[: knobs.most_items]])
        if len(at) < 2 or d[at].sum() < 2 * knobs.split_least_ms:
            continue
        part = agglomerate(e[at] @ e[at].T, w[at], knobs.split)
        length = np.bincount(part, d[at])
        kept = np.flatnonzero(length >= knobs.split_least_ms)
        if len(kept) < 2:
            continue
        marked = np.full(len(cluster), -1)
        marked[at] = np.where(np.isin(part, kept), part, -1)
        _, centres = _centres(marked, e, w)
        members = np.flatnonzero(cluster == c)
        to = (e[members] @ centres.T).argmax(1)
        largest = int(np.argmax(length[kept]))
        for k in range(len(kept)):
            if k != largest:
                cluster[members[to == k]] = fresh
                fresh += 1
    return cluster


def _move(cluster, e, w, knobs) -> np.ndarray:
    """Rows that are clearly nearer to another cluster than to the rest of their own."""
    for _ in range(knobs.move_rounds):
        names, centres = _centres(cluster, e, w)
        sums = np.stack([(w[cluster == c, None] * e[cluster == c]).sum(0) for c in names]) if len(names) else None
        after = cluster.copy()
        for i in np.flatnonzero(cluster >= 0):
            own = int(np.searchsorted(names, cluster[i]))
            rest = unit(sums[own] - w[i] * e[i]) if (cluster == cluster[i]).sum() > 1 else None
            mine = float(rest @ e[i]) if rest is not None else knobs.group
            others = centres @ e[i]
            others[own] = -np.inf
            if len(others) > 1 and others.max() - mine >= knobs.move:
                after[i] = names[int(others.argmax())]
        if (after == cluster).all():
            break
        cluster = after
    return cluster


def _absorb(cluster, e, w, d, knobs) -> np.ndarray:
    """Small clusters join the nearest one, smallest first, while one is near enough."""
    cluster = cluster.copy()
    while True:
        names, centres = _centres(cluster, e, w)
        if len(names) < 2:
            return cluster
        length = np.array([d[cluster == c].sum() for c in names])
        near = centres @ centres.T
        np.fill_diagonal(near, -np.inf)
        small = [k for k in np.argsort(length, kind="stable") if length[k] < knobs.absorb_below_ms and near[k].max() >= knobs.absorb]
        if not small:
            return cluster
        cluster[cluster == names[small[0]]] = names[int(near[small[0]].argmax())]


def _names(cluster, e, w, d, online, unembedded, prefix, knobs, voiceprint) -> list[str]:
    """A label for each cluster: the user's, those carried over by overlap, then fresh numbers."""
    n = int(cluster.max()) + 1
    _, centres = _centres(cluster, e, w)
    out: list[str | None] = [None] * n
    if voiceprint is not None and len(voiceprint) == e.shape[1]:
        s = centres @ voiceprint
        if s.max() >= knobs.user:
            out[int(s.argmax())] = "me"
    known = list(dict.fromkeys(x for x in online if x is not None and not (x == "me" and "me" in out)))
    overlap = np.zeros((n, max(len(known), 1)))
    for c, label, x in zip(cluster, online, d):
        if out[c] is None and label in known:
            overlap[c, known.index(label)] += x
    bonus = 0.5 * (len(known) - np.arange(overlap.shape[1])) / max(len(known), 1) ** 2
    gain = np.where(overlap > 0, overlap + bonus, 0)
    for c, k in enumerate(assign_best(gain)):
        if k is not None and gain[c, k] > 0:
            out[c] = known[k]
    used = [int(x.split(":")[1]) for x in [*online, *unembedded] if x is not None and x.startswith(f"{prefix}:") and x.split(":")[1].isdigit()]
    number = max(used, default=0)
    for c in range(n):  # ids are in order of first appearance
        if out[c] is None:
            number += 1
            out[c] = f"{prefix}:{number}"
    return out


def label_online(items: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """meeting_id, prefix, segment_id, label of every row (columns pos, embedding, start_ms, end_ms) by arrival."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        online = Online(rows.prefix.iloc[0], knobs)
        labels = [online.assign(e, int(a), int(b)) for e, a, b in zip(rows.embedding, rows.start_ms, rows.end_ms)]
        return rows[["meeting_id", "prefix", "segment_id"]].assign(label=labels)

    kinds = dict(items.dtypes)
    return items.groupBy("meeting_id", "prefix").applyInPandas(run, f"meeting_id {kinds['meeting_id']}, prefix string, segment_id string, label string")


def label_again(items: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """meeting_id, segment_id, speaker of the rows (also online_label, duration_ms) whose label changes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        old = [x if isinstance(x, str) else None for x in rows.online_label]
        new = recluster(list(rows.embedding), rows.duration_ms.to_numpy(), old, rows.prefix.iloc[0], knobs)
        changed = [a != b for a, b in zip(old, new)]
        return rows[["meeting_id", "segment_id"]].assign(speaker=new)[changed]

    kinds = dict(items.dtypes)
    return items.groupBy("meeting_id", "prefix").applyInPandas(run, f"meeting_id {kinds['meeting_id']}, segment_id string, speaker string")


def error_rate(confusion: pd.DataFrame) -> dict[str, float]:
    """Speaker error of one meeting from weights of (label, speaker): the best assignment counts as right."""
    total = float(confusion.weight.sum())
    known = confusion.dropna(subset=["label"])
    table = known.pivot_table(index="label", columns="speaker", values="weight", aggfunc="sum", fill_value=0).to_numpy(float) if len(known) else np.zeros((0, 0))
    right = sum(table[i, j] for i, j in enumerate(assign_best(table)) if j is not None) if table.size else 0.0
    return {"error_rate": 1 - right / total if total else 0.0, "unlabelled": float(confusion.weight[confusion.label.isna()].sum()) / total if total else 0.0}


def speaker_error_rates(confusions: DataFrame) -> DataFrame:
    """meeting_id, error_rate, unlabelled from meeting_id, label, speaker, weight (aggregated by Spark before)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"meeting_id": rows.meeting_id.iloc[0], **error_rate(rows)}])

    kinds = dict(confusions.dtypes)
    return confusions.groupBy("meeting_id").applyInPandas(run, f"meeting_id {kinds['meeting_id']}, error_rate double, unlabelled double")
