"""Speaker changes within an utterance: sliding-window embeddings, boundaries, pieces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parley.functions.audio import snapped
from parley.operators.clustering import unit

CONTEXT = 32_000  # samples to either side of a boundary that are compared


def similarity_around(starts: np.ndarray, embeddings: np.ndarray, length: int, boundary: int, context: int) -> float:
    """Cosine of the mean embeddings of the windows wholly left and right of a boundary, within a context.

    Without a window wholly on one side, the first or last one stands for it.
    """
    left = (starts + length <= boundary) & (starts + length > boundary - context)
    right = (starts >= boundary) & (starts < boundary + context)
    a = unit(embeddings[left].mean(0) if left.any() else embeddings[0])
    b = unit(embeddings[right].mean(0) if right.any() else embeddings[-1])
    return float(a @ b) if a is not None and b is not None else 1.0


def minima(curve: np.ndarray, threshold: float) -> np.ndarray:
    """Places under the threshold that no neighbour is below."""
    padded = np.concatenate([[np.inf], curve, [np.inf]])
    return np.flatnonzero((curve < threshold) & (curve <= padded[:-2]) & (curve <= padded[2:]))


def spaced(places: np.ndarray, strength: np.ndarray, apart: int, low: int, high: int) -> list[int]:
    """Greedy: the strongest place first, none nearer than ``apart`` to a chosen one or an end."""
    kept: list[int] = []
    for i in np.argsort(strength, kind="stable"):
        p = int(places[i])
        if p - low >= apart and high - p >= apart and all(abs(p - q) >= apart for q in kept):
            kept.append(p)
    return sorted(kept)


def verified(cuts: list[int], starts, embeddings, length: int, total: int, threshold: float) -> list[int]:
    """Drops the cut whose two pieces are most alike, again and again, while they are too much so."""
    cuts = list(cuts)
    while cuts:
        ends = [0, *cuts, total]
        middle = starts + length / 2
        mean = [unit(embeddings[m].mean(0)) if (m := (middle >= a) & (middle < b)).any() else None for a, b in zip(ends, ends[1:])]
        alike = [float(a @ b) if a is not None and b is not None else 1.0 for a, b in zip(mean, mean[1:])]
        worst = int(np.argmax(alike))
        if alike[worst] < threshold:
            break
        cuts.pop(worst)
    return cuts


def change_points(starts, embeddings, length: int, hop: int, total: int, threshold: float = 0.55, context: int = CONTEXT, least: int = 16_000, samples=None) -> list[int]:
    """Sample positions where the speaker changes; with the samples themselves, moved to quiet places nearby."""
    starts, embeddings = np.asarray(starts), np.asarray(embeddings, np.float64)
    if len(starts) < 2 or total < 2 * least:
        return []
    grid = np.arange(least, total - least + 1, hop)
    curve = np.array([similarity_around(starts, embeddings, length, int(b), context) for b in grid])
    low = minima(curve, threshold)
    cuts = verified(spaced(grid[low], curve[low], least, 0, total), starts, embeddings, length, total, threshold)
    return cuts if samples is None else snapped(np.asarray(samples, np.float32), cuts, least)


def pieces(cuts: list[int], total: int, least: int) -> list[int]:
    """Sorted cuts inside the utterance; while a piece is too short, it joins its shorter neighbour."""
    ends = [0, *sorted({c for c in cuts if 0 < c < total}), total]
    while len(ends) > 2:
        sizes = np.diff(ends)
        k = int(sizes.argmin())
        if sizes[k] >= least:
            break
        left = sizes[k - 1] if k else np.inf
        right = sizes[k + 1] if k + 1 < len(sizes) else np.inf
        ends.pop(k if left <= right else k + 1)
    return ends[1:-1]


def cuts_of(utterances: DataFrame, length: int, hop: int, threshold: float = 0.55, least: int = 16_000) -> DataFrame:
    """meeting_id, segment_id, cuts of utterances (columns starts, embeddings, total), batch by batch; snapped to quiet places where there is a column samples."""
    sound = ["samples"] if "samples" in utterances.columns else []

    def run(batches):
        for rows in batches:
            sounds = rows.samples if sound else [None] * len(rows)
            found = [pieces(change_points(s, [list(x) for x in e], length, hop, int(t), threshold, least=least, samples=x), int(t), least) for s, e, t, x in zip(rows.starts, rows.embeddings, rows.total, sounds)]
            yield pd.DataFrame({"meeting_id": rows.meeting_id, "segment_id": rows.segment_id, "cuts": found})

    kinds = dict(utterances.dtypes)
    return utterances.select("meeting_id", "segment_id", "starts", "embeddings", "total", *sound).mapInPandas(run, f"meeting_id {kinds['meeting_id']}, segment_id string, cuts array<int>")
