"""Cells of pairs' scores by single-precision products equal those in double precision, borders included."""

import numpy as np
import pyarrow as pa
import pytest

from parley.operators import scoring

GRID = (-0.2, 0.006, 201)


def block(rng, n, base):
    """ids (some twice), labels and vectors: of two lengths, zero, null, not finite, and with cosines on the grid's borders."""
    angles = np.arccos(np.clip(-0.2 + 0.006 * rng.integers(0, 201, n), -1, 1))
    lists = [[float(np.cos(t)), float(np.sin(t))] if k % 3 else rng.normal(size=64).tolist() for k, t in enumerate(angles)]
    lists[3:9] = [None, [], [0.0, 0.0], [1.0, None], [np.inf, 1.0], [1.0, 0.0]]
    ids = rng.permutation(n) + base
    ids[:20] = ids[20:40]
    return ids, rng.integers(0, 4, n), lists


def plain(a, b, one):
    counts = np.zeros((2, GRID[2] + 1), np.int64)
    unit = lambda v: np.array([np.nan if x is None else x for x in v or []], np.float64)
    for i, l, v in zip(*a):
        for j, m, w in zip(*b):
            x, y = unit(v), unit(w)
            n = np.sqrt(x @ x) * np.sqrt(y @ y) if len(x) == len(y) else 0
            if i < j if one else i != j:
                s = float((x / np.sqrt(x @ x)) @ (y / np.sqrt(y @ y))) if 0 < n < np.inf else 0.0
                counts[int(l != m), int(np.clip(np.floor((np.round(s, 6) - GRID[0]) / GRID[1]) + 1, 0, GRID[2]))] += 1
    return counts


@pytest.mark.parametrize("one", [True, False])
def test_cells_equal_brute_force_and_few_scores_need_double_precision(monkeypatch, one):
    rng = np.random.default_rng(5)
    a, b = block(rng, 250, 0), block(rng, 230, 1000)
    b = a if one else b
    packed = lambda x: (x[0], x[1], scoring.units(pa.chunked_array([x[2][:100], x[2][100:]], pa.list_(pa.float64()))))
    assert (scoring.tile_cells(packed(a), packed(b), one, *GRID) == plain(a, b, one)).all()
    exact, cells = [], scoring._cells_of
    monkeypatch.setattr(scoring, "_cells_of", lambda s, *grid: exact.append(len(s)) or cells(s, *grid))
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = (np.arange(2000), rng.integers(0, 4, 2000), [(np.arange(2000), x)])
    assert scoring.tile_cells(rows, rows, True, *GRID).sum() == 2000 * 1999 // 2
    assert sum(exact) < 0.01 * 2000 * 2000
