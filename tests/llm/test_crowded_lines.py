"""Words that very many lines share: nothing is missed, and lines of one template take about linear time."""

import time

import numpy as np
import pytest

from parley.llm import linededup


def rows_of(rng, n, words, template):
    r = np.zeros(n, linededup.ROW)
    r["word"], r["key"], r["place"] = rng.integers(0, words, n), rng.integers(0, 1 << 32, n), rng.permutation(n)
    r["size"], r["at"] = rng.integers(10, 16, n), rng.integers(0, 2, n)
    masks = rng.integers(0, 1 << 62, (2, 3)).astype(np.uint64)
    turned = np.uint64(1) << rng.integers(0, 60 if not template else 3, n).astype(np.uint64)
    which = rng.integers(0, 3, n)
    r["m0"], r["m1"] = masks[0][which] ^ turned, masks[1][which]
    return r[np.lexsort((r["size"], r["word"]))]


def brute_fitting(rows):
    """Of each row the earlier rows that lengths, positions and parities leave."""
    out = {k: set() for k in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            x, y = rows[i], rows[j]
            a, b, p, q = int(x["size"]), int(y["size"]), int(x["at"]), int(y["at"])
            if x["word"] != y["word"] or 5 * a < 4 * b or 9 * (min(p, q) + min(a - p, b - q)) < 4 * (a + b):
                continue
            apart = sum(int(int(x[m]) ^ int(y[m])).bit_count() for m in ("m0", "m1"))
            if 9 * (a + b - apart) >= 8 * (a + b):
                later, earlier = (i, j) if x["place"] > y["place"] else (j, i)
                out[later].add(earlier)
    return out


@pytest.mark.parametrize("walk", [1, 3, 64])
@pytest.mark.parametrize("template", [False, True])
def test_what_is_not_sent_meets_whole(monkeypatch, walk, template):
    monkeypatch.setattr(linededup, "WALK", walk)
    rng = np.random.default_rng(walk)
    for n, words in ((0, 1), (1, 1), (40, 3), (150, 2), (200, 1)):
        rows = rows_of(rng, n, words, template)
        later, earlier, more, unsent = linededup.candidates(rows, 4)
        want, sent = brute_fitting(rows), {k: set() for k in range(n)}
        for a, b in zip(later.tolist(), earlier.tolist()):
            sent[a].add(b)
        for k in range(n):
            assert sent[k] <= want[k] and len(sent[k]) <= 4 and bool(want[k]) == bool(sent[k])
            assert want[k] <= sent[k] | (set(unsent.tolist()) if k in set(more.tolist()) else set())


def test_a_template_of_fifty_thousand_lines():
    rng = np.random.default_rng(5)
    rows_of(rng, 10, 1, True)
    took = []
    for n in (12_500, 50_000):
        rows = rows_of(rng, n, 1, True)
        began = time.process_time()
        later, *_ = linededup.candidates(rows, 4)
        took.append(time.process_time() - began)
        assert len(np.unique(later)) >= n - 10
    assert took[1] < 10 * took[0] + 1  # a walk over all pairs would take sixteen times as long
