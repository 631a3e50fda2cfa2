"""Lines that meet whole do so by low bytes of their words' hashes, and nothing is missed or made up by that."""

import random

import pytest

from parley.llm import linededup


def brute(texts):
    seen, gone = [], set()
    for i, text in enumerate(texts):
        for k, line in enumerate(text.split("\n")):
            s = frozenset(line.split())
            if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
                gone.add((i, k))
            seen.append(s)
    return gone


@pytest.mark.parametrize("kind", ["<u2", "<u1"])  # of one byte, so many words look alike that lines do, too
def test_low_bytes_against_brute_force(spark, monkeypatch, kind):
    rng = random.Random(3)
    pool = [[f"{rng.choice('abc')}{rng.randrange(4000)}" for _ in range(n)] for n in (9, 20, 40, 400) for _ in range(4)]
    edited = lambda line: " ".join(w if rng.random() > 0.11 else f"d{rng.randrange(900)}" for w in line)
    texts = ["\n".join(edited(rng.choice(pool)) for _ in range(6)) for _ in range(40)]
    met, compared = [], linededup._compared
    monkeypatch.setattr(linededup, "SHORT", kind)
    monkeypatch.setattr(linededup, "_compared", lambda meeting, sets, column, of: met.append((column, of)) or compared(meeting, sets, column, of))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = linededup.removals(docs, tries=0).collect()  # all that may be similar meet whole
    assert {(r.doc_id, k) for r in found for k in r.removed} == brute(texts)
    assert met[0] == ("short", kind) and met[1:] == ([("words", "<u8")] if kind == "<u1" else [])
