"""Benchmark decontamination in batches: candidates come from the LSH keys alone, and exact verification follows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from mailsieve.llm import decontaminate as D

R = random.Random(3)
VOCAB = [f"w{i}" for i in range(2000)]


def edited(words, e, spread):
    """``e`` edits at random places, or so evenly spread that no long run is left."""
    n, out = len(words), []
    at = {int((k + 0.5) * n / e) for k in range(e)} if spread else set(R.sample(range(n), e))
    for k, w in enumerate(words):
        kind = R.choice("xix" if spread else "dix") if k in at else ""
        out += {"": [w], "d": [], "i": [w, R.choice(VOCAB)], "x": [R.choice(VOCAB)]}[kind]
    return out


def distance(a, b):
    line = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(line[j] + (x != y), line[j + 1] + 1, new[j] + 1))
        line = new
    return min(line)


@pytest.mark.parametrize("n", [1, 4, 5, 9, 15, 30, 57, 150])
@pytest.mark.parametrize("spread", [False, True])
def test_recall_at_the_limit(n, spread):
    e = D.edits(n, 0.8)
    items = [[R.choice(VOCAB) for _ in range(n)] for _ in range(40)]
    docs = [[R.choice(VOCAB) for _ in range(R.randrange(200))] + (edited(x, e, spread) if e else x) + [R.choice(VOCAB) for _ in range(R.randrange(200))] for x in items]
    index = D.build([(i, " ".join(x)) for i, x in enumerate(items)], 0.8)
    column = pa.array([" ".join(x) for x in docs])
    found = {(a, b): d for a, b, d in D.matches(index, column, screen=False)}
    assert {(a, b): d for a, b, d in D.matches(index, column)} == found  # the screen loses nothing
    truth = {(i, i) for i in range(40) if distance(items[i], docs[i]) <= e}
    assert len(truth) >= 35 and len(truth & set(found)) >= 0.97 * len(truth)
    for (a, b), d in list(found.items())[:12]:
        assert distance(items[b], docs[a]) == d <= e
    # without keys there are no candidates, but for items that allow no edit
    assert bool(D.matches(D.build([(i, " ".join(x)) for i, x in enumerate(items)], 0.8, walks=0), column, walks=0)) == (e == 0)


def test_all_pairs_against_brute_force():
    few = VOCAB[:25]
    items = [[R.choice(few) for _ in range(R.randrange(0, 14))] for _ in range(25)]
    docs = [[R.choice(few) for _ in range(R.randrange(0, 60))] for _ in range(80)]
    index = D.build([(i, " ".join(x)) for i, x in enumerate(items)], 0.8)
    found = {(a, b): d for a, b, d in D.matches(index, pa.array([*(" ".join(x) for x in docs), None, ""]))}
    truth = {(a, b): d for a, y in enumerate(docs) for b, x in enumerate(items) if x and (d := distance(x, y)) <= D.edits(len(x), 0.8)}
    assert len(truth) > 50 and len(set(found) & set(truth)) >= 0.95 * len(truth)
    assert all(truth[k] == d for k, d in found.items())


def test_long_texts_and_items():
    item = [R.choice(VOCAB) for _ in range(600)]
    text = [R.choice(VOCAB) for _ in range(20_000)]
    text[14_000:14_000] = edited(item, 100, False)
    index = D.build([(7, " ".join(item)), (8, " ".join(item[:20]))], 0.8)
    got = {b: d for _, b, d in D.matches(index, pa.array([" ".join(text)]))}
    assert 0 in got and got[0] <= 120
    many = pa.array([" ".join(item[:20] * 100)])  # one item again and again is one stretch
    assert (0, 1, 0) in D.matches(index, many)


def test_walks_that_met_stay_together():
    x = np.append(np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
    sizes = [len(at) for at, _ in D.walk(x, np.arange(2000), 1, 1, 8, 1)]
    assert sizes[0] > 1900 and sizes[20] < 400 and sizes[60] < sizes[20]
