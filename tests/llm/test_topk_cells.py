"""Exact top-k against brute force: many cells, shards and blocks, hot equal rows, odd vectors."""

import random

import numpy as np
import pytest

from mailsieve.llm import topk


def brute(rows, k, every):
    v = [(i, [int(np.floor(64 * x)) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for q in sorted({i for i, _ in v if i % every == 0}):
        mine = min((len(e), e) for i, e in v if i == q)[1]
        best = sorted((-sum(a * b for a, b in zip(mine, e)), i) for i, e in v if i != q and len(e) == len(mine))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block_rows,max_cells", [(10_000, 10_000, 64), (64, 10_000, 64), (50, 7, 64), (40, 20, 3)])
def test_cells(spark, shard_rows, block_rows, max_cells):
    r = random.Random(shard_rows)
    rows = [(i, [r.gauss(3 * (i % 4), 1) for _ in range(3)]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, 0.5]) for i in range(300)]  # a third of all rows are equal
    rows += [(2000, []), (2020, []), (2021, []), (2040, [1.0]), (2041, [2.0, 1.0]), (2060, None), (None, [1.0, 1.0, 1.0]), (2080, [float("nan"), 1.0, 1.0]), (2100, [None, 1.0, 1.0]), (40, [9.0, 9.0, 9.0]), (40, [1.0, 9.0, 9.0]), (2120, [float("inf"), 0.0, 1.0])]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<double>, dim string, cell int")
    got = [tuple(x) for x in topk.top_k(df, k=5, shard_rows=shard_rows, block_rows=block_rows, max_cells=max_cells).collect()]
    assert sorted(got) == brute(rows, 5, 20)
    if shard_rows == 64:
        assert topk.top_k(df.limit(0)).count() == 0


def test_queries_travel_only_where_the_bound_allows():
    r = np.random.default_rng(1)
    points = np.concatenate([r.normal(10 * c, 1, (500, 2)) for c in range(4)])
    cut = topk.fit(points, 4)
    cell = cut.place(points)
    assert cut.cells == 4 and np.bincount(cell).min() > 400
    assert len(np.unique(cell[:500])) <= 2
    same = topk.fit(np.ones((50, 3)), 8)
    assert same.cells == 1 and topk.fit(np.zeros((0, 3)), 8).cells == 1 and topk.fit(np.zeros((9, 0)), 8).cells == 1
    half = topk.fit(np.array([[0.0]] * 90 + [[1.0]] * 10), 2)
    assert half.place(np.array([[0.0], [1.0]])).tolist() == [0, 1]
