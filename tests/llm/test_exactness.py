"""Texts of a regular structure and forced collisions: equality is by bytes, not by hashes."""

import numpy as np
import pyarrow as pa
import pytest

from mailsieve.llm import jaccard_join, line_dedup, substring_dedup, suffix_dedup, textkit


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


ONE, TWO = thue_morse(1024), thue_morse(1024, 1)


def test_line_dedup(spark):
    lines = [" ".join(f"{x}{k}" for k in range(8)) for x in (ONE, TWO)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup(df).collect()} == {0: 0, 1: 0}


def test_windows(spark):
    rest = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{ONE} {rest}"), (2, f"{TWO} {rest}"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup(df).collect()} == {1: 0, 2: 0, 3: 0}


def test_sets(spark):
    df = spark.createDataFrame([(1, ONE), (2, TWO), (3, f"{ONE} x y"), (4, f"{TWO} x y")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.join(df).collect()} == {i: i for i in range(1, 5)}


def test_bytes(spark):
    df = spark.createDataFrame([(1, ONE), (2, TWO)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup(df, size=900).collect()}
    assert got == {1: 0, 2: 0}


@pytest.mark.parametrize("weak", [lambda v, n: np.zeros(max(0, len(v) - n + 1), np.uint64), lambda v, n: textkit.window_hash(v, n) % np.uint64(3)])
def test_counts_with_a_weak_hash(monkeypatch, weak):
    texts = ["a b c d", "b c d e", "x y z w", "a b c q"]
    data, off = textkit.flat(pa.array(texts))
    have = {"text": data, "length": np.diff(off)}
    want = [True, True, True, False, False, False, True, False]
    assert substring_dedup._counts(have, 3).tolist() == want
    monkeypatch.setattr(substring_dedup, "window_hash", weak)
    assert substring_dedup._counts(have, 3).tolist() == want


def test_first_equal_with_a_weak_hash():
    words = [b"aa", b"b", b"aa", b"", b"ab", b"", b"b", b"aa"]
    data = np.frombuffer(b"".join(words), np.uint8)
    length = np.array([len(w) for w in words])
    start = np.cumsum(length) - length
    want = [words.index(w) for w in words]
    for h in (textkit.spans_hash(data, start, start + length), np.zeros(8, np.uint64)):
        assert textkit.first_equal(data, start, length, h).tolist() == want
        assert textkit.first_equal(data, start, length, h, np.arange(8)[::-1]).tolist() == [7 - words[::-1].index(w) for w in words]


def test_hashes_by_value():
    r = np.random.default_rng(1)
    data = r.integers(0, 3, 20_000).astype(np.uint8)
    for size in (5, 8, 20, 33):
        g = textkit.gram_hash(data, size)
        assert len(np.unique(g)) == len({data[i : i + size].tobytes() for i in range(len(g))})
        w = textkit.window_hash(data.astype(np.uint64), size)
        assert len(np.unique(w)) == len(np.unique(g))
    start = r.integers(0, 15_000, 3000)
    end = start + r.integers(0, 5000, 3000)
    assert len(np.unique(textkit.spans_hash(data, start, end))) == len({data[a:b].tobytes() for a, b in zip(start, end)})


def test_only_minima_are_selected():
    """Lines that are never the smallest of their window don't go on."""
    lines = line_dedup.Lines(pa.array(["\n".join(f"line {i}" for i in range(3000))]))
    for least in (2, 5):
        mark, edge, begin, size, key, h = line_dedup.selected(lines, least, 8)
        assert len(mark) < 3000 * (2 / (least + 1) + 0.05) and len(begin) == 3001 - least
        for k in range(0, len(mark), 97):
            for b in begin[edge[k] : edge[k + 1]]:
                assert h[mark[k]] == h[b : b + least].min() and b <= mark[k] < b + least
