"""Substring and suffix dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from mailsieve.llm import substring_dedup, suffix_dedup
from mailsieve.llm.suffix_dedup import RunIndex, suffix_array

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = ["ab", "c", "dé", "ñu", "xyz", "the", "of", "Q"]
    passage = " ".join(r.choice(vocab) for _ in range(45))
    rows = []
    for i in range(n):
        kind = r.random()
        text = " ".join(r.choice(vocab) + r.choice(["", "1", "22"]) for _ in range(r.randrange(0, 90)))
        if kind < 0.3:
            text = text + "\n" + passage + "\t " + text[:7]
        elif kind < 0.5 and rows:
            text = (r.choice(rows)[1] or "") + " tail"
        elif kind < 0.55:
            text = "na " * r.randrange(1, 120)
        elif kind < 0.6:
            text = None
        rows.append((i * 3, text))
    rows += [(5, ""), (7, " \n "), rows[3], (None, passage), (None, None)]
    return rows


def brute_words(rows, k):
    words = [WORDS.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def brute_bytes(rows, k):
    texts = [((1 << 62) if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in texts:
        for i in range(len(t) - k + 1):
            s = t[i : i + k]
            first[s] = min(first.get(s, d), d)
    out = []
    for (d, t), (raw, _) in zip(texts, rows):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - k + 1):
            if first[t[i : i + k]] < d:
                gone[i : i + k] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((raw, len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


key = lambda r: tuple(str(x) for x in r)


@pytest.mark.parametrize("window,gram", [(35, 10), (6, 2), (3, 3)])
def test_substring(spark, window, gram):
    rows = corpus(window)
    df = spark.createDataFrame([(d, t, "x", d) for d, t in rows], "doc_id long, text string, g string, start long")
    got = [tuple(r) for r in substring_dedup.dedup(df, window=window, gram=gram, group_mb=0.002).collect()]
    assert sorted(got, key=key) == sorted(brute_words(rows, window), key=key)


def test_substring_within_one_document(spark):
    """Windows that repeat nowhere else but in their own document, at every period."""
    rows = [(p, " ".join(f"d{p}w{i % p}" for i in range(70 + 3 * p))) for p in [*range(1, 40), 90]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in substring_dedup.dedup(df).collect()]
    assert sorted(got, key=key) == sorted(brute_words(rows, 35), key=key)
    assert {r[0] for r in got if r[2] == 0} == set()


@pytest.mark.parametrize("size,gram", [(50, 20), (9, 4)])
def test_suffix(spark, size, gram):
    rows = corpus(size)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string")
    got = [tuple(r)[:4] + (bytes(r["kept"]),) for r in suffix_dedup.dedup(df, size=size, gram=gram, group_mb=0.002).collect()]
    assert sorted(got, key=key) == sorted(brute_bytes(rows, size), key=key)


def test_empty_and_long(spark):
    for op in (substring_dedup, suffix_dedup):
        assert op.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
        long = "word " * 300_000
        out = {r["doc_id"]: r["n_removed"] for r in op.dedup(spark.createDataFrame([(1, long), (2, long), (3, "a b")], "doc_id long, text string")).collect()}
        assert out[2] > 1_000_000 or out[2] == 300_000
        assert out[3] == 0


def test_queries_small(spark, tmp_path):
    rows = corpus(9)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n_removed, r.kept_sha256) for r in substring_dedup.query(spark, str(tmp_path)).collect()}
    assert got == {(d, n, hashlib.sha256(k.encode()).hexdigest()) for d, _, n, k in brute_words(rows, 35)}
    got = {(r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.query(spark, str(tmp_path)).collect()}
    assert got == {(d, n, s, hashlib.sha256(k).hexdigest()) for d, _, n, s, k in brute_bytes(rows, 50)}


def test_run_index():
    r = random.Random(1)
    for n in (0, 1, 2, 50, 400):
        t = np.array([r.choice([65, 66, 67]) for _ in range(n)], np.uint8)
        if n == 400:
            t[200:] = t[:200]
        sa, rank = suffix_array(t)
        raw = t.tobytes()
        assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
        assert rank[sa].tolist() == list(range(n))
        if n:
            length, source = RunIndex(t).matching()
            for k in range(1, n):
                i, j, m = int(sa[k]), int(sa[k - 1]), 0
                while i + m < n and j + m < n and raw[i + m] == raw[j + m]:
                    m += 1
                assert length[i] == m and (source[i] == j or m == 0)


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_oracle(spark, tmp_path, op):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(11))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(op.ORACLE)
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
