"""Line dedup, components and the Jaccard join against brute force."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import jaccard_join, line_dedup
from mailsieve.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
key = lambda r: tuple(str(x) for x in r)


def line_corpus():
    r = random.Random(5)
    pool = ["a b", "c", "  d e f ", "one two three four five six seven eight", "x " * 9, "", " \t", "é ü", "tail\r"]
    rows = [(i, "\n".join(r.choice(pool + [f"u{i}{j}"]) for j in range(r.randrange(0, 9)))) for i in range(80)]
    return rows + [(200, None), (201, ""), (202, "\n\n"), (203, "c\na b\n\nc\n \na b")]


def test_line_dedup_oracle(spark, tmp_path):
    rows = line_corpus()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = line_dedup.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(line_dedup.ORACLE)
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_line_dedup_edges(spark):
    run = "first line here\nsecond line here"
    rows = [(3, run + "\nown", "p"), (1, "begin\n" + run, "q"), (None, run, "r"), (3, run + "\nown", "p"), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    out = sorted(((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup(df).collect()), key=key)
    assert out == sorted([(1, "begin\n" + run, 0), (3, "own", 2), (3, "own", 2), (4, None, 0), (None, "", 2)], key=key)
    assert line_dedup.dedup(df.limit(0)).count() == 0
    kept = {r.doc_id for r in line_dedup.stage(None, df.select("doc_id", "text"), "").collect()}
    assert kept == {1, 3, 4}
    long = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(50_000)))] * 1 + [(2, "\n".join(f"line {i}" for i in range(50_000)))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup(long).collect()} == {1: 0, 2: 50_000}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for a, b in edges:
        if a != b:
            assert got[a] == find(a) and got[b] == find(b)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def join_corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "the"]
    rows = []
    for i in range(120):
        if rows and r.random() < 0.55:
            words = (r.choice(rows)[1] or "").split()
            for _ in range(r.randrange(0, 4)):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocab)
            if r.random() < 0.3:
                words += [r.choice(vocab)]
        else:
            words = [r.choice(vocab) for _ in range(r.choice([0, 1, 2, 3, 5, 12, 40, 120]))]
        rows.append((i + 10, " ".join(w.upper() if r.random() < 0.1 else w for w in words)))
    return rows + [(3, None), (4, ""), (5, "w1"), (6, "W1"), (None, "w1")]


def brute_join(rows, size, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for d, t in rows:
        w = WORDS.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    comp = [d for d, _ in rows]
    changed = True
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            m = min(comp[i], comp[j])
            if comp[i] != m or comp[j] != m:
                comp[i] = comp[j] = m
                changed = True
    return [(d, len(s), c) for (d, _), s, c in zip(rows, sets, comp)]


@pytest.mark.parametrize("size,percent,leaf", [(3, 90, 1500), (5, 80, 4)])
def test_join(spark, size, percent, leaf):
    rows = join_corpus(size)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1))
    got = [tuple(r) for r in jaccard_join.join(df, shingle=size, percent=percent, group_mb=0.002, leaf_rows=leaf).collect()]
    assert sorted(got, key=key) == sorted(brute_join(rows, size, percent), key=key)


def test_join_oracle(spark, tmp_path):
    rows = [r for r in join_corpus(9) if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = jaccard_join.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(jaccard_join.ORACLE)
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_join_edges(spark):
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = spark.createDataFrame([(i, "one two three four") for i in range(500)] + [(0, "one two three four")], "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.join(same).collect()} == {0}
    assert [r.doc_id for r in jaccard_join.stage(None, same, "").collect()] == [0]


def test_links_need_only_connect():
    import numpy as np

    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.append(base[r.random(400) < 0.985], r.integers(0, 2**63, 3).astype(np.uint64))) for _ in range(300)]
    out = jaccard_join.links(list(range(300)), sets, 90)
    assert len(out) == 299


def test_bound_keeps_links_and_drops_shared_passages():
    import numpy as np

    r = np.random.default_rng(1)
    new = lambda n: r.integers(0, 2**63, n).astype(np.uint64)
    passage = new(250)
    loose = [np.unique(np.append(passage, new(150))) for _ in range(40)]
    bases = [new(n) for n in (1, 2, 30, 400, 3000)]
    near = [np.unique(np.append(b[: len(b) - len(b) // 12], new(len(b) // 40))) for b in bases for _ in range(4)]
    sets = loose + bases + near
    ids = np.arange(len(sets)) * 3
    found = jaccard_join.bounded(ids, np.stack([jaccard_join.counts(s) for s in sets]), 80)
    assert not any(min(p) < 3 * len(loose) for p in found)
    root = {int(i): int(i) for i in ids}
    for a, b in found:
        old, to = root[a], root[b]
        root = {k: to if v == old else v for k, v in root.items()}
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                assert root[3 * i] == root[3 * j]


def test_cells_hold_every_pair(spark):
    rows = [(g, 100 * g + k) for g, n in ((1, 17), (2, 3), (3, 1), (4, 4), (5, 9)) for k in range(n)]
    cells = {}
    for x in jaccard_join.in_cells(spark.createDataFrame(rows, "hub long, rep long"), "hub", 4).collect():
        cells.setdefault(x.cell, set()).add((x.hub, x.rep))
    together = {(a, b) for c in cells.values() for a in c for b in c}
    assert all(((g, a), (g, b)) in together for g, a in rows for h, b in rows if g == h)
    assert max(len(c) for c in cells.values()) < 17


def test_join_one_id_with_two_texts(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join(a[:-1])), (6, " ".join(b[1:])), (8, "c d e f")]
    got = {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, 6: 5, 7: 5, 8: 8}


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_key(percent):
    import numpy as np
    import pyarrow as pa

    r = random.Random(percent)
    texts, pairs = [], 0
    for a in range(2, 41):
        for b in range(a, a * 100 // percent + 1):
            least = -(-percent * (a + b) // (100 + percent))
            for both in {least, a}:
                if least <= both <= a:
                    for _ in range(40):  # new words each time: another assignment to groups
                        w = [f"{r.getrandbits(60):x}" for _ in range(a + b - both)]
                        texts += [" ".join(w[:a]), " ".join(w[a - both :])]
                        pairs += 1
    sets = jaccard_join.Sets(pa.chunked_array([texts]), 1)
    row, key = sets.keys(percent)
    mine = [set() for _ in texts]
    for i, k in zip(row.tolist(), key.tolist()):
        mine[i].add(k)
    assert np.array_equal(np.bincount(row), [len(x) for x in mine])
    assert sum(not mine[2 * i] & mine[2 * i + 1] for i in range(pairs)) == 0


def test_join_of_small_sets(spark):
    r = random.Random(4)
    rows = []
    for i in range(0, 1200, 2):
        n = r.randrange(4, 12)
        w = [f"{r.getrandbits(60):x}" for _ in range(n + 4)]
        rows += [(i, " ".join(w)), (i + 1, " ".join(w + ["more"]))]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, percent=80).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: i - i % 2 for i, _ in rows}


def test_one_id_in_classes_of_other_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (5, a), (5, b), (5, ""), (9, b), (8, "c d e f"), (8, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.join(df).collect())
    assert got == [(3, 58, 3), (5, 0, 3), (5, 58, 3), (5, 58, 3), (7, 0, 7), (8, 0, 8), (8, 2, 8), (9, 58, 3)]
    kept = sorted(((x.doc_id, x.text) for x in jaccard_join.stage(None, df.union(df), "").collect()), key=key)
    assert kept == sorted([(3, a), (5, b), (5, ""), (8, "c d e f"), (8, None), (7, "")], key=key)
