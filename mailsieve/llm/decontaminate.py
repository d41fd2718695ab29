"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows.

Words (split at white space and ASCII punctuation, A-Z lower-cased) are the symbols.  The CGK random walk
copies a sequence's current symbol at every step and moves on by a random bit of (step, symbol), which maps
edit distance to Hamming distance: after an edit two walks soon meet again and copy the same symbols.  A
key samples a few steps of one stretch of a walk; every item has the keys of several walks all along its
length.  A window of an item's size starts at every word of a document.  Its walk needs no cutting, as an item
only has keys of steps at which its own walk is inside; and walks from neighbouring starts that
have met stay together, so a stretch is walked once for all windows that share it.  A window that has a
key of an item is a candidate, on the diagonal of that key; candidates are verified by exact edit
distance against any stretch of the document around them.

Two bounds save work and lose nothing.  Of n words with e edits n - 2e - 1 pairs of neighbours stay, so only
stretches of a document with that many pairs of the benchmark are walked at all, and only candidates with that
many pairs of their item are verified.  Items too short for an edit must be equal word by word and are looked up whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textkit import JOIN, SPACE, U64, Words, cover, flat, mix, pieces, row_of, sequence_hash, window_hash

SIMILARITY, WALKS, KEYS, BLOCK_WORDS = 0.8, 8, 2, 200_000
#: Of items up to a size: the steps of a stretch of their walks, and how many of these a key samples.
LADDER = ((12, 6, 3), (math.inf, 12, 4))
RATIO = 1.12  # of the item sizes that share a screen
PIECE = 4_000_000  # bytes of text at once
CELLS = 1_000_000  # of the matrices of edit distances at once
GAP = SPACE.copy()
GAP[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


def edits(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


@lru_cache(maxsize=4096)
def sampled(seed: int, m: int, keys: int, stretch: int, samples: int) -> tuple[np.uint64, list[tuple[int, ...]], np.ndarray]:
    """Of a walk's stretch: the random multiplier that gives the bits, the steps that each key samples, and the keys' salts."""
    rng = np.random.default_rng([seed, m, stretch])
    odd = U64(int(rng.integers(2**62)) * 2 + 1)
    return odd, [tuple(sorted(rng.choice(stretch, samples, replace=False).tolist())) for _ in range(keys)], rng.integers(0, 2**63, keys).astype(np.uint64)


def walk(x: np.ndarray, start: np.ndarray, seed: int, keys: int, stretch: int, samples: int, most: float = math.inf) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions at the first sampled step, keys) of the walks over ``x`` from the sorted ``start``, stretch by stretch.

    Words are not 0; a 0 ends a sequence and stops a walk.  Walks that have met go on as one.  At most ``most`` stretches are walked.
    """
    at, m = start, 0
    while len(at) and m < most:
        odd, steps, salt = sampled(seed, m, keys, stretch, samples)
        r = x * odd
        places, symbols = [], []
        for t in range(stretch):
            s = r[at]
            places.append(at)
            symbols.append(s)
            at = at + ((s >> U64(63 - t)) & U64(1)).astype(np.int64)
        for chosen, z in zip(steps, salt):
            inside = np.flatnonzero(symbols[chosen[-1]])
            h = np.full(len(inside), z)
            for t in chosen:
                h = h * JOIN + symbols[t][inside]
            yield places[chosen[0]][inside], mix(h)
        at = at[np.diff(at, prepend=-1) != 0]
        at = at[x[at] != 0]
        m += 1


@dataclass
class Table:
    """The keys of items of like size."""

    stretch: int
    samples: int
    most: int  # stretches of an item's walk
    keys: np.ndarray  # sorted
    item: np.ndarray  # of each key
    place: np.ndarray  # of each key, in its item
    bits: np.ndarray  # of the keys


@dataclass
class Index:
    ids: np.ndarray
    words: np.ndarray  # all items' word hashes
    offsets: np.ndarray
    edits: np.ndarray  # that each item allows
    exact: dict  # size -> (sorted hashes, item) of the items that allow none
    tables: list[Table]
    pairs: np.ndarray  # of neighbouring words
    own: np.ndarray  # of neighbouring words with their item
    screens: list[tuple[int, int, int]]  # for items of like size: pairs in a row, how many of these must be the benchmark's, words beside


def spare(n, e):
    """Pairs of neighbours that stay at least when ``e`` of ``n`` words are edited."""
    return n - 2 * e - 1


def screens_of(sizes: np.ndarray, similarity: float) -> list[tuple[int, int, int]]:
    """Screens of the item sizes: some run of ``width`` pairs has ``need`` of the benchmark's if an item is there.

    A stretch of n + e words has so many pairs; they are cut into runs of ``width`` and a rest.
    """
    out, todo = [], sorted({int(n) for n in sizes})
    while todo:
        part = [n for n in todo if n <= RATIO * todo[0]]
        todo = todo[len(part) :]
        width = part[0] + edits(part[0], similarity) - 1
        need = []
        for n in part:
            e = edits(n, similarity)
            k, rest = divmod(n + e - 1, width)
            need.append(max(-(-(spare(n, e) - rest) // k), -(-spare(n, e) // (k + 1))) if rest else -(-spare(n, e) // k))
        out.append((width, min(need), part[-1] + edits(part[-1], similarity) - width))
    return out


def salted(pair: np.ndarray, item: np.ndarray) -> np.ndarray:
    return mix(pair ^ (item.astype(np.uint64) * JOIN))


def bitmap(h: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << max(14, min(25, (64 * len(h)).bit_length())), bool)
    out[(h >> U64(65 - len(out).bit_length())).astype(np.int64)] = True
    return out


def maybe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return bits[(h >> U64(65 - len(bits).bit_length())).astype(np.int64)]


def build(items: list[tuple[int, str]], similarity: float, walks: int = WALKS, keys: int = KEYS) -> Index:
    w = Words(*flat(pa.array([t for _, t in items], pa.string())), lower=True, gap=GAP)
    h, off = np.maximum(w.hashes(), U64(1)), w.rows
    size = np.diff(off)
    allowed = np.array([edits(int(n), similarity) for n in size], np.int64)
    exact = {}
    for n in np.unique(size[(size > 0) & (allowed == 0)]):
        item = np.flatnonzero((size == n) & (allowed == 0))
        whole = window_hash(h, int(n))[off[item]]
        order = np.argsort(whole, kind="stable")
        exact[int(n)] = (whole[order], item[order])
    long = np.flatnonzero(allowed > 0)
    # each item's words and a 0
    x = np.zeros(len(h) + len(size), np.uint64)
    x[np.arange(len(h)) + row_of(off)] = h
    begin = off[:-1] + np.arange(len(size))
    tables, least = [], 0
    for upto, stretch, samples in LADDER:
        part = long[(size[long] > least) & (size[long] <= upto)]
        least, found, most = upto, [], 0
        for seed in range(walks):
            of = [np.stack([k, at.astype(np.uint64)]) for at, k in walk(x, begin[part], seed, keys, stretch, samples)]
            found, most = found + of, max(most, len(of) // keys)
        if found:
            key, at = np.concatenate(found, axis=1)
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order].astype(np.int64)
            item = np.searchsorted(begin, at, side="right") - 1
            tables.append(Table(stretch, samples, most, key, item, at - begin[item], bitmap(key)))
    two = np.concatenate([np.arange(off[i], off[i + 1] - 1) for i in long]) if len(long) else long
    pair = window_hash(h, 2)[two] if len(two) else h[:0]
    return Index(np.array([i for i, _ in items]), h, off, allowed, exact, tables, bitmap(pair), bitmap(salted(pair, row_of(off)[two])), screens_of(size[long], similarity))


def distance(item: np.ndarray, words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Least edit distance of the item to any stretch of words[start:stop], for each pair of bounds."""
    width = int((stop - start).max())
    col = np.arange(width)
    inside = start[:, None] + col < stop[:, None]
    region = np.where(inside, words[np.minimum(start[:, None] + col, len(words) - 1)], U64(0))
    line = np.zeros((len(start), width + 1), np.int64)
    ramp = np.arange(width + 1)
    for i, symbol in enumerate(item):
        new = np.empty_like(line)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(line[:, :-1] + ((region != symbol) | ~inside), line[:, 1:] + 1)
        line = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return line.min(axis=1)


def lookup(sorted_keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in ``h``, index in the keys) of all that are equal."""
    lo, hi = np.searchsorted(sorted_keys, h), np.searchsorted(sorted_keys, h, side="right")
    each = hi - lo
    of = np.repeat(np.arange(len(h)), each)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lo, each)


def screened(index: Index, pair: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Mask over the words: stretches with as many pairs of the benchmark as some item leaves."""
    n = rows[-1]
    most = max((w for w, _, _ in index.screens), default=0)
    total = np.zeros(n + most + 1, np.int32)
    total[1 : len(pair) + 1] = np.cumsum(maybe(index.pairs, pair))
    total[len(pair) + 1 :] = total[len(pair)]
    out = np.zeros(n, bool)
    for width, need, beside in index.screens:
        hot = np.flatnonzero(total[width : width + n] - total[:n] >= need)
        row = np.searchsorted(rows, hot, side="right") - 1
        out |= cover(n, np.maximum(hot - beside, rows[row]), np.minimum(hot + width + 1 + beside, rows[row + 1]))
    return out


def candidates(index: Index, h: np.ndarray, rows: np.ndarray, walks: int, keys: int, screen: bool) -> np.ndarray:
    """Distinct (row, item, first word of the window) whose windows share a key with the item."""
    word = np.flatnonzero(screened(index, window_hash(h, 2), rows)) if screen else np.arange(len(h))
    if not len(word) or not index.tables:
        return np.zeros((0, 3), np.int64)
    row = row_of(rows)
    ends = np.ones(len(word), bool)
    ends[:-1] = (np.diff(word) != 1) | (row[word[1:]] != row[word[:-1]])
    place = np.arange(len(word)) + np.cumsum(ends) - ends
    x, origin = np.zeros(place[-1] + 2, np.uint64), np.zeros(place[-1] + 2, np.int64)
    x[place], origin[place] = h[word], word
    out = []
    for table in index.tables:
        for seed in range(walks):
            for at, key in walk(x, place, seed, keys, table.stretch, table.samples, table.most):
                some = np.flatnonzero(maybe(table.bits, key))
                of, hit = lookup(table.keys, key[some])
                if len(of):
                    at0 = origin[at[some[of]]]
                    out.append((row[at0], table.item[hit], at0 - table.place[hit]))
    if not out:
        return np.zeros((0, 3), np.int64)
    r, i, s = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((s, i, r))
    r, i, s = r[order], i[order], s[order]
    new = np.append(True, (np.diff(r) != 0) | (np.diff(i) != 0) | (np.diff(s) != 0))
    return np.stack([r[new], i[new], s[new]], axis=1)


def matches(index: Index, column, walks: int = WALKS, keys: int = KEYS, screen: bool = True) -> list[tuple[int, int, int]]:
    """(row, item, edit distance) of every item found in a row of the batch, the best stretch of each."""
    w = Words(*flat(column), lower=True, gap=GAP)
    h = np.maximum(w.hashes(), U64(1))
    row = row_of(w.rows)
    best: dict[tuple[int, int], int] = {}
    for n, (whole, item) in index.exact.items():
        g = window_hash(h, n)
        at = np.flatnonzero(np.isin(g, whole))
        at = at[at + n <= w.rows[row[at] + 1]]
        of, hit = lookup(whole, g[at])
        best |= dict.fromkeys(zip(row[at[of]].tolist(), item[hit].tolist()), 0)
    todo = candidates(index, h, w.rows, walks, keys, screen)
    if len(todo):
        r, i, s = todo.T
        size = np.diff(index.offsets)
        # windows of one item whose starts lie within its edits are one stretch
        head = np.append(True, (np.diff(r) != 0) | (np.diff(i) != 0) | (np.diff(s) > index.edits[i[1:]]))
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(r)) - 1
        r, i = r[first], i[first]
        begin = np.maximum(s[first] - index.edits[i], w.rows[r])
        stop = np.minimum(s[last] + size[i] + index.edits[i], w.rows[r + 1])
        if screen:
            enough = np.zeros(len(r), bool)
            pair = window_hash(h, 2)
            for a in range(0, len(r), 10_000):
                z = slice(a, a + 10_000)
                wide = np.maximum(stop[z] - begin[z] - 1, 1)
                edge = np.cumsum(wide) - wide
                at = np.minimum(np.repeat(begin[z] - edge, wide) + np.arange(int(wide.sum())), len(pair) - 1)
                enough[z] = np.add.reduceat(maybe(index.own, salted(pair[at], np.repeat(i[z], wide))).astype(np.int64), edge) >= spare(size[i[z]], index.edits[i[z]])
            r, i, begin, stop = r[enough], i[enough], begin[enough], stop[enough]
        for x in np.unique(i):
            part = np.flatnonzero(i == x)
            part = part[np.argsort((stop - begin)[part], kind="stable")]
            while len(part):
                # as many stretches as fit, the widest last
                fit = max(1, int(np.searchsorted((stop - begin)[part] * np.arange(1, len(part) + 1), CELLS, side="right")))
                now, part = part[:fit], part[fit:]
                for rr, d in zip(r[now].tolist(), distance(index.words[index.offsets[x] : index.offsets[x + 1]], h, begin[now], stop[now]).tolist()):
                    if d <= index.edits[x]:
                        best[rr, int(x)] = min(best.get((rr, int(x)), d), d)
    return [(r, i, d) for (r, i), d in best.items()]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    """The benchmark's items in blocks of bounded size, one after another."""
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("long"), F.col(text_col).cast("string"))
    block, words = [], 0
    for i, t in rows.toLocalIterator():
        block.append((i, t))
        words += len(t) // 4 + 1
        if words > block_words:
            yield block
            block, words = [], 0
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, edit_distance, similarity): the items that a document holds.

    An item is held if some stretch of the document is within floor((1 - similarity) * words) word
    edits of it; which windows are verified depends on the LSH, so recall is high but not 1.  Null and
    empty texts and items hold nothing; texts of any length are taken whole.  Repeated rows give repeated
    results; items that repeat an id count alone.  An empty benchmark gives no rows.  The benchmark is taken in
    blocks of at most ``block_words`` words or one item, each sent to all tasks and each a pass over the
    documents.  Other columns are not looked at, whatever their names.
    """
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {kind}, item_id long, edit_distance int, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks_of(benchmark, item_col, item_text, block_words):
        index = docs.sparkSession.sparkContext.broadcast(build(block, similarity))

        def run(batches, index=index):
            for b in pieces(batches, 1, PIECE):
                x = index.value
                got = matches(x, b.column(1))
                n = np.diff(x.offsets)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": b.column(0).take(pa.array([r for r, _, _ in got], pa.int64())),
                        "item_id": pa.array([int(x.ids[i]) for _, i, _ in got], pa.int64()),
                        "edit_distance": pa.array([d for _, _, d in got], pa.int32()),
                        "similarity": pa.array([1 - d / float(n[i]) for _, i, d in got], pa.float64()),
                    }
                )

        out = out.unionByName(base.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item (see ``find``); columns pass through."""
    for block in blocks_of(benchmark, item_col, item_text, block_words):
        index = docs.sparkSession.sparkContext.broadcast(build(block, similarity))

        def run(batches, index=index):
            for b in pieces(batches, text_col, PIECE):
                keep = np.ones(b.num_rows, bool)
                keep[[r for r, _, _ in matches(index.value, b.column(b.schema.names.index(text_col)).cast(pa.string()))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return find(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean(docs, common.read(spark, sf_dir, "benchmark"))
