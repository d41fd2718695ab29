"""Suffix-array dedup of bytes with a run-length index.

Super-k-mers of the byte windows that may repeat meet in the bucket of their minimiser (see
``superk``).  There, the different strings of the repetitive rest are indexed: the runs of their
Burrows-Wheeler transform and, at each run's head, a sample (a suffix, the suffix before it, their
common length).  The suffix array lives only while the index is built.  Between two samples a match
only gets shorter by one each byte, so streaming the text over them gives every position's matching
statistics: the suffix before it and how long they match.  Positions linked by matches of a whole window
are the occurrences of one string; a long match goes unless it is in the smallest document of these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .superk import Shape, repeated
from .textkit import U64, cover, first_equal, flat, slices, spans_hash, true_runs

SIZE, GRAM = 50, 20
END = 0xFF  # no byte of UTF-8


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each position) by prefix doubling; only ties are sorted again."""
    n = len(text)
    if n < 2:
        return np.arange(n), np.arange(n)
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << U64(9)) | np.where(np.arange(n) + k < n, wide[k : n + k].astype(np.uint64) + U64(1), U64(0))
    sa = np.argsort(key, kind="stable")
    s = key[sa]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 7
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slot = np.flatnonzero(tied)  # slots of the suffix array not settled yet
        if not len(slot):
            return sa, rank
        at = sa[slot]
        after = at + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(rank[at] * (n + 1) + second, kind="stable")
        at, first, second = at[order], rank[at][order], second[order]
        sa[slot] = at
        new[slot[1:]] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[slot[0]] = True
        rank[at] = np.maximum.accumulate(np.where(new[slot], slot, 0))
        step *= 2


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of ``text``: its runs and a sample at every run's head."""

    def __init__(self, text: np.ndarray):
        self.text = text
        sa, rank = suffix_array(text)
        bwt = text[sa - 1]
        head = np.ones(len(text), bool)
        head[1:] = bwt[1:] != bwt[:-1]
        zero = rank[0] if len(text) else 0  # the first suffix has no byte before it
        head[zero : zero + 2] = True
        heads = np.flatnonzero(head)
        at, before = sa[heads], np.where(heads > 0, sa[heads - 1], -1)
        del sa, rank, bwt, head
        order = np.argsort(at)
        self.at, self.before = at[order], before[order]
        self.length = self._common(self.at, self.before)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix length of the suffixes a and b; 0 where b is -1."""
        n, out = len(self.text), np.zeros(len(a), np.int64)
        live = np.flatnonzero(b >= 0)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            ok = (x < n) & (y < n)
            live, x, y = live[ok], x[ok], y[ok]
            live = live[self.text[x] == self.text[y]]
            out[live] += 1
        return out

    def matching(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position, its longest match with the suffix before it in suffix order, and where that is."""
        n = len(self.text)
        k = np.searchsorted(self.at, np.arange(n), side="right") - 1
        shift = np.arange(n) - self.at[k]
        return np.maximum(self.length[k] - shift, 0), self.before[k] + shift

    def smallest(self, value: np.ndarray, size: int) -> np.ndarray:
        """For each position, the least ``value`` of all positions that share its next ``size`` bytes."""
        length, before = self.matching()
        up = np.where(length >= size, before, np.arange(len(value)))
        while True:  # to the first of the positions in suffix order, in doubled steps
            far = up[up]
            if np.array_equal(far, up):
                break
            up = far
        order = np.lexsort((value, up))
        head = np.append(True, np.diff(up[order]) != 0) if len(order) else np.zeros(0, bool)
        least = np.empty(len(value), value.dtype)
        least[up[order[head]]] = value[order[head]]
        return least[up]


def _marks(have: dict, size: int) -> np.ndarray:
    """Mask over the windows of one bucket: the bytes also start in a smaller document."""
    text, length, doc, rest, count = have["text"], have["length"], have["doc"], have["rest"], have["count"]
    end = np.cumsum(length)
    start = end - length
    # of each different string, one with the smallest document
    first, string = np.unique(first_equal(text, start, length, spans_hash(text, start, end), np.argsort(doc, kind="stable")), return_inverse=True)
    mask = np.repeat(doc > doc[first][string], count)
    # strings alone with their minimiser match no other string
    by = np.argsort(rest[first], kind="stable")
    r = rest[first][by]
    shared = np.zeros(len(by), bool)
    if len(by):
        twice = r[1:] == r[:-1]
        shared[by[1:][twice]] = True
        shared[by[:-1][twice]] = True
    pick = np.flatnonzero(shared)
    if len(pick):
        pick = pick[np.argsort(rest[first][pick], kind="stable")]
        item = first[pick]
        wide = np.append(text, np.uint8(END))
        n = length[item] + 1
        joined = slices(wide, start[item], n)
        edge = np.cumsum(n)
        joined[edge - 1] = END
        least = RunIndex(joined).smallest(np.repeat(doc[item], n), size)
        # the smallest documents of each string's windows, then all who carry the string at its first document
        number = np.full(len(first), -1)
        number[pick] = np.arange(len(pick))
        who = np.flatnonzero((number[string] >= 0) & (doc == doc[first][string]))
        windows = slices(least, (edge - n)[number[string[who]]], count[who])
        at = slices(np.arange(len(mask)), (np.cumsum(count) - count)[who], count[who])
        mask[at] = windows < np.repeat(doc[who], count[who])
    return mask


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, group_mb: float = 1.5) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept binary, spans), one for each row of ``docs``.

    A byte goes if it is covered by a string of ``size`` bytes that also starts in a document with a
    smaller id.  Rows with one id are one document's and don't count against each other; a null id is
    larger than others; null is the empty text; texts under ``size`` bytes are kept; other columns
    are not looked at.  ``spans`` are the maximal removed runs (start, end).
    """
    if gram > size:
        raise ValueError("gram must not exceed size")

    def finish(table: pa.Table, row, start, end) -> pa.Table:
        data, offsets = flat(table["text"])
        gone = cover(len(data), offsets[row] + start, offsets[row] + end)
        n_removed, kept, spans = [], [], []
        for a, b in zip(offsets[:-1], offsets[1:]):
            g = gone[a:b]
            x, y = true_runs(g)
            spans.append([{"start": int(i), "end": int(j)} for i, j in zip(x, y)])
            kept.append(data[a:b][~g].tobytes())
            n_removed.append(int(g.sum()))
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.table({"doc_id": table["doc_id"], "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array([len(s) for s in spans], pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(span))})

    return repeated(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")),
        lambda buckets: Shape("byte", size, gram, buckets),
        lambda have: _marks(have, size),
        finish,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:int,end:int>>",
        group_mb,
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
t AS (SELECT doc_id, n, unnest(range(n)) AS i, b FROM d),
win AS (SELECT doc_id, i, hex(b[i + 1 : i + 1]) AS x, CASE WHEN i + {SIZE} <= n THEN b[i + 1 : i + {SIZE}] END AS s FROM t),
flagged AS (SELECT doc_id, i, x, CASE WHEN s IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY s) THEN 1 ELSE 0 END AS again FROM win),
marked AS (SELECT doc_id, i, x, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW) AS gone FROM flagged),
edged AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS head FROM marked),
done AS (SELECT doc_id, sum(gone) AS n_removed, sum(head) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM edged GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN done ON d.doc_id = done.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
