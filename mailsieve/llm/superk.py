"""Repeated fixed-size windows of units (words or bytes) across a corpus, by super-k-mers.

Documents are hashed into small groups, so each task holds one group.  Consecutive windows with
the same minimiser (the smallest hash of the grams inside) form a super-k-mer, and equal windows
have equal minimisers, so whatever can be equal meets in the bucket of its minimiser:

1. every group sends the 32-bit rests of its minimisers to their buckets, packed, none more than twice;
2. a bucket answers with one bit for each: seen at least twice, or not;
3. super-k-mers whose minimiser is repeated travel as packed strings to the bucket, and where
   repeats inside a document count, so do those that hold their minimiser twice themselves; of
   strings with equal bytes in a group one travels with its text and settles the others;
4. ``resolve`` finds the windows to mark there and answers with spans of units;
5. the group marks its documents.

Work and traffic are linear in the text.  A passage that is everywhere reaches its bucket once a
group as a short string; a document, source or copy group is never gathered as a whole.  Hashes only
bring strings together: what is marked is equal by bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textkit import U64, Words, first_equal, flat, gram_hash, row_of, slices, sliding_min, spans_hash, starts_inside, window_hash


#: Of a packed batch of super-k-mers, the text last.  state: ASK, or KNOWN (marked, but others must see it), or SETTLED (marked, no text).
FIELDS = (("length", np.int32), ("row", np.int32), ("start", np.int32), ("count", np.int32), ("doc", np.int64), ("rest", np.uint32), ("state", np.uint8), ("text", np.uint8))
ASK, KNOWN, SETTLED = 0, 1, 2


def squeeze(raw: bytes) -> bytes:
    return pa.Codec("zstd", 3).compress(raw, asbytes=True)


def expand(packed, size: int):
    return pa.Codec("zstd").decompress(packed, size)


@dataclass(frozen=True)
class Shape:
    unit: str  # "word" or "byte"
    window: int
    gram: int
    buckets: int
    inside: bool = False  # whether repeats inside one document count


def ordered(table: pa.Table) -> pa.Table:
    """A group in one order, whatever order the rows came in."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


class Group:
    """Units of a group: canonical bytes and, for each unit, where its bytes begin and end."""

    def __init__(self, table: pa.Table, shape: Shape):
        data, offsets = flat(table["text"])
        if shape.unit == "word":
            w = Words(data, offsets)
            self.words, self.data, self.rows = w, w.data, w.rows
            self.padded, self.wide = np.append(w.data, np.uint8(32)), (w.end - w.start) + 1  # a word and one space
            self.grams = window_hash(w.hashes(), shape.gram)
        else:
            self.data, self.rows = data, offsets
            self.grams = gram_hash(data, shape.gram)

    def runs(self, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Super-k-mers: first window, number of windows, minimiser."""
        m = sliding_min(self.grams, shape.window - shape.gram + 1)
        if not len(m):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), m
        ok, row = starts_inside(self.rows, shape.window)[: len(m)], row_of(self.rows)[: len(m)]
        head = ok.copy()
        head[1:] &= (m[1:] != m[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1]
        start = np.flatnonzero(head)
        stop = np.flatnonzero(np.append(head | ~ok, True))
        end = stop[np.searchsorted(stop, start, side="right")] if len(start) else start
        return start, end - start, m[start]

    def keyed(self, shape: Shape):
        """First window, number of windows, bucket and rest of every super-k-mer, by bucket and rest."""
        start, count, h = self.runs(shape)
        twice = self.holds_twice(shape, start, count, h) if shape.inside else np.zeros(len(start), bool)
        bucket, rest = h % U64(shape.buckets), (h // U64(shape.buckets)) & U64(0xFFFFFFFF)
        key = (bucket << U64(32)) | rest
        order = np.argsort(key, kind="stable")
        key, self.twice = key[order], twice[order]
        self.head = np.ones(len(key), bool)  # the first of each key, and the second as well
        self.head[1:] = key[1:] != key[:-1]
        self.sent = self.head.copy()
        self.sent[1:] |= self.head[:-1]
        return start[order], count[order], bucket[order].astype(np.int64), rest[order].astype(np.uint32)

    def flagged(self, bucket: np.ndarray, bits: dict[int, bytes]) -> np.ndarray:
        """Super-k-mers whose minimiser their bucket has seen twice."""
        at, out = np.flatnonzero(self.sent), np.zeros(len(bucket), bool)
        for k, a, b in cuts(bucket[at]):
            if k in bits:
                out[at[a:b]] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=b - a)
        return out[np.maximum.accumulate(np.where(self.head, np.arange(len(bucket)), 0))]

    def holds_twice(self, shape: Shape, start: np.ndarray, count: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Super-k-mers in which the gram that is their minimiser starts twice: only these can repeat a window within."""
        if not len(start):
            return np.zeros(0, bool)
        n = count + (shape.window - shape.gram)
        first = np.cumsum(n) - n
        at = np.repeat(start - first, n) + np.arange(int(n.sum()))
        same = self.grams[at] == np.repeat(h, n)
        return np.add.reduceat(same.astype(np.int64), first) > 1

    def packed(self, shape: Shape, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the super-k-mers, one after another, and their lengths."""
        if shape.unit == "byte":
            n = count + (shape.window - 1)
            return slices(self.data, start, n), n
        n = count + (shape.window - 1)
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        size = self.wide[at]
        out = slices(self.padded, self.words.start[at], size)
        ends = np.cumsum(size)
        out[ends - 1] = 32
        last = np.cumsum(n)
        return out, np.diff(ends[last - 1], prepend=0)


def cuts(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(sorted_keys):
        edge = np.flatnonzero(np.diff(sorted_keys)) + 1
        for a, b in zip(np.append(0, edge), np.append(edge, len(sorted_keys))):
            yield int(sorted_keys[a]), int(a), int(b)


def joined(column, kind) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def bits_of_repeats(table: pa.Table) -> pa.Table:
    """One bucket: for each group, a bit for each of its rests, set if the bucket has it twice."""
    rest = joined(table["rests"], np.uint32)
    order = np.argsort(rest)
    s = rest[order]
    same = s[1:] == s[:-1]
    flag = np.zeros(len(rest), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    sizes = [len(x.as_buffer()) // 4 for x in table["rests"]]
    gs, bits, at = [], [], 0
    for g, size in zip(table["g"].to_pylist(), sizes):
        if flag[at : at + size].any():
            gs.append(g)
            bits.append(np.packbits(flag[at : at + size]).tobytes())
        at += size
    return pa.table({"g": pa.array(gs, pa.int32()), "bucket": pa.array([table["bucket"][0].as_py()] * len(gs), pa.int32()), "bits": pa.array(bits, pa.binary())})


Resolve = Callable[[dict], np.ndarray]


def repeated(docs: DataFrame, shape_of: Callable[[int], Shape], resolve: Resolve, finish, schema: str, group_mb: float = 1.5) -> DataFrame:
    """``finish(group table, Group, row, start, end)`` makes the rows of one group from the marked spans of units.

    ``docs`` has doc_id and text.  ``resolve`` gets the super-k-mers of one bucket (data, length,
    row, start, count, doc, rest) and gives, for each of them, the mask over its windows, one after
    another.
    """
    n = common.groups_for(docs, group_mb)
    shape = shape_of(n)
    grouped = docs.withColumn("g", common.doc_group(n)).select("g", "doc_id", "text")

    def anchors(table: pa.Table) -> pa.Table:
        group = Group(ordered(table), shape)
        _, _, bucket, rest = group.keyed(shape)
        bucket, rest = bucket[group.sent], rest[group.sent]
        found = [(k, rest[a:b].tobytes()) for k, a, b in cuts(bucket)]
        g = table["g"][0].as_py()
        return pa.table({"bucket": pa.array([k for k, _ in found], pa.int32()), "g": pa.array([g] * len(found), pa.int32()), "rests": pa.array([x for _, x in found], pa.binary())})

    def travel(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ("bucket", "g", "n", "raw", "packed")}
        if len(left) and (len(right) or shape.inside):
            table = ordered(left)
            group = Group(table, shape)
            start, count, bucket, rest = group.keyed(shape)
            bits = dict(zip(right["bucket"].to_pylist(), right["bits"].to_pylist()))
            go = np.flatnonzero(group.flagged(bucket, bits) | group.twice)
            start, count, bucket, rest = start[go], count[go], bucket[go], rest[go]
            doc = table["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
            row = np.searchsorted(group.rows, start, side="right") - 1
            text, length = group.packed(shape, start, count)
            at = np.cumsum(length) - length
            first = first_equal(text, at, length, spans_hash(text, at, at + length), np.argsort(doc[row], kind="stable"))
            if shape.inside:
                alone = np.bincount(first, minlength=len(first))[first] == 1
                state = np.where(alone, ASK, np.where(first == np.arange(len(first)), KNOWN, SETTLED))
            else:
                state = np.where(doc[row] > doc[row[first]], SETTLED, ASK)
            text = text[np.repeat(state != SETTLED, length)]
            length = np.where(state != SETTLED, length, 0)
            edge = np.append(0, np.cumsum(length))
            fields = {"length": length, "row": row, "start": start - group.rows[row], "count": count, "doc": doc[row], "rest": rest, "state": state}
            g = left["g"][0].as_py()
            for k, a, b in cuts(bucket):
                raw = b"".join((text[edge[a] : edge[b]] if name == "text" else fields[name][a:b]).astype(kind).tobytes() for name, kind in FIELDS)
                out["bucket"].append(k)
                out["g"].append(g)
                out["n"].append(b - a)
                out["raw"].append(len(raw))
                out["packed"].append(squeeze(raw))
        return pa.table({k: pa.array(v, pa.binary() if k == "packed" else pa.int32()) for k, v in out.items()})

    def answer(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_numpy()
        parts: dict[str, list[np.ndarray]] = {name: [] for name, _ in FIELDS}
        for n_items, raw, packed in zip(sizes, table["raw"].to_pylist(), table["packed"]):
            at, blob = 0, expand(packed.as_buffer(), raw)
            for name, kind in FIELDS:
                x = np.frombuffer(blob, kind, -1 if name == "text" else n_items, at)
                at += x.nbytes
                parts[name].append(x if name in ("text", "rest", "state") else x.astype(np.int64))
        have = {name: np.concatenate(x) for name, x in parts.items()}
        ask = have["state"] != SETTLED
        mask = np.repeat(have["state"] != ASK, have["count"])
        mask[np.repeat(ask, have["count"])] |= resolve({name: x if name == "text" else x[ask] for name, x in have.items()})
        first = np.cumsum(have["count"]) - have["count"]
        head = mask.copy()
        inner = np.ones(len(mask), bool)
        inner[first] = False
        head[1:] &= ~(mask[:-1] & inner[1:])
        tail = mask.copy()
        tail[:-1] &= ~(mask[1:] & inner[1:])
        a, b = np.flatnonzero(head), np.flatnonzero(tail)
        item = np.searchsorted(first, a, side="right") - 1
        offset = have["start"][item] - first[item]
        source = np.repeat(np.arange(len(sizes)), sizes)[item]
        spans = np.stack([have["row"][item], a + offset, b + offset + shape.window], axis=1).astype(np.int32)
        gs, out = table["g"].to_pylist(), []
        found = [(gs[k], spans[x:y].tobytes()) for k, x, y in cuts(source)]
        return pa.table({"g": pa.array([g for g, _ in found], pa.int32()), "spans": pa.array([x for _, x in found], pa.binary())})

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        table = ordered(left)
        spans = joined(right["spans"], np.int32).reshape(-1, 3).astype(np.int64)
        return finish(table, spans[:, 0], spans[:, 1], spans[:, 2])

    first = grouped.groupBy("g").applyInArrow(anchors, "bucket int, g int, rests binary")
    again = first.groupBy("bucket").applyInArrow(bits_of_repeats, "g int, bucket int, bits binary")
    moved = grouped.groupBy("g").cogroup(again.groupBy("g")).applyInArrow(travel, "bucket int, g int, n int, raw int, packed binary")
    spans = moved.groupBy("bucket").applyInArrow(answer, "g int, spans binary")
    return grouped.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(mark, schema)
