"""Vectorised text primitives shared by the operators of this subpackage.

A batch of texts is one UTF-8 byte buffer plus row offsets.  Words are maximal runs of bytes
outside 0x20 and 0x09-0x0D, which never split a multi-byte character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
STEP, JOIN = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
SEEDS = (U64(0x243F6A8885A308D3), U64(0x13198A2E03707345))
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # of the first k bytes of a chunk
LONG = 4096  # bytes from which a span is hashed by the library
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(29)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(32)
    return h


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    a = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = a.buffers()
    off = np.frombuffer(off, np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number; zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of every span.

    Chunks of eight bytes are chained through a bijective finaliser: unlike a polynomial modulo
    2**64, nothing cancels out in texts of a regular structure.
    """
    left = np.asarray(end - start, np.int64)
    h = mix(left.astype(np.uint64) + SEEDS[seed])
    for i in np.flatnonzero(left > LONG):
        h[i] ^= U64(int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little"))
    live = np.flatnonzero((left > 0) & (left <= LONG))
    at, left, eight = np.asarray(start)[live], left[live], chunks(data)
    while len(live):
        h[live] = mix(h[live] ^ (eight[at] & MASK[np.minimum(left, 8)]))
        go = np.flatnonzero(left > 8)
        live, at, left = live[go], at[go] + 8, left[go] - 8
    return h


def gram_hash(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` bytes, by its start."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = chunks(data)
    if size < 8:
        return mix((eight[:n] & MASK[size]) ^ SEEDS[0])
    h = np.full(n, SEEDS[0])
    for at in [*range(0, size - 8, 8), size - 8]:
        h ^= eight[at : at + n]
        h *= STEP
        h ^= h >> U64(31)
    return mix(h)


def window_hash(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` values, by its start: halves are joined and mixed, level by level."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, span = values, 1
    while span * 2 <= size:
        h = mix(h[:-span] * JOIN + (h[span:] ^ U64(span)))
        span *= 2
    return mix(h[:n] * STEP + h[size - span : size - span + n])


def sequence_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values of every span; for short spans."""
    h = mix((end - start).astype(np.uint64) + SEEDS[1])
    live = np.flatnonzero(end > start)
    k = 0
    while len(live):
        h[live] = mix(h[live] * JOIN + values[start[live] + k])
        k += 1
        live = live[start[live] + k < end[live]]
    return h


class Words:
    """Words of a batch: start, end (bytes), offsets by row, 64-bit hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, gap: np.ndarray = SPACE):
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        ink = ~gap[data]
        before = np.zeros(len(data), bool)
        before[1:] = ink[:-1]
        before[edges] = False
        self.start = np.flatnonzero(ink & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = ink[1:]
        after[edges - 1] = False
        self.end = np.flatnonzero(ink & ~after) + 1
        self.rows = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        return spans_hash(self.data, self.start, self.end)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b of one row, joined by one space."""
        d = self.data
        return b" ".join(d[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b]))


def starts_inside(row_offsets: np.ndarray, size: int) -> np.ndarray:
    """Mask over all positions: a run of ``size`` from here stays in its row."""
    n = int(row_offsets[-1])
    left = np.repeat(row_offsets[1:], np.diff(row_offsets)) - np.arange(n)
    return left >= size


def row_of(row_offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(row_offsets) - 1), np.diff(row_offsets))


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive values (len(x) - k + 1 of them)."""
    if len(x) < k:
        return x[:0]
    m, size = x, 1
    while size * 2 <= k:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return m if size == k else np.minimum(m[: len(x) - k + 1], m[k - size : k - size + len(x) - k + 1])


def slices(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices data[start:start+length], one after another."""
    total = int(length.sum())
    if not total:
        return data[:0]
    first = np.cumsum(length) - length
    return data[np.repeat(start - first, length) + np.arange(total)]


def same_bytes(data: np.ndarray, one: np.ndarray, two: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each pair of spans of ``length`` bytes from ``one`` and ``two`` whether their bytes are equal."""
    if not len(length):
        return np.zeros(0, bool)
    wrong = slices(data, one, length) != slices(data, two, length)
    total = np.append(0, np.cumsum(wrong))
    end = np.cumsum(length)
    return total[end] == total[end - length]


def first_equal(data: np.ndarray, start: np.ndarray, length: np.ndarray, h: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """For each span the index of the first one, in ``order``, with the same bytes; ``h`` holds their hashes.

    Hashes only propose: every span is compared with its first by bytes, and where two different spans
    have one hash these are told apart one by one.
    """
    n = len(start)
    order = np.arange(n) if order is None else order
    by = order[np.argsort(h[order], kind="stable")]
    head = np.ones(n, bool)
    head[1:] = h[by[1:]] != h[by[:-1]]
    out = np.empty(n, np.int64)
    out[by] = by[np.maximum.accumulate(np.where(head, np.arange(n), 0))]
    wrong = length != length[out]
    ok = np.flatnonzero(~wrong & (out != np.arange(n)))
    wrong[ok] = ~same_bytes(data, start[ok], start[out[ok]], length[ok])
    if wrong.any():
        seen: dict[bytes, int] = {}
        for i in by[np.isin(h[by], h[wrong])]:
            out[i] = seen.setdefault(data[start[i] : start[i] + length[i]].tobytes(), i)
    return out


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask over n positions covered by the spans [start, end)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:-1]) > 0


def true_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def pieces(batches, column: int | str, size: int = 1_000_000):
    """The record batches cut into slices of about ``size`` bytes of the text column, so that working memory is bounded."""
    for b in batches:
        text = b.column(column if isinstance(column, int) else b.schema.names.index(column))
        total = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        if not len(total):
            yield b
            continue
        a = 0
        while a < len(total):
            done = total[a - 1] if a else 0
            z = max(a + 1, int(np.searchsorted(total, done + size, side="right")))
            yield b.slice(a, z - a)
            a = z
