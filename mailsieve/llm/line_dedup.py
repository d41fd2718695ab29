"""Line dedup by winnowing over line hashes.

A document is its sequence of non-blank lines.

1. Select: of every ``min_lines`` consecutive lines the one with the smallest hash is a fingerprint, so any
   shared run of that many lines has a fingerprint in common; a line of ``min_words`` words or more is
   one too.  Only selected lines go on, each once, with hashes of the runs around it.
2. Join: positions meet on fingerprints that occur at least twice.
3. Extend: around such a position the runs of ``min_lines`` lines that it is the smallest of are compared, to its
   left and to its right; overlapping runs chain, which extends a match both ways as far as it goes.
4. Delete: of equal runs all but the first, by document id and line, go.

No pairs of positions are made: each run meets its first occurrence only.  First occurrences come from
sums made before the shuffle, and fingerprints or runs that are everywhere are broadcast (see ``by_key``).
Equal lines have two equal hashes of 64 bits, by different seeds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textkit import U64, Words, flat, mix, pieces, row_of, sliding_min, spans_hash, starts_inside, window_hash

MIN_LINES, MIN_WORDS = 2, 8
NEWLINE = 0x0A


class Lines:
    """All lines of a batch, and which of them are not blank (stripped of white space)."""

    def __init__(self, column):
        self.data, self.offsets = flat(column)
        data, off = self.data, self.offsets
        breaks = np.flatnonzero(data == NEWLINE)
        # a line starts at each row's start and after each newline
        self.start = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
        row_breaks = np.searchsorted(breaks, off)
        self.lines = np.append(0, np.cumsum(np.diff(row_breaks) + 1))  # offsets of rows in lines
        end = np.empty(len(self.start), np.int64)
        end[:-1] = self.start[1:] - 1
        if len(end):
            end[self.lines[1:] - 1] = off[1:]
        self.end = end
        w = Words(data, off)
        self.words = np.searchsorted(w.start, self.end) - np.searchsorted(w.start, self.start)
        self.full = np.flatnonzero(self.words > 0)
        first = np.searchsorted(w.start, self.start[self.full])
        self.a, self.b = w.start[first], w.end[first + self.words[self.full] - 1]
        self.units = np.searchsorted(self.full, self.lines)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return spans_hash(self.data, self.a, self.b, seed)


def selected(lines: Lines, min_lines: int, min_words: int):
    """(position, offsets of its runs, first unit of each run, its units, its hash) of every selected line."""
    h, other = lines.hashes(), lines.hashes(1)
    start = np.flatnonzero(starts_inside(lines.units, min_lines))
    if len(start):
        low = sliding_min(h, min_lines)[start]
        at = start.copy()
        for k in range(min_lines - 1, -1, -1):  # the leftmost of the smallest
            at[h[start + k] == low] = (start + k)[h[start + k] == low]
        run = window_hash(other, min_lines)[start]
    else:
        at, run = start, h[:0]
    long = np.flatnonzero(lines.words[lines.full] >= min_words)
    mark, begin = np.concatenate([at, long]), np.concatenate([start, long])
    size = np.concatenate([np.full(len(start), min_lines), np.ones(len(long), np.int64)])
    key = np.concatenate([run, mix(other[long] + U64(1))])
    order = np.argsort(mark, kind="stable")
    mark, begin, size, key = mark[order], begin[order], size[order], key[order]
    head = np.flatnonzero(np.diff(mark, prepend=-1))
    return mark[head], np.append(head, len(mark)), begin, size, key, h


def _emit(min_lines: int, min_words: int):
    def run(batches):
        for b in pieces(batches, 1):
            lines = Lines(b.column(1))
            mark, edge, begin, size, key, h = selected(lines, min_lines, min_words)
            row = row_of(lines.units)[mark]
            first = lines.units[np.repeat(row, np.diff(edge))]
            runs = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array((begin - first).astype(np.int32)), pa.array(size.astype(np.int32))], ["run", "at", "n"])
            yield pa.RecordBatch.from_pydict({"mark": pa.array(h[mark].view(np.int64)), "id": b.column(0).take(pa.array(row)), "th": b.column(2).take(pa.array(row)), "runs": pa.ListArray.from_arrays(pa.array(edge, pa.int32()), runs)})

    return run


def _cut(columns: list[str], text_col: str, spans_col: str):
    def run(batches):
        for b in pieces(batches, text_col):
            names = b.schema.names
            text = b.column(names.index(text_col))
            lines = Lines(text)
            gone = np.zeros(len(lines.full) + 1, np.int64)
            spans = b.column(names.index(spans_col))
            size = np.diff(spans.offsets.to_numpy()) if len(spans) else np.zeros(0, np.int64)
            flat_spans = spans.flatten()
            at, n = flat_spans.field(0).to_numpy().astype(np.int64), flat_spans.field(1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(spans)), np.array([0 if x is None else x for x in pa.compute.list_value_length(spans).to_pylist()], np.int64) if len(spans) else size)
            np.add.at(gone, lines.units[row] + at, 1)
            np.add.at(gone, lines.units[row] + at + n, -1)
            gone = np.cumsum(gone)[:-1] > 0
            drop = np.zeros(len(lines.start), bool)
            drop[lines.full[gone]] = True
            out, removed = [], np.add.reduceat(np.append(drop, False).astype(np.int64), lines.lines[:-1]) if len(spans) else []
            valid = text.is_valid().to_numpy(zero_copy_only=False)
            for r in range(len(spans)):
                a, z = lines.offsets[r], lines.offsets[r + 1]
                if not valid[r]:
                    out.append(None)
                elif not removed[r]:
                    out.append(lines.data[a:z].tobytes().decode())
                else:
                    keep = [lines.data[s:e].tobytes() for s, e, d in zip(lines.start[lines.lines[r] : lines.lines[r + 1]], lines.end[lines.lines[r] : lines.lines[r + 1]], drop[lines.lines[r] : lines.lines[r + 1]]) if not d]
                    out.append(b"\n".join(keep).decode())
            cols = {c: b.column(names.index(c)) for c in columns} | {text_col: pa.array(out, pa.string())}
            yield pa.RecordBatch.from_pydict(cols | {"n_lines": pa.array(np.diff(lines.units), pa.int64()), "n_removed": pa.array(np.asarray(removed, np.int64))})

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs of lines cut from the text, and n_lines (not blank) and n_removed.

    Lines end at newlines and are compared without white space at their ends.  A line goes if it is in a run
    of ``min_lines`` consecutive non-blank lines, or alone has ``min_words`` words, and the same run
    or line occurs earlier: in a smaller id, or higher up in the same text.  Texts that lose nothing
    are unchanged; blank lines stay; a text can become empty, and one of any length is taken whole.  Null ids
    come last.  Rows with one id are ordered by a hash of their text; rows equal in id and text count as one
    place.  Null stays null.  Other columns pass through whatever their names; n_lines and n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    text = F.col(text_col).cast("string")
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    rows = common.cut(base.mapInArrow(_emit(min_lines, min_words), f"mark long, id {kind}, th long, runs array<struct<run:long,at:int,n:int>>"))
    marks = rows.groupBy("mark").agg(F.count("*").alias("c")).where("c > 1")
    met = common.by_key(rows, marks, ["mark"], "c", rows.count())
    place = F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("i"), F.col("th").alias("t"), F.col("at").alias("a"))
    met = common.cut(met.select("mark", "id", "th", F.inline("runs")).select("mark", "run", "n", place.alias("place")))
    first = met.groupBy("mark", "run").agg(F.min("place").alias("first"), F.count("*").alias("c")).where("c > 1")
    later = common.by_key(met, first, ["mark", "run"], "c", met.count()).where("not (place <=> first)")
    i, t, spans, h = (common.fresh(x, docs.columns) for x in ("span_id", "span_hash", "spans", "text_hash"))
    cuts = later.groupBy(F.col("place.i").alias(i), F.col("place.t").alias(t)).agg(F.collect_set(F.struct("place.a", "n")).alias(spans))
    keyed = docs.withColumn(h, F.xxhash64(text)).withColumn(text_col, text)
    out = keyed.join(cuts, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(h) == F.col(t)), "left")
    none = F.array().cast("array<struct<a:int,n:int>>")
    schema = keyed.select(*docs.columns).schema.add("n_lines", "long").add("n_removed", "long")
    return out.select(*docs.columns, F.coalesce(spans, none).alias(spans)).mapInArrow(_cut(docs.columns, text_col, spans), schema)


def query(spark, sf_dir: str) -> DataFrame:
    done = dedup(common.read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated lines; those left without any line go."""
    out = dedup(docs)
    return out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))).select(*docs.columns)


SPACES = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
ORACLE_BODY = f"""
  SELECT doc_id, line, raw_pos, row_number() OVER (PARTITION BY doc_id ORDER BY raw_pos) AS pos,
         len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS words
  FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), {SPACES}) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS raw_pos FROM {{table}} WHERE text IS NOT NULL)
  WHERE line <> ''
"""
ORACLE = f"""
WITH l AS ({ORACLE_BODY.format(table="documents")}),
p AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM l),
r AS (
  SELECT doc_id, pos, 2 AS n, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, pos) AS k FROM p WHERE next IS NOT NULL
  UNION ALL
  SELECT doc_id, pos, 1, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) FROM p WHERE words >= 8
),
gone AS (SELECT DISTINCT doc_id, pos + unnest(range(n)) AS pos FROM r WHERE k > 1),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS raw_pos FROM documents WHERE text IS NOT NULL),
kept AS (
  SELECT raw.doc_id, string_agg(raw.line, chr(10) ORDER BY raw.raw_pos) AS text
  FROM raw LEFT JOIN l ON raw.doc_id = l.doc_id AND raw.raw_pos = l.raw_pos
  LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos
  WHERE gone.pos IS NULL GROUP BY raw.doc_id
)
SELECT d.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id) n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
