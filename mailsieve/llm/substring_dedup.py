"""Substring dedup: words covered by a window that is repeated anywhere are removed.

Super-k-mer partitioning: consecutive windows that share a minimiser travel as one packed string
to the minimiser's bucket, where sorting counts the windows exactly: words are numbered by their
bytes, and windows with one hash are compared number by number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .superk import Shape, repeated
from .textkit import U64, Words, cover, first_equal, flat, mix, slices, starts_inside, window_hash

WINDOW, GRAM = 35, 10


def _counts(have: dict, window: int) -> np.ndarray:
    """Mask over the windows of one bucket: the sequence starts at least twice here."""
    w = Words(have["text"], np.append(0, np.cumsum(have["length"])))
    number = first_equal(w.data, w.start, w.end - w.start, w.hashes())
    at = np.flatnonzero(starts_inside(w.rows, window))
    h = window_hash(mix(number.astype(np.uint64) + U64(1)), window)[at]
    order = np.argsort(h, kind="stable")
    pair = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    one, two = order[pair], order[pair + 1]
    equal = np.ones(len(pair), bool)
    for k in range(window):
        equal &= number[at[one] + k] == number[at[two] + k]
    out = np.zeros(len(at), bool)
    out[one[equal]] = True
    out[two[equal]] = True
    if not equal.all():  # different windows with one hash are told apart one by one
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(h, h[one[~equal]])):
            j = seen.setdefault(number[at[i] : at[i] + window].tobytes(), i)
            if j != i:
                out[i] = out[j] = True
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group_mb: float = 1.5) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept), one for each row of ``docs``.

    A word goes if it is covered by a window of ``window`` consecutive words whose word sequence also
    starts at another place of the corpus, the same document included.  Null and blank texts have no
    words and keep the empty string; texts under one window are kept; repeated rows count as
    different places; a null id is an id like others; other columns are not looked at.
    """
    if gram > window:
        raise ValueError("gram must not exceed window")

    def finish(table: pa.Table, row, start, end) -> pa.Table:
        w = Words(*flat(table["text"]))
        gone = cover(len(w.start), w.rows[row] + start, w.rows[row] + end)
        kept, n_words, n_removed = [], np.diff(w.rows), []
        total = np.append(0, np.cumsum(gone))
        n_removed = total[w.rows[1:]] - total[w.rows[:-1]]
        stay = np.flatnonzero(~gone)
        size = (w.end - w.start)[stay] + 1
        data = slices(np.append(w.data, np.uint8(32)), w.start[stay], size)
        ends = np.cumsum(size)
        data[ends - 1] = 32
        left = np.append(0, np.cumsum(n_words - n_removed))
        edge = np.append(0, ends)[left]
        kept = [data[a : max(a, b - 1)].tobytes().decode("utf-8") for a, b in zip(edge[:-1], edge[1:])]
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return repeated(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")),
        lambda buckets: Shape("word", window, gram, buckets, inside=True),
        lambda have: _counts(have, window),
        finish,
        "doc_id long, n_words long, n_removed long, kept string",
        group_mb,
    )


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
t AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
win AS (
  SELECT r, i, word, string_agg(word, ' ') OVER ahead AS s, count(*) OVER ahead AS n FROM t
  WINDOW ahead AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)
),
flagged AS (SELECT r, i, word, CASE WHEN n = {WINDOW} AND count(*) OVER (PARTITION BY s) > 1 THEN 1 ELSE 0 END AS again FROM win),
marked AS (SELECT r, i, word, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM flagged),
done AS (SELECT r, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY r)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN done ON d.r = done.r
"""


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
