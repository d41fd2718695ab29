"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

One weight vector w serves all thresholds: P(grade > k) = sigmoid(w.x - t_k) with t_0 < t_1 < ...
Features are the distinct words of the whole text (A-Z lower-cased, split at white space and ASCII
punctuation) and the first bytes of the longer ones, so that a word counts in all its forms; all are hashed.  An L1 penalty that falls with the root of the number of examples, applied by proximal steps, keeps the weights of ordinary words
at zero.  The expected severity is the sum of P(grade > k) over the thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, read
from .decontaminate import GAP
from .textkit import U64, Words, flat, mix, pieces, row_of, spans_hash

SLOTS, MAX_FIT, STEPS, L1, L2, REJECT = 1 << 20, 8_000, 300, 0.0165, 1e-5, 0.5
STEMS, LEAST_DOCS, PRUNE = (5, 7), 3, 60


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the distinct words and stems of each row, and the offsets of the rows."""
    w = Words(*flat(column), lower=True, gap=GAP)
    row, shift = row_of(w.rows) * SLOTS, U64(64 - (SLOTS.bit_length() - 1))
    key = [row + (mix(w.hashes()) >> shift).astype(np.int64)]
    for size in STEMS:
        at = np.flatnonzero(w.end - w.start > size)
        key.append(row[at] + (mix(spans_hash(w.data, w.start[at], w.start[at] + size, 1) + U64(size)) >> shift).astype(np.int64))
    key = np.unique(np.concatenate(key))
    return key % SLOTS, np.searchsorted(key, np.arange(len(w.rows)) * SLOTS)


def sums(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out, some = np.zeros(len(offsets) - 1), np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(value, offsets[:-1][some])
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray  # of the slots, the rest is zero
    thresholds: np.ndarray

    def severity(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity and most likely grade of each row."""
        slot, off = features(column)
        table = np.zeros(SLOTS)
        table[self.slots] = self.weights
        above = sigmoid(sums(table[slot], off)[:, None] - self.thresholds)
        at = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
        return above.sum(axis=1), (at[:, :-1] - at[:, 1:]).argmax(axis=1)


def fit_arrays(slot: np.ndarray, off: np.ndarray, grade: np.ndarray, steps: int = STEPS, l1: float = L1, l2: float = L2) -> Model:
    """Penalised maximum likelihood by proximal gradient steps with adaptive scales.

    Every PRUNE steps the features whose weight is zero by then leave, so that later steps are cheap.
    """
    # words of one or two documents can't tell grades apart; small integers keep the driver's share small
    seen = np.bincount(slot, minlength=SLOTS) >= min(LEAST_DOCS, max(1, len(grade) // 20))
    used, often = np.flatnonzero(seen), seen[slot]
    off = np.append(0, np.cumsum(often, dtype=np.int32))[off]
    slot = (np.cumsum(seen, dtype=np.int32) - np.int32(1))[slot[often]]
    del often
    n, k = len(grade), max(1, int(grade.max(initial=0)))
    row = row_of(off).astype(np.int32)
    w = np.zeros(len(used))
    # thresholds as a first one and logarithms of the gaps, which keeps them in order
    share = np.clip([(grade > j).mean() if n else 0.5 for j in range(k)], 1e-4, 1 - 1e-4)
    t = -np.log(share / (1 - share))
    first, gap = t[0], np.log(np.maximum(np.diff(t), 0.05))
    sw, st = np.zeros(len(used)), np.zeros(k)
    for step in range(steps if n else 0):
        if step and step % PRUNE == 0:
            live = w != 0
            stay = live[slot]
            off = np.append(0, np.cumsum(stay))[off]
            slot, row = (np.cumsum(live, dtype=np.int32) - np.int32(1))[slot[stay]], row[stay]
            used, w, sw = used[live], w[live], sw[live]
        t = first + np.append(0.0, np.cumsum(np.exp(gap)))
        above = sigmoid(sums(w[slot], off)[:, None] - t)
        p = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        i = np.arange(n)
        likely = np.maximum(p[i, grade] - p[i, grade + 1], 1e-9)
        slope = p * (1 - p)
        up, down = slope[i, grade] / likely, slope[i, grade + 1] / likely  # of the thresholds below and above the grade
        gs = down - up  # of the loss by the score
        gt = np.zeros((n, k + 2))
        gt[i, grade] += up
        gt[i, grade + 1] -= down
        gt = gt[:, 1:-1].mean(axis=0)
        gw = np.bincount(slot, gs[row], minlength=len(used)) / n + l2 * w
        sw += gw * gw
        rate = 0.5 / np.sqrt(sw + 1e-10)
        w = w - rate * gw
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / np.sqrt(n), 0)
        tail = np.cumsum(gt[::-1])[::-1]
        st += np.append(tail[0], tail[1:] * np.exp(gap)) ** 2
        move = 0.3 / np.sqrt(st + 1e-10)
        first -= move[0] * tail[0]
        gap = np.clip(gap - move[1:] * tail[1:] * np.exp(gap), -3, 3)
    live = w != 0
    return Model(used[live], w[live], first + np.append(0.0, np.cumsum(np.exp(gap))))


def grades(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One grade for each labelled id: 0 clean, 1 toxic, 2 toxic and of low quality; the highest if labelled twice."""
    grade = F.when(F.col("toxic") > 0, F.when(F.col("quality") == 0, 2).otherwise(1)).when(F.col("toxic") == 0, 0)
    return labels.select(F.col(id_col).alias("__id"), grade.alias("__grade")).where("__id is not null and __grade is not null").groupBy("__id").agg(F.max("__grade").alias("__grade"))


def held_out(i):
    """Every fourth document by the hash of its id is no example, so its grade tells how well the model does."""
    return F.coalesce(F.crc32(i.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fit: int = MAX_FIT) -> Model | None:
    """Fit on labelled documents that are not held out, at most about ``max_fit`` of them, those whose hashed id is lowest."""
    graded = grades(labels, id_col).where(~held_out(F.col("__id")))
    n = graded.count()
    unit = F.shiftrightunsigned(F.xxhash64("__id", F.lit(3)), 11) / F.lit(float(2**53))
    picked = graded.where(unit < F.lit(min(1.0, max_fit / max(1, n))))
    # bounded by max_fit rows of an id and a grade
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked.limit(2 * max_fit)), F.col("id") == F.col("__id")).select("id", "__grade", "text")

    def run(batches):
        for b in pieces(batches, 2):
            slot, off = features(b.column(2))
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "grade": b.column(1), "slots": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(slot.astype(np.int32)))})

    kind = dict(rows.dtypes)["id"]
    got = rows.mapInArrow(run, f"id {kind}, grade int, slots array<int>").orderBy("id", "slots").limit(4 * max_fit).toArrow().combine_chunks()
    if not len(got):
        return None
    lists, grade = got["slots"].combine_chunks(), got["grade"].to_numpy().astype(np.int64)
    off = lists.offsets.to_numpy().astype(np.int64)
    slot = lists.flatten().to_numpy()
    del got, lists
    return fit_arrays(slot, off - off[0], grade)


def _score(docs: DataFrame, model: Model | None, text_col: str, keep: list[str]) -> DataFrame:
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("severity"), F.lit(0).alias("grade"))
    shared, text = docs.sparkSession.sparkContext.broadcast(model), fresh("words_of", docs.columns)

    def run(batches):
        for b in pieces(batches, text):
            s, g = shared.value.severity(b.column(b.schema.names.index(text)))
            cols = {c: b.column(i) for i, c in enumerate(b.schema.names) if c in keep}
            yield pa.RecordBatch.from_pydict(cols | {"severity": pa.array(s, pa.float64()), "grade": pa.array(g.astype(np.int32))})

    schema = docs.select(*keep).schema.add("severity", "double").add("grade", "integer")
    return docs.select(*keep, F.col(text_col).cast("string").alias(text)).mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fit: int = MAX_FIT) -> DataFrame:
    """``docs`` with severity (expected grade), grade (most likely), toxic (severity at least 0.5) and held_out.

    Labels of held-out documents (crc32 of the id as text is 2 modulo 4) are not learned from.

    Null and empty texts have no words and get the severity of the thresholds alone.  Without any
    label that meets a document all severities are 0.  Rows are scored on their own, so ties and
    repeated rows score equally; texts of any length are taken whole; columns named severity, grade, toxic
    and held_out are replaced, all others pass through whatever their names.
    """
    keep = [c for c in docs.columns if c not in ("severity", "grade", "toxic", "held_out")]
    return _score(docs, fit(docs, labels, id_col, text_col, max_fit), text_col, keep).withColumns({"toxic": F.col("severity") >= REJECT, "held_out": held_out(F.col(id_col))})


def query(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")).select("doc_id", "severity", "grade", "toxic", "held_out")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return score(docs.select(*docs.columns), read(spark, sf_dir, "labels")).where(~F.col("toxic")).select(*docs.columns)
