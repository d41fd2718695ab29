"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased and everything but letters becomes one separator.  The n-grams of one to three
characters are hashed; a text's value for an n-gram is its share among the text's n-grams times
the inverse document frequency, counted over all training documents, times a constant.  Weights are fitted by
follow-the-regularised-leader with elastic-net penalties, then a temperature is fitted on examples kept
aside.  A logit is linear in those values, so a text of any length is scored by one gather and sum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .textkit import pieces

SLOTS, ORDERS, PER_LANG, FIT_DOCS, LEAST, EPOCHS, SCALE = 1 << 15, (1, 2, 3), 600, 12_000, 20, 4, 20.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5
U = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point: itself if it is a letter, else the separator."""
    return np.array([c if (c < 0xD800 or c > 0xDFFF) and chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


def grams(column) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Slots of the n-grams of every order, the offsets of the rows in them, and whether a row has letters."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = [(x or "").lower() for x in column.to_pylist()]
    code = letter_table()[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)] if texts else np.zeros(0, np.uint32)
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    # runs of separators count once; each row ends with one
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (row[1:] != row[:-1])
    code, row = code[keep].astype(np.uint64), row[keep]
    letters = np.bincount(row[code != 32], minlength=len(texts)) > 0
    slots, offsets = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(code) - n + 1
        h = h[: max(m, 0)] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(1) if m > 0 else h[:0]
        if n in ORDERS:
            same = row[: max(m, 0)] == row[n - 1 :] if m > 0 else np.zeros(0, bool)
            k = h[same] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * n)
            slots.append((k >> np.uint64(64 - int(math.log2(SLOTS)))).astype(np.int32))
            offsets.append(np.searchsorted(row[: len(same)][same], np.arange(len(texts) + 1)))
    return slots, offsets, letters


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # slots x langs: weight times inverse document frequency
    bias: np.ndarray
    temperature: float

    def logits(self, column) -> tuple[np.ndarray, np.ndarray]:
        slots, offsets, letters = grams(column)
        out = np.zeros((len(letters), len(self.langs)))
        total = np.zeros(len(letters))
        for s, o in zip(slots, offsets):
            n = np.diff(o)
            some = np.flatnonzero(n)
            if len(some):
                for c in range(len(self.langs)):
                    out[some, c] += np.add.reduceat(self.table[c][s], o[:-1][some])
            total += n
        return out / np.maximum(total, 1)[:, None] + self.bias, letters

    def predict(self, column) -> tuple[list[str], list[float]]:
        z, letters = self.logits(column)
        z = z / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        z = z / z.sum(axis=1, keepdims=True) if len(z) else z
        best = z.argmax(axis=1) if len(z) else []
        return [self.langs[b] if ok else U for b, ok in zip(best, letters)], [float(z[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, letters))]


def counted(batches):
    """(id, lang, slots, counts): the n-grams of every row, so that no text leaves its executor."""
    for b in pieces(batches, 1):
        slots, offsets, letters = grams(b.column(1))
        each = [np.unique(np.concatenate([x[o[r] : o[r + 1]] for x, o in zip(slots, offsets)]), return_counts=True) for r in range(len(letters))]
        edge = pa.array(np.cumsum([0, *(len(s) for s, _ in each)]), pa.int32())
        lists = [pa.ListArray.from_arrays(edge, pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int32())) for x in ([s for s, _ in each], [n for _, n in each])]
        yield pa.RecordBatch.from_pydict({"id": b.column(0), "lang": b.column(2), "slots": lists[0], "counts": lists[1]})


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes x slots) and bias, by follow-the-regularised-leader with L1 and L2 penalties."""
    z, n = np.zeros((classes, SLOTS)), np.zeros((classes, SLOTS))
    zb, nb = np.zeros(classes), np.zeros(classes)
    rng = np.random.default_rng(seed)

    def leader(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            s, v = rows[i]
            zs, ns = z[:, s], n[:, s]
            w, b = leader(zs, ns, L1), leader(zb, nb, 0.0)
            p = w @ v + b
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = p[:, None] * v
            z[:, s] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[:, s] = ns + g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA * b
            nb += p * p
    return leader(z, n, L1), leader(zb, nb, 0.0)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least loss, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        x = logits / math.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(y)), y]).mean())

    a, b, r = -4.0, 4.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def fit(train: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = PER_LANG, fit_docs: int = FIT_DOCS) -> Model | None:
    """Fit on the rows of ``train``.

    Document frequencies are counted over all of them; the weights are fitted on about ``per_lang`` documents of
    each language, or fit_docs / languages if that is less, but LEAST at least: those whose hashed id is lowest, a
    fifth of them kept aside for the temperature.  The driver holds these documents' n-gram counts and two weights
    a slot and language; there is no cap on languages.
    """
    rows = train.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def count(batches):
        df, n = np.zeros(SLOTS, np.int64), 0
        for b in pieces(batches, 0):
            slots, offsets, letters = grams(b.column(0))
            n += int(letters.sum())
            for a in range(0, len(letters), 64):
                z = min(len(letters), a + 64)
                seen = np.zeros((z - a, SLOTS), bool)
                for s, o in zip(slots, offsets):
                    seen[np.repeat(np.arange(z - a), np.diff(o[a : z + 1])), s[o[a] : o[z]]] = True
                df += seen.sum(axis=0)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(np.append(at, -1).astype(np.int32)), "df": pa.array(np.append(df[at], n))})

    counts = {r.slot: r.df for r in rows.select("text").mapInArrow(count, "slot int, df long").groupBy("slot").agg(F.sum("df").alias("df")).collect()}
    docs = counts.pop(-1, 0)
    df = np.zeros(SLOTS)
    df[list(counts)] = list(counts.values())
    idf = np.log((1 + docs) / (1 + df)) + 1
    sizes = rows.groupBy("lang").count().toArrow()
    if not len(sizes) or not docs:
        return None
    per = min(per_lang, max(LEAST, fit_docs // len(sizes)))
    share = F.broadcast(train.sparkSession.createDataFrame(sizes).select(F.col("lang").alias("of"), (F.lit(float(per)) / F.col("count")).alias("share")))
    unit = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(2**53))
    picked = rows.join(share, F.col("lang") == F.col("of")).where(unit < F.col("share")).select("id", "text", "lang")
    sample = picked.mapInArrow(counted, f"id {dict(rows.dtypes)['id']}, lang string, slots array<int>, counts array<int>").orderBy("id", "lang", "slots").limit(4 * per * len(sizes)).toArrow()
    langs = sorted(set(sample["lang"].to_pylist()))
    if not langs:
        return None
    y = np.searchsorted(langs, sample["lang"].to_pylist())
    slots, n = (sample[c].combine_chunks() for c in ("slots", "counts"))
    x = []
    for r in range(len(sample)):
        s, c = slots[r].values.to_numpy(), n[r].values.to_numpy()
        x.append((s, c * (SCALE / max(1, c.sum())) * idf[s]))
    aside = np.arange(len(y)) % 5 == 4
    w, b = ftrl([v for v, a in zip(x, aside) if not a], y[~aside], len(langs))
    model = Model(langs, (w * idf * SCALE).astype(np.float64), b, 1.0)
    kept = [(v, k) for v, k, a in zip(x, y, aside) if a and len(v[0])]
    if kept:
        model.temperature = temperature(np.array([w[:, s] @ v + b for (s, v), _ in kept]), np.array([k for _, k in kept]))
    return model


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of ``docs``.

    Rows whose crc32 of the id as text is 2 modulo 4 are held out; the others with a language are
    learned from.  Language and id are no inputs of a prediction.  Texts that are null or have no
    letters are 'und' with score 0, and so is all if there is nothing to learn from; texts of any length are
    taken whole.  A null id is not held out and not learned from.  Repeated rows count each; other columns are
    not looked at, whatever their names.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()), id_col, text_col, lang_col, per_lang)
    base = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return base.select("doc_id", "held_out", F.lit(U).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in pieces(batches, 2):
            lang, score = shared.value.predict(b.column(2))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "held_out": b.column(1), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    return base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
