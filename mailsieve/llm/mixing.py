"""Mixing sources to target weights by Pfair scheduling.

Every source's documents form blocks.  Block k of a source with weight w is released at slot
floor(k / w) and due at ceil((k + 1) / w); each slot takes the released block with the earliest
deadline.  On one processor that meets every deadline, so at any slot a source has had its share
to within less than one block.  Weights are exact whole numbers over their sum, so nothing adds up
over the run.  The driver deals the slots of all blocks, a block at a time; rows look theirs up.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read

BLOCK, ALPHA, BUCKET_ROWS, CHUNK, SMALL_BLOCKS = 8, 0.5, 256, 256, 4_000_000


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole slots of one period for each source: the nearest by largest remainders, but at least one for each."""
    weights = {k: w for k, w in weights.items() if w > 0}
    if len(weights) > period:
        raise ValueError("more sources than slots in a period: raise the period")
    parts, out, free = whole(weights), {}, period
    while True:  # sources below one slot get one, the others share the rest
        total = sum(parts.values())
        tiny = [k for k, w in parts.items() if w * free < total]
        if not tiny:
            break
        out |= dict.fromkeys(tiny, 1)
        free -= len(tiny)
        parts = {k: w for k, w in parts.items() if k not in out}
    out |= {k: w * free // total for k, w in parts.items()}
    for k in sorted(parts, key=lambda k: (-(parts[k] * free % total), k))[: period - sum(out.values())]:
        out[k] += 1
    return out


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = {k: Fraction(w) for k, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    return {k: int(x * scale) for k, x in exact.items()}


def deal(parts: list[int], counts: list[int], block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(source, number in its source, slot) of every block in slot order, and the first slot at which a source lacks a full block.

    Earliest deadline first among released blocks.  A source that has run out leaves its next slot
    empty and takes no more; the other blocks keep their releases and deadlines.
    """
    total = sum(parts)
    waiting = [(0, i, 0) for i in range(len(parts))]  # release, source, block
    ready: list[tuple[int, int, int]] = []
    source, number, slots = array("i"), array("q"), array("q")
    t, short = 0, -1
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // parts[i]), i, k))
        deadline, i, k = heapq.heappop(ready)
        assert deadline > t, "a deadline was missed"
        if short < 0 and (k + 1) * block > counts[i]:
            short = t
        if k * block < counts[i]:
            source.append(i)
            number.append(k)
            slots.append(t)
            heapq.heappush(waiting, ((k + 1) * total // parts[i], i, k + 1))
        t += 1
    return np.array(source, np.int32), np.array(number, np.int64), np.array(slots, np.int64), max(short, 0)


def one_period(share: dict[str, int], period: int) -> list[str]:
    """The source of every slot of a period in which each source has its share of blocks."""
    names = sorted(share)
    source, _, slots, _ = deal([share[k] for k in names], [share[k] for k in names], 1)
    assert np.array_equal(slots, np.arange(period))
    return [names[i] for i in source]


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", period: int | None = None, block: int = BLOCK, alpha: float = ALPHA) -> DataFrame:
    """``docs`` with mix_slot, mix_position (from 0, without gaps) and mix_on_target.

    Without ``weights``, a source weighs its count to the power ``alpha``; there may be any number of
    sources.  With a ``period`` the weights are rounded to whole slots of it.  No row is dropped: when a
    source has run out, its share of the slots stays empty and the others go on at their pace;
    mix_on_target is true up to the first slot at which some source had no full block left.  Rows of a source without
    a weight (or with one of 0) come after all others, in its own order, with a null slot.  Inside
    a source the order is by a hash of the id, then the id, then a hash of the row's text columns, so
    repeated rows tie and may swap.  A null source is a source named ''.  Columns named mix_slot,
    mix_position and mix_on_target are replaced; all others pass through whatever their names.  Texts of any
    length are taken whole.  An empty table stays empty.  A task gathers about the root of the number of rows.
    """
    docs = docs.drop("mix_slot", "mix_position", "mix_on_target")
    tie = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c, kind in docs.dtypes if kind in ("string", "bigint", "int")] or [F.lit(0)])
    # the row travels as one value, so its columns' names clash with none below
    base = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.xxhash64(F.col(id_col), F.lit(7)).alias("key"), F.col(id_col).alias("id"), tie.alias("tie"))
    per = {r[0]: r[1] for r in base.groupBy("source").count().collect()}
    if weights is None:
        weights = {k: n**alpha for k, n in per.items()}
    weights = {k: w for k, w in weights.items() if w > 0 and per.get(k)}
    names = sorted(weights)
    counts = [per[k] for k in names]
    parts = shares(weights, period) if period and names else whole(weights)
    spark = docs.sparkSession
    rows = sum(per.values())
    width = min(40, max(0, math.ceil(math.log2(max(1, rows / max(BUCKET_ROWS, math.isqrt(rows)))))))
    keyed = base.withColumn("bucket", F.shiftrightunsigned("key", 64 - width) if width else F.lit(0).cast("long"))
    sizes = keyed.groupBy("source", "bucket").count()
    before = sizes.select(F.col("source").alias("s0"), F.col("bucket").alias("b0"), (F.sum("count").over(Window.partitionBy("source").orderBy("bucket")) - F.col("count")).alias("before"))
    ranked = keyed.withColumn("nr", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("key", "id", "tie")))
    ranked = ranked.join(before, (F.col("source") == F.col("s0")) & (F.col("bucket") == F.col("b0"))).select("row", "source", (F.col("before") + F.col("nr") - 1).alias("index"))
    if not names:
        return ranked.select("row.*", F.lit(None).cast("long").alias("mix_slot"), F.lit(None).cast("long").alias("mix_position"), F.lit(False).alias("mix_on_target"))
    source, number, slots, short = deal([parts[k] for k in names], counts, block)
    held = np.minimum(block, np.array(counts)[source] - number * block)
    # rows of CHUNK blocks of a source, packed
    order = np.lexsort((number, source))
    at = np.flatnonzero(number[order] % CHUNK == 0)
    edge = pa.array(np.append(at, len(order)), pa.int32())
    packed = {c: pa.ListArray.from_arrays(edge, pa.array(x[order])) for c, x in (("slots", slots), ("starts", np.cumsum(held) - held))}
    small = spark.createDataFrame(pa.table({"s1": pa.array([names[i] for i in source[order][at]], pa.string()), "k1": number[order][at] // CHUNK} | packed))
    if len(source) <= SMALL_BLOCKS:
        small = F.broadcast(small)
    nth = F.floor(F.col("index") / F.lit(block)).cast("long")
    out = ranked.join(small, (F.col("source") == F.col("s1")) & (F.floor(nth / F.lit(CHUNK)).cast("long") == F.col("k1")), "left")
    place = (nth % CHUNK + 1).cast("int")
    slot, position = F.element_at("slots", place), F.element_at("starts", place) + F.col("index") % block
    return out.select("row.*", slot.alias("mix_slot"), position.alias("mix_position"), F.coalesce(slot < short, F.lit(False)).alias("mix_on_target"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "mix_slot", "mix_position", "mix_on_target")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its slot and position."""
    return mix(docs)
