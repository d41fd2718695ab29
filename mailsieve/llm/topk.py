"""Exact top-k inner products with KD-trees per shard.

Coarse median splits, fitted on a bounded sample, deal all rows into cells; a cell above the size of a
shard is split by a hash of the id, so equal rows fill no task.  The exact bounding box of every cell (at
most MAX_CELLS) is known to all tasks.  Queries first search the shard they lie in; the kth score found there
is propagated, and they travel only to the shards of cells whose box can hold as much.  Each shard
builds one KD-tree: median splits on the widest dimension, tight bounding boxes; best-first traversal
opens boxes by their upper bound (the largest inner product any point of the box can have) and stops below
the kth score.  A task holds one shard and one block of queries, whatever the number of either.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import read
from .textkit import mix

LEAF, MAX_CELLS, FIT_VALUES = 128, 1024, 2_000_000


class Tree:
    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.low, self.high, self.child, self.span = [], [], [], []

        def grow(a: int, b: int) -> int:
            block = points[order[a:b]]
            me = len(self.low)
            low, high = block.min(axis=0), block.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.span.append((a, b))
            self.child.append(None)
            wide = int(np.argmax(high - low)) if len(low) else -1
            if b - a > leaf and wide >= 0 and high[wide] > low[wide]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(block[:, wide], mid)]
                self.child[me] = (grow(a, a + mid), grow(a + mid, b))
            return me

        if len(ids):
            grow(0, len(ids))
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> list[list[tuple[float, int]]]:
        """For each query its best (score, -id), at most k, none below ``floor``; its own id is left out."""
        if not len(self.ids):
            return [[] for _ in own]
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        out = []
        for q, me, bar, bound in zip(queries, own, floor, bounds):
            best: list[tuple[float, int]] = []
            todo = [(-bound[0], 0)]
            while todo:
                up, node = heapq.heappop(todo)
                if -up < bar:
                    break
                if self.child[node]:
                    for c in self.child[node]:
                        if bound[c] >= bar:
                            heapq.heappush(todo, (-bound[c], c))
                    continue
                a, b = self.span[node]
                score = self.points[a:b] @ q
                for i in np.flatnonzero(score >= bar):
                    pair = (score[i], -int(self.ids[a + i]))
                    if -pair[1] == me:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, pair)
                    elif pair > best[0]:
                        heapq.heapreplace(best, pair)
                if len(best) == k:
                    bar = max(bar, best[0][0])
            out.append(best)
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): every component floored to an integer; vectors with a bad component are left out."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    v = F.col(vector_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad)).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))


@dataclass
class Splits:
    """Median splits of the vectors of one length: node i sends values of axis[i] up to cut[i] to the left."""

    axis: list[int]
    cut: list[float]
    kids: list[tuple[int, int]]  # cells are written as ~cell
    cells: int

    def place(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))] if self.axis else []
        while todo:
            node, at = todo.pop()
            left = points[at, self.axis[node]] <= self.cut[node]
            for kid, part in zip(self.kids[node], (at[left], at[~left])):
                if kid < 0:
                    out[part] = ~kid
                elif len(part):
                    todo.append((kid, part))
        return out


def fit(points: np.ndarray, cells: int) -> Splits:
    """Splits into at most ``cells`` cells of about as many sample points each; cells side by side have numbers side by side."""
    out = Splits([], [], [], 0)

    def grow(at: np.ndarray, n: int) -> int:
        block = points[at]
        spread = block.max(axis=0) - block.min(axis=0) if len(at) and block.shape[1] else np.zeros(1)
        if n < 2 or len(at) < 2 or not spread.max() > 0:
            out.cells += 1
            return ~(out.cells - 1)
        wide = int(np.argmax(spread))
        value = np.sort(block[:, wide])
        cut = value[max(0, len(at) * (n // 2) // n - 1)]
        if cut == value[-1]:
            cut = value[np.searchsorted(value, cut) - 1]  # there is a smaller one, as the spread is not 0
        me = len(out.axis)
        out.axis.append(wide)
        out.cut.append(float(cut))
        out.kids.append((0, 0))
        left = block[:, wide] <= cut
        out.kids[me] = (grow(at[left], n // 2), grow(at[~left], n - n // 2))
        return me

    grow(np.arange(len(points)), cells)
    return out


def matrix(batch, name: str, dim: int) -> np.ndarray:
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(batch), dim)


def by_dim(batches, column: str):
    """The rows of the batches, by the length of their vectors."""
    for b in batches:
        dims = b.column(column).to_numpy()
        for d in np.unique(dims):
            yield int(d), b.filter(pa.array(dims == d))


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shard_rows: int = 8192, block_rows: int = 8192, max_cells: int = MAX_CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows, ties to the smaller id.

    Queries are the rows whose id is divisible by ``query_every``.  Rows with a null id, a null vector
    or a null or non-finite component take no part; only vectors of equal length are compared, and empty
    ones score 0; rows that repeat an id are candidates each, but not of a query with that id, and the smallest
    of their vectors is that id's query; other columns are not looked at.  An empty table gives no rows.
    Scores are exact while they stay below 2**53.  The driver holds a sample of FIT_VALUES components and two
    vectors for each of at most ``max_cells`` cells.
    """
    sc = vectors.sparkSession.sparkContext
    rows = usable(vectors, id_col, vector_col, scale).withColumn("dim", F.size("v"))
    sizes = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}  # one cheap pass
    rate = min(1.0, FIT_VALUES / max(1, sum(max(1, d) * n for d, n in sizes.items())))
    unit = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(5)), 11) / F.lit(float(2**53))
    sample = {d: matrix(b, "v", d) for d, b in by_dim([rows.where(unit < rate).select("dim", "v").toArrow()], "dim")}
    total = max(1, sum(sizes.values()))
    splits = {d: fit(sample.get(d, np.zeros((0, d))), max(1, min(-(-n // shard_rows), max_cells * n // total))) for d, n in sizes.items()}
    shared = sc.broadcast(splits)

    def boxes(batches):
        found: dict = {}
        for d, b in by_dim(batches, "dim"):
            points = matrix(b, "v", d)
            cell = shared.value[d].place(points)
            for c in np.unique(cell):
                own = points[cell == c]
                low, high, n = found.get((d, c), (own[0], own[0], 0))
                found[d, c] = np.minimum(low, own.min(axis=0)), np.maximum(high, own.max(axis=0)), n + len(own)
        yield pa.RecordBatch.from_pydict({"dim": pa.array([d for d, _ in found], pa.int32()), "cell": pa.array([int(c) for _, c in found], pa.int32()), "low": pa.array([x[0].tobytes() for x in found.values()], pa.binary()), "high": pa.array([x[1].tobytes() for x in found.values()], pa.binary()), "n": pa.array([x[2] for x in found.values()], pa.int64())})

    def whole_box(part: pa.Table) -> pa.Table:
        low, high = (f(np.stack([np.frombuffer(x, np.float64) for x in part[c].to_pylist()]), axis=0) for f, c in ((np.min, "low"), (np.max, "high")))
        return pa.table({"dim": part["dim"][:1], "cell": part["cell"][:1], "low": pa.array([low.tobytes()], pa.binary()), "high": pa.array([high.tobytes()], pa.binary()), "n": pa.array([sum(part["n"].to_pylist())], pa.int64())})

    kind = "dim int, cell int, low binary, high binary, n long"
    cells = sorted(rows.mapInArrow(boxes, kind).groupBy("dim", "cell").applyInArrow(whole_box, kind).collect(), key=lambda r: (r.dim, r.cell))
    box: dict = {}  # of each dim: cells, low, high
    for d in sizes:
        own = [r for r in cells if r.dim == d]
        box[d] = np.array([r.cell for r in own]), np.array([np.frombuffer(r.low, np.float64) for r in own]).reshape(len(own), d), np.array([np.frombuffer(r.high, np.float64) for r in own]).reshape(len(own), d)
    subs = {(r.dim, r.cell): -(-r.n // shard_rows) for r in cells}
    # blocks of queries run through the cells in their order; a cell with more than a block has several
    block_of, before, blocks = {}, 0, 0
    for r in cells:
        asked_here = r.n / query_every
        block_of[r.dim, r.cell] = (int(before // block_rows), max(1, math.ceil(asked_here / block_rows)))
        blocks = max(blocks, sum(block_of[r.dim, r.cell]))
        before += asked_here
    routes = sc.broadcast((box, subs, block_of))

    def home_of(d: int, cell: np.ndarray, ids: np.ndarray) -> np.ndarray:
        many = np.array([routes.value[1][d, int(c)] for c in cell], np.uint64)
        return (mix(ids.astype(np.uint64)) % many).astype(np.int32)

    def dealt(batches):
        for d, b in by_dim(batches, "dim"):
            cell = shared.value[d].place(matrix(b, "v", d))
            yield pa.RecordBatch.from_pydict({"dim": b.column("dim"), "cell": pa.array(cell), "sub": pa.array(home_of(d, cell, b.column("vec_id").to_numpy())), "vec_id": b.column("vec_id"), "v": b.column("v")})

    def routed(batches):
        """To every shard, but the query's own, that can hold its kth score."""
        for d, b in by_dim(batches, "dim"):
            q = matrix(b, "v", d)
            cell, ids, bar = shared.value[d].place(q), b.column("vec_id").to_numpy(), b.column("bar").to_numpy()
            own = home_of(d, cell, ids)
            numbers, low, high = routes.value[0][d]
            first, several = np.array([routes.value[2][d, int(c)] for c in cell]).reshape(-1, 2).T
            block = (first + (mix(ids.astype(np.uint64) + np.uint64(1)) % several.astype(np.uint64)).astype(np.int64)).astype(np.int32)
            bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
            for j, c in enumerate(numbers):
                for sub in range(routes.value[1][d, int(c)]):
                    go = pa.array(np.flatnonzero((bound[:, j] >= bar) & ((cell != c) | (own != sub))))
                    if len(go):
                        same = lambda x, kind: pa.array(np.full(len(go), x), kind)  # noqa: B023, E731
                        yield pa.RecordBatch.from_pydict({"dim": same(d, pa.int32()), "cell": same(c, pa.int32()), "sub": same(sub, pa.int32()), "block": pa.array(block).take(go), "q_id": b.column("vec_id").take(go), "q_v": b.column("v").take(go), "bar": b.column("bar").take(go)})

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            d = left["dim"][0].as_py()
            own = right["q_id"].to_numpy()
            for q, best in zip(own, Tree(left["vec_id"].to_numpy(), matrix(left, "v", d)).search(matrix(right, "q_v", d), own, k, right["bar"].to_numpy())):
                found += [(int(q), -i, int(s)) for s, i in best]
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.int64())})

    shard, hit = ["dim", "cell", "sub"], "query_id long, vec_id long, score long"
    data = rows.select("dim", "vec_id", "v").mapInArrow(dealt, "dim int, cell int, sub int, vec_id long, v array<double>")
    asked = rows.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.dim", "x.v")
    home = asked.select("dim", "vec_id", "v").mapInArrow(dealt, data.schema).select(*shard, F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"), F.lit(float("-inf")).alias("bar"))
    near = data.groupBy(*shard).cogroup(home.groupBy(*shard)).applyInArrow(search, hit)
    if sum(subs.values()) > 1:
        kth = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        barred = asked.join(kth, F.col("vec_id") == F.col("query_id"), "left").select("dim", "vec_id", "v", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))).alias("bar"))
        far = barred.mapInArrow(routed, "dim int, cell int, sub int, block int, q_id long, q_v array<double>, bar double")
        if blocks > 1:  # a shard goes to the blocks that ask it
            pairs, on = far.select(*shard, "block").distinct().toDF("d", "c", "s", "block_"), [*shard, "block"]
            left = data.join(pairs, (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c")) & (F.col("sub") == F.col("s"))).select(*data.columns, F.col("block_").alias("block"))
        else:
            left, on = data, shard
        near = near.unionByName(left.groupBy(*on).cogroup(far.groupBy(*on)).applyInArrow(search, hit))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast(T.IntegerType()), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
