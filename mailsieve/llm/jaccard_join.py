"""N-gram Jaccard join with a count-vector R-tree.

Each document is its set of word shingles, as 64-bit hashes.  Equal sets collapse to one class.

Routing: a class's shingles are hashed into groups, one more than the largest symmetric difference
that a link allows at this size, so two linked sets have at least one group with equal content.
That group may be empty in both.  A set whose non-empty groups could all be touched by differences is
therefore routed by a prefix of its shingles too, so two linked sets always share a key.
Group contents that occur once are dropped by the bucketed bit exchange of ``superk``.  The smallest
class of a group content is its hub; two linked sets share a hub.

Index: the classes of a hub are points of an R-tree over their group counts, which are narrow and
travel once for each hub of a class.  The overlap of a set and a box is bounded by the summed minima
of its counts and the box's upper corner, and that of two sets by those of their counts.  What the
bound leaves joins classes into candidate components, which hold all links.  Shared passages alone
pass the first step but not the bound, so these components stay near the groups of near duplicates.

Verification: only now the sets travel, to the leaves of bounded size of their candidate component,
where the R-tree's surviving pairs are verified until they are connected.  Links between pairs that
are connected already are not made.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import NARROW, components
from .superk import cuts, ordered
from .textkit import U64, Words, flat, mix, row_of, sequence_hash, starts_inside, window_hash

SHINGLE, PERCENT, DIMS, FAN, LEAF_ROWS, LEAF_SHINGLES = 3, 90, 256, 32, 1500, 5_000_000


def bands(percent: int, most: int) -> list[int]:
    """Lower ends of the size bands, each half as large again as the one before."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


def group_count(high: int, percent: int) -> int:
    """Groups for sets of at most ``high`` shingles: one more than the largest symmetric difference."""
    return 2 * high * (100 - percent) // (100 + percent) + 1


class Sets:
    """Distinct shingle hashes of each row of a batch, sorted within the row."""

    def __init__(self, column, size: int):
        w = Words(*flat(column), lower=True)
        h = w.hashes()
        n = np.diff(w.rows)
        inside = np.flatnonzero(starts_inside(w.rows, size))
        rows = row_of(w.rows)
        s, row = window_hash(h, size)[inside] if len(inside) else h[:0], rows[inside]
        few = np.flatnonzero((n > 0) & (n < size))  # the whole sequence is one shingle
        s = np.concatenate([s, sequence_hash(h, w.rows[few], w.rows[few + 1])])
        row = np.concatenate([row, few])
        order = np.lexsort((s, row))
        s, row = s[order], row[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
        self.hash, self.row = s[new], row[new]
        self.offsets = np.searchsorted(self.row, np.arange(len(n) + 1))
        self.size = np.diff(self.offsets)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Two order-free 64-bit sums of each set."""
        out = []
        for k in (0x1234567, 0x7654321):
            c = np.append(U64(0), np.cumsum(mix(self.hash ^ U64(k))))
            out.append(c[self.offsets[1:]] - c[self.offsets[:-1]])
        return out[0], out[1]

    def keys(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) such that any two linked sets share a key.

        For the band of the set and those of larger partners: the content of every non-empty group, and,
        where differences could touch all of these (the group with equal content is then empty, or may
        be), the first shingles in a random order, of which two linked sets share one.
        """
        if not len(self.hash):
            return np.zeros(0, np.int64), self.hash
        edge = np.array(bands(percent, int(self.size.max()) * 4))
        band = np.searchsorted(edge, self.size, side="right") - 1
        need = np.array([group_count(int(e) - 1, percent) for e in edge[1:]], np.int64)
        most = self.size * 100 // percent  # the largest partner
        rows, keys = [], []
        for step in (0, 1, 2):
            at = np.minimum(band + step, len(need) - 1)
            live = (self.size > 0) & ((step == 0) | (most >= edge[at]))
            if not live.any():
                continue
            pick = live[self.row]
            h, row = self.hash[pick], self.row[pick]
            b = at[row]
            g = (mix(h ^ U64(0xABCDEF)) % need[b].astype(np.uint64)).astype(np.int64)
            wide = int(need[at[live]].max())
            cell = row * wide + g
            order = np.argsort(cell, kind="stable")
            cell, hs = cell[order], mix(h[order] ^ U64(0x55AA))
            head = np.flatnonzero(np.diff(cell, prepend=-1))
            total = np.add.reduceat(hs, head)
            owner = cell[head] // wide
            rows.append(owner)
            keys.append(mix(total ^ mix((at[owner] * 1_000_003 + cell[head] % wide).astype(np.uint64))))
            filled = np.bincount(owner, minlength=len(self.size))
            partner = np.minimum(most, edge[at + 1] - 1)
            unsure = live & (filled <= (self.size + partner) * (100 - percent) // (100 + percent))
            if not unsure.any():
                continue
            pick = unsure[self.row]
            row, hs = self.row[pick], mix(self.hash[pick] ^ U64(0x3C3C3C))
            order = np.lexsort((hs, row))
            row, hs = row[order], hs[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            first = place <= (self.size - -(-percent * self.size // 100))[row]
            row, hs = row[first], hs[first]
            rows.append(row)
            keys.append(mix(hs ^ mix(~at[row].astype(np.uint64))))
        return np.concatenate(rows), np.concatenate(keys)


class CountTree:
    """R-tree over count vectors, bulk loaded in the order of size and first coordinates."""

    def __init__(self, points: np.ndarray, fan: int = FAN):
        order = np.lexsort((points[:, 1], points[:, 0], points.sum(axis=1)))
        self.order, self.points = order, points[order]
        self.levels = []
        top = self.points
        while len(top) > fan:
            top = np.maximum.reduceat(top, np.arange(0, len(top), fan), axis=0)
            self.levels.append(top)
        self.fan = fan

    def search(self, q: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Points whose bound on the overlap with ``q`` reaches ``need`` (one number for each point)."""
        least = need.min() if len(need) else 0
        live = np.arange(len(self.levels[-1]) if self.levels else 0)
        for depth in range(len(self.levels) - 1, -1, -1):
            boxes = self.levels[depth]
            live = live[np.minimum(boxes[live], q).sum(axis=1) >= least]
            below = len(self.levels[depth - 1]) if depth else len(self.points)
            live = (live[:, None] * self.fan + np.arange(self.fan)).ravel()
            live = live[live < below]
        if not self.levels:
            live = np.arange(len(self.points))
        at = self.order[live]
        return at[np.minimum(self.points[live], q).sum(axis=1) >= need[at]]


def counts(s: np.ndarray) -> np.ndarray:
    """The point of a set: how many of its hashes fall into each group."""
    return np.bincount((s % U64(DIMS)).astype(np.int64), minlength=DIMS).astype(np.uint32)


def least_overlap(size: np.ndarray, i: int, percent: int) -> np.ndarray:
    """Overlap with each set that makes a link of it and set ``i``."""
    return -(-percent * (size + size[i]) // (100 + percent))


def bounded(ids: np.ndarray, points: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that connect what all pairs within the bound connect, one fewer than there are ids at most."""
    size = points.sum(axis=1, dtype=np.int64)
    tree = CountTree(points)
    root = np.arange(len(ids))
    out = []
    for i in range(len(ids)):
        near = tree.search(points[i], least_overlap(size, i, percent))
        others, at = np.unique(root[near], return_index=True)
        fresh = others != root[i]
        out += [(int(ids[i]), int(ids[j])) for j in near[at[fresh]]]
        root[np.isin(root, others[fresh])] = root[i]
    return out


def links(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Verified links that connect what all links connect."""
    n = len(ids)
    size = np.array([len(s) for s in sets])
    points = np.stack([counts(s) for s in sets])
    tree = CountTree(points)
    root = np.arange(n)
    out = []
    for i in range(n):
        near = tree.search(points[i], least_overlap(size, i, percent))
        for j in near[(near > i) & (root[near] != root[i])]:
            if root[i] == root[j]:
                continue
            overlap = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * overlap >= percent * (size[i] + size[j] - overlap):
                out.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
    return out


def in_cells(members: DataFrame, group: str, leaf_rows: int, weight: str = "0L") -> DataFrame:
    """``members`` (``group``, rep, ...) with a column cell.

    All pairs of a group meet in some cell.  A small group lies in one cell, with other groups; a group
    above ``leaf_rows`` rows or LEAF_SHINGLES of ``weight`` is split into leaves, with a cell for each two.
    """
    per = members.groupBy(group).agg(F.count("*").alias("rows"), F.sum(F.expr(weight)).alias("w"))
    per = common.cut(per.select(group, "rows", "w", F.greatest(F.lit(1), F.ceil(F.col("rows") / leaf_rows), F.ceil(F.col("w") / LEAF_SHINGLES)).cast("int").alias("leaves")))
    total = per.agg(F.sum("rows"), F.sum("w")).first()
    cells = max(1, math.ceil((total[0] or 0) / leaf_rows), math.ceil((total[1] or 0) / LEAF_SHINGLES))
    leaf = F.pmod(F.xxhash64("rep"), F.col("leaves")).cast("int")
    placed = common.by_key(members, per, [group], "rows", total[0] or 0, NARROW).withColumn("leaf", leaf).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("leaves") - 1)))
    own = F.xxhash64(group, F.least("leaf", "other"), F.greatest("leaf", "other"))
    return placed.withColumn("cell", F.when(F.col("leaves") > 1, own).otherwise(F.pmod(F.xxhash64(group), F.lit(cells)))).drop("rows", "w", "leaves", "leaf", "other")


def edges_of(pairs) -> pa.Table:
    found = list(pairs)
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, group_mb: float = 1.5, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``.

    Words are lower-cased in A-Z.  A text of fewer words than a shingle is one shingle of all its
    words; without words (or null) the set is empty and links with nothing.  Two rows link when
    100 * intersection >= ``percent`` * union.  component_id is the smallest id reachable by links, the own
    one included.  Rows with a null id link with nothing and have a null component; rows with one id
    are one node; other columns are not looked at.
    """
    if percent < 60:
        raise ValueError("sizes of linked sets must lie within neighbouring bands: percent must be 60 at least")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = common.groups_for(base, group_mb)
    grouped = base.withColumn("g", common.doc_group(n)).select("g", "doc_id", "text")

    def keyed(table: pa.Table):
        sets = Sets(table["text"], shingle)
        row, key = sets.keys(percent)
        bucket = (key % U64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return sets, row[order], key[order], bucket[order]

    def anchors(table: pa.Table) -> pa.Table:
        _, _, key, bucket = keyed(ordered(table))
        rest = ((key // U64(n)) & U64(0xFFFFFFFF)).astype(np.uint32)
        found = [(k, rest[a:b].tobytes()) for k, a, b in cuts(bucket)]
        g = table["g"][0].as_py()
        return pa.table({"bucket": pa.array([k for k, _ in found], pa.int32()), "g": pa.array([g] * len(found), pa.int32()), "rests": pa.array([x for _, x in found], pa.binary())})

    def nodes(left: pa.Table, right: pa.Table) -> pa.Table:
        table = ordered(left)
        sets, row, key, bucket = keyed(table)
        bits = dict(zip(right["bucket"].to_pylist(), right["bits"].to_pylist()))
        hit = np.zeros(len(row), bool)
        for k, a, b in cuts(bucket):
            if k in bits:
                hit[a:b] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=b - a)
        row, key = row[hit], key[hit]
        order = np.argsort(row, kind="stable")
        row, key = row[order], key[order]
        edge = np.searchsorted(row, np.arange(len(table) + 1))
        one, two = sets.sums()
        has = np.diff(edge) > 0
        packed = [sets.hash[a:b].tobytes() if k else None for a, b, k in zip(sets.offsets[:-1], sets.offsets[1:], has)]
        keys = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(key.view(np.int64)))
        return pa.table({"doc_id": table["doc_id"].combine_chunks(), "n": pa.array(sets.size, pa.int64()), "s1": pa.array(one.view(np.int64)), "s2": pa.array(two.view(np.int64)), "keys": keys, "packed": pa.array(packed, pa.binary())})

    from .superk import bits_of_repeats

    seen = grouped.groupBy("g").applyInArrow(anchors, "bucket int, g int, rests binary").groupBy("bucket").applyInArrow(bits_of_repeats, "g int, bucket int, bits binary")
    table = common.cut(grouped.groupBy("g").cogroup(seen.groupBy("g")).applyInArrow(nodes, "doc_id long, n long, s1 long, s2 long, keys array<long>, packed binary"), free=True)
    linkable = table.where("n > 0 and doc_id is not null")
    classes = common.cut(linkable.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("keys").alias("keys"), F.min("packed").alias("packed")), free=True)
    several = classes.where(F.size("keys") > 0)
    by_key = several.select(F.explode("keys").alias("key"), "rep")
    low = by_key.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("high"), F.count("*").alias("c")).where("hub < high").select("key", "hub", "c")
    routed = several.agg(F.sum(F.size("keys"))).first()[0] or 0
    member = common.cut(common.by_key(by_key, low, ["key"], "c", routed, NARROW).select("rep", "hub").distinct(), free=True)

    def pointed(batches):
        for batch in batches:
            point = [counts(np.frombuffer(x.as_buffer(), np.uint64)).tobytes() for x in batch["packed"]]
            yield pa.RecordBatch.from_pydict({"node": batch["rep"], "point": pa.array(point, pa.binary())})

    def bound(group: pa.Table) -> pa.Table:
        group = group.sort_by([("hub", "ascending"), ("rep", "ascending")])
        rep = group["rep"].to_numpy()
        points = np.frombuffer(b"".join(group["point"].to_pylist()), np.uint32).reshape(-1, DIMS)
        return edges_of(x for _, a, b in cuts(group["hub"].to_numpy()) for x in bounded(rep[a:b], points[a:b], percent))

    def verify(group: pa.Table) -> pa.Table:
        group = group.sort_by([("component", "ascending"), ("rep", "ascending")])
        rep = group["rep"].to_pylist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["packed"]]
        return edges_of(x for _, a, b in cuts(group["component"].to_numpy()) for x in links(rep[a:b], sets[a:b], percent))

    points = several.select("rep", "packed").mapInArrow(pointed, "node long, point binary")
    at_hub = in_cells(member, "hub", leaf_rows).join(points, F.col("rep") == F.col("node")).select("cell", "hub", "rep", "point")
    near = components(at_hub.groupBy("cell").applyInArrow(bound, "a long, b long")).withColumnRenamed("node", "rep")
    sizes = several.select(F.col("rep").alias("node"), "n")
    at_component = in_cells(near.join(sizes, F.col("rep") == F.col("node")).select("component", "rep", "n"), "component", leaf_rows, "n")
    sets = several.select(F.col("rep").alias("node"), "packed")
    spread = at_component.join(sets, F.col("rep") == F.col("node")).select("cell", "component", "rep", "packed")
    edges = spread.groupBy("cell").applyInArrow(verify, "a long, b long")
    # rows that repeat an id with different texts join their classes as well
    kind = F.struct("s1", "s2", "n")
    repeated = table.where("doc_id is not null").groupBy("doc_id").agg(F.min(kind).alias("low"), F.max(kind).alias("high")).where("low < high")
    repeated = common.cut(repeated.select(F.col("doc_id").alias("id")))
    twice = not repeated.isEmpty()
    if twice:
        of = table.where("n > 0").join(repeated, F.col("doc_id") == F.col("id")).select("s1", "s2", "n", "id").distinct()
        edges = edges.unionByName(of.join(classes, ["s1", "s2", "n"]).select(F.col("rep").alias("a"), F.col("id").alias("b")))
    found = components(edges)
    named = classes.select("s1", "s2", "n", "rep", "copies").join(found, F.col("rep") == F.col("node"), "left").select("s1", "s2", "n", "copies", F.coalesce("component", "rep").alias("label"))
    # rows without a set or an id link with nothing and meet no key
    out = common.by_key(linkable.select("doc_id", "s1", "s2", "n"), named, ["s1", "s2", "n"], "copies", table.count(), NARROW).select("doc_id", "n", "label")
    rest = table.where("n = 0 or doc_id is null").select("doc_id", "n")
    if twice:  # an empty text of an id that has others too
        label = rest.join(repeated.join(found, F.col("id") == F.col("node")).select("id", "component"), F.col("doc_id") == F.col("id"), "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("label"))
    else:
        label = rest.withColumn("label", F.col("doc_id"))
    return out.unionByName(label).select("doc_id", F.col("n").alias("n_shingles"), F.col("label").alias("component_id"))


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
),
t AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
win AS (
  SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {SHINGLE - 1} FOLLOWING) AS s FROM t
),
sets AS (SELECT DISTINCT doc_id, s FROM win WHERE i <= greatest(n - {SHINGLE}, 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
linked AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM d LEFT JOIN sizes ON d.doc_id = sizes.doc_id LEFT JOIN low ON d.doc_id = low.a
"""


def query(spark, sf_dir: str) -> DataFrame:
    return join(common.read(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.  Word shingles of five, 80 %.

    Rows that repeat an id with different texts are different documents here, so no text is lost with another's copy;
    of rows equal in id and text one stays.  Rows with a null id, and all texts without words, stay.  Other columns pass
    through whatever their names.  An empty table stays empty.
    """
    th, nr = common.fresh("text_hash", docs.columns), common.fresh("nr", docs.columns)
    known = docs.where("doc_id is not null").withColumn(th, F.xxhash64("text", F.col("text").isNull()))
    several = known.groupBy("doc_id").agg(F.min(th).alias("low"), F.max(th).alias("high")).where("low < high")
    if several.isEmpty():
        known = known.withColumn(nr, F.col("doc_id").cast("long"))
    else:  # numbered in the order of the ids
        pairs = common.cut(known.select("doc_id", F.col(th).alias("t")).distinct().orderBy("doc_id", "t"))
        numbers = pairs.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])).toDF(f"{nr}_d long, {nr}_t long, {nr} long")
        known = common.cut(known.join(numbers, (F.col("doc_id") == F.col(f"{nr}_d")) & (F.col(th) == F.col(f"{nr}_t"))))
    named = join(known.select(F.col(nr).alias("doc_id"), "text"), shingle=5, percent=80)
    kept = common.fresh("kept", known.columns)
    keep = named.where("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    known = known.join(keep, F.col(nr) == F.col(kept), "left_semi").dropDuplicates([nr])
    return known.select(*docs.columns).unionByName(docs.where("doc_id is null"))
