"""Plan helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import math
import os
import re
import tempfile
import uuid
from collections.abc import Iterable
from functools import reduce
from operator import and_
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(df: DataFrame, ratio: float) -> float:
    """About how many bytes of text ``df`` has: from the files' size if it is a plain scan, else counted."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    if leaves.size() == 1 and "LogicalRelation" in leaves.head().getClass().getName():
        return int(str(leaves.head().stats().sizeInBytes())) * ratio
    texts = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    return df.agg(F.sum(sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(0)).cast("long"))).first()[0] or 0


def shared_dir(spark: SparkSession) -> None:
    """Checkpoints go where spark.checkpoint.dir says.  Only a local session without it (tests) gets a folder of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = Path(tempfile.gettempdir(), f"mailsieve-checkpoints-{os.getuid()}").as_uri()
        sc.setCheckpointDir(where)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name like ``name`` that is not taken (Spark's names know no case)."""
    taken = {x.lower() for x in taken}
    while name.lower() in taken:
        name += "_"
    return name


def by_key(rows: DataFrame, per: DataFrame, keys: list[str], count: str, total: int, least: int = 2000, hot_keys: int = 50_000) -> DataFrame:
    """``rows`` joined to the one row that ``per`` has for their ``keys``; no task gathers a frequent key.

    ``count`` of ``per`` says how many of the ``total`` rows a key has at most.  Keys above ``least`` and
    total / hot_keys are broadcast, and there can be no more than ``hot_keys`` of them; the others meet in a shuffle.
    """
    bound = max(least, -(-total // hot_keys))
    if total <= bound:
        return rows.join(per, keys)
    taken = [*rows.columns, *per.columns]
    names = {k: fresh(f"per_{k}", taken) for k in keys}
    value = fresh("per_value", [*taken, *names.values()])
    values = [c for c in per.columns if c not in keys]
    met = reduce(and_, [F.col(k) == F.col(n) for k, n in names.items()])
    of = lambda part: part.select(*[F.col(k).alias(n) for k, n in names.items()], F.struct(*values).alias(value))
    marked = rows.join(F.broadcast(of(per.where(F.col(count) > bound))), met, "left")
    near = marked.where(F.col(value).isNotNull())
    far = marked.where(F.col(value).isNull()).select(*rows.columns).join(of(per.where(F.col(count) <= bound)), met)
    return near.unionByName(far).select(*rows.columns, *[F.col(value)[c].alias(c) for c in values])


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder.

    With ``free`` (after a wide stage), a collection on the driver lets Spark's cleaner drop the shuffle files and older checkpoints
    that nothing refers to any more; otherwise they stay until the driver's heap happens to fill.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    if free:
        gc.collect()
        out.sparkSession.sparkContext._jvm.System.gc()
    return out


def groups_for(df: DataFrame, mb: float, ratio: float = 2.2) -> int:
    """How many hash groups make one group about ``mb`` MB of text (files hold text ``ratio`` times smaller)."""
    return max(1, math.ceil(text_bytes(df, ratio) / (mb * 1e6)))


def doc_group(n: int, *cols: str):
    return F.pmod(F.xxhash64(*(cols or ("doc_id",))), F.lit(n)).cast("int")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; the files go when the session ends."""
    shared_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    path = f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return df.sparkSession.read.parquet(path)
