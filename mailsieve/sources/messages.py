"""Messages from files, and cleaned messages to files."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_messages(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """(msg_id, path, raw) of every message file of a folder, not of its subfolders; reports order them by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(path)
    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("msg_id"), "path", F.col("content").alias("raw"))


def write_messages(df: DataFrame, path: str) -> None:
    """Cleaned messages with their counters as Parquet."""
    df.write.mode("overwrite").parquet(path)


def read_packs(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """Rule packs as (name, text), in the order given, through Spark's file systems."""
    path = lambda p: re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*(?=/)", "", p)
    rows = {path(r.path): r.value for r in spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").collect()}

    def text(p: str) -> str:
        want = path(p)
        exact = rows.get(want, rows.get(quote(want)))
        # a relative path or one without its store's authority: by its end, whole names only
        return exact if exact is not None else next(v for k, v in rows.items() if unquote(k).endswith("/" + want.lstrip("./")))

    return [(p, text(p)) for p in paths]
