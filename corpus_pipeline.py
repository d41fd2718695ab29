"""A corpus pipeline of five stages; each gets the documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailsieve.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from mailsieve.llm.common import read, saved

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("jaccard_join", jaccard_join.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
]

#: The fitted classifier and the LSH have no SQL equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the first four stages keep, with the lines that are left and their place in the mix.

    Every stage but the last is written and read again.  Null texts and ids, empty tables, ties, repeated rows, very
    long texts and clashing column names are treated as each stage's docstring says.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
