"""DataFrame operators: URLs, links, HTML and messages cleaned in Arrow batches, and rule joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.engine import Engine
from ..functions.html import clean_html as one_html
from ..functions.mime import clean_message_fail_open
from ..functions.url import parse
from ..rules.packs import Ruleset


#: Rows of a task at most, where Python works on each row for a good part of a millisecond.
ROWS_PER_TASK = 5_000


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` in partitions of about ``rows_per_task`` rows at most, if it has too few: small rows make a file's split very many.

    The count reads no column: for files it comes from their footers.  Streams are left as they are.
    """
    if df.isStreaming:
        return df
    wanted = -(-df.select().count() // rows_per_task)
    return df.repartition(wanted) if wanted > df.rdd.getNumPartitions() else df


def by_row(df: DataFrame, inputs: list[str], fields: list[tuple[str, str]], make, rows_per_task: int | None = ROWS_PER_TASK) -> DataFrame:
    """``df`` with columns that ``make(*inputs)`` gives for each row, in Arrow batches; columns of those names go.

    Without ``rows_per_task`` the partitions stay as they are.
    """
    keep = [c for c in df.columns if c not in {n for n, _ in fields}]
    schema = T.StructType([*df.select(*keep).schema.fields, *T._parse_datatype_string(", ".join(f"{n} {k}" for n, k in fields)).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            names = b.schema.names
            rows = [make(*x) for x in zip(*[b.column(names.index(c)).to_pylist() for c in inputs])]
            cols = [b.column(names.index(c)) for c in keep]
            cols += [pa.array([r[i] for r in rows], wanted.field(n).type) for i, (n, _) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *[n for n, _ in fields]])

    return (spread(df, rows_per_task) if rows_per_task else df).mapInArrow(run, schema)


def normalise_urls(df: DataFrame, url_col: str = "url", out: str = "normal_url") -> DataFrame:
    """The normal form of each URL; null if it is none."""
    return by_row(df, [url_col], [(out, "string")], lambda u: (str(x) if (x := parse(u)) else None,))


def clean_urls(df: DataFrame, engine: Engine, url_col: str = "url") -> DataFrame:
    """cleaned_url, changed and removed_params; text that is no URL stays as it is."""

    def one(text):
        url = parse(text)
        done = engine.clean(url) if url else None
        return (done.url, done.changed, done.removed) if done else (text, False, [])

    return by_row(df, [url_col], [("cleaned_url", "string"), ("changed", "boolean"), ("removed_params", "array<string>")], one)


def unwrap_urls(df: DataFrame, engine: Engine, url_col: str = "url") -> DataFrame:
    """final_url, unwrapped, provider and rejected."""

    def one(text):
        url = parse(text)
        got = engine.unwrap(url) if url and url.web else None
        return (got.url, got.unwrapped, got.provider, got.rejected) if got else (text, False, None, None)

    return by_row(df, [url_col], [("final_url", "string"), ("unwrapped", "boolean"), ("provider", "string"), ("rejected", "string")], one)


def explain_links(df: DataFrame, engine: Engine, html_col: str = "html", key: str = "page_id", base_col: str | None = None) -> DataFrame:
    """One row for each link: its place, href, verdict and new href."""
    every = spread(df).select(key, *([base_col] if base_col else []), F.posexplode(C.links(F.col(html_col))).alias("place", "href"))

    def one(href, base=None):
        new, verdict = engine.link(href, base=parse(base) if base else None)
        return verdict, new

    return by_row(every, ["href", *([base_col] if base_col else [])], [("verdict", "string"), ("new_href", "string")], one, None)


def clean_html(df: DataFrame, engine: Engine, html_col: str = "html", base_col: str | None = None, sensitive_col: str | None = None) -> DataFrame:
    """The html rewritten in place of the old, with changed and the counters."""

    def one(html, *more):
        more = list(more)
        base = more.pop(0) if base_col else None
        sensitive = set(more.pop(0) or ()) if sensitive_col else set()
        r = one_html(html or "", engine, sensitive, base)
        return (r.html if html is not None else None), r.changed, r.urls_cleaned, r.redirects_unwrapped, r.pixels_removed, r.pings_stripped

    fields = [("cleaned_html", "string"), ("changed", "boolean"), *((k, "long") for k in ("urls_cleaned", "redirects_unwrapped", "pixels_removed", "pings_stripped"))]
    return by_row(df, [html_col, *([base_col] if base_col else []), *([sensitive_col] if sensitive_col else [])], fields, one)


MESSAGE = [("cleaned", "binary"), ("audit_headers", "array<struct<name:string,value:string>>"), ("html_parts", "long"), ("urls_cleaned", "long"), ("redirects_unwrapped", "long"), ("pixels_removed", "long"), ("pings_stripped", "long"), ("modified", "boolean"), ("mode", "string"), ("policy", "string"), ("error", "string")]


def clean_messages(df: DataFrame, engine: Engine, raw_col: str = "raw") -> DataFrame:
    """Messages cleaned; a bad one passes unchanged with its error in a column, and never fails the job."""

    def one(raw):
        o = clean_message_fail_open(bytes(raw or b""), engine)
        return (o.cleaned, [{"name": k, "value": v} for k, v in o.headers], o.html_parts, o.urls_cleaned, o.redirects_unwrapped, o.pixels_removed, o.pings_stripped, o.modified, o.mode, o.policy, o.error)

    return by_row(df, [raw_col], MESSAGE, one)


def rule_table(spark, rules: Ruleset) -> DataFrame:
    """The exact global parameters as rows, for packs too large to be one expression."""
    rows = [(p.matcher.value.lower(), i) for i, (p, _) in enumerate(rules.params) if p.is_global and p.matcher.kind == "exact"]
    return spark.createDataFrame(rows, "name string, ord int")


#: Names that fit into one test of a column.
MAX_IN_LIST = 100_000


def strip_by_join(df: DataFrame, names: DataFrame, url_col: str = "url", max_in_list: int = MAX_IN_LIST) -> DataFrame:
    """``df`` with cleaned_url and n_removed: parameters tested against a table of names.

    Up to ``max_in_list`` names are one hashed list inside the scan, without a shuffle.  More are joined by name, with the
    names that the URLs hold; the corpus then meets only the names that both have, as a list for each URL.
    Rows without a query meet no key, and rows are told apart by a row id, not by their values.
    """
    lower = lambda s: F.lower(C.form_decode(C.segment_name(s)))
    listed = names.select(F.lower("name").alias("bad_name")).distinct()
    few = [r.bad_name for r in listed.limit(max_in_list + 1).collect()]
    if len(few) <= max_in_list:
        cleaned, removed = C.strip(F.col(url_col), lambda s: lower(s).isin(few))
        return df.withColumns({"cleaned_url": cleaned, "n_removed": F.size(removed).cast("long")})
    rid, bad = "strip_row", "strip_bad"
    keyed = df.withColumn(rid, F.monotonically_increasing_id())
    used = keyed.where(C.query(F.col(url_col)).isNotNull()).select(rid, F.explode(F.array_distinct(F.transform(F.split(C.query(F.col(url_col)), "&"), lower))).alias("bad_name"))
    hits = used.join(listed, "bad_name").groupBy(rid).agg(F.collect_set("bad_name").alias(bad))
    cleaned, removed = C.strip(F.col(url_col), lambda s: F.array_contains(F.col(bad), lower(s)))
    out = keyed.join(hits, rid, "left")
    return out.select(*df.columns, F.when(F.col(bad).isNull(), F.col(url_col)).otherwise(cleaned).alias("cleaned_url"), F.when(F.col(bad).isNull(), 0).otherwise(F.size(removed)).cast("long").alias("n_removed"))
