"""Reports over cleaned tables: totals, trackers, rules and line differences."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.engine import Engine
from ..functions.html import links
from ..functions.mime import clean_message_fail_open, decode_charset, decoded, header_block, parts, sender_domain, unsubscribe_targets
from ..functions.url import parse
from ..operators.clean import by_row
from ..rules.packs import Ruleset

COUNTERS = ("html_parts", "urls_cleaned", "redirects_unwrapped", "pixels_removed", "pings_stripped")


def totals(messages: DataFrame) -> DataFrame:
    return messages.agg(F.count("*").alias("messages"), *[F.sum(c).alias(c) for c in COUNTERS], F.count("error").alias("errors"), F.sum(F.col("modified").cast("long")).alias("modified"))


def per_message(messages: DataFrame, key: str = "msg_id") -> DataFrame:
    state = F.when(F.col("error").isNotNull(), "FAIL-OPEN").otherwise("ok")
    return messages.select(key, state.alias("state"), *COUNTERS).orderBy(key)


def message_links(raw: bytes, engine: Engine) -> list[dict]:
    """Of every link of a message's HTML parts: place, href, verdict, new href, provider, removed parameters."""
    headers, _ = header_block(raw, 0, len(raw))
    config, _ = engine.config.for_sender(sender_domain(headers))
    engine, safe = engine.with_config(config), set(unsubscribe_targets(headers))
    out = []
    for p in parts(raw):
        if p.ctype != "text/html" or p.attachment:
            continue
        for href in links(decode_charset(decoded(raw, p), p.charset) or ""):
            new, verdict = engine.link(href, safe)
            url = parse(href.replace("&amp;", "&"))
            web = url is not None and url.web
            got = engine.unwrap(url) if web else None
            cleaned = engine.clean(url) if web else None
            out.append({"place": len(out) + 1, "href": href, "verdict": verdict, "new_href": new, "provider": got.provider if got and (got.unwrapped or got.rejected) else None, "removed": cleaned.removed if cleaned else []})
    return out


LINKS = "array<struct<place:int,href:string,verdict:string,new_href:string,provider:string,removed:array<string>>>"


def explain_messages(messages: DataFrame, engine: Engine, key: str = "msg_id", raw_col: str = "raw") -> DataFrame:
    """One row for each link of each message."""
    found = by_row(messages.select(key, raw_col), [raw_col], [("links", LINKS)], lambda raw: (message_links(bytes(raw or b""), engine),))
    return found.select(key, F.inline("links"))


def trackers(messages: DataFrame, engine: Engine, key: str = "msg_id", raw_col: str = "raw") -> DataFrame:
    """For each message: wrapped links, links with tracking parameters, pixels, pings."""

    def one(raw):
        raw = bytes(raw or b"")
        every, done = message_links(raw, engine), clean_message_fail_open(raw, engine)
        every = [x for x in every if x["verdict"] != "sensitive"]
        return sum(x["provider"] is not None for x in every), sum(bool(x["removed"]) for x in every), done.pixels_removed, done.pings_stripped

    return by_row(messages.select(key, raw_col), [raw_col], [(k, "long") for k in ("redirect_wrappers", "param_tracking_links", "tracking_pixels", "link_pings")], one).drop(raw_col)


def diff_messages(messages: DataFrame, engine: Engine, key: str = "msg_id", raw_col: str = "raw") -> DataFrame:
    """For each message the changed lines, as one hunk."""
    one = lambda raw: (line_diff(bytes(raw or b"").decode("utf-8", "replace"), clean_message_fail_open(bytes(raw or b""), engine).cleaned.decode("utf-8", "replace")),)
    return by_row(messages.select(key, raw_col), [raw_col], [("diff", "array<string>")], one).drop(raw_col)


def rule_stats(spark: SparkSession, rules: Ruleset) -> DataFrame:
    return spark.createDataFrame([(k, int(v)) for k, v in rules.stats().items()], "name string, value long")


def rule_stats_json(rules: Ruleset) -> str:
    return json.dumps({**rules.stats(), "reports": [r.__dict__ for r in rules.reports]}, indent=2)


def source_reports(spark: SparkSession, rules: Ruleset) -> DataFrame:
    rows = [(r.source, r.format, r.loaded, r.duplicates, r.unsupported, r.failed, r.error, r.samples) for r in rules.reports]
    return spark.createDataFrame(rows, "source string, format string, loaded int, duplicates int, unsupported int, failed int, error string, samples array<string>")


def line_diff(before: str, after: str) -> list[str]:
    """One hunk: what lies between the common lines at the start and at the end."""
    a, b = before.split("\n"), after.split("\n")
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return [f"-{x}" for x in a[head : len(a) - tail]] + [f"+{x}" for x in b[head : len(b) - tail]]
