"""Registered queries and their DuckDB equivalents.

Where the tables have no suitable column, URLs, tags and messages are made from keys by expressions
that Spark and DuckDB read alike.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import SENSITIVE, Config, Policy
from .functions import columns as C
from .functions.engine import Engine, glob_regex, target_regex
from .operators import clean as ops
from .plans import reports
from .rules import builtin
from .rules.packs import Ruleset, load

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def table(spark, sf_dir: str, name: str, **made: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({k: F.expr(v) for k, v in made.items()})


def rules() -> Ruleset:
    return load()


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


PACK = load()
EXACT = sorted({m.value for m in C.global_params(PACK) if m.kind == "exact"})
PREFIX = [m.value for m in C.global_params(PACK) if m.kind == "prefix"]

# ---- expressions that both engines read ----
EVENT_URL = (
    "concat(CASE event_id % 8 WHEN 0 THEN 'https://www.amazon.de/dp/' WHEN 1 THEN 'https://www.youtube.com/watch/' WHEN 2 THEN 'https://shop.example.com/p/' "
    "WHEN 3 THEN 'https://www.google.com/search/' WHEN 4 THEN 'https://x.com/i/' WHEN 5 THEN 'https://medium.com/s/' WHEN 6 THEN 'https://open.spotify.com/track/' ELSE 'http://news.example.org/a/' END, "
    "CAST(user_id AS VARCHAR(20)), '?id=', CAST(event_id AS VARCHAR(20)), CASE event_id % 5 WHEN 0 THEN '&utm_source=mail&ref=nl' WHEN 1 THEN '&fbclid=a1&si=zz' WHEN 2 THEN '&tag=x&keep=1' WHEN 3 THEN '&UTM_Campaign=y&s=20&source=z' ELSE '' END, "
    "CASE WHEN event_id % 11 = 0 THEN '#top' ELSE '' END)"
)
WRAPPED = (
    "concat(CASE event_id % 6 WHEN 0 THEN 'https://u7.ct.sendgrid.net/ls/click?upn=1&url=' WHEN 1 THEN 'https://t.hubspotlinks.com/c?k=2&url=' WHEN 2 THEN 'https://links.iterable.com/u/click?url=' "
    "WHEN 3 THEN 'https://mail.brand.example/ls/click?a=b&url=' WHEN 4 THEN 'https://www.google.com/url?sa=t&q=' ELSE 'https://plain.example.com/?url=' END, "
    "CASE event_id % 4 WHEN 0 THEN 'https://dest.example.com/' WHEN 1 THEN 'https%3A%2F%2Fdest.example.org%2Fp%3Fa%3D1' WHEN 2 THEN 'http://10.1.2.3/' ELSE 'https://u@evil.example/' END, CAST(user_id AS VARCHAR(20)))"
)
HOST = "regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"
NAME = "lower(url_decode(replace(string_split(s, '=')[1], '+', ' ')))"
GONE = f"({NAME} IN ({quoted(EXACT)}) OR " + " OR ".join(f"starts_with({NAME}, '{p}')" for p in PREFIX) + ")"


def stripped(source: str, key: str, gone: str, url: str = "url", extra: str = "") -> str:
    """DuckDB: (key, cleaned_url, n_removed, removed) of a source, for a test of one segment s."""
    return f"""
SELECT {key}, {extra}
  CASE WHEN len(g) > 0 THEN regexp_extract(u, '^([^?#]*)', 1) || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END || regexp_extract(u, '(#.*)$', 1) ELSE u END AS cleaned_url,
  CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  array_to_string(list_transform(coalesce(g, []), lambda s: url_decode(replace(string_split(s, '=')[1], '+', ' '))), ',') AS removed
FROM (SELECT *, list_filter(q, lambda s: s <> '' AND {gone}) AS g, list_filter(q, lambda s: s <> '' AND NOT {gone}) AS k
      FROM (SELECT *, CASE WHEN regexp_matches(u, '^[^?#]*\\?') THEN string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&') END AS q
            FROM (SELECT *, {url} AS u FROM {source})))"""


def strip_columns(df: DataFrame, url, removes):
    cleaned, removed = C.strip(url, removes)
    return df.withColumns({"cleaned_url": cleaned, "n_removed": F.size(removed).cast("long"), "removed": F.array_join(removed, ",")})


RESULT = ("cleaned_url", "n_removed", "removed")


@query("clean_url_pages", stripped("pages", "page_id", GONE))
def clean_url_pages(spark, d):
    """Page URLs without the global tracking parameters."""
    matchers = C.global_params(rules())
    return strip_columns(table(spark, d, "pages").select("page_id", "url"), F.col("url"), lambda s: C.any_match(matchers, s)).select("page_id", *RESULT)


@query("removed_params_by_host", f"SELECT {HOST.format(u='url')} AS host, name, count(*) AS n FROM (SELECT url, lower(string_split(unnest(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&')), '=')[1]) AS name FROM pages) WHERE name IN ({quoted(EXACT)}) OR " + " OR ".join(f"starts_with(name, '{p}')" for p in PREFIX) + " GROUP BY ALL")
def removed_params_by_host(spark, d):
    """How often each tracking parameter is removed, by host."""
    matchers = C.global_params(rules())
    _, removed = C.strip(F.col("url"), lambda s: C.any_match(matchers, s))
    return table(spark, d, "pages").select(C.host(F.col("url")).alias("host"), F.explode(removed).alias("name")).groupBy("host", F.lower("name").alias("name")).agg(F.count("*").alias("n"))


@query("provider_detect", f"SELECT provider, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(u, '(?i){p.pattern}') THEN '{p.name}'" for p in PACK.providers if not p.is_global) + f" END AS provider FROM (SELECT {EVENT_URL} AS u FROM events UNION ALL SELECT {WRAPPED} FROM events)) GROUP BY ALL")
def provider_detect(spark, d):
    """URLs by the first provider that matches."""
    e = table(spark, d, "events", a=EVENT_URL, b=WRAPPED)
    urls = e.select(F.col("a").alias("u")).unionByName(e.select(F.col("b").alias("u")))
    return urls.groupBy(C.provider(F.col("u"), rules()).alias("provider")).agg(F.count("*").alias("n"))


AMAZON = "^https?://([a-z0-9_-]+[.])*(amazon([.][a-z]{2,})+|amzn[.]to)(:|/|[?]|#|$)"
VENDOR = "(" + GONE + f" OR (regexp_matches(u, '{AMAZON}') AND (" + NAME + " IN (" + quoted(sorted({m.value for m in C.vendor_params(PACK, "amazon") if m.kind == "exact"})) + f") OR regexp_matches({NAME}, '^(?:p[fd]_rd_[a-z]*)$') OR regexp_matches({NAME}, '^(?:srs?)$'))))"


@query("vendor_param_strip", stripped("events", "event_id", VENDOR, EVENT_URL))
def vendor_param_strip(spark, d):
    """Global parameters, and on one vendor's hosts its own."""
    r = rules()
    everywhere, vendor = C.global_params(r), C.vendor_params(r, "amazon")
    pattern = next(p.pattern for p in r.providers if p.name == "amazon")
    e = table(spark, d, "events", u=EVENT_URL).withColumn("on_vendor", F.col("u").rlike("(?i)" + pattern))
    return strip_columns(e, F.col("u"), lambda s: C.any_match(everywhere, s) | (F.col("on_vendor") & C.any_match(vendor, s))).select("event_id", *RESULT)


@query("keep_params", stripped("events", "event_id", f"({GONE} OR {NAME} = 'tag') AND {NAME} <> 'fbclid' AND NOT starts_with({NAME}, 'utm_c')", EVENT_URL))
def keep_params(spark, d):
    """Kept names win over extra names, and those over the rules."""
    matchers = C.global_params(rules())
    name = lambda s: F.lower(C.form_decode(C.segment_name(s)))
    spared = lambda s: (name(s) == "fbclid") | F.startswith(name(s), F.lit("utm_c"))
    e = table(spark, d, "events", u=EVENT_URL)
    return strip_columns(e, F.col("u"), lambda s: ~spared(s) & ((name(s) == "tag") | C.any_match(matchers, s))).select("event_id", *RESULT)


@query("exclude_domains", stripped("events", "event_id", f"({GONE} AND NOT (h = 'example.com' OR suffix(h, '.example.com') OR h = 'x.com' OR suffix(h, '.x.com')))", "u0").replace("FROM events", f"FROM (SELECT *, {HOST.format(u='u0')} AS h FROM (SELECT *, {EVENT_URL} AS u0 FROM events))"))
def exclude_domains(spark, d):
    """Hosts at or below an excluded domain are left alone."""
    matchers = C.global_params(rules())
    e = table(spark, d, "events", u=EVENT_URL).withColumn("spared", C.host_in(C.host(F.col("u")), ["example.com", "x.com"]))
    return strip_columns(e, F.col("u"), lambda s: ~F.col("spared") & C.any_match(matchers, s)).select("event_id", *RESULT)


@query("param_join", stripped("events", "event_id", f"{NAME} IN ({quoted(EXACT)})", EVENT_URL).replace("SELECT event_id, ", "SELECT event_id, cleaned_url, n_removed FROM (SELECT event_id, ", 1) + ")")
def param_join(spark, d):
    """Parameters tested against the table of names, for packs of any size."""
    return ops.strip_by_join(table(spark, d, "events", url=EVENT_URL), ops.rule_table(spark, rules())).select("event_id", "cleaned_url", "n_removed")


@query("brave_raw_key", stripped("events", "event_id", "(string_split(s, '=')[1] = 'si' AND contains(s, '=') AND regexp_matches(u, '(?is)^.*://www[.]youtube[.]com/.*$'))", EVENT_URL))
def brave_raw_key(spark, d):
    """A raw-name rule with a glob scope, from its own pack syntax."""
    pack = load([("p", json.dumps([{"include": ["*://www.youtube.com/*"], "exclude": [], "params": ["si"]}]))], with_builtin=False)
    rule = pack.params[0][0]
    e = table(spark, d, "events", u=EVENT_URL).withColumn("inside", F.col("u").rlike(glob_regex(rule.include[0].pattern).replace(r"\Z", r"\z")))
    return strip_columns(e, F.col("u"), lambda s: F.col("inside") & C.matches(rule.matcher, s)).select("event_id", *RESULT)


@query("adguard_removeparam", stripped("events", "event_id", "(regexp_matches(url_decode(replace(s, '+', ' ')), '^(?:(?:s|source)=[0-9z]+)$') AND contains(s, '='))", EVENT_URL))
def adguard_removeparam(spark, d):
    """A regular expression over decoded pairs, from a filter line."""
    rule = load([("f", "*$removeparam=/(?:s|source)=[0-9z]+/")], formats={"f": "ad-guard"}, with_builtin=False).params[0][0]
    return strip_columns(table(spark, d, "events", u=EVENT_URL), F.col("u"), lambda s: C.matches(rule.matcher, s)).select("event_id", *RESULT)


@query("adguard_exception_anti", stripped("events", "event_id", "(string_split(s, '=')[1] = 'tag' AND contains(s, '=') AND NOT regexp_matches(u, '^[a-z]+://(?:[^/?#]*[.@])?example[.]com(?:[^A-Za-z0-9_.%-]|$)'))", EVENT_URL))
def adguard_exception_anti(spark, d):
    """A rule, and an exception with the same matcher on some hosts."""
    pack = load([("f", "$removeparam=tag\n@@||example.com^$removeparam=tag")], formats={"f": "ad-guard"}, with_builtin=False)
    rule, spared = (p for p, _ in pack.params)
    scope = target_regex(spared.include[0].pattern).replace(r"\Z", r"\z")
    e = table(spark, d, "events", u=EVENT_URL).withColumn("spared", F.col("u").rlike(scope))
    return strip_columns(e, F.col("u"), lambda s: ~F.col("spared") & C.matches(rule.matcher, s)).select("event_id", *RESULT)


@query("redirect_query_param", f"SELECT event_id, CASE WHEN len(v) = 1 THEN v[1] END AS target FROM (SELECT event_id, list_distinct(list_transform(list_filter(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&'), lambda s: starts_with(s, 'url=')), lambda s: substr(s, 5))) AS v FROM (SELECT event_id, {WRAPPED} AS u FROM events))")
def redirect_query_param(spark, d):
    """The value of one parameter by its raw name; several different values give none."""
    return table(spark, d, "events", u=WRAPPED).select("event_id", C.query_value(F.col("u"), "url").alias("target"))


@query("redirect_first_match", f"SELECT event_id, coalesce(" + ", ".join(f"CASE WHEN regexp_matches(u, '(?i){r.pattern}') THEN regexp_extract(u, '(?i){r.pattern}', 1) END" for r in PACK.redirects) + f") AS target FROM (SELECT event_id, {WRAPPED} AS u FROM events)")
def redirect_first_match(spark, d):
    """The target by the first redirect rule in load order."""
    return table(spark, d, "events", u=WRAPPED).select("event_id", C.redirect_target(F.col("u"), rules()).alias("target"))


PATH_URL = "concat('https://r.example.net/go/', CAST(o_orderkey % 9 AS VARCHAR(20)), '/', CASE WHEN o_orderkey % 3 = 0 THEN 'shop.example.com' ELSE 'x' END, '/item-', CAST(o_custkey AS VARCHAR(20)))"


@query("redirect_path_regex", f"SELECT o_orderkey, CASE WHEN regexp_matches(u, '^https://r[.]example[.]net/go/[0-9]/[a-z.]+[.]com/item-[0-9]+$') THEN regexp_replace(u, '^https://r[.]example[.]net/go/[0-9]/([a-z.]+[.]com)/item-([0-9]+)$', 'https://\\1/p/\\2') END AS target FROM (SELECT o_orderkey, {PATH_URL} AS u FROM orders)")
def redirect_path_regex(spark, d):
    """A template filled from groups of the path."""
    pattern = r"^/go/[0-9]/([a-z.]+[.]com)/item-([0-9]+)\z"
    p = C.path(F.col("u"))
    return table(spark, d, "orders", u=PATH_URL).select("o_orderkey", F.when(p.rlike(pattern), F.regexp_replace(p, pattern, "https://$1/p/$2")).alias("target"))


TOKEN = "CASE WHEN o_orderkey % 5 = 4 THEN 'not_base64!' ELSE replace(replace(regexp_replace({b64}, '=+$', ''), '+', '-'), '/', '_') END"


@query("redirect_base64", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN concat('https://shop.example.com/?o=', CAST(o_orderkey AS VARCHAR), '&x=~~~???') END AS target FROM orders")
def redirect_base64(spark, d):
    """Targets in URL-safe base64."""
    o = table(spark, d, "orders", token=TOKEN.format(b64="replace(base64(CAST(concat('https://shop.example.com/?o=', CAST(o_orderkey AS STRING), '&x=~~~???') AS BINARY)), '\\r\\n', '')"))
    return o.select("o_orderkey", C.base64_text(F.col("token")).alias("target"))


IP = "concat(CAST(l_orderkey % 256 AS VARCHAR(20)), '.', CAST(l_partkey % 256 AS VARCHAR(20)), '.', CAST(l_suppkey % 4 AS VARCHAR(20)), '.', CAST(l_linenumber AS VARCHAR(20)))"
PRIVATE = "(a = 127 OR a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 0 AND b = 0 AND c = 0 AND d = 0) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b IN (18, 19)) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224)"


@query("private_ipv4", f"SELECT a AS first_octet, {PRIVATE} AS blocked, count(*) AS n FROM (SELECT l_orderkey % 256 AS a, l_partkey % 256 AS b, l_suppkey % 4 AS c, l_linenumber AS d FROM lineitem) GROUP BY ALL")
def private_ipv4(spark, d):
    """Addresses outside the public internet, by first octet."""
    x = table(spark, d, "lineitem", ip=IP)
    return x.groupBy(F.regexp_extract("ip", r"^(\d+)", 1).cast("long").alias("first_octet"), C.blocked_ipv4(F.col("ip")).alias("blocked")).agg(F.count("*").alias("n"))


GOAL = "concat(CASE o_orderkey % 6 WHEN 0 THEN 'https://ok.example.com/' WHEN 1 THEN 'ftp://files.example.com/' WHEN 2 THEN 'https://user@host.example/' WHEN 3 THEN 'http://192.168.1.7/' WHEN 4 THEN 'javascript:alert(1)//' ELSE 'https://93.184.216.34/' END, CAST(o_custkey AS VARCHAR(20)))"


@query("validate_destination", f"SELECT reason, count(*) AS n FROM (SELECT CASE o_orderkey % 6 WHEN 1 THEN 'bad-scheme:ftp' WHEN 2 THEN 'userinfo' WHEN 3 THEN 'private-ip' WHEN 4 THEN 'bad-scheme:javascript' END AS reason FROM orders) GROUP BY ALL")
def validate_destination(spark, d):
    """Why redirect targets are not taken."""
    return table(spark, d, "orders", goal=GOAL).groupBy(C.reject_reason(F.col("goal")).alias("reason")).agg(F.count("*").alias("n"))


@query("host_suffix_join", f"SELECT dom, count(*) AS n FROM (SELECT {HOST.format(u=EVENT_URL)} AS h FROM events) JOIN (VALUES ('amazon.de'), ('example.com'), ('com'), ('spotify.com'), ('org')) AS t(dom) ON h = dom OR suffix(h, '.' || dom) GROUP BY ALL")
def host_suffix_join(spark, d):
    """Hosts joined with a table of domains on their exploded suffixes: an equi-join."""
    domains = spark.createDataFrame([(x,) for x in ("amazon.de", "example.com", "com", "spotify.com", "org")], "dom string")
    e = table(spark, d, "events", u=EVENT_URL).select(F.explode(C.host_suffixes(C.host(F.col("u")))).alias("suffix"))
    return e.join(domains, e.suffix == domains.dom).groupBy("dom").agg(F.count("*").alias("n"))


@query("extract_links", "SELECT page_id, CAST(unnest(range(len(l))) AS INTEGER) AS place, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1) AS l FROM pages)")
def extract_links(spark, d):
    """Every link of every page, in page order."""
    return table(spark, d, "pages").select("page_id", F.posexplode(C.links(F.col("html"))).alias("place", "href"))


IMG = {
    "src": "concat(CASE event_id % 4 WHEN 0 THEN 'https://cdn.example.com/img/' WHEN 1 THEN 'https://ad.doubleclick.net/' WHEN 2 THEN 'cid:' ELSE 'https://t.example.com/open/' END, CAST(event_id AS VARCHAR(20)), '.gif')",
    "width": "CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '600' END",
    "height": "CASE event_id % 5 WHEN 0 THEN '1px' WHEN 1 THEN '50%' END",
    "alt": "CASE WHEN event_id % 7 = 0 THEN 'Photo' ELSE ' ' END",
    "style": "CASE event_id % 11 WHEN 0 THEN 'display: none' WHEN 1 THEN 'width:1px; height:2px' WHEN 2 THEN 'opacity:0.0' WHEN 3 THEN 'display:none !important' ELSE '' END",
    "hint": "CASE WHEN event_id % 13 = 0 THEN 'site-logo' ELSE 'x' END",
}
IMG_SQL = "SELECT event_id, " + ", ".join(f"{v} AS {k}" for k, v in IMG.items()) + " FROM events"
HIDDEN_SQL = "(replace(style, ' ', '') IN ('display:none') OR replace(style, ' ', '') = 'opacity:0.0')"


@query("pixel_classify", f"SELECT event_id, starts_with(src, 'http') AND (contains(src, 'doubleclick.net') OR {HIDDEN_SQL} OR (trim(alt) = '' AND (greatest(w, h) <= 2 OR (w IS NULL AND h IS NULL AND hint <> 'site-logo' AND (contains(src, '/open/') OR regexp_matches(src, '/[a-z0-9]{{0,2}}[.]gif$')))))) AS pixel FROM (SELECT *, coalesce(CAST(width AS INTEGER), CASE WHEN style LIKE 'width:1px%' THEN 1 END) AS w, coalesce(CASE height WHEN '1px' THEN 1 END, CASE WHEN style LIKE 'width:1px%' THEN 2 END) AS h FROM ({IMG_SQL}))".replace("greatest(w, h) <= 2", "coalesce(greatest(w, h) <= 2, false)"))
def pixel_classify(spark, d):
    """Tracking pixels among images."""
    e = table(spark, d, "events", **IMG)
    beacon = F.lit(False)
    for p in rules().providers:
        if p.complete:
            beacon = beacon | F.col("src").rlike("(?i)" + p.pattern)
    return e.select("event_id", C.is_pixel(*[F.col(c) for c in ("src", "width", "height", "alt", "style", "hint")], beacon).alias("pixel"))


@query("style_hidden", f"SELECT style, {HIDDEN_SQL} AS hidden, count(*) AS n FROM ({IMG_SQL}) GROUP BY ALL")
def style_hidden(spark, d):
    """Styles that hide their element."""
    return table(spark, d, "events", **IMG).groupBy("style", C.style_hidden(F.col("style")).alias("hidden")).agg(F.count("*").alias("n"))


STYLE = "concat('color:red;background:url(', CASE event_id % 3 WHEN 0 THEN 'https://x.example/' WHEN 1 THEN 'data:abc' ELSE 'http://y.example/' END, CAST(event_id AS VARCHAR(20)), ');margin:0')"


@query("css_url_neutralize", f"SELECT event_id, regexp_replace(s, 'url\\(https?://[^)]*\\)', 'none', 'g') AS style FROM (SELECT event_id, {STYLE} AS s FROM events)")
def css_url_neutralize(spark, d):
    """Remote url(...) values made none."""
    return table(spark, d, "events", s=STYLE).select("event_id", C.css_neutralise(F.col("s")).alias("style"))


@query("canonical_link_sort", f"SELECT event_id, regexp_extract(u, '^([a-z]+)://', 1) || '://' || {HOST.format(u='u')} || regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) || '?' || array_to_string(list_sort(string_split(regexp_extract(u, '\\?([^#]*)', 1), '&')), '&') AS canonical FROM (SELECT event_id, {EVENT_URL} AS u FROM events)")
def canonical_link_sort(spark, d):
    """Links in a form that compares equal whatever the order of parameters."""
    return table(spark, d, "events", u=EVENT_URL).select("event_id", C.canonical_link(F.col("u")).alias("canonical"))


@query("sensitive_link_anti", f"SELECT event_id FROM events WHERE NOT (event_id % 3 = 0 AND user_id % 2 = 0)")
def sensitive_link_anti(spark, d):
    """Links that aren't protected ones of the same user, compared in canonical form."""
    e = table(spark, d, "events", u=EVENT_URL)
    safe = e.where("event_id % 3 = 0 and user_id % 2 = 0").select(F.col("user_id").alias("k"), C.canonical_link(F.col("u")).alias("c"))
    return e.withColumn("canonical", C.canonical_link(F.col("u"))).join(safe, (F.col("user_id") == F.col("k")) & (F.col("canonical") == F.col("c")), "left_anti").select("event_id")


SENDER = "concat('Shop <news@', CASE o_orderkey % 6 WHEN 0 THEN 'mail.PayPal.com' WHEN 1 THEN 'shop.example.com' WHEN 2 THEN 'github.com.' WHEN 3 THEN 'notgithub.com' WHEN 4 THEN 'a.b.shop.example.com' ELSE 'example.org' END, '>')"


@query("sender_policy", "SELECT CASE o_orderkey % 6 WHEN 0 THEN 'sensitive-sender' WHEN 1 THEN 'custom:shop.example.com' WHEN 2 THEN 'sensitive-sender' WHEN 4 THEN 'custom:shop.example.com' ELSE 'default' END AS policy, count(*) AS n FROM orders GROUP BY ALL")
def sender_policy(spark, d):
    """The policy of each sender: the first that matches, the built-in list last."""
    domain = C.sender_domain(F.col("sender"))
    policy = F.when(C.host_in(domain, ["shop.example.com"]), "custom:shop.example.com").when(C.host_in(domain, SENSITIVE), "sensitive-sender").otherwise("default")
    return table(spark, d, "orders", sender=SENDER).groupBy(policy.alias("policy")).agg(F.count("*").alias("n"))


UNSUB = "concat('<mailto:u@x.example>', CASE o_orderkey % 3 WHEN 0 THEN ', <https://x.example/u?id=' WHEN 1 THEN ', < >, <HTTP://x.example/v?id=' ELSE ', <mailto:' END, CAST(o_orderkey AS VARCHAR(20)), '>')"


@query("unsubscribe_pick", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat('https://x.example/u?id=', CAST(o_orderkey AS VARCHAR)) WHEN 1 THEN concat('HTTP://x.example/v?id=', CAST(o_orderkey AS VARCHAR)) ELSE 'mailto:u@x.example' END AS target FROM orders")
def unsubscribe_pick(spark, d):
    """The first web target of List-Unsubscribe, else the first target."""
    return table(spark, d, "orders", h=UNSUB).select("o_orderkey", C.unsubscribe(F.col("h")).alias("target"))


@query("header_sanitize", "SELECT o_orderkey, replace(replace(concat('a', chr(13), chr(10), 'X: ', o_orderpriority), chr(13), ' '), chr(10), ' ') AS value FROM orders")
def header_sanitize(spark, d):
    """Header values without control characters."""
    return table(spark, d, "orders").select("o_orderkey", C.safe_header(F.concat(F.lit("a\r\nX: "), "o_orderpriority")).alias("value"))


@query("clean_stats_sum", stripped("events", "event_id", GONE, EVENT_URL).join(("SELECT count(*) AS urls, sum(CAST(n_removed > 0 AS BIGINT)) AS cleaned, sum(n_removed) AS removed FROM (", ")")))
def clean_stats_sum(spark, d):
    """Totals over all cleaned URLs."""
    matchers = C.global_params(rules())
    e = strip_columns(table(spark, d, "events", u=EVENT_URL), F.col("u"), lambda s: C.any_match(matchers, s))
    return e.agg(F.count("*").alias("urls"), F.sum((F.col("n_removed") > 0).cast("long")).alias("cleaned"), F.sum("n_removed").alias("removed"))


@query("rule_dedup", "SELECT count(DISTINCT lower(p_brand)) AS loaded, count(DISTINCT (lower(p_brand), p_size)) - count(DISTINCT lower(p_brand)) AS duplicates, count(DISTINCT p_size) AS providers FROM part")
def rule_dedup(spark, d):
    """A pack whose providers share a URL pattern, compiled: equal rules become one, with the number of duplicates.

    The pack has a provider for each size and a rule for each of its brands, so it is bounded whatever the table's size.
    """
    sizes = table(spark, d, "part").groupBy("p_size").agg(F.collect_set(F.lower("p_brand")).alias("brands")).collect()
    pack = {"providers": {f"p{r.p_size}": {"urlPattern": "https://x[.]example", "rules": sorted(x.replace("#", "") for x in r.brands)} for r in sizes}}
    report = load([("parts", json.dumps(pack))], with_builtin=False)
    return spark.createDataFrame([(report.reports[0].loaded, report.reports[0].duplicates, len(report.providers))], "loaded long, duplicates long, providers long")


PACK_JSON = json.dumps(builtin.pack()).replace("'", "''")
RULES_SQL = f"""
WITH pack AS (SELECT CAST('{PACK_JSON}' AS JSON) -> 'providers' AS p),
each AS (SELECT name, p -> name AS v FROM (SELECT p, unnest(json_keys(p)) AS name FROM pack)),
rules AS (SELECT name, unnest(CAST(coalesce(v -> 'rules', '[]') AS VARCHAR[])) AS r FROM each),
kinds AS (
  SELECT name, r, CASE WHEN regexp_matches(r, '^[A-Za-z0-9_-]+[.][*]$') THEN 'prefix' WHEN regexp_matches(r, '[.*+?[]') THEN 'regex' ELSE 'exact' END AS kind,
         CASE WHEN contains(r, '(') THEN len(string_split(r, '|')) ELSE 1 END AS n FROM rules
),
sizes AS (
  SELECT count(*) AS providers, count(*) FILTER (v ->> 'completeProvider' = 'true') AS beacons, sum(coalesce(json_array_length(v -> 'redirections'), 0)) AS redirects FROM each
),
counts AS (
  SELECT coalesce(sum(n), 0) AS params, sum(n) FILTER (kind = 'exact') AS exact, sum(n) FILTER (kind = 'prefix') AS prefix, sum(n) FILTER (kind = 'regex') AS regex, count(DISTINCT name) - 1 AS scopes FROM kinds
)
SELECT name, CAST(value AS BIGINT) AS value FROM (
  SELECT unnest(['sources', 'providers', 'params', 'exact', 'prefix', 'regex', 'redirects', 'beacons', 'raw_rules', 'scopes', 'duplicates']) AS name,
         unnest([1, providers, params, exact, prefix, regex, redirects, beacons, 0, scopes, 0]) AS value FROM sizes, counts)
"""


@query("rule_stats", RULES_SQL)
def rule_stats(spark, d):
    """Counters of the compiled built-in pack."""
    return reports.rule_stats(spark, rules())


@query("glob_match", f"SELECT event_id FROM (SELECT event_id, {EVENT_URL} AS u FROM events) WHERE regexp_matches(lower(u), '^https://[^.]*[.]?.*example[.].*/p/.*[?].*tag=.*$')".replace("[^.]*[.]?.*example", ".*example"))
def glob_match(spark, d):
    """URLs that a glob covers as wholes."""
    return table(spark, d, "events", u=EVENT_URL).where(C.glob(F.col("u"), "https://*EXAMPLE.*/p/*?*tag=*")).select("event_id")


@query("tracker_summary", f"SELECT count(*) FILTER (regexp_matches(u, '(?:sendgrid[.]net|/ls/click[?]|hubspotlinks[.]com|links[.]iterable[.]com)')) AS wrappers, count(*) AS links FROM (SELECT {WRAPPED} AS u FROM events)")
def tracker_summary(spark, d):
    """How many links are click wrappers of mail services."""
    wrappers = ("sendgrid", "sendgrid_branded", "hubspot", "iterable")
    e = table(spark, d, "events", u=WRAPPED)
    return e.agg(F.count_if(C.provider(F.col("u"), rules()).isin(*wrappers)).alias("wrappers"), F.count("*").alias("links"))


# ---- links, pages and messages: what the engine must make of them, put together in SQL from their parts ----
FULL = "(" + GONE + "".join(
    f" OR (regexp_matches(u, '(?i){p.pattern}') AND (" + " OR ".join([f"{NAME} IN ({quoted(sorted({m.value for m in ms if m.kind == 'exact'}))})", *(f"regexp_matches({NAME}, '{m.value}')" for m in ms if m.kind == "regex")]) + "))"
    for p in PACK.providers if not p.is_global and (ms := C.vendor_params(PACK, p.name))
) + ")"
EVENT_CLEAN, WRAPPED_CLEAN = stripped("events", "event_id", FULL, EVENT_URL), stripped("events", "event_id", FULL, WRAPPED, "user_id, u,")
#: Of each event's two links: x cleaned, y where the wrapper leads, and the verdicts.
LINKS_SQL = f"""
SELECT event_id, u0, w, x, CASE WHEN n_x > 0 THEN 'clean' ELSE 'unchanged' END AS vx, y, provider, rejected,
       CASE WHEN rejected IS NULL AND provider IS NOT NULL THEN 'unwrap' WHEN y <> w THEN 'clean' WHEN rejected IS NOT NULL THEN 'rejected:' || rejected ELSE 'unchanged' END AS vy, removed_x
FROM (SELECT e.event_id, e.u AS u0, e.cleaned_url AS x, e.n_removed AS n_x, e.removed AS removed_x, v.u AS w,
             CASE e.event_id % 6 WHEN 0 THEN 'sendgrid' WHEN 1 THEN 'hubspot' WHEN 2 THEN 'iterable' WHEN 3 THEN 'sendgrid_branded' WHEN 4 THEN 'google' END AS provider,
             CASE WHEN e.event_id % 6 = 5 THEN NULL WHEN e.event_id % 4 = 2 THEN 'private-ip' WHEN e.event_id % 4 = 3 THEN 'userinfo' END AS rejected,
             CASE WHEN e.event_id % 6 <> 5 AND e.event_id % 4 = 0 THEN 'https://dest.example.com/' || v.user_id WHEN e.event_id % 6 <> 5 AND e.event_id % 4 = 1 THEN 'https://dest.example.org/p?a=1' || v.user_id ELSE v.cleaned_url END AS y
      FROM ({stripped("events", "event_id", FULL, EVENT_URL, "u,")}) e JOIN ({WRAPPED_CLEAN}) v USING (event_id))
"""
TEXT = f"concat('See ', {EVENT_URL}, '.')"


@query("text_url_clean", f"SELECT event_id, 'See ' || cleaned_url || '.' AS text, CAST(n_removed > 0 AS BIGINT) AS n FROM ({EVENT_CLEAN})")
def text_url_clean(spark, d):
    """URLs inside plain text, cleaned and not unwrapped."""
    from .functions.html import clean_text

    engine = Engine(rules())
    return ops.by_row(table(spark, d, "events", body=TEXT).select("event_id", "body"), ["body"], [("text", "string"), ("n", "long")], lambda t: clean_text(t, engine)).select("event_id", "text", "n")


@query("unwrap_urls", f"SELECT event_id, y AS final_url, vy = 'unwrap' AS unwrapped, provider, rejected FROM ({LINKS_SQL})")
def unwrap_urls(spark, d):
    """Wrapped links resolved offline, with provider and reason."""
    return ops.unwrap_urls(table(spark, d, "events", url=WRAPPED).select("event_id", "url"), Engine(rules())).drop("url")


MAIL_HTML = f"concat('<p><a href=\"', {EVENT_URL}, '\">a</a><a href=\"', {WRAPPED}, '\" ping=\"https://p.example/\">b</a><a href=\"#top\">c</a><area href=\"mailto:a@b.example\"><img src=\"https://t.example.com/o.gif\" width=\"1\" height=\"1\"><img src=\"https://cdn.example.com/photo.jpg\" width=\"600\" alt=\"x\"></p>')"


@query("explain_links", f"SELECT event_id, unnest([0, 1, 2, 3]) AS place, unnest([u0, w, '#top', 'mailto:a@b.example']) AS href, unnest([vx, vy, 'skip', 'skip']) AS verdict, unnest([CASE WHEN vx = 'clean' THEN x END, CASE WHEN vy IN ('clean', 'unwrap') THEN y END, NULL, NULL]) AS new_href FROM ({LINKS_SQL})")
def explain_links(spark, d):
    """The verdict on every link of a page."""
    return ops.explain_links(table(spark, d, "events", html=MAIL_HTML), Engine(rules()), key="event_id")


@query("explain_page_links", "SELECT page_id, CAST(unnest(range(len(l))) AS INTEGER) AS place, unnest(l) AS href, CASE WHEN starts_with(unnest(l), '#') THEN 'skip' ELSE 'unchanged' END AS verdict FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1) AS l FROM pages)")
def explain_page_links(spark, d):
    """The verdict on every link of every page, against the page's own URL."""
    return ops.explain_links(table(spark, d, "pages"), Engine(rules()), base_col="url").select("page_id", "place", "href", "verdict")


COUNTS = "CAST(CAST(vx = 'clean' AS INT) + CAST(vy = 'clean' AS INT) AS BIGINT) AS urls_cleaned, CAST(vy = 'unwrap' AS BIGINT) AS redirects_unwrapped, CAST(1 AS BIGINT) AS pixels_removed, CAST(1 AS BIGINT) AS pings_stripped"


@query("html_rewrite", f"SELECT event_id, true AS changed, {COUNTS}, '<p><a href=\"' || x || '\">a</a><a href=\"' || y || '\" >b</a><a href=\"#top\">c</a><area href=\"mailto:a@b.example\"><img src=\"https://cdn.example.com/photo.jpg\" width=\"600\" alt=\"x\"></p>' AS cleaned_html FROM ({LINKS_SQL})")
def html_rewrite(spark, d):
    """HTML rewritten: links cleaned and unwrapped, pings and pixels taken out, all else as it was."""
    return ops.clean_html(table(spark, d, "events", html=MAIL_HTML).select("event_id", "html"), Engine(rules())).drop("html")


@query("html_rewrite_pages", "SELECT page_id, false AS changed, sha256(html) AS sha FROM pages")
def html_rewrite_pages(spark, d):
    """Whole pages, which have no tracking: every byte stays."""
    return ops.clean_html(table(spark, d, "pages"), Engine(rules()), base_col="url").select("page_id", "changed", F.sha2("cleaned_html", 256).alias("sha"))


MESSAGE = f"CAST(concat('From: Shop <news@shop.example.com>\\r\\nList-Unsubscribe: <https://shop.example.com/u?utm_a=', CAST(event_id AS STRING), '>\\r\\nContent-Type: text/html; charset=utf-8\\r\\n\\r\\n<p><a href=\"', {EVENT_URL}, '\">a</a><a href=\"', {WRAPPED}, '\" ping=\"https://p.example/\">b</a><img src=\"https://t.example.com/o.gif\" width=\"1\" height=\"1\"></p>\\r\\n') AS BINARY)"
HEADERS_SQL = "['Version: 1', 'Mode: enforce', 'Modified: yes', 'Html-Parts: 1', 'Urls-Cleaned: ' || urls_cleaned, 'Redirects-Unwrapped: ' || redirects_unwrapped, 'Pixels-Removed: 1', 'Pings-Stripped: 1', 'Policy: default', 'Unsubscribe: https://shop.example.com/u?utm_a=' || event_id]"
MAIL_SQL = f"""
SELECT *, list_transform({HEADERS_SQL}, lambda h: 'X-Mailsieve-' || h) AS hs FROM (SELECT *, {COUNTS} FROM ({LINKS_SQL}))
"""


@query("mime_clean", f"SELECT event_id, CAST(1 AS BIGINT) AS html_parts, urls_cleaned, redirects_unwrapped, pixels_removed, pings_stripped, true AS modified, 'enforce' AS mode, 'default' AS policy, 10 AS n_headers, sha256(array_to_string(['From: Shop <news@shop.example.com>', 'List-Unsubscribe: <https://shop.example.com/u?utm_a=' || event_id || '>', 'Content-Type: text/html; charset=utf-8', array_to_string(hs, chr(13) || chr(10)), '', '<p><a href=\"' || x || '\">a</a><a href=\"' || y || '\" >b</a></p>', ''], chr(13) || chr(10))) AS sha FROM ({MAIL_SQL})")
def mime_clean(spark, d):
    """Whole messages cleaned, with counters and audit headers."""
    e = table(spark, d, "events", raw=MESSAGE).select("event_id", "raw")
    policies = (Policy(("quiet.example",), mode="report-only"),)
    out = ops.clean_messages(e, Engine(rules(), Config(sender_policies=policies)))
    return out.select("event_id", "html_parts", "urls_cleaned", "redirects_unwrapped", "pixels_removed", "pings_stripped", "modified", "mode", "policy", F.size("audit_headers").alias("n_headers"), F.sha2("cleaned", 256).alias("sha"))


@query("audit_headers", f"SELECT event_id, array_to_string(hs, '; ') AS headers FROM ({MAIL_SQL})")
def audit_headers(spark, d):
    """The audit headers of every message, in their order; those that are zero by default are left out."""
    out = ops.clean_messages(table(spark, d, "events", raw=MESSAGE).select("event_id", "raw"), Engine(rules()))
    return out.select("event_id", F.array_join(F.transform("audit_headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "; ").alias("headers"))


@query("message_totals", f"SELECT count(*) AS messages, count(*) AS html_parts, CAST(sum(urls_cleaned) AS BIGINT) AS urls_cleaned, CAST(sum(redirects_unwrapped) AS BIGINT) AS redirects_unwrapped, count(*) AS pixels_removed, count(*) AS pings_stripped, CAST(0 AS BIGINT) AS errors, count(*) AS modified FROM ({MAIL_SQL})")
def message_totals(spark, d):
    """Totals over all messages."""
    return reports.totals(ops.clean_messages(table(spark, d, "events", raw=MESSAGE).select("event_id", "raw"), Engine(rules())))


@query("message_links", f"SELECT event_id, unnest([1, 2]) AS place, unnest([u0, w]) AS href, unnest([vx, vy]) AS verdict, unnest([NULL, provider]) AS provider, unnest([replace(removed_x, ',', ' '), CASE WHEN vy IN ('unwrap', 'unchanged') OR event_id % 6 <> 4 THEN CASE event_id % 6 WHEN 4 THEN 'sa' ELSE '' END ELSE 'sa' END]) AS removed FROM ({LINKS_SQL})")
def message_links(spark, d):
    """Every link of every message with its verdict, provider and removed parameters."""
    out = reports.explain_messages(table(spark, d, "events", raw=MESSAGE), Engine(rules()), key="event_id")
    return out.select("event_id", "place", "href", "verdict", "provider", F.array_join("removed", " ").alias("removed"))


@query("message_trackers", f"SELECT event_id, CAST(provider IS NOT NULL AS BIGINT) AS redirect_wrappers, CAST(CAST(vx = 'clean' AS INT) + CAST(provider = 'google' AND provider IS NOT NULL AS INT) AS BIGINT) AS param_tracking_links, CAST(1 AS BIGINT) AS tracking_pixels, CAST(1 AS BIGINT) AS link_pings FROM ({LINKS_SQL})")
def message_trackers(spark, d):
    """The trackers of every message."""
    return reports.trackers(table(spark, d, "events", raw=MESSAGE), Engine(rules()), key="event_id")


@query("qp_encode", "SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '\r?\n', chr(13) || chr(10), 'g')) AS sha, true AS fits FROM documents")
def qp_encode(spark, d):
    """Documents in quoted-printable and back: the text with network line ends; every line is ASCII of at most 76 bytes."""
    import quopri

    from .functions.mime import quoted_printable

    def one(t):
        encoded = quoted_printable((t or "").encode())
        return quopri.decodestring(encoded), encoded.isascii() and max(map(len, encoded.split(b"\r\n"))) <= 76

    docs = table(spark, d, "documents").select("doc_id", "text")
    return ops.by_row(docs, ["text"], [("decoded", "binary"), ("fits", "boolean")], one).select("doc_id", F.sha2("decoded", 256).alias("sha"), "fits")


LINE = "concat('<a href=\"https://a.example/?utm_a=', CAST(turn AS VARCHAR(20)), '&k=', CAST(turn AS VARCHAR(20)), '\">', role, '</a>')"


@query("milter_session", f"""
WITH c AS (SELECT conv_id, count(*) AS n, sha256(string_agg(replace(l, 'utm_a=' || turn || '&', ''), '' ORDER BY turn, l)) AS body FROM (SELECT conv_id, turn, {LINE} AS l FROM conversations) GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS conn_id, 'O' AS action, CAST(1 AS BIGINT) AS n, NULL AS body FROM c
UNION ALL SELECT CAST(conv_id AS VARCHAR), 'c', n + 3, NULL FROM c
UNION ALL SELECT CAST(conv_id AS VARCHAR), 'h', 9, NULL FROM c
UNION ALL SELECT CAST(conv_id AS VARCHAR), 'b', 1, body FROM c
""")
def milter_session(spark, d):
    """Sessions of a mail filter, one for each conversation, replayed as a batch through the session logic: the replies of each kind, and the new body."""
    import pandas as pd

    from .streaming.session import OUTPUT, Session

    engine = Engine(rules())
    c = table(spark, d, "conversations", l=LINE).select(F.col("conv_id").cast("string").alias("conn_id"), F.col("turn").alias("seq"), F.lit("B").alias("cmd"), F.encode("l", "utf-8").alias("payload"))
    ends = c.select("conn_id").distinct()
    fixed = lambda seq, cmd, payload: ends.select("conn_id", F.lit(seq).cast("long").alias("seq"), F.lit(cmd).alias("cmd"), F.lit(payload).alias("payload"))
    packets = c
    for part in (fixed(-3, "O", b"\0\0\0\x06\0\0\0\x03"), fixed(-2, "M", b""), fixed(-1, "L", b"Content-Type\0text/html\0"), fixed(1 << 40, "E", b""), fixed((1 << 40) + 1, "Q", b"")):
        packets = packets.unionByName(part)

    def run(key, frame):
        s, out = Session(engine.config.max_message_size), []
        for r in frame.sort_values(["seq", "payload"]).itertuples():
            out += [(key[0], r.seq, a, p) for a, p in s.feed(r.cmd, bytes(r.payload), engine)]
        return pd.DataFrame(out, columns=["conn_id", "seq", "action", "payload"])

    replies = packets.groupBy("conn_id").applyInPandas(run, OUTPUT)
    return replies.groupBy("conn_id", "action").agg(F.count("*").alias("n"), F.max(F.when(F.col("action") == "b", F.sha2("payload", 256))).alias("body"))


from . import cases  # noqa: E402  the same for functions on single values

QUERIES |= cases.QUERIES
ORACLE |= cases.ORACLE
