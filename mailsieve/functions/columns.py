"""Native column functions: they stay inside the JVM and whole-stage code generation.

They work on URLs in normal form (see ``url.parse``); ``operators.normalise_urls`` makes others normal.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.packs import Matcher, Ruleset
from .engine import needed
from .html import EXTENSIONS, LAYOUT, NEEDLES


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    """The query; null without one."""
    q = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.when(url.rlike(r"^[^?#]*\?"), q)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, "(#.*)$", 1)


def form_decode(text: Column) -> Column:
    """'+' and percent escapes decoded; escapes that aren't any stay as they are."""
    safe = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), text)


def segment_name(segment: Column) -> Column:
    return F.substring_index(segment, "=", 1)


def host_suffixes(name: Column) -> Column:
    """The host and everything after each of its dots."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def host_in(name: Column, domains: Iterable[str]) -> Column:
    """The host is one of a few domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (name == d) | F.endswith(name, F.lit("." + d))
    return out


def matches(m: Matcher, segment: Column) -> Column:
    raw = segment_name(segment)
    name = raw if m.subject == "raw-name" else form_decode(raw)
    if m.subject == "decoded-pair":
        name = F.concat(form_decode(raw), F.lit("="), form_decode(F.regexp_extract(segment, "^[^=]*=(.*)$", 1)))
    value = m.value if m.case else m.value.lower()
    subject = name if m.case or m.kind == "regex" else F.lower(name)
    out = {"exact": lambda: subject == value, "prefix": lambda: F.startswith(subject, F.lit(value)), "regex": lambda: subject.rlike(m.value)}[m.kind]()
    return out & F.contains(segment, F.lit("=")) if m.needs_equals else out


def any_match(matchers: Iterable[Matcher], segment: Column) -> Column:
    """One test for many matchers: plain names as one IN list."""
    matchers = list(matchers)
    plain = sorted({m.value.lower() for m in matchers if m.kind == "exact" and not m.case and m.subject == "decoded-name" and not m.needs_equals})
    out = F.lower(form_decode(segment_name(segment))).isin(plain) if plain else F.lit(False)
    for m in matchers:
        if not (m.kind == "exact" and m.value.lower() in plain):
            out = out | matches(m, segment)
    return out


def strip(url: Column, removes) -> tuple[Column, Column]:
    """(cleaned URL, decoded names of the removed segments): ``removes`` tests one segment of the query."""
    segments = F.split(query(url), "&")
    gone = F.filter(segments, lambda s: (s != "") & removes(s))
    kept = F.filter(segments, lambda s: (s != "") & ~removes(s))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    cleaned = F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), tail, fragment(url))
    changed = F.coalesce(F.size(gone) > 0, F.lit(False))
    return F.when(changed, cleaned).otherwise(url), F.when(changed, F.transform(gone, lambda s: form_decode(segment_name(s)))).otherwise(F.array().cast("array<string>"))


def global_params(rules: Ruleset) -> list[Matcher]:
    return [p.matcher for p, _ in rules.params if p.is_global and not p.referral]


def vendor_params(rules: Ruleset, name: str) -> list[Matcher]:
    return [p.matcher for p, names in rules.params if name in names and not p.is_global]


def found(url: Column, low: Column, pattern: str) -> Column:
    """Whether a pattern matches, tried only where the URL (``low``: in lower case) holds one of the strings that it needs."""
    test = url.rlike("(?i)" + pattern)
    strings = needed(pattern)
    if "" in strings:
        return test
    holds = F.contains(low, F.lit(strings[0]))
    for x in strings[1:]:
        holds = holds | F.contains(low, F.lit(x))
    return holds & test


def provider(url: Column, rules: Ruleset) -> Column:
    """The first provider other than the global one whose pattern the URL matches."""
    out, low = F.lit(None).cast("string"), F.lower(url)
    for p in reversed([p for p in rules.providers if not p.is_global]):
        out = F.when(found(url, low, p.pattern), p.name).otherwise(out)
    return out


def redirect_target(url: Column, rules: Ruleset) -> Column:
    """The undecoded target of the first pattern redirect that matches; lazily, in load order."""
    low = F.lower(url)
    hits = [F.when(found(url, low, r.pattern), F.regexp_extract(url, "(?i)" + r.pattern, 1)) for r in rules.redirects if r.kind == "pattern"]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def query_value(url: Column, name: str) -> Column:
    """The value of a parameter by its raw name; null if it has several values."""
    hits = F.array_distinct(F.transform(F.filter(F.split(query(url), "&"), lambda s: F.startswith(s, F.lit(name + "="))), lambda s: F.substring(s, len(name) + 2, 1 << 30)))
    return F.when(F.size(hits) == 1, F.element_at(hits, 1))


def base64_text(text: Column, least: int = 16) -> Column:
    """UTF-8 text from base64 of either alphabet; null if it is none."""
    body = F.regexp_replace(text, "=+$", "")
    ok = (F.length(body) >= least) & (body.rlike(r"^[A-Za-z0-9_-]+\z") | body.rlike(r"^[A-Za-z0-9+/]+\z")) & (F.length(body) % 4 != 1)
    full = F.rpad(F.translate(body, "-_", "+/"), (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.when(ok, F.try_validate_utf8(F.try_to_binary(full, F.lit("base64")).cast("string")))


def blocked_ipv4(name: Column) -> Column:
    """Dotted addresses that aren't of the public internet."""
    octet = [F.regexp_extract(name, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\z", i).try_cast("int") for i in (1, 2, 3, 4)]
    a, b, c, d = octet
    value = ((a * 256 + b) * 256 + c).cast("long") * 256 + d
    tests = (a == 127) | (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | (value == 0) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)) | (a >= 224)
    return F.coalesce(tests, F.lit(False))


def reject_reason(url: Column) -> Column:
    """Why a redirect target is not taken; null if it is."""
    scheme = F.lower(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return (
        F.when(~scheme.isin("http", "https"), F.concat(F.lit("bad-scheme:"), scheme))
        .when(url.rlike("^[^/?#]*//[^/?#]*@"), "userinfo")
        .when(url.rlike("[\\x00-\\x1f\\x7f]"), "control-chars")
        .when(host(url) == "", "invalid-host")
        .when(blocked_ipv4(host(url)), "private-ip")
    )


def canonical_link(url: Column) -> Column:
    pairs = F.array_join(F.array_sort(F.transform(F.filter(F.split(query(url), "&"), lambda s: s != ""), form_decode)), "&")
    scheme = F.lower(F.regexp_extract(url, "^([a-zA-Z]+)://", 1))
    return F.concat(scheme, F.lit("://"), host(url), path(url), F.when(F.coalesce(pairs, F.lit("")) != "", F.concat(F.lit("?"), pairs)).otherwise(""))


def glob(url: Column, pattern: str) -> Column:
    return url.rlike(r"(?is)\A" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + r"\z")


HREF = r"""(?is)<(?:a|area)\b(?:[^>"']|"[^"]*"|'[^']*')*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def links(html: Column) -> Column:
    """The href of every a and area, in page order."""
    every = lambda i: F.regexp_extract_all(html, F.lit(HREF), F.lit(i))
    return F.zip_with(F.zip_with(every(1), every(2), lambda a, b: F.when(a != "", a).otherwise(b)), every(3), lambda a, b: F.when(a != "", a).otherwise(b))


def dimension(text: Column) -> Column:
    return F.when(~text.rlike(r"^\s*\d+\s*%"), F.regexp_extract(text, r"^\s*(\d+)", 1)).try_cast("int")


def style_hidden(style: Column) -> Column:
    parts = F.split(F.lower(F.regexp_replace(style, r"\s+", "")), ";")
    return F.coalesce(F.exists(parts, lambda p: p.isin("display:none", "visibility:hidden") | F.coalesce(F.when(F.startswith(p, F.lit("opacity:")), F.substring(p, 9, 50).try_cast("double") <= 0), F.lit(False))), F.lit(False))


def style_size(style: Column, key: str) -> Column:
    parts = F.filter(F.split(F.lower(F.regexp_replace(style, r"\s+", "")), ";"), lambda p: p.rlike(rf"^{key}:\d") & ~p.rlike(r":\d+%"))
    return F.regexp_extract(F.try_element_at(parts, F.lit(-1)), r":(\d+)", 1).try_cast("int")


def pixel_path(src: Column) -> Column:
    p = F.lower(path(src))
    out = p.rlike(rf"/[a-z0-9]{{0,2}}\.(?:{EXTENSIONS})\z")
    for n in NEEDLES:
        out = out | F.contains(p, F.lit(n))
    return out


def is_pixel(src: Column, width: Column, height: Column, alt: Column, style: Column, hint: Column, beacon: Column) -> Column:
    """Tracking pixel: a remote image that is a beacon, hidden, tiny without text, or of a telling path."""
    w, h = F.coalesce(dimension(width), style_size(style, "width")), F.coalesce(dimension(height), style_size(style, "height"))
    blank = F.trim(F.coalesce(alt, F.lit(""))) == ""
    tiny = F.coalesce(F.greatest(w, h) <= 2, F.lit(False))
    layout = F.coalesce(F.lower(hint).rlike("|".join(LAYOUT)), F.lit(False))
    shaped = w.isNull() & h.isNull() & ~layout & pixel_path(src)
    return F.coalesce(src.rlike("^https?://"), F.lit(False)) & (beacon | style_hidden(style) | (blank & (tiny | shaped)))


def css_neutralise(style: Column) -> Column:
    """Remote url(...) values made none."""
    return F.regexp_replace(style, r"""(?i)url\(\s*(?:"https?://[^"]*"|'https?://[^']*'|https?://[^)"']*)\s*\)""", "none")


def unsubscribe(header: Column) -> Column:
    """The first web target of a List-Unsubscribe value, else the first."""
    every = F.filter(F.transform(F.regexp_extract_all(header, F.lit("<([^>]*)>"), F.lit(1)), lambda t: F.trim(t)), lambda t: t != "")
    web = F.filter(every, lambda t: F.lower(t).rlike("^https?://"))
    return F.coalesce(F.try_element_at(web, F.lit(1)), F.try_element_at(every, F.lit(1)))


def safe_header(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f]", " ")


def sender_domain(address: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.substring_index(address, "@", -1)), r"[.>\s]+$", ""))
