"""Queries that put the engine's functions on rows made from ``orders``: each row has one of a few shapes around its own key.

A shape is an input expression that Spark and DuckDB read alike, and a DuckDB expression of what must come out.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial

from pyspark.sql import functions as F

from .config import Config, Policy, parse_toml
from .functions import url as U
from .functions.engine import Engine
from .functions.html import clean_html, links, style_facts
from .functions.mime import clean_message, clean_message_fail_open, decode_charset, decoded, encode_charset, header_block, parts, sender_domain, unsubscribe_targets
from .operators.clean import by_row
from .plans.reports import line_diff
from .rules.packs import Limits, detect, load, normalise, source_name
from .streaming.session import Session

K = "CAST(o_custkey AS VARCHAR(20))"
QUERIES: dict = {}
ORACLE: dict = {}
SHAPES: dict = {}


def text(*pieces: str) -> str:
    """Pieces of text around the row's key, as an expression; '@' in a piece is the key, '(at)' the sign itself."""
    out = []
    for p in pieces:
        for i, x in enumerate(p.split("@")):
            out += [K] if i else []
            out += ["'" + x.replace("'", "''").replace("(at)", "@") + "'"] if x else []
    return f"concat({', '.join(out)}, '')" if out else "''"


def shapes(name: str, doc: str, make: Callable[[str], str | None], *pairs: tuple[str, str | None]) -> None:
    """Register a query: inputs and results with '@' for the key; no result is null."""
    SHAPES[name] = make, pairs
    case = lambda values: "CASE o_orderkey % " + str(len(pairs)) + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
    given = case([text(a) for a, _ in pairs])
    wanted = case(["NULL" if b is None else text(b) for _, b in pairs])

    def run(spark, d):
        # Spark reads a backslash in a literal as an escape
        df = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.expr(given.replace("\\", "\\\\")).alias("given"))
        return by_row(df, ["given"], [("result", "string")], lambda t: (make(t),)).drop("given")

    run.__doc__ = doc
    QUERIES[name], ORACLE[name] = run, f"SELECT o_orderkey, {wanted} AS result FROM orders"


def engine(pack: str | None = None, fmt: str | None = None, builtin: bool = True, **settings) -> Engine:
    formats = {"p": fmt} if fmt else None
    return Engine(load([("p", pack)] if pack is not None else [], formats=formats, with_builtin=builtin, usage={"p": settings.pop("usage", "")}, disabled=settings.get("disabled_providers", ())), Config(**settings))


def clean(e: Engine, t: str) -> str | None:
    u = U.parse(t)
    return e.clean(u).url if u else None


def unwrap(e: Engine, t: str) -> str:
    got = e.unwrap(U.parse(t))
    return got.url if got.unwrapped else f"{got.rejected or 'no'} {got.url}"


def html(e: Engine, t: str, base: str | None = None) -> str:
    return clean_html(t, e, base_url=base).html


PLAIN = engine()

# ---- URLs ----
shapes("url_parse", "URLs in normal form; null where the text is none.", lambda t: str(x) if (x := U.parse(t)) else None,
    ("HTTP://Example.COM:80/a/../b?q=@#f", "http://example.com/b?q=@#f"), (" https://ex.com/a b/@\t", "https://ex.com/a%20b/@"), ("http://0x7f.1/@", "http://127.0.0.1/@"), ("https:\\\\ex.com\\@", "https://ex.com/@"),
    ("https://bücher.example/ü@", "https://xn--bcher-kva.example/%C3%BC@"), ("http://[::0001]:8080/@", "http://[::1]:8080/@"), ("mailto:a@b.c", "mailto:a@b.c"), ("http://x:99999/@", None), ("nothing @", None))
shapes("url_join", "References resolved against a base.", lambda t: str(U.parse(t, U.parse("https://ex.com/a/b?x=1"))),
    ("c@", "https://ex.com/a/c@"), ("/d/@", "https://ex.com/d/@"), ("../e@", "https://ex.com/e@"), ("?y=@", "https://ex.com/a/b?y=@"), ("#z@", "https://ex.com/a/b?x=1#z@"), ("//o.com/@", "https://o.com/@"))
shapes("decode_target", "Redirect candidates: as they are, decoded up to three times, or from base64.", lambda t: str(x) if (x := U.decode_target(t)) else None,
    ("https://a.com/@", "https://a.com/@"), ("https%3A%2F%2Fa.com%2F@", "https://a.com/@"), ("https%253A%252F%252Fa.com%252F@", "https://a.com/@"), ("https%25253A%25252F%25252Fa.com%25252F@", "https://a.com/@"), ("aHR0cHM6Ly9leGFtcGxlLmNvbS94", "https://example.com/x"), ("eyJocmVmIjogImh0dHBzOi8vZXhhbXBsZS5jb20veSJ9", "https://example.com/y"), ("no target @", None))
shapes("base64_envelope", "URLs in base64: plain, of the URL alphabet, or as href or url of a JSON object.", lambda t: U.from_base64(t),
    ("aHR0cHM6Ly9leGFtcGxlLmNvbS94", "https://example.com/x"), ("eyJ1cmwiOiAiaHR0cHM6Ly9leGFtcGxlLmNvbS96In0", "https://example.com/z"), ("aHR0cHM6Ly9hLmIvP349_Pz8", None), ("short", None), ("not base64 @", None))
shapes("reject_reason", "Why a redirect target is not taken, addresses of the sixth version included.", lambda t: U.reject_reason(U.parse(t)) or "ok",
    ("https://a.com/@", "ok"), ("ftp://a.com/@", "bad-scheme:ftp"), ("https://u:p(at)a@.com/", "userinfo"), ("http://10.0.0.1/@", "private-ip"), ("http://[::1]/@", "private-ip"), ("http://[fd00::1]/@", "private-ip"), ("http://[fe80::1]/@", "private-ip"), ("http://[::ffff:10.0.0.1]/@", "private-ip"), ("http://[2606:4700::1111]/@", "ok"), ("javascript:alert(@)", "bad-scheme:javascript"))
shapes("private_ip_any", "Addresses that are not of the public internet, in both versions.", lambda t: str(U.blocked_ip(t)).lower(),
    ("127.0.0.1", "true"), ("100.64.3.4", "true"), ("198.19.0.1", "true"), ("8.8.8.8", "false"), ("::1", "true"), ("ff02::1", "true"), ("::ffff:8.8.8.8", "false"), ("::a00:1", "true"), ("2001:4860::1", "false"), ("host@", "false"))
shapes("mixed_script", "Hosts with a label of two scripts.", lambda t: str(U.mixed_script(t)).lower(),
    ("ex@.com", "false"), ("аpple@.com", "true"), ("пример.com", "false"), ("bücher.example", "false"))
shapes("registrable_domain", "The public suffix and one label more.", lambda t: U.registrable(t),
    ("a.b@.com", "b@.com"), ("a.b@.co.kr", "b@.co.kr"), ("x@.com.br", "x@.com.br"), ("co.uk", None), ("u@.github.io", None), ("10.0.0.1", None), ("A.B.Example@.DE.", "example@.de"))
shapes("canonical_link", "Links in a form for comparing.", U.canonical_link,
    ("https://A.com/x%20y?b=@&a=1", "https://a.com/x y?a=1&b=@"), ("https://a.com/?a=%41@&&", "https://a.com/?a=A@"), (" mailto:x@y ", "mailto:x@y"))
shapes("param_is_tracking", "Single names, as they are or with an equals sign.", lambda t: str(PLAIN.param_is_tracking(U.parse("https://www.amazon.de/"), t)).lower(),
    ("utm_@", "true"), ("FBCLID", "true"), ("ref", "true"), ("pf_rd_p", "true"), ("srs", "true"), ("keep@", "false"))

# ---- rules of the four syntaxes, and what decides between them ----
REFERRAL = json.dumps({"providers": {"shop": {"urlPattern": "^https?://shop[.]example", "rules": ["track"], "referralMarketing": ["aff"], "exceptions": ["/raw/"], "rawRules": ["/ref=[^/?]*"], "redirections": ["^https?://shop[.]example/go[?]to=([^&]+)"]}}})
shapes("pack_rules", "A provider pack: names, and an exception of the provider.", partial(clean, engine(REFERRAL)),
    ("https://shop.example/?track=1&id=@", "https://shop.example/?id=@"), ("https://shop.example/raw/?track=1&id=@", "https://shop.example/raw/?track=1&id=@"), ("https://shop.example/raw/?fbclid=1&id=@", "https://shop.example/raw/?fbclid=1&id=@"), ("https://other.example/?track=@", "https://other.example/?track=@"), ("https://shop.example/?aff=1&id=@", "https://shop.example/?aff=1&id=@"))
shapes("pack_referral", "Referral parameters go only where the setting says so.", partial(clean, engine(REFERRAL, strip_referral_marketing=True)),
    ("https://shop.example/?aff=1&id=@", "https://shop.example/?id=@"), ("https://other.example/?aff=@", "https://other.example/?aff=@"))
shapes("pack_raw_rules", "Raw rules cut from the URL of a matching provider.", engine(REFERRAL).raw_rules,
    ("https://shop.example/p/ref=abc/@", "https://shop.example/p/@"), ("https://other.example/p/ref=abc/@", "https://other.example/p/ref=abc/@"))
shapes("pack_redirect", "A provider's redirection.", partial(unwrap, engine(REFERRAL)),
    ("https://shop.example/go?to=https%3A%2F%2Fa.com%2F@", "https://a.com/@"), ("https://shop.example/go?to=http%3A%2F%2F127.0.0.1%2F@", "private-ip https://shop.example/go?to=http%3A%2F%2F127.0.0.1%2F@"), ("https://shop.example/stay?to=@", "no https://shop.example/stay?to=@"))
shapes("disabled_provider", "A provider that is switched off.", partial(clean, engine(REFERRAL, disabled_providers=("SHOP",))),
    ("https://shop.example/?track=@", "https://shop.example/?track=@"), ("https://shop.example/?fbclid=1&id=@", "https://shop.example/?id=@"))
shapes("no_vendor_rules", "Only global parameters go when vendor rules are off.", partial(clean, engine(apply_vendor_rules=False)),
    ("https://www.amazon.de/dp/@?ref=1&utm_a=2", "https://www.amazon.de/dp/@?ref=1"), ("https://www.youtube.com/?si=@", "https://www.youtube.com/?si=@"))
shapes("name_settings", "Kept names win over extra ones, and those over rules; excluded hosts are left alone.", partial(clean, engine(extra_tracking_params=("cid", "my_*"), keep_params=("utm_keep",), exclude_domains=("safe.example",))),
    ("https://a.com/?cid=@&my_x=1&id=2", "https://a.com/?id=2"), ("https://a.com/?utm_keep=@&utm_go=1", "https://a.com/?utm_keep=@"), ("https://x.safe.example/?utm_a=@", "https://x.safe.example/?utm_a=@"))
CLEAN_URLS = json.dumps([{"include": ["*://a.example/*"], "exclude": ["*://a.example/keep*"], "params": ["Sid"]}])
shapes("clean_url_list", "A list of names with globs: raw names, case and an equals sign count.", partial(clean, engine(CLEAN_URLS, builtin=False)),
    ("https://a.example/?Sid=@&x=1", "https://a.example/?x=1"), ("https://a.example/?sid=@", "https://a.example/?sid=@"), ("https://a.example/?Sid&x=@", "https://a.example/?Sid&x=@"), ("https://a.example/keep?Sid=@", "https://a.example/keep?Sid=@"), ("https://b.example/?Sid=@", "https://b.example/?Sid=@"))
DEBOUNCE = json.dumps([{"include": ["*://r.example/q*"], "action": "redirect", "param": "u"}, {"include": ["*://r.example/b*"], "action": "base64,redirect", "param": "u"}, {"include": ["*://r.example/p/*"], "action": "regex-path", "param": "^/p/(.*)$", "prepend_scheme": "https"}, {"include": ["*://r.example/t/*"], "action": "regex-path-template", "param": "^/t/([a-z]+)/([0-9]+)$", "redirect_url_template": "https://$1.com/item/$2"}])
shapes("debounce_list", "Redirects by parameter, base64, path and template, and the check that they leave the site.", partial(unwrap, engine(DEBOUNCE, builtin=False)),
    ("https://r.example/q?u=https%3A%2F%2Fa.com%2F@", "https://a.com/@"), ("https://r.example/q?u=https%3A%2F%2Fx.r.example%2F@", "brave-destination-scope https://r.example/q?u=https%3A%2F%2Fx.r.example%2F@"), ("https://r.example/b?u=aHR0cHM6Ly9leGFtcGxlLmNvbS94&k=@", "https://example.com/x"), ("https://r.example/p/shop.com/@", "https://shop.com/@"), ("https://r.example/t/shop/@", "https://shop.com/item/@"), ("https://r.example/q?u=1&u=@", "no https://r.example/q?u=1&u=@"), ("https://r.example/q?u=http%3A%2F%2F8.8.8.8%2F@", "brave-destination-scope https://r.example/q?u=http%3A%2F%2F8.8.8.8%2F@"))
FILTERS = "! comment\n||a.example^$removeparam=x\n@@||keep.a.example^$removeparam=x\n$removeparam=/^z[0-9]+/\n@@||free.example^$removeparam\n||free.example^$removeparam=q\n*$removeparam=only,domain=d.example\n||a.example^$script"
shapes("filter_lines", "Filter lines: targets, patterns over pairs, exceptions for one and for all.", partial(clean, engine(FILTERS, "ad-guard", builtin=False)),
    ("https://a.example/?x=@&k=1", "https://a.example/?k=1"), ("https://keep.a.example/?x=@", "https://keep.a.example/?x=@"), ("https://b.example/?x=@", "https://b.example/?x=@"), ("https://free.example/?q=@", "https://free.example/?q=@"), ("https://d.example/?only=@", "https://d.example/"), ("https://e.example/?only=@", "https://e.example/?only=@"))
shapes("filter_beacons", "Image lines of a filter list are beacons, also inside another URL.", lambda t, e=engine("||px.example^$image", "ad-guard", builtin=False, extra_pixel_domains=("own.example",)): str(e.beacon(t)).lower(),
    ("https://px.example/@", "true"), ("https://a.px.example/@", "true"), ("https://npx.example/@", "false"), ("https://i.example/?u=https%3A%2F%2Fpx.example%2F@", "true"), ("https://img.own.example/@", "true"))
shapes("pattern_kinds", "How a parameter pattern is compiled.", lambda t: " ".join(f"{m.kind}:{m.value}" for m in normalise(t) or ()) or "bad",
    ("plain@", "exact:plain@"), ("utm_.*", "prefix:utm_"), ("ga_(source|medium)", "exact:ga_medium exact:ga_source"), ("A{2}@", "exact:aa@"), ("srs?", "regex:(?i)^(?:srs?)$"), ("(?=@)", "bad"), ("(", "bad"))
shapes("pack_format", "The syntax of a pack, by its text.", lambda t: detect(t) or "none",
    ('{"providers": {"@": {}}}', "clear-urls"), ('[{"include": ["@"], "action": "redirect"}]', "brave-debounce"), ('[{"params": ["@"]}]', "brave-clean-urls"), ("||a.example^$removeparam=@", "ad-guard"), ("[@", "none"))
shapes("pack_names", "Names of sources without user information, query and fragment.", source_name,
    ("https://u:p(at)h.example/@?key=1#f", "https://h.example/@"), ("https://h.example/@", "https://h.example/@"), ("packs/@.json", "packs/@.json"))


def outcome(t: str) -> str:
    r = load([("p", t)], with_builtin=False, limits=Limits(source_bytes=400, rules=3)).reports[0]
    return f"{r.error}" if r.error else f"loaded={r.loaded} duplicates={r.duplicates} failed={r.failed} unsupported={r.unsupported}"


shapes("pack_budgets", "What a pack contributes: bad rules are skipped, packs beyond a budget give nothing.", outcome,
    ('{"providers": {"a": {"urlPattern": "x", "rules": ["r@", "("]}}}', "loaded=1 duplicates=0 failed=1 unsupported=0"), ('{"providers": {"a": {"urlPattern": "x", "rules": ["r@", "R@"]}}}', "loaded=1 duplicates=1 failed=0 unsupported=0"), ('{"providers": {"a": {"urlPattern": "x", "rules": ["a", "b", "c", "d@"]}}}', "too many rules"), ("$removeparam=" + "a" * 400 + "@", "source too large"), ("||a^$script\n$removeparam=x@", "loaded=1 duplicates=0 failed=0 unsupported=1"), ("[@", "unknown format"))


def setting(t: str) -> str:
    try:
        c = parse_toml(t)
    except (ValueError, TypeError) as e:
        return type(e).__name__ if not str(e).startswith("unknown") else str(e)
    return f"{c.mode} {','.join(c.blocked_domains)} {c.timeout_ms}"


shapes("config_toml", "Settings from text; unknown keys are errors.", setting,
    ('mode = "report-only"', "report-only  1500"), ('blocked_domains = ["b@.example"]\ntimeout_ms = 5', "enforce b@.example 5"), ("nonsense = @", "unknown keys: nonsense"), ("mode = ", "TOMLDecodeError"))
POLICIES = Config(sender_policies=(Policy(("quiet.example",), mode="report-only"), Policy(("bare.example",), clean_html=False), Policy(("shop.example", "news.example"), remove_pixels=False)))
shapes("sender_settings", "The policy of a sender, and what it sets.", lambda t: (lambda c: f"{c[1]} {c[0].mode} {c[0].clean_html} {c[0].remove_pixels} {c[0].clean_query_params}")(POLICIES.for_sender(t or None)),
    ("a@.quiet.example", "custom:quiet.example report-only True True True"), ("bare.example", "custom:bare.example enforce False True True"), ("x@.news.example", "custom:news.example enforce True False True"), ("mail.paypal.com", "sensitive-sender enforce True True False"), ("other@.example", "default enforce True True True"), ("", "default enforce True True True"))

# ---- HTML ----
shapes("html_links", "The links of a page; none in comments and in elements whose content is text.", lambda t: " ".join(links(t)),
    ("<a href='/x@'>a</a><AREA HREF=/y>", "/x@ /y"), ("<!-- <a href=/no> --><a class=a href=\"/z?a=1&b=@\">", "/z?a=1&b=@"), ("<script>'<a href=/no@>'</script><a name=x>", ""), ("<p title=don't><a href=/k@>", "/k@"))
shapes("html_link_edits", "Links rewritten: cleaned, unwrapped, blocked, protected by the base URL, pings gone.", partial(html, engine(blocked_domains=("bad.example",), preserve_original_href=False)),
    ('<a href="https://a.com/?utm_a=1&amp;id=@">', '<a href="https://a.com/?id=@">'), ('<a href="https://x.bad.example/@">', '<a href="about:blank">'), ("<a href=https://a.com/@ ping='https://p.example/'>", "<a href=https://a.com/@ >"), ('<a href="#top@">', '<a href="#top@">'), ('<a href="https://t.hubspotlinks.com/c?url=https%3A%2F%2Fbad.example%2F@">', '<a href="about:blank">'))
shapes("html_original_href", "The old address kept beside the new one.", partial(html, engine(preserve_original_href=True)),
    ('<a href="https://a.com/?utm_a=@">', '<a href="https://a.com/" data-original-href="https://a.com/?utm_a=@">'), ('<a href="https://a.com/@">', '<a href="https://a.com/@">'))
shapes("html_relative", "Relative links against a base URL.", partial(html, PLAIN, base="https://a.com/b/c"),
    ('<a href="d?fbclid=1&x=@">', '<a href="https://a.com/b/d?x=@">'), ('<a href="d?x=@">', '<a href="d?x=@">'))
shapes("html_pixels", "Images that are taken out: tiny, hidden, of beacon hosts or telling paths; others stay.", partial(html, PLAIN),
    ('a<img src="https://x.example/@.gif" width="1" height="1">b', "ab"), ('a<img src="https://x.example/@.jpg" style="display:none">b', "ab"), ('a<img src="https://ad.doubleclick.net/@" alt="x" width="600">b', "ab"), ('a<img src="https://x.example/wf/open?u=@">b', "ab"), ('a<img src="https://x.example/@.jpg" width="600" alt="Photo">b', 'a<img src="https://x.example/@.jpg" width="600" alt="Photo">b'), ('a<img src="cid:@" width="1" height="1">b', 'a<img src="cid:@" width="1" height="1">b'), ('a<img class="logo" src="https://x.example/o.gif?@">b', 'a<img class="logo" src="https://x.example/o.gif?@">b'))
shapes("html_removed_notes", "Images that are taken out leave a note where the setting says so.", partial(html, engine(debug_preserve_removed=True)),
    ('<img src="https://x.example/a--b/@.gif" width=1 height=1>', "<!-- removed: https://x.example/a- -b/@.gif -->"))
shapes("html_css_beacons", "Beacons in styles and backgrounds.", partial(html, PLAIN),
    ('<div style="display:none;background:url(https://x.example/@)">', '<div style="display:none;background:none">'), ('<td background="https://ad.doubleclick.net/@" width="9">', '<td  width="9">'), ('<div style="background:url(\'https://x.example/@.png\')">', '<div style="background:url(\'https://x.example/@.png\')">'), ('<div style="width:1px;background:url(https://x.example/@)">', '<div style="width:1px;background:none">'))
shapes("html_settings_off", "Nothing is taken out where the settings say so.", partial(html, engine(remove_pixels=False, strip_link_ping=False, clean_query_params=False, unwrap_known_redirects=False)),
    ('<a ping="https://p.example/" href="https://a.com/?utm_a=@"><img width=1 height=1 src="https://x.example/@.gif">', '<a ping="https://p.example/" href="https://a.com/?utm_a=@"><img width=1 height=1 src="https://x.example/@.gif">'))
shapes("style_sizes", "Whether a style hides, and its sizes.", lambda t: str(style_facts(t)),
    ("display : none; width: @", "(True, @, None)"), ("opacity:0.0;height:2px", "(True, None, 2)"), ("width:50%;color:red", "(False, None, None)"), ("VISIBILITY:hidden", "(True, None, None)"))

# ---- messages ----
CRLF = "\r\n"
shapes("mime_parts", "The leaf parts of messages: type, charset, transfer encoding, attachment.", lambda t: " ".join(f"{p.ctype}/{p.charset}/{p.encoding}/{int(p.attachment)}" for p in parts(t.replace("\n", CRLF).encode())),
    ("Content-Type: text/html; charset=\"ISO-8859-1\"\nContent-Transfer-Encoding: Base64\n\nx@", "text/html/iso-8859-1/base64/0"), ("Subject: @\n\nbody", "text/plain/utf-8/7bit/0"), ("Content-Type: multipart/alternative; boundary=\"b\"\n\n--b\n\nplain @\n--b\nContent-Type: text/html\nContent-Disposition: attachment\n\n<p>\n--b--\n", "text/plain/utf-8/7bit/0 text/html/utf-8/7bit/1"), ("Content-Type: message/rfc822\n\nContent-Type: text/html; charset*0=utf; charset*1=-16\n\n<p>@", "text/html/utf-16/7bit/0"))
shapes("mime_decode", "Bodies decoded from their transfer encoding and charset.", lambda t: (lambda raw: decode_charset(decoded(raw, parts(raw)[0]), parts(raw)[0].charset))(t.encode("latin-1")),
    ("Content-Transfer-Encoding: quoted-printable\n\na=3D@=\nb", "a=@b"), ("Content-Transfer-Encoding: base64\n\naGVsbG8=", "hello"), ("Content-Type: text/plain; charset=latin1\n\ncaf\xe9@", "café@"), ("Content-Type: text/plain; charset=none\n\nx@", None))
shapes("mime_encode", "Texts in the charset of their part, as hexadecimal digits; null where it can't carry them.", lambda t: (lambda x: x.hex() if x is not None else None)(encode_charset(t.split("|")[1], t.split("|")[0])),
    ("utf-8|é", "c3a9"), ("iso-8859-1|é", "e9"), ("iso-8859-1|€", "3f"), ("windows-1252|€", "80"), ("utf-16|é", None), ("utf-16|ab", "6162"), ("unknown|é", None))


def body(t: str, **settings) -> str:
    raw = t.encode()
    done = clean_message(raw, Engine(PLAIN.rules, Config(**settings)))
    return done.cleaned[header_block(done.cleaned, 0, len(done.cleaned))[1] :].decode()


def told(t: str, names: tuple[str, ...], **settings) -> str:
    done = clean_message_fail_open(t.encode(), Engine(PLAIN.rules, Config(**settings)))
    have = {k.removeprefix("X-Mailsieve-"): v for k, v in done.headers}
    return " ".join(f"{n}={have.get(n, '-')}" for n in names)


LINK = '<a href="https://a.com/?utm_a=1&id=@">'
shapes("mime_transfer", "Bodies put back in their own transfer encoding.", body,
    (f"Content-Type: text/html\n\n{LINK}\n", '<a href="https://a.com/?id=@">\n'), ("Content-Type: text/html\nContent-Transfer-Encoding: quoted-printable\n\n<a href=3D\"https://a.com/?utm_a=3D1&id=3D@\">\n", '<a href=3D"https://a.com/?id=3D@">\n'), ("Content-Type: text/html\nContent-Transfer-Encoding: base64\n\nPGEgaHJlZj0iaHR0cHM6Ly9hLmNvbS8/dXRtX2E9MSI+\n", "PGEgaHJlZj0iaHR0cHM6Ly9hLmNvbS8iPg==\n"), (f"Content-Type: text/plain\n\n{LINK}", LINK))
shapes("mime_text_plain", "Plain parts are cleaned only where the setting says so.", lambda t: body(t, clean_text_plain=True),
    ("Content-Type: text/plain\n\nsee https://a.com/?utm_a=1&id=@, ok", "see https://a.com/?id=@, ok"), ("\nhttps://a.com/@", "https://a.com/@"))
shapes("mime_counters", "Counters of messages, and those that are left out when zero.", lambda t: told(t, ("Modified", "Html-Parts", "Urls-Cleaned", "Cte-Mismatch-Parts")),
    (f"Content-Type: text/html\n\n{LINK}", "Modified=yes Html-Parts=1 Urls-Cleaned=1 Cte-Mismatch-Parts=-"), (f"Content-Type: text/plain\n\n{LINK}", "Modified=no Html-Parts=0 Urls-Cleaned=0 Cte-Mismatch-Parts=-"), (f"Content-Type: text/html\nContent-Transfer-Encoding: base64\n\n{LINK}", "Modified=yes Html-Parts=1 Urls-Cleaned=1 Cte-Mismatch-Parts=1"), (f"Content-Type: text/html\nContent-Disposition: attachment\n\n{LINK}", "Modified=no Html-Parts=0 Urls-Cleaned=0 Cte-Mismatch-Parts=-"))
shapes("mime_limits", "Parts above their limit are skipped and told; messages above theirs pass as they are.", lambda t: told(t, ("Skipped-Oversized-Parts", "Error", "Modified"), max_html_part_size=200, max_message_size=1000),
    (f"Content-Type: text/html\n\n{LINK}", "Skipped-Oversized-Parts=- Error=- Modified=yes"), (f"Content-Type: text/html\n\n{LINK}{'x' * 300}", "Skipped-Oversized-Parts=1 Error=- Modified=no"), (f"Content-Type: text/html\n\n{LINK}{'x' * 1000}", "Skipped-Oversized-Parts=- Error=message too large Modified=-"))
shapes("mime_modes", "The mode and policy of the sender; reports change nothing.", lambda t: told(t, ("Mode", "Policy", "Modified", "Urls-Cleaned"), sender_policies=POLICIES.sender_policies),
    (f"From: Q <x(at)quiet.example>\nContent-Type: text/html\n\n{LINK}", "Mode=report-only Policy=custom:quiet.example Modified=no Urls-Cleaned=1"), (f"From: x(at)bare.example\nContent-Type: text/html\n\n{LINK}", "Mode=enforce Policy=custom:bare.example Modified=no Urls-Cleaned=0"), (f"From: x(at)github.com\nContent-Type: text/html\n\n{LINK}", "Mode=enforce Policy=sensitive-sender Modified=no Urls-Cleaned=0"), (f"Content-Type: text/html\n\n{LINK}", "Mode=enforce Policy=default Modified=yes Urls-Cleaned=1"))
shapes("sender_domains", "The domain of a From header.", lambda t: sender_domain([("From", t)]),
    ("Shop <news(at)Shop@.Example.com>", "shop@.example.com"), ("a(at)b@.example.", "b@.example"), ("nobody @", None), ('"x(at)y" <z(at)w@.example>', "w@.example"))
shapes("unsubscribe_list", "The targets of List-Unsubscribe.", lambda t: "|".join(unsubscribe_targets([("list-unsubscribe", t)])),
    ("<mailto:u>, <https://x.example/@>", "mailto:u|https://x.example/@"), ("< >, nothing @", ""))
shapes("unsubscribe_protected", "Links that the message names for unsubscribing stay.", body,
    ('List-Unsubscribe: <https://a.com/?utm_a=1&id=@>\nContent-Type: text/html\n\n<a href="https://a.com/?utm_a=1&amp;id=@"><a href="https://b.com/?utm_a=@">', '<a href="https://a.com/?utm_a=1&amp;id=@"><a href="https://b.com/">'),)
shapes("line_difference", "The changed lines as one hunk.", lambda t: "/".join(line_diff(*t.split("|"))),
    ("a\nb@\nc|a\nx@\nc", "-b@/+x@"), ("same@|same@", ""), ("a|a\nb@", "+b@"))


def session(t: str) -> str:
    """Replies to packets 'C:payload', joined."""
    s, out = Session(200), []
    for p in t.split("|"):
        out += [a + (":" + x.decode("latin-1") if a == "b" else "") for a, x in s.feed(p[0], p[2:].replace("~", "\0").encode("latin-1"), PLAIN)]
    return " ".join(out)


shapes("session_replies", "Packets of a mail-filter session and the replies: negotiation, a message, an abort, a message above the limit.", session,
    (f"M:|L:Content-Type~text/html~|B:{LINK}|E:", 'c c c b:<a href="https://a.com/?id=@"> h h h h h h h h h c'), (f"M:|L:Content-Type~text/html~|B:{LINK}|A:|M:|B:x@|E:", "c c c c c h h h h h h h h h c"), (f"M:|B:{'x' * 201}|E:|Q:", "c c t"), ("M:|B:plain @|D:x|E:", "c c h h h h h h h h h c"))
