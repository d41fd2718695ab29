"""Packs, URLs, HTML, messages and sessions on small cases."""

import base64
import json
import random
import re

import pytest

from mailsieve.config import Config, Policy, finalize, parse_toml
from mailsieve.functions.engine import Engine, glob_regex, target_regex
from mailsieve.functions.html import clean_html, clean_text, links, style_facts
from mailsieve.functions.mime import clean_message, clean_message_fail_open, parts, quoted_printable, with_headers
from mailsieve.functions.url import blocked_ip, canonical_link, decode_target, from_base64, mixed_script, parse, registrable, reject_reason
from mailsieve.plans.reports import line_diff
from mailsieve.rules.packs import Limits, detect, expansions, load, normalise, placeholders_ok, source_name

RULES = load()
ENGINE = Engine(RULES)


def test_builtin_counts():
    s = RULES.stats()
    assert (s["providers"], s["params"], s["exact"], s["prefix"], s["regex"], s["redirects"], s["beacons"]) == (54, 169, 163, 4, 2, 19, 14)


@pytest.mark.parametrize(
    "text,want",
    [
        ("HTTP://Example.COM:80/a/../b?q#f", "http://example.com/b?q#f"),
        ("https://ex.com", "https://ex.com/"),
        (" https://ex.com/a b\n", "https://ex.com/a%20b"),
        ("http://0x7f.1/", "http://127.0.0.1/"),
        ("http://[::1]:8080/", "http://[::1]:8080/"),
        ("https://bücher.example/ü", "https://xn--bcher-kva.example/%C3%BC"),
        ("https:\\\\ex.com\\x", "https://ex.com/x"),
        ("mailto:a@b.c", "mailto:a@b.c"),
    ],
)
def test_parse(text, want):
    assert str(parse(text)) == want


def test_parse_bad_and_relative():
    assert [parse(x) for x in ("", "nothing", "http://", "http://a b/", "http://x:99999/", "http://256.1.1.1/", None)] == [None] * 7
    base = parse("https://ex.com/a/b?x=1")
    assert [str(parse(x, base)) for x in ("c", "/d", "../e", "?y", "#z", "//o.com/p")] == ["https://ex.com/a/c", "https://ex.com/d", "https://ex.com/e", "https://ex.com/a/b?y", "https://ex.com/a/b?x=1#z", "https://o.com/p"]


@pytest.mark.parametrize(
    "url,want,removed",
    [
        ("https://a.com/?utm_source=x&id=7", "https://a.com/?id=7", ["utm_source"]),
        ("https://a.com/?&&id=7&", "https://a.com/?&&id=7&", []),
        ("https://a.com/?&a&UTM_x=1&&b=#f", "https://a.com/?a&b=#f", ["UTM_x"]),
        ("https://a.com/?fbclid", "https://a.com/", ["fbclid"]),
        ("https://a.com/?f%62clid=1&ga_source=2&ga_other=3", "https://a.com/?ga_other=3", ["fbclid", "ga_source"]),
        ("https://www.amazon.de/dp/1?ref=x&pf_rd_p=2&sr=1&q=z", "https://www.amazon.de/dp/1?q=z", ["ref", "pf_rd_p", "sr"]),
        ("https://other.de/dp/1?ref=x", "https://other.de/dp/1?ref=x", []),
    ],
)
def test_clean(url, want, removed):
    done = ENGINE.clean(parse(url))
    assert (done.url, done.removed, done.changed) == (want, removed, bool(removed))


def test_clean_config():
    e = Engine(RULES, Config(keep_params=("utm_s*",), extra_tracking_params=("foo", "bar*"), exclude_domains=("safe.com",), apply_vendor_rules=False))
    assert e.clean(parse("https://a.com/?utm_source=1&utm_term=2&foo=3&barx=4")).removed == ["utm_term", "foo", "barx"]
    assert not e.clean(parse("https://x.safe.com/?utm_term=2")).changed
    assert not e.clean(parse("https://www.amazon.de/?tag=2")).changed


@pytest.mark.parametrize(
    "url,want,unwrapped,rejected",
    [
        ("https://u1.ct.sendgrid.net/ls/click?upn=1&url=https%3A%2F%2Fd.com%2F%3Futm_source%3Dx%26a%3D1", "https://d.com/?a=1", True, None),
        ("https://links.brand.com/ls/click?my_url_id=3", "https://links.brand.com/ls/click?my_url_id=3", False, None),
        ("https://www.google.com/url?sa=t&q=https://d.com/", "https://d.com/", True, None),
        ("https://www.google.com/url?q=http://192.168.0.1/", "https://www.google.com/url?q=http://192.168.0.1/", False, "private-ip"),
        ("https://m.x.com/e/c/" + base64.urlsafe_b64encode(b'{"href":"https://d.com/p"}').decode() + "/sig", "https://d.com/p", True, None),
        ("https://m.x.com/lnk/a/1/t/" + base64.urlsafe_b64encode(b"https://d.com/long/path").decode().rstrip("="), "https://d.com/long/path", True, None),
        ("https://k.awstrack.me/L0/https:%2F%2Fd.com%2Fx/1/sig", "https://d.com/x", True, None),
    ],
)
def test_unwrap(url, want, unwrapped, rejected):
    got = ENGINE.unwrap(parse(url))
    assert (got.url, got.unwrapped, got.rejected) == (want, unwrapped, rejected)


def test_targets():
    assert str(decode_target("https%253A%252F%252Fd.com%252F")) == "https://d.com/"
    assert from_base64("aHR0cHM6Ly9kLmNvbS8") and from_base64("short") is None and from_base64("aHR0cHM6Ly9kLmNvbS8_+") is None
    assert [reject_reason(parse(u)) for u in ("javascript:alert(1)", "https://u@h.com/", "https://h.com/", "http://100.64.0.1/", "http://[fd00::1]/", "http://[::ffff:10.0.0.1]/")] == ["bad-scheme:javascript", "userinfo", None, "private-ip", "private-ip", "private-ip"]
    assert not blocked_ip("8.8.8.8") and not blocked_ip("h.com") and blocked_ip("[fe80::1]")
    assert mixed_script("pаypal.com") and not mixed_script("paypal.com")
    assert registrable("a.b.co.uk") == "b.co.uk" and registrable("me.github.io") is None and registrable("x.com") == "x.com"
    assert canonical_link("HTTPS://A.com/x%20y?b=1&a=%32#f") == "https://a.com/x y?a=2&b=1"


def test_formats():
    assert [detect(x) for x in ('{"providers":{}}', '[{"action":"redirect"}]', '[{"params":["a"]}]', "[{}]", "||a.com^", "{x")] == ["clear-urls", "brave-debounce", "brave-clean-urls", None, "ad-guard", "ad-guard"]
    debounce = json.dumps([{"include": ["*://r.com/*"], "action": "redirect", "param": "u"}, {"include": ["*://b.com/*"], "action": "base64,redirect", "param": "u"}, {"include": ["*://p.com/*"], "action": "regex-path-template", "param": "^/go/(.*)/(.*)$", "redirect_url_template": "https://$2/$1"}, {"action": "redirect", "param": "u", "pref": "x"}, {"include": ["*://s.com/*"], "action": "regex-path", "param": "^/(.*)$", "prepend_scheme": "https"}])
    r = load([("d", debounce)], with_builtin=False)
    assert len(r.redirects) == 4 and r.reports[0].unsupported == 1
    e = Engine(r)
    go = lambda u: e.unwrap(parse(u))
    assert go("https://r.com/?u=https://d.com/").url == "https://d.com/"
    assert go("https://r.com/?u=https://d.com/&u=https://e.com/").unwrapped is False
    assert go("https://r.com/?u=https://x.r.com/").rejected == "brave-destination-scope"
    assert go("https://b.com/?u=" + base64.b64encode(b"https://d.com/").decode()).url == "https://d.com/"
    assert go("https://p.com/go/x/d.com").url == "https://d.com/x"
    assert go("https://s.com/d.com/y").url == "https://d.com/y"
    assert placeholders_ok("$1$2", 2) and not placeholders_ok("$10", 1) and not placeholders_ok("$1$1", 1) and not placeholders_ok("a$", 1)


def test_ad_guard():
    lines = "! note\n||a.com^$removeparam=x\n$removeparam=/y=[0-9]+/\n@@||b.com^$removeparam=x\n@@||c.com^$removeparam\n||img.com^$image\n$removeparam=/a,b/\nplain\n$removeparam=z,domain=d.com|e.com\n"
    r = load([("f", lines)], with_builtin=False)
    assert (len(r.params), len(r.beacons), r.reports[0].unsupported) == (5, 1, 2)
    e = Engine(r)
    c = lambda u: e.clean(parse(u)).removed
    assert c("https://a.com/?x=1&y=2&X=3&x") == ["x", "y", "X"]
    assert c("https://c.com/?y=2") == [] and c("https://s.d.com/?z=1") == ["z"] and c("https://q.com/?z=1") == []
    assert e.beacon("https://img.com/a.png") and not e.beacon("https://b.com/a.png")
    assert len(load([("f", "site##.ad\n")], usage={"f": "mail-beacon"}, with_builtin=False).beacons) == 1


def test_budgets_and_duplicates():
    pack = json.dumps({"providers": {"P": {"urlPattern": "^https?://p", "rules": ["a", "A", "(?=x)"], "exceptions": ["ok"]}, "Bad": {"urlPattern": "("}}})
    r = load([("u:p@x?y", pack), ("u:p@x?y", pack), ("two", pack)], with_builtin=False)
    assert [(x.loaded, x.duplicates, x.failed) for x in r.reports] == [(1, 1, 2), (0, 2, 2)]
    assert load([("one", pack)], limits=Limits(source_bytes=10)).reports[1].error == "source too large"
    assert load([("one", pack)], limits=Limits(rules=1)).reports[1].error == "too many rules"
    assert load([("one", pack)], disabled=["p"], with_builtin=False).stats()["params"] == 0
    assert load([("x", json.dumps({"providers": {"P": {"urlPattern": "a", "exceptions": ["("]}}}))]).reports[1].error
    assert source_name("https://u:p@h/x?q#f") == "https://h/x"
    assert expansions("ga_(source|medium)") == ["ga_medium", "ga_source"] and expansions("a.*") is None
    assert normalise("utm_.*")[0].kind == "prefix" and normalise("srs?")[0].kind == "regex" and normalise("(?=a)") is None


def test_exceptions():
    pack = json.dumps({"providers": {"P": {"urlPattern": "^https?://p\\.com", "rules": ["a"], "referralMarketing": ["r"], "rawRules": ["/raw[0-9]"], "exceptions": ["p\\.com/keep"]}}})
    r = load([("p", pack)])
    assert Engine(r).clean(parse("https://p.com/x?a=1&r=2")).removed == ["a"]
    assert Engine(r, Config(strip_referral_marketing=True)).clean(parse("https://p.com/x?r=2")).removed == ["r"]
    assert Engine(r).clean(parse("https://p.com/keep?a=1&utm_x=2")).removed == []
    assert Engine(r).raw_rules("https://p.com/raw1/x") == "https://p.com/x"


def test_globs_against_a_plain_matcher():
    def plain(p, s):
        if not p:
            return not s
        return (p[0] == "*" and (plain(p[1:], s) or bool(s) and plain(p, s[1:]))) or (bool(s) and p[0] in ("?", s[0]) and p[0] != "*" and plain(p[1:], s[1:]))

    r = random.Random(7)
    for _ in range(3000):
        p, s = ("".join(r.choice("ab*?.") for _ in range(r.randrange(7))), "".join(r.choice("ab.") for _ in range(r.randrange(7))))
        assert bool(re.match(glob_regex(p), s)) == plain(p, s)
    for target, url, want in (("||a.com^", "https://x.a.com/", True), ("||a.com^", "https://xa.com/", False), ("|https://a", "https://a.com", True), ("com|", "https://a.com", True), ("a^b", "x/a/b", True), ("a^", "a", True)):
        assert bool(re.search(target_regex(target), url)) == want


def test_html():
    page = '<A HREF=\'https://a.com/?utm_x=1&amp;b=2\' ping="https://p">x</a><a href="#t">y</a><area href="https://u1.ct.sendgrid.net/ls/click?url=https%3A%2F%2Fd.com%2F"><img src="https://t.com/logo.png" class="logo" alt=""><img src="https://t.com/p.gif"><img src="cid:1" width=1 height=1><img src="https://x.com/a.png" style="display:none"><td background="https://doubleclick.net/b" style="background:url(\'https://ok.com/x\')">'
    r = clean_html(page, ENGINE)
    assert (r.urls_cleaned, r.redirects_unwrapped, r.pixels_removed, r.pings_stripped) == (1, 1, 3, 1)
    assert 'HREF="https://a.com/?b=2"' in r.html and 'href="https://d.com/"' in r.html and "cid:1" in r.html and "logo.png" in r.html and "ok.com" in r.html and "ping" not in r.html
    assert links(page)[1] == "#t" and len(links(page)) == 3
    assert clean_html(page, ENGINE, {"https://a.com/?b=2&utm_x=1"}).urls_cleaned == 0
    assert clean_html('<a href="https://bad.com/">', Engine(RULES, Config(blocked_domains=("bad.com",)))).html == '<a href="about:blank">'
    assert clean_html('<a href="/x?utm_a=1">', ENGINE, base_url="https://h.com/p").html == '<a href="https://h.com/x">'
    assert clean_html('<i style="width:1px;background:url(https://a.com/b)">', ENGINE).html == '<i style="width:1px;background:none">'
    assert not clean_html("x" * 100, Engine(RULES, Config(max_html_part_size=10))).changed
    assert style_facts("opacity: 0; width:5px; WIDTH: 1px;min-width:9px") == (True, 1, None)
    assert clean_html('<img src=unterminated <a href="https://a.com/?utm_a=1"', ENGINE).html
    assert clean_text("see (https://a.com/?utm_a=1), ok", ENGINE) == ("see (https://a.com/), ok", 1)


def message(ctype="text/html; charset=utf-8", cte="7bit", body=b'<a href="https://a.com/?utm_a=1">x</a>\n\n', sender="n@shop.example", more=""):
    return f"From: N <{sender}>\r\n{more}Content-Type: {ctype}\r\nContent-Transfer-Encoding: {cte}\r\n\r\n".encode() + body


def test_messages():
    out = clean_message(message(), ENGINE)
    assert out.cleaned.endswith(b'<a href="https://a.com/">x</a>\n\n') and out.urls_cleaned == 1 and b"X-Mailsieve-Modified: yes" in out.cleaned
    b64 = clean_message(message(cte="base64", body=base64.b64encode(b'<a href="https://a.com/?utm_a=1">\xc3\xa9</a>') + b"\r\n"), ENGINE)
    assert base64.b64decode(b64.cleaned.split(b"\r\n\r\n", 1)[1]) == b'<a href="https://a.com/">\xc3\xa9</a>'
    qp = clean_message(message(cte="quoted-printable", body=b'<a href=3D"https://a.com/?utm_a=3D1">=C3=A9</a>'), ENGINE)
    assert b'<a href=3D"https://a.com/">=C3=A9</a>' in qp.cleaned
    assert clean_message(message(sender="x@mail.paypal.com"), ENGINE).policy == "sensitive-sender"
    custom = Engine(RULES, Config(sender_policies=(Policy(("shop.example",), no_modify=True),)))
    quiet = clean_message(message(), custom)
    assert (quiet.modified, quiet.urls_cleaned, quiet.policy, quiet.mode) == (False, 1, "custom:shop.example", "report-only")
    unsub = clean_message(message(more="List-Unsubscribe: <mailto:a@b>,\r\n <https://a.com/?utm_a=1>\r\n"), ENGINE)
    assert unsub.urls_cleaned == 0 and ("X-Mailsieve-Unsubscribe", "https://a.com/?utm_a=1") in unsub.headers
    multi = b'Content-Type: multipart/alternative; boundary="B"\n\npre\n--B\nContent-Type: text/plain\n\nhttps://a.com/?utm_a=1\n--B\nContent-Type: text/html\n\n<a href="https://a.com/?utm_a=1">\n--B--\n'
    assert [(p.ctype, multi[p.start : p.end]) for p in parts(multi)] == [("text/plain", b"https://a.com/?utm_a=1"), ("text/html", b'<a href="https://a.com/?utm_a=1">')]
    assert clean_message(multi, ENGINE).cleaned.count(b"utm_a") == 1
    assert clean_message(multi, Engine(RULES, Config(clean_text_plain=True))).cleaned.count(b"utm_a") == 0
    small = Engine(RULES, Config(max_message_size=10))
    assert clean_message_fail_open(message(), small).error == "message too large"
    with pytest.raises(ValueError):
        clean_message_fail_open(message(), Engine(RULES, Config(max_message_size=10, fail_open=False)))
    assert clean_message(b"", ENGINE).modified is False
    assert with_headers(b"A: b\n\nbody", [("C", "d")]) == b"A: b\nC: d\n\nbody"
    assert max(map(len, quoted_printable(("é" * 200 + " \n=").encode()).split(b"\r\n"))) <= 76
    assert line_diff("a\nb\nc", "a\nx\nc") == ["-b", "+x"]


def test_config():
    c = parse_toml('mode = "report-only"\nblocked_domains = ["x.com"]\nrule_packs = ["p"]\n[[sender_policies]]\nmatch_domains = ["a.b"]\n')
    assert c.blocked_domains == ("x.com",) and c.sender_policies[0].match_domains == ("a.b",)
    with pytest.raises(ValueError):
        parse_toml("nonsense = 1")
    r = finalize(c, lambda name: b'{"providers": {"P": {"urlPattern": "p", "rules": ["q"]}}}')
    assert r.stats()["providers"] == 55


def test_session():
    import struct

    from mailsieve.streaming.session import Session

    s = Session(1000)
    assert s.feed("O", struct.pack(">III", 6, 0xFF, 0), ENGINE) == [("O", struct.pack(">III", 6, 3, 0))]
    for cmd, p in (("M", b""), ("L", b"From\0a@shop.example\0"), ("L", b"Content-Type\0text/html\0"), ("N", b"")):
        assert s.feed(cmd, p, ENGINE) == [("c", b"")]
    s.feed("B", b'<a href="https://a.com/?utm_a=1">', ENGINE)
    out = s.feed("E", b"", ENGINE)
    assert out[0] == ("b", b'<a href="https://a.com/">') and out[-1] == ("c", b"") and sum(a == "h" for a, _ in out) == 9
    s.feed("B", b"x" * 2000, ENGINE)
    assert s.feed("E", b"", ENGINE) == [("t", b"")] and s.feed("D", b"", ENGINE) == []
