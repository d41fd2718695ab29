"""Commands, SQL functions, redirects over a made-up network, message reports, packs and rulesets."""

import io
import json

import pytest

from mailsieve import sql
from mailsieve.cli import main
from mailsieve.config import CACHE, Config, finalize
from mailsieve.functions import network
from mailsieve.functions.engine import Engine
from mailsieve.functions.html import clean_html
from mailsieve.functions.mime import clean_message, parts
from mailsieve.functions.url import Suffixes, parse, registrable
from mailsieve.operators import clean as ops
from mailsieve.plans import reports
from mailsieve.rules.packs import join, load, normalise, without
from mailsieve.sources.messages import read_packs

ENGINE = Engine(load())
RAW = b'From: A <a@shop.example.com>\nList-Unsubscribe: <https://shop.example.com/u>\nContent-Type: text/html\n\n<a href="https://a.com/?utm_a=1&id=2">x</a><a href="https://t.hubspotlinks.com/c?url=https%3A%2F%2Fb.com%2F" ping="https://p.example/">y</a><a href="https://shop.example.com/u">z</a><img src="https://t.example/o.gif" width=1 height=1>\n'


def run(*args, raw=b""):
    out = io.BytesIO()
    return main(list(args), io.BytesIO(raw), out), out.getvalue().decode()


def test_commands(tmp_path):
    code, text = run("clean-message", raw=RAW)
    assert code == 0 and 'href="https://a.com/?id=2"' in text and 'href="https://b.com/"' in text and "o.gif" not in text and "ping" not in text.split("\n\n", 1)[1]
    assert run("clean-html", "--base-url", "https://a.com/x/", raw=b'<a href="y?fbclid=1">')[1] == '<a href="https://a.com/x/y">'
    code, text = run("explain-url", "https://t.hubspotlinks.com/c?url=http%3A%2F%2F10.0.0.1%2F")
    assert "provider: hubspot" in text and "rejected: private-ip" in text
    text = run("explain-message", raw=RAW)[1]
    assert "sender: shop.example.com" in text and "[2]" in text and "unwrap -> https://b.com/" in text and "[3] https://shop.example.com/u: sensitive" in text
    assert run("print-trackers", raw=RAW)[1].splitlines()[-1] == "summary: redirect_wrappers=1 param_tracking_links=1 tracking_pixels=1 link_pings=1"
    diff = run("diff-message", raw=RAW)[1]
    assert diff.startswith("+X-Mailsieve") or "-<a href" in diff
    for name in ("b.eml", "a.eml"):
        (tmp_path / name).write_bytes(RAW)
    code, text = run("test-rules", str(tmp_path))
    assert code == 0 and [x.split(":")[0] for x in text.splitlines()] == ["[ok] a.eml", "[ok] b.eml", "2 messages, 0 failures"]
    pack = tmp_path / "p.json"
    pack.write_text('{"providers": {"z": {"urlPattern": "https://z[.]com", "rules": ["zz"]}}}')
    stats = json.loads(run("--rule-pack", str(pack), "rule-stats", "--json")[1])
    assert stats["providers"] == 55 and len(stats["reports"]) == 2
    assert "providers: 54" in run("rule-stats")[1]
    assert run("test-rules", str(tmp_path / "none"))[0] == 1


def test_sql_functions(spark):
    assert "message_parts" in sql.register(spark, ENGINE)
    row = spark.sql("select clean_url('https://a.com/?utm_a=1&b=2') a, unwrap_url('https://t.hubspotlinks.com/c?url=https%3A%2F%2Fb.com%2F') b, provider_of('https://www.amazon.de/') c, normal_url('HTTP://A.com') d, clean_url(null) e, param_is_tracking('https://a.com/', 'FBCLID') f").first()
    assert tuple(row) == ("https://a.com/", "https://b.com/", "amazon", "http://a.com/", None, True) or row.a == "https://a.com/?b=2"
    assert row.a == "https://a.com/?b=2"
    spark.createDataFrame([(1, RAW)], "i int, raw binary").createOrReplaceTempView("mails")
    got = spark.sql("select p.place, p.content_type, p.attachment from mails, lateral message_parts(raw) p").collect()
    assert [tuple(r) for r in got] == [(1, "text/html", False)]


ALLOW = Config(network_redirect_resolution=True, allowlisted_redirect_domains=("links.example",))
WEB = {"https://links.example/1": (302, "https://links.example/2"), "https://links.example/2": (301, "https://shop.example/p"), "https://links.example/3": (302, "http://10.0.0.1/"), "https://links.example/4": (200, None), "https://links.example/5": (302, "/5"), "https://links.example/6": (302, "ftp://x.example/")}


@pytest.mark.parametrize("n,goal,note", [(1, "https://shop.example/p", "final location"), (3, None, "rejected: private-ip"), (4, "https://links.example/4", "status 200"), (5, None, "too many redirects"), (6, None, "rejected: bad-scheme:ftp")])
def test_network(n, goal, note):
    asked = []
    got, said = network.resolve(parse(f"https://links.example/{n}"), ALLOW, lambda u, t: asked.append(u) or WEB[u], lambda h: ["93.184.216.34"])
    assert (str(got) if got else None, said) == (goal, note)
    assert all("links.example" in u for u in asked)


def test_network_refusals(spark):
    fetch, lookup = (lambda u, t: WEB[u]), (lambda h: ["93.184.216.34"])
    assert network.resolve(parse("https://other.example/"), ALLOW, fetch, lookup)[1] == "host not on the allowlist"
    assert network.resolve(parse("https://links.example/4"), ALLOW, fetch, lambda h: ["127.0.0.1"])[1] == "blocked address"
    df = spark.createDataFrame([("https://links.example/4",), ("mailto:x",), (None,)], "url string")
    web = dict(WEB)
    out = network.resolve_redirects(df, ALLOW, lambda u, t: web[u], lambda h: ["93.184.216.34"]).collect()
    assert [r.resolved_url for r in out] == ["https://links.example/4", None, None]
    with pytest.raises(ValueError):
        network.resolve_redirects(df, Config(), fetch, lookup)


def test_message_reports(spark):
    df = spark.createDataFrame([(1, RAW), (2, b"no html")], "msg_id long, raw binary")
    got = reports.explain_messages(df, ENGINE).orderBy("msg_id", "place").collect()
    assert [r.verdict for r in got] == ["clean", "unwrap", "sensitive"] and got[0].removed == ["utm_a"]
    assert [tuple(r)[1:] for r in reports.trackers(df, ENGINE).orderBy("msg_id").collect()] == [(1, 1, 1, 1), (0, 0, 0, 0)]
    assert any(x.startswith("-<a href") for x in reports.diff_messages(df, ENGINE).orderBy("msg_id").first()["diff"])


def test_raw_text_elements_stay():
    for html in ("<script>var t='<img src=\"https://t.example/o.gif\" width=1 height=1>'</script>", "<textarea><a href='https://a.com/?utm_a=1'>x</a></textarea>", "<title><a href='https://a.com/?utm_a=1'></title>"):
        assert clean_html(html, ENGINE).html == html
    assert clean_html("<p title=don't><a href='https://a.com/?utm_a=1'>", ENGINE).html == "<p title=don't><a href=\"https://a.com/\">"


def test_deep_and_forwarded_parts():
    leaf = b"Content-Type: text/html\r\n\r\n<a href=\"https://a.com/?utm_a=1\">x</a>\r\n"
    for i in range(60):
        leaf = b'Content-Type: multipart/mixed; boundary="b%d"\r\n\r\n--b%d\r\n%s\r\n--b%d--\r\n' % (i, i, leaf, i)
    assert b'href="https://a.com/"' in clean_message(leaf, ENGINE).cleaned
    inner = b"Content-Type: message/rfc822\r\n\r\nSubject: x\r\nContent-Type: text/html; charset*=utf-8''iso-8859-1\r\n\r\n<a href=\"https://a.com/?utm_a=1\">"
    assert [(p.ctype, p.charset) for p in parts(inner)] == [("text/html", "iso-8859-1")]
    split = b'Content-Type: multipart/mixed; boundary*0="a"; boundary*1=b\r\n\r\n--ab\r\n\r\nx\r\n--ab--\r\n'
    assert len(parts(split)) == 1 and parts(split)[0].ctype == "text/plain"


def test_packs_by_path(spark, tmp_path):
    for name in "AB":
        (tmp_path / name).mkdir()
        (tmp_path / name / "pack.json").write_text(f'{{"providers": {{"{name}": {{"urlPattern": "x"}}}}}}')
    paths = [str(tmp_path / "B" / "pack.json"), (tmp_path / "A" / "pack.json").as_uri()]
    assert ['"B"' in read_packs(spark, paths)[0][1], '"A"' in read_packs(spark, paths)[1][1]] == [True, True]


@pytest.mark.parametrize("host,want", [("a.b.co.kr", "b.co.kr"), ("b.co.kr", "b.co.kr"), ("x.com.br", "x.com.br"), ("a.x.de", "x.de"), ("co.uk", None), ("com", None), ("10.0.0.1", None), ("a.github.io", None), ("a.b.example", "b.example")])
def test_registrable(host, want):
    assert registrable(host) == want


def test_suffix_list():
    s = Suffixes("// x\ncom\nck\n*.ck\n!www.ck\nuk\nco.uk\n// ===BEGIN PRIVATE DOMAINS===\nshop.com\n")
    assert [registrable(h, s) for h in ("b.ck", "c.a.b.ck", "www.ck", "x.co.uk", "x.shop.com", "y.com")] == [None, "a.b.ck", "www.ck", "x.co.uk", None, "y.com"]


def test_rulesets():
    one = load([("p", '{"providers": {"z": {"urlPattern": "https://z[.]com", "rules": ["zz", "q"]}, "y": {"urlPattern": "https://z[.]com", "rules": ["q"]}}}')], with_builtin=False)
    both = join(load(), one)
    assert both.stats()["providers"] == 56 and both.stats()["params"] == 171
    assert join(both, one).stats()["params"] == 171
    left = without(both, ["Z"])
    assert left.stats()["providers"] == 55 and left.stats()["params"] == 170
    assert Engine(left).clean(parse("https://z.com/?zz=1&q=2")).url == "https://z.com/?zz=1"
    config = Config(rule_packs=("x",))
    a = finalize(config, lambda n: b'{"providers": {}}')
    assert finalize(config, lambda n: b'{"providers": {}}') is a and len(CACHE) <= 16
    assert finalize(config, lambda n: b'{"providers": {"n": {"urlPattern": "n"}}}') is not a
    assert finalize(Config(rule_pack_urls=("http://x.example/p",)), lambda n: b'{"providers": {}}').reports[-1].error
    assert [m.value for m in normalise("a{2}(bb|cc)")] == ["aabb", "aacc"] and normalise("srs?")[0].kind == "regex"


def test_names_of_any_number(spark):
    df = spark.createDataFrame([(1, "https://a.com/?x=1&B=2"), (1, "https://a.com/?B=2&z=1#f"), (2, "https://a.com/"), (3, None), (4, "https://a.com/?keep=1")], "id int, url string")
    names = spark.createDataFrame([("b",), ("x",)], "name string")
    want = [(1, "https://a.com/", 2), (1, "https://a.com/?z=1#f", 1), (2, "https://a.com/", 0), (3, None, 0), (4, "https://a.com/?keep=1", 0)]
    for most in (1, 100):
        got = ops.strip_by_join(df, names, max_in_list=most).select("id", "cleaned_url", "n_removed").collect()
        assert sorted((r[0], r[1], max(r[2], 0)) for r in got) == want


def test_packets_of_files(spark, tmp_path):
    from mailsieve.streaming.session import framed, frames, read_packets

    every = [("M", b""), ("B", b"x" * 300), ("Q", b"")]
    raw = b"".join(framed(c, p) for c, p in every)
    assert frames(raw) == every and frames(raw, limit=100) == [("M", b""), ("Q", b"")] and frames(raw[:-3]) == every[:2]
    assert frames(b"\0\0\0\0") == [("Q", b"")] and frames(b"") == []
    (tmp_path / "c1.bin").write_bytes(raw)
    (tmp_path / "c2.bin").write_bytes(framed("M", b"")[:4])
    got = read_packets(spark, str(tmp_path)).orderBy("conn_id", "seq").collect()
    assert [(r.conn_id, r.seq, r.cmd, bytes(r.payload)) for r in got] == [("c1.bin", i, c, p) for i, (c, p) in enumerate(every)] + [("c2.bin", 0, "Q", b"")]
    stream = read_packets(spark, str(tmp_path), stream=True).writeStream.format("memory").queryName("packets").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert spark.table("packets").count() == 4
