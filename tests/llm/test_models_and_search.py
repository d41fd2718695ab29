"""Decontamination, language, toxicity, top-k, mixing, HTML and the pipeline."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import decontaminate, html_text, language, mixing, topk, toxicity
from mailsieve.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def edit_distance(a, b):
    """Least word edits of a to any stretch of b."""
    line = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(line[j] + (x != y), line[j + 1] + 1, new[j] + 1))
        line = new
    return min(line)


def test_decontaminate_recall_and_precision(spark):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(15, 58)))) for i in range(40)] + [(50, ""), (51, None), (None, "a b")]
    docs, planted = [], set()
    for d in range(300):
        words = [r.choice(vocab) for _ in range(r.randrange(0, 200))]
        if d % 2:
            i = r.randrange(40)
            item = items[i][1].split()
            for _ in range(r.randrange(0, int(0.2 * len(item)) + 1)):
                k = r.randrange(len(item))
                kind = r.random()
                item[k : k + 1] = [r.choice(vocab)] if kind < 0.5 else [] if kind < 0.75 else [item[k], r.choice(vocab)]
            at = r.randrange(len(words) + 1)
            words[at:at] = [w.upper() + r.choice(["", ",", "."]) for w in item]
            planted.add((d, i))
        docs.append((d, " ".join(words), "x"))
    docs += [(1000, None, None), (1001, "", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id): x.edit_distance for x in decontaminate.find(df, bench).collect()}
    strip = lambda t: [w.strip(",.").lower() for w in t.split()]
    text = {d: strip(t) for d, t, _ in docs if t}
    truth = {}
    for d, i in planted:
        n = edit_distance(strip(items[i][1]), text[d])
        if n <= 0.2 * len(items[i][1].split()):
            truth[d, i] = n
    assert len(truth) > 100
    assert len(set(truth) & set(found)) >= 0.97 * len(truth)
    for (d, i), n in found.items():
        assert edit_distance(strip(items[i][1]), text[d]) <= n <= 0.2 * len(items[i][1].split())
    few = {(x.doc_id, x.item_id) for x in decontaminate.find(df, bench, block_words=200).collect()}
    assert few == set(found)
    kept = {x.doc_id for x in decontaminate.clean(df, bench).collect()}
    assert kept == {d for d, _, _ in docs} - {d for d, _ in found}
    assert decontaminate.find(df, bench.limit(0)).count() == 0
    assert decontaminate.find(df.limit(0), bench).count() == 0


def test_language_held_out(spark):
    rows = QUERIES["op3_language"](spark, "/root/testdata/sf0.01").collect()
    lang = {x.doc_id: x.lang for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == 1000
    for x in rows:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2)
        assert 0 <= x.score <= 1
    held = [x for x in rows if x.held_out and lang[x.doc_id]]
    right = sum(x.lang_pred == lang[x.doc_id] for x in held)
    assert right >= 0.93 * len(held)


def test_language_edges(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["le", "la", "ça"] if i % 2 else ["der", "die", "über"]) for _ in range(12)), "fr" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "fr"), (101, "123 ...", "de"), (102, "", None), (None, "der die", "de"), (103, "le la " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    out = {x.doc_id: x for x in language.identify(df).collect()}
    assert [out[k].lang_pred for k in (100, 101, 102, 103)] == ["und", "und", "und", "fr"]
    assert out[None].held_out is False and out[None].lang_pred == "de"
    assert out[100].score == 0
    nothing = language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {x.lang_pred for x in nothing} == {"und"} and len(nothing) == len(rows)
    assert language.identify(df.limit(0)).count() == 0


def test_toxicity(spark):
    r = random.Random(4)
    bad, good = ["idiot", "scum", "trash"], [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [r.choice(good) for _ in range(r.randrange(3, 60))]
        for _ in range(r.randrange(2, 5) if toxic else 0):
            words[r.randrange(len(words))] = r.choice(bad).upper() + "!"
        rows.append((i, " ".join(words)))
        if i < 400:
            labels.append((i, 1 - (i % 10 == 0), int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "idiot scum")]
    labels += [(None, 1, 1), (5, None, None), (7, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("grade", F.lit("old"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in toxicity.score(df, lab).collect()}
    assert len(out) == len(rows)
    test = range(400, 600)
    assert sum(out[i].toxic == (i % 5 == 0) for i in test) >= 0.92 * len(test)
    assert not out[1000].toxic and not out[1001].toxic and out[None].toxic
    assert all(0 <= x.severity <= 2 and 0 <= x.grade <= 2 for x in out.values())
    assert {x.severity for x in toxicity.score(df, lab.limit(0)).collect()} == {0.0}
    assert toxicity.score(df.limit(0), lab).count() == 0


def test_toxicity_of_held_out_documents(spark):
    """Labels that the model has not seen."""
    d = "/root/testdata/sf0.1"
    out = QUERIES["op9_toxicity"](spark, d).withColumnRenamed("toxic", "said").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(x.said and x.toxic == 1 for x in out)
    assert len(out) > 900 and hit >= 0.92 * sum(x.said for x in out) and hit >= 0.7 * sum(x.toxic == 1 for x in out)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in out)


def test_ordinal_thresholds_are_ordered():
    r = np.random.default_rng(0)
    grade = r.integers(0, 4, 400)
    slot = np.concatenate([np.unique(np.append(r.integers(10, 60, 5), np.arange(g))) for g in grade])
    off = np.append(0, np.cumsum([len(np.unique(np.append(x, np.arange(g)))) for x, g in zip([[]] * 400, grade)]))
    sizes, parts = [], []
    for g in grade:
        p = np.unique(np.append(r.integers(10, 60, 5), np.arange(g)))
        parts.append(p)
        sizes.append(len(p))
    slot, off = np.concatenate(parts).astype(np.int64), np.append(0, np.cumsum(sizes))
    m = toxicity.fit_arrays(slot, off, grade)
    assert (np.diff(m.thresholds) > 0).all() and len(m.thresholds) == 3
    table = np.zeros(60)
    table[m.slots] = m.weights
    severity = toxicity.sigmoid(toxicity.sums(table[slot], off)[:, None] - m.thresholds).sum(axis=1)
    assert np.corrcoef(severity, grade)[0, 1] > 0.9


@pytest.mark.parametrize("shard_rows", [16384, 60])
def test_topk(spark, shard_rows):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=8).astype(np.float32)]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(30)]
    rows += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (520, [float("inf")] * 8), (None, rows[0][1]), (540, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = sorted(tuple(x) for x in topk.top_k(df, shard_rows=shard_rows, block_rows=7).collect())
    v = {i: np.floor(64 * np.array(x)) for i, x in rows[:430]}
    want = []
    for q in v:
        if q % 20 == 0:
            best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:20]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_pfair_deviation():
    share = mixing.shares({"a": 5, "b": 2, "c": 2.5, "d": 0.01, "e": 0}, 100)
    assert sum(share.values()) == 100 and "e" not in share and share["d"] == 1
    table = mixing.one_period(share, 100)
    had = dict.fromkeys(share, 0)
    for t, s in enumerate(table):
        had[s] += 1
        for k, n in had.items():
            assert abs(n - Fraction((t + 1) * share[k], 100)) < 1


def test_mix(spark):
    rows = [(i, "t", "ABC"[min(2, i % 7 // 3)]) for i in range(500)] + [(900, None, None), (900, None, None), (None, "x", "A")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_slot", F.lit("old"))
    out = mixing.mix(df, block=4, period=50).collect()
    assert len(out) == len(rows)
    assert sorted(x.mix_position for x in out) == list(range(len(rows)))
    out.sort(key=lambda x: x.mix_position)
    assert [x.mix_slot for x in out] == sorted(x.mix_slot for x in out)
    n = {}
    for x in out:
        n[x.source] = n.get(x.source, 0) + 1
    share = mixing.shares({k or "": v**0.5 for k, v in n.items()}, 50)
    had = dict.fromkeys(share, 0)
    on = [x for x in out if x.mix_on_target]
    assert on == out[: len(on)]
    for x in on:
        had[x.source or ""] += 1
        blocks = sum(had.values()) / 4
        if blocks == int(blocks):
            assert all(abs(Fraction(c, 4) - Fraction(int(blocks) * share[k], 50)) < 1 for k, c in had.items())
    given = mixing.mix(df, weights={"A": 1, "Z": 3}).collect()
    assert len(given) == len(rows) and {x.mix_slot is None for x in given if x.source != "A"} == {True}
    assert mixing.mix(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header>Site</header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="ad">Buy, now.</div>
<div id="cookie-notice">We use cookies, really.</div><div id=main class=content><h1>Head&shy;line</h1>
<p>First   para&nbsp;graph, with &lt;text&gt; and <b>bo</b>ld, long enough to count as a real paragraph of the article.<p>Second one,
with a <a href=x>link</a><br>after the break, and quite some more words to make it long.</p><!-- no --><p>Third.</p>
<form><input value=x><p>Type here</p></form></div><div class="sidebar"><p>Side text, with, commas, and more, words, for points.</p></div>
<div class="comments"><p>I think, that, this, comment, is not, an article.</p></div><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    want = "Head­line First para graph, with <text> and bold, long enough to count as a real paragraph of the article. Second one, with a link after the break, and quite some more words to make it long. Third."
    assert html_text.main_text(PAGE) == want
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>a<p>b"), (None, "u", "<div>" * 20_000 + "deep" + "</div>"), (5, "u", "<script>x"), (6, "u", "<a href='x>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = [(x.page_id, x.text, x.n_chars) for x in html_text.extract(df).collect()]
    assert out[0] == out[1] == (1, want, len(want))
    assert out[2:] == [(2, "", 0), (3, "", 0), (4, "a b", 3), (None, "deep", 4), (5, "", 0), (6, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0
    long = "<article><p>" + "word, " * 300_000 + "</p></article>"
    assert len(html_text.main_text(long)) == len("word, " * 300_000) - 1


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {x.doc_id for x in docs.select("doc_id").collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, SF).toPandas(), at.schema)
        assert at.columns == docs.columns
        now = {x.doc_id for x in at.select("doc_id").collect()}
        assert now <= before and len(now) > 0.3 * len(before)
        before = now
    out = corpus_pipeline.run(spark, SF).collect()
    assert {x.doc_id for x in out} == before
    assert sorted(x.mix_position for x in out) == list(range(len(out)))


@pytest.mark.parametrize("counts", [{"a": 7000} | {f"s{i}": 700 for i in range(20)}, {"a": 60_000} | {f"s{i:03}": 100 for i in range(200)}])
def test_mix_follows_exact_weights(counts):
    names, parts = sorted(counts), mixing.whole({k: n**0.5 for k, n in counts.items()})
    part, n = np.array([parts[k] for k in names], object), [100 * counts[k] for k in names]
    source, number, slots, short = mixing.deal(list(part), n, 8)
    assert len(source) == sum(-(-x // 8) for x in n) and (np.diff(slots) > 0).all() and short > 20_000
    share = (part / part.sum()).astype(float)
    had = np.zeros(len(names))
    for t in range(short):
        assert slots[t] == t and number[t] == had[source[t]]
        had[source[t]] += 1
        assert np.abs(had - (t + 1) * share).max() < 1 + 1e-6
    w = [Fraction(int(part[i]), int(part.sum())) for i in source[short:]]
    assert all(int(k / x) <= s < -(-(k + 1) // x) for k, x, s in zip(number[short:].tolist(), w, slots[short:].tolist()))


def test_mix_follows_given_weights(spark):
    df = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 6000, "a").otherwise(F.concat(F.lit("b"), F.col("id") % 10)).alias("source"))
    weights = {"a": 0.6} | {f"b{i}": 0.04 for i in range(10)}
    had = {k: 0 for k in weights}
    for x in sorted((x for x in mixing.mix(df, weights=weights, block=2).collect() if x.mix_on_target), key=lambda x: x.mix_position):
        had[x.source] += 1
        if sum(had.values()) % 2 == 0:
            assert all(abs(n - sum(had.values()) * weights[k]) < 2 + 1e-6 for k, n in had.items())
    assert sum(had.values()) > 9000


ARTICLE = "".join(f"<p>Paragraph {i}, long enough to count, with some commas, and words of the article.</p>" for i in range(6))


@pytest.mark.parametrize("name", ["content has-sidebar", "layout no-sidebar", "page with-header", "post has-tags", "legal-text", "sidebar-layout", "main-side", "social"])
def test_html_name_of_wrapper_drops_no_article(name):
    want = html_text.main_text(f"<div>{ARTICLE}</div>")
    assert want.count("Paragraph") == 6
    aside = "<div class='sidebar'><p>Side text, with, commas.</p></div><ul class='nav'><li><a href=x>Menu</a></li></ul>"
    for page in ("<div class='{}'>{}</div>{}", "<article><div class='{}'>{}</div>{}</article>", "<div class='{}'><div>{}</div>{}</div>", "<section id=x><div id='{}'>{}</div></section>{}"):
        assert html_text.main_text(page.format(name, ARTICLE, aside)) == want, page


def test_html_names_of_parts():
    want = html_text.main_text(f"<div>{ARTICLE}</div>")
    for name in ("comments", "related-posts", "share", "post-tags", "cookie-notice"):
        part = f"<div class='{name}'><a href=x>one</a>, <a href=y>two</a></div>"
        assert html_text.main_text(f"<div>{ARTICLE}{part}</div>") == want
    thread = "<div class='comments'>" + ARTICLE.replace("Paragraph", "Comment") * 2 + "</div>"
    assert html_text.main_text(f"<article>{ARTICLE}{thread}</article>") == want
    post = f"<div class='post has-tags'>{ARTICLE}</div>"
    assert html_text.main_text(f"<div>{post}{post}{post}</div>").count("Paragraph") == 18


def test_mix_of_more_than_1000_sources(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), F.col("id") % 1500).alias("source"))
    out = mixing.mix(many).collect()
    assert sorted(x.mix_position for x in out) == list(range(3000)) and {x.mix_slot for x in out} == set(range(1500))
