"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing names, for operators and stages."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mailsieve.llm import common, decontaminate, jaccard_join, language, line_dedup, mixing, substring_dedup, suffix_dedup, topk, toxicity

R = random.Random(11)
VOCAB = [f"w{i}" for i in range(300)]
NAMES = "id th h mark runs run at n place first c m r spans span_id span_hash text_hash row key bucket nr nr_d tie index slots starts s0 b0 s1 k1 before kept words_of __text __id __h __grade rep hub node component cell leaf rows w s1_ packed keys share of unit dim sub block v q_id per_mark per_value mix_key mix_source total".split()
LONG = "\n".join(" ".join(R.choice(VOCAB) for _ in range(30)) for _ in range(4000))
SAME = "one and the same text of some more words than eight, here it is\nand a second line of it"


def sentence(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def rows():
    out = [(i, sentence(R.randrange(1, 60)) + (" scum idiot" if i % 4 == 0 else ""), "de" if i % 2 else "fr", "s" if i % 3 else "t", 5) for i in range(40)]
    out += [(100, None, None, None, None), (101, "", "de", "s", 0), (102, " \n\t", None, "", 1), (None, SAME, "fr", "s", 1), (None, None, None, None, None), (104, SAME, "de", "s", 3), (105, SAME, "de", "t", 3), (105, SAME, "de", "t", 3), (105, "another text under the same id, in quite a few words more", "fr", "u", 3), (106, LONG, "de", "s", 9)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in NAMES}).cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    labels = [(i, i % 2, int(i % 4 == 0)) for i in range(40)] + [(None, 1, 1), (101, None, None), (104, 1, 0), (104, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, rows()[3][1] + " and more " + sentence(20)), (2, None), (None, SAME), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return str(d)


def passed_through(before, after):
    """Clashing columns come back as they were, with their rows."""
    have = {x: n for x, n in ((tuple(r[c] for c in NAMES), 1) for r in before.select(*NAMES).collect())}
    assert all(tuple(r[c] for c in NAMES) in have for r in after.select(*NAMES).collect())


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, folder)
    assert out.columns[: len(docs.columns)] == docs.columns and [f.dataType for f in out.schema][: len(docs.columns)] == [f.dataType for f in docs.schema]
    got = out.collect()
    assert len(got) <= docs.count() and len(got) > 30
    passed_through(docs, out)
    ids = [r.doc_id for r in got]
    if name in ("toxicity", "decontamination", "mixing"):
        assert ids.count(105) == 3 and ids.count(None) == 2 and {100, 101, 102, 106} <= set(ids)
    if name == "jaccard_join":
        assert ids.count(104) == 1 and ids.count(105) == 1 and ids.count(None) == 2 and {100, 101, 102, 106} <= set(ids)
    if name == "line_dedup":
        assert next(r.text for r in got if r.doc_id == 106) == LONG and next(r.text for r in got if r.doc_id == 104) == SAME
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_pipeline_runs_whole(spark, folder, tmp_path):
    got = corpus_pipeline.run(spark, folder).collect()
    assert {"doc_id", "text", "mix_slot", "mix_position"} <= set(got[0].asDict()) and sorted(r.mix_position for r in got) == list(range(len(got)))
    toxic = {r.doc_id for r in toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).where("toxic").collect()}
    assert not toxic & {r.doc_id for r in got}
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_operators_take_any_other_columns(spark, docs, folder):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").withColumn("doc_id", F.lit(1))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    n = docs.count()
    for f in (substring_dedup.dedup, suffix_dedup.dedup, jaccard_join.join, language.identify):
        one, two = f(docs), f(plain)
        assert one.columns == two.columns and one.count() == n
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
        assert f(docs.limit(0)).count() == 0
    assert sorted(map(str, decontaminate.find(docs, bench).collect())) == sorted(map(str, decontaminate.find(plain, bench).collect()))
    score = toxicity.score(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    passed_through(docs, score)
    assert score.count() == n
    passed_through(docs, line_dedup.dedup(docs))


def test_vectors_with_other_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], "x") for i in range(50)], "vec_id long, embedding array<double>, cell string").withColumns({n: F.lit("x") for n in ("dim", "v", "sub", "block", "bar", "q_id", "rank")})
    assert topk.top_k(df, k=3, shard_rows=10).count() == 9


def test_any_number_of_languages(spark):
    words = {f"l{k}": [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in "aeiou"] for k in range(140)}
    data = [(4 * i + k, " ".join(R.choice(words[n]) for _ in range(30)), n) for k, n in enumerate(words) for i in range(0, 4000, 250)]
    df = spark.createDataFrame([(j, t, n) for j, (_, t, n) in enumerate(data)], "doc_id long, text string, lang string")
    out = language.identify(df, per_lang=30).join(df.select("doc_id", "lang"), "doc_id").where("held_out").select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("right"), F.count_distinct("lang_pred").alias("n")).first()
    assert out.right > 0.8 and out.n > 100


def brute_schedule(parts, counts, block):
    """Slot by slot: of the released blocks that one with the earliest deadline."""
    total, done, t, out = sum(parts), [0] * len(parts), 0, []
    while any(k * block < n for k, n in zip(done, counts)):
        ready = [(-(-(done[i] + 1) * total // parts[i]), i) for i in range(len(parts)) if done[i] * block < counts[i] and done[i] * total // parts[i] <= t]
        if ready:
            _, i = min(ready)
            out.append((i, done[i], t))
            done[i] += 1
        t += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_schedule_against_slot_by_slot(seed):
    r = random.Random(seed)
    parts = [r.randrange(1, 60) for _ in range(r.randrange(1, 9))]
    counts = [40 * p for p in parts]  # no source runs out before the others
    source, number, slot, short = mixing.deal(parts, counts, 4)
    assert list(zip(source.tolist(), number.tolist(), slot.tolist())) == brute_schedule(parts, counts, 4)
    had = [0] * len(parts)
    for t, i in enumerate(source.tolist()):
        had[i] += 1
        assert all(abs(h - Fraction((t + 1) * p, sum(parts))) < 1 for h, p in zip(had, parts))


def test_frequent_keys_are_broadcast(spark):
    left = spark.range(10_000).select((F.col("id") % 10 == 0).cast("int").alias("k"), "id").withColumn("k", F.when(F.col("k") == 0, -1).otherwise(F.col("id")))
    per = left.groupBy("k").agg(F.count("*").alias("c"), F.max("id").alias("top"))
    out = common.by_key(left, per, ["k"], "c", 10_000)
    assert out.count() == 10_000 and out.where("k = -1").agg(F.min("top")).first()[0] == 9999
    assert common.fresh("Text", ["text", "Text_"]) == "Text__"


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
