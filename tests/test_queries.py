"""Every query against its DuckDB equivalent, the operators on tables, and the stream."""

import glob
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from mailsieve import queries
from mailsieve.functions import columns as C
from mailsieve.functions.engine import Engine
from mailsieve.operators import clean as ops
from mailsieve.plans import reports
from mailsieve.rules.packs import load
from mailsieve.sources.messages import read_messages, read_packs
from mailsieve.streaming.session import replies

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in queries.ORACLE:
        con = duckdb.connect()
        for p in glob.glob(f"{SF}/*.parquet"):
            con.sql(f"create view {p.split('/')[-1][:-8]} as select * from read_parquet('{p}')")
        want = con.sql(queries.ORACLE[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert sorted((tuple(r[c] for c in want.columns) for r in rows), key=str) == sorted(want.fetchall(), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_native_agrees_with_arrow(spark):
    rules = load()
    e = queries.table(spark, SF, "events", url=queries.EVENT_URL).select("event_id", "url")
    native = queries.strip_columns(e, F.col("url"), lambda s: C.any_match(C.global_params(rules), s)).select("event_id", "cleaned_url")
    from mailsieve.config import Config

    arrow = ops.clean_urls(e, Engine(rules, Config(apply_vendor_rules=False))).select("event_id", "cleaned_url")
    assert native.exceptAll(arrow).count() == 0
    assert ops.normalise_urls(spark.createDataFrame([("HTTP://A.com",), (None,)], "url string")).where("normal_url is not null").first().normal_url == "http://a.com/"


def test_messages_from_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.eml").write_bytes(b'Content-Type: text/html\n\n<a href="https://a.com/?utm_a=%d">\n' % i)
    (tmp_path / "x.txt").write_text("no")
    (tmp_path / "pack.json").write_text('{"providers": {}}')
    out = ops.clean_messages(read_messages(spark, str(tmp_path)), Engine(load())).cache()
    assert [tuple(r) for r in reports.per_message(out).select("msg_id", "state", "urls_cleaned").collect()] == [(f"{i}.eml", "ok", 1) for i in range(3)]
    assert reports.totals(out).first().modified == 3
    assert read_packs(spark, [str(tmp_path / "pack.json")])[0][1] == '{"providers": {}}'
    assert reports.source_reports(spark, load()).count() == 1 and '"providers": 54' in reports.rule_stats_json(load())


def test_stream(spark, tmp_path):
    rows = [("c1", 1, "M", b""), ("c1", 2, "L", b"Content-Type\0text/html\0"), ("c1", 3, "B", b'<a href="https://a.com/?utm_a=1">'), ("c1", 4, "E", b""), ("c1", 5, "Q", b""), ("c2", 1, "M", b"")]
    schema = "conn_id string, seq long, cmd string, payload binary"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = replies(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), Engine(load()))
    q = stream.writeStream.format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    got = spark.table("out").collect()
    assert [bytes(r.payload) for r in got if r.action == "b"] == [b'<a href="https://a.com/">']
    assert math.isclose(sum(r.action == "h" for r in got), 9)
