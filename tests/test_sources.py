"""Readers, decoders and sinks."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tickloom.operators import ops
from tickloom.sources import files, market, pages, sinks


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Größe\nzwei", encoding="utf-8")
    xml = '<w:document><w:p><w:t>One &amp; two</w:t></w:p><w:p><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:p></w:document>'
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "Größe\nzwei", "b.docx": "One & two\na\tb\n\n"}
    with pytest.raises(ValueError):
        files.document_text("x.md", b"")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("other", "")
    with pytest.raises(ValueError):
        files.docx_text((tmp_path / "c.docx").read_bytes())


def test_csv(spark, tmp_path):
    body = '﻿code,name,category,content,tags,source\n600519,"a, ""b""",x,"text, more",t,s\n\n# note\n1,2\n,n,c,text\n7,n,,body\n'
    (tmp_path / "k.csv").write_text(body, encoding="utf-8")
    rows = files.read_csv(spark, str(tmp_path / "k.csv"))
    got = {r["line_no"]: r for r in rows.collect()}
    assert [got[k]["status"] for k in range(2, 8)] == ["ok", "skipped", "skipped", "short", "missing", "ok"]
    assert (got[2]["stock_name"], got[2]["content"], got[7]["source"]) == ('a, "b"', "text, more", "")
    assert files.csv_stats(rows.where("line_no < 8")).first().asDict() == {"imported": 2, "total_rows": 6, "skipped": 4, "errors": 2}


def test_json_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"id": "a", "stockCode": " 1 ", "content": "c", "category": "", "createdAt": "2024-01-01T00:00:00Z"}, {"id": "b"}]))
    rows = {r["id"]: r for r in files.manifest(spark, str(tmp_path / "m.json")).collect()}
    assert rows["a"]["stock_code"] == "1" and rows["a"]["category"] == "general" and rows["b"]["content"] == ""
    (tmp_path / "v.json").write_text(json.dumps({"entries": [{"id": "x", "embedding": {"vector": [1.0, 0.5]}, "embedded": {"text": "t", "metadata": {"metadata": {"k": "v"}}}}]}))
    r = files.vector_store(spark, str(tmp_path / "v.json")).first()
    assert (r["chunk_id"], r["vector"], r["content"], r["metadata"]) == ("x", [1.0, 0.5], "t", {"k": "v"})
    (tmp_path / "bad.json").write_text("not json")
    assert files.vector_store(spark, str(tmp_path / "bad.json")).count() == 0 and files.manifest(spark, str(tmp_path / "bad.json")).where("id is not null").count() == 0
    (tmp_path / "c.jsonl").write_text('{"id": "1", "expected": "pass"}\n\n{"id": "2", "toolObservations": ["a"]}\n')
    assert files.cases(spark, str(tmp_path / "c.jsonl")).count() == 2
    (tmp_path / "d.jsonl").write_text('{"id": "1"}\n{oops\n')
    with pytest.raises(Exception):
        files.cases(spark, str(tmp_path / "d.jsonl")).collect()


def test_quotes(spark):
    q = one(spark, 'var hq="n,1495.0,1498.05,1500.0,1520.5,1490,0,0,12345678,9";', market.quoted_csv_quote)
    assert (q["name"], q["price"], q["open"], q["high"], q["low"], q["change"], q["volume"]) == ("n", 1500.0, 1495.0, 1520.5, 1490.0, 0.13, 123456)
    assert one(spark, 'x="a,b"', market.quoted_csv_quote) is None and one(spark, None, market.quoted_csv_quote) is None
    q = one(spark, '{"data":{"f43":1500.0,"f44":1520.5,"f45":1490,"f46":1495,"f47":123456,"f57":"600519","f58":"n","f116":1.885e12,"f162":"-","f170":0.13}}', market.json_quote)
    assert (q["code"], q["price"], q["volume"], q["pe"], q["market_cap"], q["change"]) == ("600519", 1500.0, 123456, None, 1.885e12, 0.13)
    for bad in ('{"rc":0,"data":null}', "{}", "not-a-json", None):
        assert one(spark, bad, market.json_quote) is None


def test_bars(spark):
    lines = ["2026-08-07,1,2,3,0.5,35000,1,1", "2026-08-08,1,-,3,0.5,1", "2026-08-09,1,2", "2026-08-10,1,2,3,0.5,--"]
    df = spark.createDataFrame([("a", json.dumps({"data": {"klines": lines}})), ("b", "oops"), ("c", '{"data":null}')], "symbol string, response string")
    got = market.csv_bars(df).orderBy("bar_idx").collect()
    assert [(r["date"], r["close"], r["volume"]) for r in got] == [("2026-08-07", 2.0, 3_500_000), ("2026-08-10", 2.0, 0)]
    df = spark.createDataFrame([("a", '[{"day":"d","open":"1","high":"3","low":"0","volume":"7"}]')], "symbol string, response string")
    r = market.json_bars(df).first()
    assert (r["open"], r["close"], r["volume"]) == (1.0, 0.0, 7)
    s = one(spark, '{"result":{"data":[{"year":"2023","revenue":"1.5","roe":null}]}}', market.statement)
    assert (s["year"], s["revenue"], s["profit"], s["roe"]) == ("2023", 1.5, 0.0, 0.0)
    sectors = spark.createDataFrame([('{"data":{"diff":[{"f12":"a","f14":"n","f2":1.5,"f3":"-"},{"f12":"b"}]}}',)], "response string")
    assert [tuple(r)[1:] for r in market.sectors(sectors, 1, 1).collect()] == [("a", "n", 1.5, None)]
    assert market.FileFetcher({"u": "r"}).get("u") == "r" and market.FileFetcher({}).get("u") is None


def test_pages(spark):
    html = '<a href="/x">short</a><a class="k" href="/news/1?a=1&amp;b=2"><b>A long</b> title &amp; more</a><a href="http://finance.o.com/2">Another title</a><a href="mailto:x">Mail to someone</a>'
    table = "<table><tr><td>r</td><td>1,234.5 M</td></tr><tr><td>p</td><td>--</td></tr></table>"
    df = spark.createDataFrame([(1, "https://sina.com.cn/a/b", html), (2, "u", table), (3, None, None)], "page_id long, url string, html string")
    got = [(r["rank"], r["title"], r["url"]) for r in pages.links(df, ("sina.com", "finance")).collect()]
    assert got == [(1, "A long title & more", "https://sina.com.cn/news/1?a=1&b=2"), (2, "Another title", "http://finance.o.com/2")]
    assert [tuple(r) for r in pages.financials(df).collect()] == [(2, 12_345_000.0, 0.0)]


def test_sinks(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "new words here"), ("b", None), (None, "x")], "chunk_id string, content string")
    path = str(tmp_path / "index")
    sinks.write_index(corpus, path)
    sinks.write_index(spark.createDataFrame([("c", "words again")], "chunk_id string, content string"), path, add=True)
    assert {(r["term"], r["chunk_id"]) for r in spark.read.parquet(path).where("term = 'words'").collect()} == {("words", "a"), ("words", "c")}
    sinks.write_index(corpus, path)
    assert spark.read.parquet(path).where("chunk_id = 'c'").count() == 0
    table = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    assert sinks.sync(table, table.where("id = 2"), "id", str(tmp_path / "t")) == 1
    sinks.append(table, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert sinks.latest_alerts(spark.createDataFrame([], "ts long, id long")) == [{"heartbeat": True}]
    assert [r["id"] for r in sinks.latest_alerts(spark.createDataFrame([(1, 1), (2, 2)], "ts long, id long"), 1)] == [2]


def test_fact_check(spark):
    raw = 'answer: {"dataAccurate": true, "targetMatched": "true", "logicComplete": false, "passed": true, "issues": ["a"]} end'
    r = one(spark, raw, ops.fact_check_report)
    assert (r["dataAccurate"], r["targetMatched"], r["logicComplete"], r["passed"], r["issues"]) == (True, False, False, True, ["a"])
    r = one(spark, "no json", ops.fact_check_report)
    assert r["passed"] is False and r["issues"] == []
