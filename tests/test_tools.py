"""The named analytics, fetching and wording."""

import pytest
from pyspark.sql import functions as F

from tests.test_indicators import SCHEMA, made
from tickloom import tools
from tickloom.functions import labels
from tickloom.sources import fetch, market


def test_retries():
    calls, waits = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("down")
        return "body"

    assert fetch.with_retries(flaky, "u", wait=waits.append) == "body"
    assert len(calls) == 3 and len(waits) == 2 and all(1 <= w <= 3 for w in waits)
    with pytest.raises(ConnectionError):
        fetch.with_retries(lambda u: " ", "u", wait=waits.append)


def test_fetched(spark):
    rows = fetch.fetched(spark.createDataFrame([("a",), ("b",)], "url string"), market.FileFetcher({"a": "x"})).collect()
    assert [(r["url"], r["response"], r["error"] is None) for r in rows] == [("a", "x", True), ("b", None, False)]


def test_indicator_tool(spark):
    bars = spark.createDataFrame(made(65, 100, 0.5, "long") + made(59, 100, 0.5, "short"), SCHEMA)
    rows = tools.get_indicators(bars).collect()
    assert [r["symbol"] for r in rows] == ["long"]
    assert rows[0]["macd_text"] == labels.MACD["golden_cross"] and rows[0]["rsi_text"] == "超买区"


def test_quotes_and_extractor(spark):
    rows = spark.createDataFrame([("a", 'x="n,1,2,4,5,6,0,0,900,9"'), ("b", '{"data":{"f43":7.0,"f58":"m"}}'), ("c", None)], "code string, response string")
    got = {r["code"]: (r["name"], r["price"], r["change"]) for r in tools.get_quotes(rows).collect()}
    assert got == {"a": ("n", 4.0, 100.0), "b": ("m", 7.0, None), "c": (None, None, None)}
    texts = spark.createDataFrame([(1, "buy 贵州茅台 now"), (2, "none")], "id long, text string")
    names = spark.createDataFrame([("茅台", "c2"), ("贵州茅台", "c1")], "name string, code string")
    assert [tuple(r) for r in tools.rule_extractor(texts, names).collect()] == [(1, "贵州茅台", "c1")]


def test_small_ones(spark):
    df = spark.createDataFrame([("STOCK_NEWS", 0), ("FINANCIAL", 500), ("other", 7)], "k string, n int")
    assert [tuple(r) for r in df.select(tools.context_hours(F.col("k")), tools.rounds(F.col("n"))).collect()] == [(24, 1), (72, 200), (None, 7)]
    chunks, refused = tools.ingest(spark.createDataFrame([(1, "One. Two."), (2, " \n "), (3, None)], "doc_id long, text string"))
    assert [(r["doc_id"], r["content"]) for r in chunks.collect()] == [(1, "One.Two.")]
    assert sorted(r["doc_id"] for r in refused.collect()) == [2, 3]
