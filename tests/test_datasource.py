"""Python data sources: pushed filters, offsets over a restart, and epochs of the newest alerts."""

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.sources import datasource as D
from tickloom.sources import market

FAILS = {"n": 0}


def opened(url):
    """A fetcher of the tests: the first try of each process fails, and a symbol that is not there always."""
    FAILS["n"] += 1
    if "none" in url or FAILS["n"] == 1:
        raise OSError("no answer")
    return f"body of {url}"


def store(folder, symbol, date, price):
    at = folder / f"symbol={symbol}"
    at.mkdir(parents=True, exist_ok=True)
    (at / f"{date}.json").write_text(json.dumps({"data": {"klines": [f"{date},{price},{price},{price},{price},7"]}}))


@pytest.fixture()
def stored(tmp_path):
    for s in ("a", "b", "c"):
        for k in range(1, 6):
            store(tmp_path / "in", s, f"2024-01-0{k}", 10 + k)
    (tmp_path / "in" / "symbol=a" / "notes.txt").write_text("x")
    return tmp_path / "in"


def test_read_and_pushed_filters(spark, stored):
    D.register(spark)
    df = spark.read.format("responses").option("path", str(stored)).load()
    assert df.count() == 15 and df.rdd.getNumPartitions() == 3
    some = df.where((F.col("symbol") == "b") & (F.col("date") >= "2024-01-03") & F.col("response").contains("klines"))
    assert some.rdd.getNumPartitions() == 1
    got = market.csv_bars(some).orderBy("date").collect()
    assert [(r["symbol"], r["date"], r["open"], r["volume"]) for r in got] == [("b", f"2024-01-0{k}", 10.0 + k, 700) for k in (3, 4, 5)]
    assert df.where(F.col("symbol").isin("a", "c") & (F.col("date") < "2024-01-02")).count() == 2
    assert df.where("symbol = 'zz'").count() == 0
    # What is read, by the reader itself: only the asked files.
    reader = D.Reader({"path": str(stored)})
    left = list(reader.pushFilters([D.EqualTo(("symbol",), "b"), D.GreaterThan(("date",), "2024-01-04"), D.EqualTo(("response",), "x")]))
    assert [f.attribute for f in left] == [("response",)]
    assert [(p.symbol, len(p.cells)) for p in reader.partitions()] == [("b", 1)]


def test_fetched_with_tries(spark):
    D.register(spark)
    df = spark.read.format("responses").options(urls="http://local/{symbol}/{date}", symbols="a, none", dates="2024-01-01", opener="tests.test_datasource:opened", tries=3, least=0, most=0).load()
    got = {r["symbol"]: (r["response"], r["error"]) for r in df.collect()}
    assert got["a"] == ("body of http://local/a/2024-01-01", None)
    assert got["none"][0] is None and "no answer" in got["none"][1]


def test_stream_goes_on_after_a_restart(spark, stored, tmp_path):
    D.register(spark)

    def run():
        df = spark.readStream.format("responses").option("path", str(stored)).load()
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(90) and q.exception() is None
        return sorted((r["symbol"], r["date"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run()
    assert len(first) == 15
    store(stored, "a", "2024-01-06", 99)
    store(stored, "d", "2024-01-07", 99)
    assert run() == sorted([*first, ("a", "2024-01-06"), ("d", "2024-01-07")])
    assert len(run()) == 17  # nothing new, nothing twice


def epochs(folder):
    return [json.loads(p.read_text()) for p in sorted(folder.glob("*.json"), key=lambda p: int(p.stem))]


def test_newest_alerts_across_epochs_and_a_restart(spark, tmp_path):
    D.register(spark)
    at, kind = datetime(2024, 1, 1), "id long, ts timestamp, message string"
    rows = [(k, at + timedelta(minutes=k * 7 % 60), f"m{k}") for k in range(90)]
    rows[5] = (None, None, None)

    def put(some, n):
        spark.createDataFrame(some, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).writeStream.format("alerts").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(90) and q.exception() is None
        return epochs(tmp_path / "out")

    for k in range(3):  # each time a new query that goes on from the checkpoint
        found = put(rows[30 * k : 30 * k + 30], k)
        known = sorted(((t, i) for i, t, _ in rows[: 30 * k + 30] if i is not None), reverse=True)[:20]
        assert len(found) == k + 1 and [r["id"] for r in found[-1]["newest"]] == [i for _, i in known]
        assert not found[-1]["heartbeat"]
    found = put([(None, None, None)], 3)
    assert found[-1]["heartbeat"] and found[-1]["newest"] == found[-2]["newest"]
    # The same epoch committed again has the same content.
    writer = D.AlertWriter({"path": str(tmp_path / "out")})
    writer.commit([D.Newest([{"id": r[0], "ts": r[1].isoformat(timespec="seconds"), "message": r[2]} for r in rows[30:60]])], 1)
    assert epochs(tmp_path / "out")[1] == found[1] and len(epochs(tmp_path / "out")) == 4


def test_heartbeats_without_alerts(spark, tmp_path):
    kind = "id long, ts timestamp, message string"
    (tmp_path / "in").mkdir()
    q = D.push_newest(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), every="1 second")
    try:
        end = time.time() + 60
        while time.time() < end and len(list((tmp_path / "out").glob("*.json")) if (tmp_path / "out").exists() else []) < 3:
            time.sleep(0.3)
        assert q.exception() is None
    finally:
        q.stop()
    assert len(epochs(tmp_path / "out")) >= 3 and all(e["heartbeat"] and not e["newest"] for e in epochs(tmp_path / "out"))
