"""Caches, retries, extraction, fetching, ingest and readers against plain loops."""

import random
import time
from collections import OrderedDict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom import session, tools
from tickloom.operators import monitor, ops
from tickloom.sources import fetch, files, sinks

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def plain_misses(times, ttls):
    out, born = [], None
    for t, ttl in zip(times, ttls):
        out.append(born is None or t - born >= ttl)
        born = t if out[-1] else born
    return out


def test_misses_batch_after_batch():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(0, 40))
        times = np.sort(rng.integers(0, 120, n))
        ttl = np.full(n, 7) if rng.random() < 0.5 else rng.integers(1, 20, n)
        cut, born, got = int(rng.integers(0, n + 1)), None, []
        for part in (slice(0, cut), slice(cut, n)):
            missed, born = ops.misses(times[part], ttl[part], born)
            got += missed.tolist()
        assert got == plain_misses(times.tolist(), ttl.tolist())


def test_cache_of_a_busy_key(spark):
    """One key without a gap over many batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rng = random.Random(1)
        seconds = sorted(rng.randrange(3000) for _ in range(1500))
        df = spark.createDataFrame([("k", at(s), i) for i, s in enumerate(seconds)] + [(None, at(s), 5000 + s) for s in range(50)], "key string, ts timestamp, id long").repartition(4)
        got = {r["id"]: r["hit"] for r in ops.cache_replay(df, F.lit(30)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [not got[i] for i in range(1500)] == plain_misses(seconds, [30] * 1500)
    assert [s for s in range(50) if not got[5000 + s]] == [0, 30]


def test_tiers_with_evictions(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), f"k{rng.randrange(12)}", at(rng.randrange(4000)), i) for i in range(800)]
    got = {r["id"]: r for r in ops.tier_replay(spark.createDataFrame(rows, "shard long, key string, ts timestamp, id long").repartition(3), F.lit(200), entries=5, most=150).collect()}
    evicted = 0
    for shard in (0, 1):
        first, second = OrderedDict(), {}
        for _, key, ts, i in sorted((r for r in rows if r[0] == shard), key=lambda r: (r[2], r[3])):
            if key in first and ts < first[key]:
                want = "L1"
            else:
                want = "L2" if key in second and ts < second[key] else "miss"
                if want == "miss":
                    second[key] = ts + timedelta(seconds=200)
                first[key] = ts + timedelta(seconds=150)
            first.move_to_end(key)
            gone = len(first) > 5
            if gone:
                first.popitem(last=False)
            evicted += gone
            assert (got[i]["tier"], got[i]["evicted"], got[i]["size"]) == (want, int(gone), len(first))
    assert evicted > 100 and {r["tier"] for r in got.values()} == {"L1", "L2", "miss"}
    stats = ops.tier_stats(spark.createDataFrame(list(got.values()))).agg(F.sum("evictions"), F.sum("hits") + F.sum("misses")).first()
    assert tuple(stats) == (evicted, 800)


def _answers(text):
    if "fail" in text:
        raise OSError("down")
    return ("Blue", "") if "blue" in text else ("", "SH600519") if "code" in text else None


def test_extract(spark):
    q = [(1, at(0), "blue one"), (2, at(1700), "blue one"), (3, at(1800), "blue one "), (4, at(0), "fail on Red"), (5, at(0), "code"), (6, at(0), " "), (7, at(0), None), (8, at(0), "nothing")]
    names = spark.createDataFrame([("Blue", "c1"), ("Red", "c2")], "name string, code string")
    got = {r["id"]: (r["name"], r["code"], r["asked"]) for r in tools.extract(spark.createDataFrame(q, "id long, ts timestamp, text string"), names, _answers).collect()}
    assert got == {1: ("Blue", "c1", True), 2: ("Blue", "c1", False), 3: ("Blue", "c1", True), 4: ("Red", "c2", True), 5: (None, "1.600519", True), 6: (None, None, False), 7: (None, None, False), 8: (None, None, True)}
    plain = {r["id"]: r["name"] for r in tools.extract(spark.createDataFrame(q, "id long, ts timestamp, text string"), names).collect()}
    assert plain[4] == "Red" and plain[1] is None and len(plain) == 8


class Pages:
    """Text, bytes of a charset, and failures."""

    def get(self, url):
        return {"t": "plain", "b": "größe".encode("latin-1"), "c": ("ü".encode("gbk", "replace"), "text/html; charset=GBK"), "u": (b"x\xff", "text/html; charset=none-such")}.get(url)


def test_charsets_and_waits(spark):
    assert fetch.decoded("中文".encode("gbk"), "text/html; charset=gbk") == "中文"
    assert fetch.decoded(None) is None and fetch.decoded(b"\xff") == "�"
    rows = {r["url"]: (r["response"], r["error"] is None) for r in fetch.fetched(spark.createDataFrame([(u,) for u in "tbu"], "url string"), Pages(), charset="latin-1").collect()}
    assert rows == {"t": ("plain", True), "b": ("größe", True), "u": ("xÿ", True)}
    began = time.time()
    assert fetch.fetched(spark.createDataFrame([("none",)], "url string"), Pages(), tries=2, least=0.3, most=0.4).first()["response"] is None
    assert time.time() - began >= 0.3


class Browser:
    def __init__(self):
        self.well, self.log = False, []

    def healthy(self):
        return self.well

    def restart(self):
        self.well = True
        self.log.append("restart")

    def open(self, url, wait_for):
        self.log.append((url, wait_for))
        if url == "bad":
            self.well = False
            raise OSError("crashed")
        return "<html>"


def test_browser_is_restarted():
    b = Browser()
    page = fetch.Rendered(b, "#main")
    assert page.get("u") == "<html>" and b.log == ["restart", ("u", "#main")]
    with pytest.raises(ConnectionError):
        fetch.with_retries(page.get, "bad", 2, wait=lambda s: None)
    assert b.log[2:] == [("bad", "#main"), "restart"] * 2 and b.well


def test_reading_order():
    pieces = [(50, 700, "b\n"), (10, 700.1, "a "), (10, 650, "third"), (0, 660, " "), (10, 680, "second")]
    assert files.in_reading_order(pieces) == "a b\nsecond\nthird"


def test_csv_in_parts(spark, tmp_path):
    """A file that is read in several parts keeps its lines' numbers, beside another one."""
    body = ["code,name,category,content"] + [f"c{k},n,x,text {k}" for k in range(2000)]
    (tmp_path / "a.csv").write_text("\n".join(body))
    (tmp_path / "b.csv").write_text("head\nc,n,x,t\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_csv(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 1
        got = rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["file"][-5], r["line_no"], r["content"]) for r in got) == sorted([("a", k + 2, f"text {k}") for k in range(2000)] + [("b", 2, "t")])


def _lengths(texts):
    return [[float(len(t)), 1.0] for t in texts]


def test_ingest_files(spark, tmp_path):
    from tickloom.operators import retrieval

    for name, body in (("one.txt", "First report. It says much."), ("two.TXT", "Second report."), ("empty.txt", " \n "), ("x.csv", "a,b")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(body)
    folder = str(tmp_path / "out")
    got = {r["name"]: (r["status"], r["chunks"], r["format"], r["source"]) for r in tools.ingest_files(spark, str(tmp_path / "in"), folder, _lengths, "src").collect()}
    assert got == {"one.txt": ("ok", 1, "txt", "src"), "two.TXT": ("ok", 1, "txt", "src"), "empty.txt": ("empty", 0, "txt", "src"), "x.csv": ("unsupported", 0, "csv", "src")}
    chunks = spark.read.parquet(f"{folder}/chunks").collect()
    assert sorted((r["content"], r["vector"][0]) for r in chunks) == [("First report.It says much.", 26.0), ("Second report.", 14.0)]
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "three.txt").write_text("Third report, too.")
    assert tools.ingest_files(spark, str(tmp_path / "more"), folder, _lengths).count() == 1  # earlier documents stay
    q = spark.createDataFrame([(0, "report")], "query_id long, text string")
    assert retrieval.index_search(q, f"{folder}/index").count() == 3 and spark.read.parquet(f"{folder}/manifest").count() == 5


def test_txt_files_are_streamed_by_lines(spark, tmp_path):
    """Chunks are those of the whole cleaned text, whatever parts a file is read in; no txt file is read as one value."""
    from tickloom.functions.text import clean
    from tickloom.operators import text_prep

    odd = "\ufeff  One. Two\r\nthree!\r\n \t \r\n\r\n four\x00\x0b\u3000 \u3000five\rsix\u2028 seven？ ﬁne e\u0301.\n\n\nlast \u0085 line"
    bodies = {"odd a+b%20é.txt": odd, "long.TXT": "\n".join(f"Line {k} of it{'.' * (k % 3 == 0)}{chr(10) * (k % 5)}" for k in range(900)), "none.txt": "\n \n", "marks.txt": "...\n!\n?a\r", "bom.txt": "\ufeff\n", "one.txt": "word " * 700, "txt": "\nno suffix\n\n"}
    (tmp_path / "in").mkdir()
    for name, body in bodies.items():
        (tmp_path / "in" / name).write_bytes(body.encode())
    rows = spark.createDataFrame(list(bodies.items()), "doc_id string, text string")
    want = text_prep.chunk_documents(rows.select("doc_id", clean(F.col("text")).alias("text")).where("text <> ''"), 40)
    small = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.sources.binaryFile.maxLength": "1000"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        assert files.lines(spark, str(tmp_path / "in")).rdd.getNumPartitions() > len(bodies)
        got = tools.ingest_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), _lengths, size=40).select("name", "chunks", "status").collect()
    finally:
        for key in small:
            spark.conf.unset(key)
    told = lambda df, name: sorted((r[name], r["chunk_no"], r["content"], r["tokens"]) for r in df.collect())
    chunks = spark.read.parquet(str(tmp_path / "out" / "chunks")).join(spark.read.parquet(str(tmp_path / "out" / "manifest")).select("doc_id", "name"), "doc_id")
    assert told(chunks, "name") == told(want, "doc_id") and chunks.where("name = 'long.TXT'").count() > 50
    assert {r["name"]: r["chunks"] for r in got} == {n: sum(c[0] == n for c in told(want, "doc_id")) for n in bodies}
    assert {r["name"] for r in got if r["status"] == "empty"} == {"none.txt"}


def test_retries_and_rounds(spark):
    tries = [(1, 1, False, None), (1, 2, True, 900), (1, 3, True, 1000), (2, 1, False, None), (2, 2, False, 800), (2, 3, None, 900), (2, 4, True, 1), (3, 1, True, None)]
    got = {r["call_id"]: tuple(r)[1:] for r in ops.retry_summary(spark.createDataFrame(tries, "call_id long, attempt_no int, ok boolean, wait_ms long")).collect()}
    assert got == {1: (2, 900, True, False), 2: (3, 1700, False, True), 3: (1, 0, True, False)}
    raw = lambda ok, *issues: '{"passed": %s, "issues": [%s]}' % (ok, ", ".join(f'"{i}"' for i in issues))
    rounds = [(1, 1, raw("true")), (2, 1, raw("false", "a", "b")), (2, 2, raw("true")), (3, 1, "oops"), (3, 2, raw("false")), (3, 3, raw("true"))]
    got = {r["answer_id"]: tuple(r)[1:] for r in ops.checked_rounds(spark.createDataFrame(rounds, "answer_id long, round int, raw string")).collect()}
    assert got == {1: (1, True, None), 2: (2, True, ops.AGAIN + "a；b"), 3: (2, False, ops.AGAIN)}


def test_watch_list_and_push(spark):
    ticks = spark.createDataFrame([(datetime(2024, 1, 2, 10), k, f"s{k % 30}", float(k)) for k in range(60)], "ts timestamp, event_id long, event_type string, value double")
    watch = spark.createDataFrame([(f"s{k}", k) for k in range(30)] + [(None, -1)], "symbol string, pos int")
    assert {r["symbol"] for r in monitor.cycles(ticks, watchlist=watch).collect()} == {f"s{k}" for k in range(19)}  # the first 20 rows, one without a symbol
    sent = []
    stream = spark.readStream.format("rate").option("rowsPerSecond", 5).load().select(F.col("timestamp").alias("ts"), F.col("value").alias("id"))
    running = sinks.push_alerts(stream, sent.append, every="1 second")
    try:
        end = time.time() + 60
        while time.time() < end and not any("id" in x[0] for x in sent):
            time.sleep(0.2)
    finally:
        running.stop()
    assert any("id" in x[0] for x in sent) and all(len(x) <= 20 for x in sent)


def test_scratch_needs_a_shared_folder(spark):
    from types import SimpleNamespace as Like

    assert session.scratch(spark) != session.scratch(spark)
    unset = lambda master: Like(conf=Like(get=lambda key, other: other), sparkContext=Like(master=master, getCheckpointDir=lambda: None))
    assert session.scratch(unset("local[2]")).startswith("file:/")
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            session.scratch(unset(master))
