"""Streaming twins give what the batch forms give."""

import time
import uuid
from datetime import datetime, timedelta

import pytest

from tickloom.operators import bars as B
from tickloom.streaming import stateful as S

T0 = datetime(2024, 1, 1)


@pytest.fixture()
def run(spark, tmp_path):
    S.use_rocksdb(spark)

    def go(df, transform, mode="append", batches=2, by="ts"):
        src, n = str(tmp_path / "in"), df.count()
        rows = df.orderBy(by).collect()
        step = -(-n // batches)
        for k in range(0, n, step):
            spark.createDataFrame(rows[k : k + step], df.schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        name = f"out_{uuid.uuid4().hex}"
        q = transform(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            # With state that expires by processing time a query goes on after the last row.
            seen, end = {}, time.time() + 90
            while q.isActive and sum(seen.values()) < n and time.time() < end:
                time.sleep(0.2)
                seen |= {p["batchId"]: p["numInputRows"] for p in q.recentProgress}
            if transform in (S.bar_stream, S.monitor_stream, S.trace_stream, S.suppress_stream, S.profile_stream):  # closed by a batch after the last row
                q.awaitTermination(60)
            assert q.exception() is None
            go.checkpoint = str(tmp_path / "cp")
            return spark.table(name).collect()
        finally:
            q.stop()

    return go


def test_suppress(spark, run):
    at = [0, 1000, 1800, 1801, 3700]
    df = spark.createDataFrame([("a", "m", T0 + timedelta(seconds=s), k) for k, s in enumerate(at)], "symbol string, message string, ts timestamp, id long")
    assert sorted(r["id"] for r in run(df, S.suppress_stream)) == [0, 3, 4]


def state(spark, run, name):
    return spark.read.format("statestore").option("path", run.checkpoint).option("stateVarName", name).load()


def test_suppression_state_ends_by_event_time(spark, run):
    """Keys that were silent for the time and the watermark hold nothing; a late row does not revive them."""
    rows = [("a", 0, 0), ("b", 60, 1), ("a", 120, 2), ("c", 20_000, 3), ("a", 1, 4), ("c", 20_100, 5), ("c", 40_000, 6), ("b", 40_001, 7)]
    df = spark.createDataFrame([(s, "m", T0 + timedelta(seconds=at), k) for s, at, k in rows], "symbol string, message string, ts timestamp, id long")
    got = run(df, S.suppress_stream, batches=4, by="id")
    assert sorted(r["id"] for r in got) == [0, 1, 3, 6, 7]  # row 4 came after its time
    held = {r["key"]["symbol"] for r in state(spark, run, "last").select("key").collect()}
    assert held == {"b", "c"}  # a ended with the watermark past 1800 seconds


def test_a_silent_utterance_renews_nothing(spark, run):
    from tickloom.operators.memory import Profile

    day, kind = 86_400.0, "user_id string, turn long, at double, text string, candidates array<struct<key: string, value: string>>"
    rows = [("u", 0, 0.0, "x", [("risk", "稳健")]), ("u", 1, 60 * day, "nothing to say", []), ("u", 2, 89 * day, "y", [("risk", "激进")])]
    rows += [("u", 3, 89 * day + Profile.PENDING_SECONDS + 1, "确认", []), ("u", 4, 91 * day, "z", [("risk", "激进")]), ("v", 5, 300 * day, "w", [])]
    df = spark.createDataFrame([(u, t, 1e9 + at, x, c) for u, t, at, x, c in rows], kind)
    got = [(r["turn"], r["event"]) for r in sorted(run(df, S.profile_stream, batches=6, by="turn"), key=lambda r: r["turn"])]
    # The waiting change has ended at turn 3, the profile at turn 4, which sets it anew.
    assert got == [(0, "set"), (2, "conflict"), (4, "set")]
    assert state(spark, run, "pending").count() == 0


def test_traces_of_closed_sessions(spark, run):
    from tickloom.operators import ops

    rows = [(f"r{k % 3}", k, T0 + timedelta(seconds=7 * k), "error" if k % 4 == 0 else "view") for k in range(30)]
    rows += [("r9", 99, T0 + timedelta(hours=9), "view"), ("r9", 100, T0 + timedelta(hours=20), "view")]
    df = spark.createDataFrame(rows, "request_id string, call_id long, ts timestamp, tool string")
    got = {(r["request_id"], r["total_ms"], r["tool_calls"], r["errors"]) for r in run(df, S.trace_stream, batches=4)}
    want = {tuple(r) for r in ops.trace_summary(df.where("request_id <> 'r9'")).collect()}
    assert want <= got and len(got - want) <= 1


def test_cache(spark, run):
    at = [0, 10, 29, 30, 45, 200]
    df = spark.createDataFrame([("k", T0 + timedelta(seconds=s), k) for k, s in enumerate(at)], "key string, ts timestamp, id long")
    assert [r["hit"] for r in sorted(run(df, lambda d: S.cache_stream(d, 30)), key=lambda r: r["id"])] == [False, True, True, False, True, False]


def test_history(spark, run):
    df = spark.createDataFrame([(1, T0 + timedelta(seconds=k), k) for k in range(7)], "session_id long, ts timestamp, id long")
    rows = run(df, lambda d: S.history_stream(d, 3), "update")
    assert max((r["newest"], r["size"]) for r in rows) == (6, 3)


def test_profile(spark, run):
    kind = "user_id long, turn long, at double, text string, candidates array<struct<key: string, value: string>>"
    df = spark.createDataFrame([(1, 0, 1e9, "x", [("risk", "稳健")]), (1, 1, 1e9 + 10, "y", [("risk", "激进")]), (1, 2, 1e9 + 20, "确认", [])], kind)
    rows = run(df, S.profile_stream, batches=3, by="turn")
    assert [(r["turn"], r["event"]) for r in sorted(rows, key=lambda r: r["turn"])] == [(0, "set"), (1, "conflict"), (2, "confirmed")]


def test_bars(spark, run):
    df = spark.createDataFrame([(k, T0 + timedelta(minutes=20 * k), "a", float(k)) for k in range(12)], "event_id long, ts timestamp, event_type string, value double")
    got = {(r["ts"], r["open"], r["close"], r["volume"]) for r in run(df, S.bar_stream, batches=3)}
    want = {(r["ts"], r["open"], r["close"], r["volume"]) for r in B.ohlcv(df).collect()}
    assert got and got <= want


def test_monitor(spark, run):
    t = datetime(2024, 1, 5, 9, 0)
    df = spark.createDataFrame([(k, t + timedelta(minutes=15 * k), "a", float(k)) for k in range(16)], "event_id long, ts timestamp, event_type string, value double")
    rows = run(df, S.monitor_stream, batches=2)
    assert rows and all(r["ticks"] <= 2 for r in rows)
