"""Structured Streaming forms of the stateful operators.

State lives in RocksDB and goes by event time: each key has a timer at the end of its state's life,
which fires when the watermark passes it. Streams carry a watermark of one hour; later rows are
dropped, so none can meet state that its timer has removed, nor revive it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "1 hour"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def micros(ts) -> int:
    return int(pd.Timestamp(ts).value // 1000)


class Expiring(StatefulProcessor):
    """A processor whose key has one timer, at the end of the life of what it holds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def live_until(self, at_micros: int | None) -> None:
        """Let the state end at this time; None: nothing is held."""
        timers = [int(t) for t in self.handle.listTimers()]
        wanted = [] if at_micros is None else [int(at_micros // 1000) + 1]
        for t in timers:
            if t not in wanted:
                self.handle.deleteTimer(t)
        for t in wanted:
            if t not in timers:
                self.handle.registerTimer(t)

    def expire(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.expire()
        return iter(())

    def close(self) -> None:
        pass


class Suppress(Expiring):
    """Emits an alert unless the last one emitted for its key is at most ``within`` seconds old.

    Beyond that the last one says nothing any more, and is forgotten."""

    columns = ["symbol", "message", "ts", "id"]

    def __init__(self, within: int):
        self.within = within * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["ts", "id"])
        last = before = self.last.get()[0] if self.last.exists() else None
        kept = []
        for k, ts in enumerate(own["ts"]):
            at = micros(ts)
            if last is None or at - last > self.within:
                kept.append(k)
                last = at
        if last != before:
            self.last.update((last,))
            self.live_until(last + self.within)
        yield own.iloc[kept][self.columns]

    def expire(self) -> None:
        self.last.clear()


def suppress_stream(alerts: DataFrame, minutes: int = 30, late: str = LATE) -> DataFrame:
    """alerts(symbol, message, ts, id) without repeats within minutes of a retained one."""
    own = alerts.withWatermark("ts", late).groupBy("symbol", "message")
    return own.transformWithStateInPandas(Suppress(minutes * 60), "symbol string, message string, ts timestamp, id long", "Append", "EventTime")


class Cache(Expiring):
    """Classifies requests of a key as hits or misses of a cache with a time to live."""

    columns = ["key", "id", "hit"]

    def __init__(self, ttl: int):
        self.ttl = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.born = handle.getValueState("born", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["ts", "id"])
        born = before = self.born.get()[0] if self.born.exists() else None
        hits = []
        for ts in own["ts"]:
            at = micros(ts)
            hit = born is not None and at - born < self.ttl
            hits.append(hit)
            born = born if hit else at
        if born != before:
            self.born.update((born,))
            self.live_until(born + self.ttl)
        own["hit"] = hits
        yield own[self.columns]

    def expire(self) -> None:
        self.born.clear()


def cache_stream(requests: DataFrame, ttl_seconds: int, late: str = LATE) -> DataFrame:
    own = requests.withWatermark("ts", late).groupBy("key")
    return own.transformWithStateInPandas(Cache(ttl_seconds), "key string, id long, hit boolean", "Append", "EventTime")


class History(Expiring):
    """Keeps the newest ``most`` records of a session until ttl after its last one, and emits its size."""

    columns = ["session_id", "size", "newest"]

    def __init__(self, most: int, ttl: int):
        self.most, self.ttl = most, ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ids = handle.getListState("ids", "at long, id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows))
        new = [(micros(ts), int(k)) for ts, k in zip(own["ts"], own["id"])]
        held = [(int(x[0]), int(x[1])) for x in self.ids.get()] if self.ids.exists() else []
        held = sorted(held + new)[-self.most :]
        self.ids.put(held)
        self.live_until(held[-1][0] + self.ttl)
        yield pd.DataFrame({"session_id": [key[0]], "size": [len(held)], "newest": [held[-1][1]]})

    def expire(self) -> None:
        self.ids.clear()


def history_stream(records: DataFrame, most: int = 200, ttl_days: int = 7, late: str = LATE) -> DataFrame:
    """records(session_id, ts, id) → session_id, size, newest after each batch; sessions are of any type."""
    own = records.withWatermark("ts", late).groupBy("session_id")
    schema = f"session_id {dict(records.dtypes)['session_id']}, size int, newest long"
    return own.transformWithStateInPandas(History(most, ttl_days * 86_400), schema, "Update", "EventTime")


class ProfileState(Expiring):
    """The profile state machine: one map, when it was last written, and one waiting change per user.

    Only what changed is written, so an utterance that states nothing renews nothing."""

    columns = ["user_id", "turn", "event", "key", "value"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.profile = handle.getMapState("profile", "key string", "value string")
        self.written = handle.getValueState("written", "at double")
        self.pending = handle.getValueState("pending", "key string, value string, at double")

    def _load(self):
        from tickloom.operators.memory import Profile

        written = self.written.get()[0] if self.written.exists() else None
        return Profile({k[0]: v[0] for k, v in self.profile.iterator()}, tuple(self.pending.get()) if self.pending.exists() else None, written)

    def _keep(self, own, before) -> None:
        for k in before.values.keys() - own.values.keys():
            self.profile.removeKey((k,))
        for k, v in own.values.items():
            if before.values.get(k) != v:
                self.profile.updateValue((k,), (v,))
        if own.written != before.written:
            self.written.update((own.written,)) if own.written is not None else self.written.clear()
        if own.pending != before.pending:
            self.pending.update(own.pending) if own.pending else self.pending.clear()
        ends = [own.written + own.PROFILE_SECONDS] if own.written is not None else []
        ends += [own.pending[2] + own.PENDING_SECONDS] if own.pending else []
        self.live_until(int(min(ends) * 1_000_000) if ends else None)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        own, before, out = self._load(), self._load(), []
        for r in pd.concat(list(rows)).sort_values(["at", "turn"]).itertuples():
            found = [(c["key"], c["value"]) for c in r.candidates]
            out += [(r.user_id, r.turn, *e) for e in own.hear(r.text or "", found, r.at)]
        self._keep(own, before)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The profile, the waiting change, or both, whichever has ended by now."""
        own, before = self._load(), self._load()
        own.forget(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self._keep(own, before)
        return iter(())


def profile_stream(utterances: DataFrame, late: str = LATE) -> DataFrame:
    """utterances(user_id, turn, at seconds, text, candidates) → user_id, turn, event, key, value."""
    kind = dict(utterances.dtypes)
    own = utterances.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late).groupBy("user_id")
    return own.transformWithStateInPandas(ProfileState(), f"user_id {kind['user_id']}, turn {kind['turn']}, event string, key string, value string", "Append", "EventTime")


def trace_stream(calls: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Closed traces of a stream of calls(request_id, call_id, ts, tool): as ``ops.trace_summary``, with its
    start, once nothing has come for gap and the watermark has passed that."""
    rows = calls.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "request_id")
    span = (F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))).alias("total_ms")
    rows = rows.agg(span, F.count(F.lit(1)).alias("tool_calls"), F.count_if(F.col("tool") == "error").alias("errors"))
    return rows.select("request_id", F.col("session_window.start").alias("started"), "total_ms", "tool_calls", "errors")


def bar_stream(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """Closed bars of a tick stream: symbol, ts, open, high, low, close, volume."""
    at = F.struct("ts", "event_id")
    rows = ticks.withWatermark("ts", LATE).groupBy(F.window("ts", width), F.col("event_type").alias("symbol"))
    rows = rows.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume"))
    return rows.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def monitor_stream(ticks: DataFrame, width: str = "30 minutes") -> DataFrame:
    """Polls in trading time from a tick stream, one row a cycle and symbol."""
    from tickloom.operators.monitor import cycles

    return cycles(ticks.withWatermark("ts", LATE), width)
