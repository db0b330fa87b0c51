"""Tool-call analytics: error classes, repeated calls, round guards, traces, caches, latencies, evaluation."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import half_up
from tickloom.functions.text import contains_any, truncate

#: Parts of messages that mean a bad parameter.
SECID_WORDS = ("secid", "代码", "code", "无效", "不存在", "404", "not found", "格式")
KEYWORD_WORDS = ("keyword", "参数", "无效", "不存在", "404")


def error_class(kind: Column, message: Column) -> Column:
    """Struct code, retryable for errors of kind secid, keyword, name, duplicate or any other."""
    m = F.coalesce(message, F.lit("unknown"))
    code = (
        F.when(kind == "secid", F.when(contains_any(m, SECID_WORDS, True), "INVALID_SECID").otherwise("NETWORK_ERROR"))
        .when(kind == "keyword", F.when(contains_any(m, KEYWORD_WORDS, True), "PARAMETER_INVALID").otherwise("NETWORK_ERROR"))
        .when(kind == "name", "STOCK_NOT_FOUND")
        .when(kind == "duplicate", "DUPLICATE_CALL")
        .otherwise("UNKNOWN")
    )
    return F.struct(code.alias("code"), (~code.isin("STOCK_NOT_FOUND", "DUPLICATE_CALL")).alias("retryable"))


def render_error(tool: Column, param: Column, value: Column, error: Column, message: Column, attempts: Column, most: Column) -> Column:
    """The error as nested JSON; the request's key is the parameter's name."""
    body = F.struct(error["code"].alias("code"), message.alias("message"), error["retryable"].alias("retryable"), attempts.alias("attempts"), most.alias("maxAttempts"))
    return F.to_json(F.struct(tool.alias("tool"), F.create_map(param, value).alias("request"), body.alias("error")))


def duplicate_calls(calls: DataFrame, request: str = "request_id") -> DataFrame:
    """calls with duplicate: whether the request made the same call of (tool, param) before."""
    w = Window.partitionBy(request, "tool", "param").orderBy("ts", "call_id")
    return calls.withColumn("duplicate", F.row_number().over(w) > 1)


def round_guard(calls: DataFrame, most: int = 8, request: str = "request_id") -> DataFrame:
    """calls with round (from 1) and stopped: the most-th round and later ones are refused."""
    w = Window.partitionBy(request).orderBy("ts", "call_id")
    rows = calls.withColumn("round", F.row_number().over(w))
    return rows.withColumn("stopped", F.col("round") >= most)


def trace_events(calls: DataFrame) -> DataFrame:
    """Trace lines as JSON, with long arguments cut."""
    attrs = F.create_map(F.lit("traceId"), F.col("request_id").cast("string"), F.lit("tool"), F.col("tool"), F.lit("args"), truncate(F.col("param"), 300, trim=False))
    return calls.select("call_id", F.to_json(F.struct(F.lit("TOOL_CALL").alias("stage"), attrs.alias("attrs"))).alias("line"))


def trace_summary(calls: DataFrame, request: str = "request_id") -> DataFrame:
    """total_ms from first to last event, tool_calls and errors of each trace."""
    span = (F.unix_millis(F.max("ts").cast("timestamp")) - F.unix_millis(F.min("ts").cast("timestamp"))).alias("total_ms")
    return calls.groupBy(request).agg(span, F.count(F.lit(1)).alias("tool_calls"), F.count_if(F.col("tool") == "error").alias("errors"))


def latency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """runs, mean, p50 (the upper median) and max by key, to three decimals.

    Equal values are counted first, on the map side too, so that a busy key reaches the window
    as its different values only; the median is the first whose running count passes the middle.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_r", F.sum("_c").over(run)).withColumn("_n", F.sum("_c").over(Window.partitionBy(key)))
    mid = F.min(F.when(F.col("_r") > F.floor(F.col("_n") / 2), F.col(value)))
    mean = F.sum(F.floor(F.col(value) * 1000 + 0.5).cast("long") * F.col("_c")) / F.sum("_c") / 1000
    return ranked.groupBy(key).agg(F.sum("_c").alias("runs"), half_up(mean, 3).alias("mean"), half_up(mid, 3).alias("p50"), half_up(F.max(value), 3).alias("max"))


#: Seconds that entries of a cache live, by what they hold.
TTL = {"quote": 30, "kline": 300, "financial": 3600, "news": 600, "analysis": 1200}


def _in_order(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a key in one partition, in time order, one after the other, for a fold that streams."""
    return rows.repartition(*[F.col(k) for k in key]).sortWithinPartitions(*key, "_t", "id")


def misses(times: np.ndarray, ttl: np.ndarray, born: int | None) -> tuple[np.ndarray, int | None]:
    """(which of the rising times miss, when the entry was born after them) for an entry born before.

    With one time to live the next miss is looked up; a row may have one of its own."""
    out, k = np.zeros(len(times), bool), 0
    alike = len(ttl) == 0 or (ttl == ttl[0]).all()
    while k < len(times):
        if born is not None:
            rest = times[k:] - born >= ttl[k:] if not alike else None
            k += int(np.searchsorted(times[k:], born + ttl[0])) if alike else int(rest.argmax()) if rest.any() else len(rest)
            if k >= len(times):
                break
        out[k], born = True, int(times[k])
        k += 1
    return out, born


def _replayed(batches):
    last, born = None, None
    for pdf in batches:
        parts = []
        for (key, run), own in pdf.groupby(["key", "_run"], sort=False, dropna=False):
            if last != (key, run):
                last, born = (key, run), None
            missed, born = misses(own["_t"].to_numpy(np.int64), own["_ttl"].to_numpy(np.int64) * 1_000_000, born)
            parts.append(own[["key", "id"]].assign(hit=~missed))
        if parts:
            yield pd.concat(parts)


def cache_replay(requests: DataFrame, ttl_seconds: Column) -> DataFrame:
    """requests(key, ts, id) with hit: whether a cache with this time to live would have had it.

    A miss fetches and starts a new life; a hit does not prolong it. A gap longer than the time
    to live always misses, so stretches between such gaps are replayed apart. Each streams
    through one task in time order, which holds a batch and the entry's birth, however busy the
    key is. Requests without a key share one entry.
    """
    w = Window.partitionBy("key").orderBy("ts", "id")
    rows = requests.withColumn("_ttl", ttl_seconds.cast("long")).withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    gap = F.col("_t") - F.lag("_t").over(w) >= F.col("_ttl") * 1_000_000
    rows = rows.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = _in_order(rows.select(F.col("key").cast("string").alias("key"), "id", "_t", "_ttl", "_run"), ["key", "_run"])
    return rows.mapInPandas(_replayed, "key string, id long, hit boolean")


#: What a first tier may hold: entries, and seconds at most.
L1_ENTRIES, L1_SECONDS = 500, 3600


class Tiers:
    """A first tier of bounded size in front of a second one; both live by each entry's time to live.

    A hit in the second puts the entry into the first anew, with a whole new life there. When the
    first is full the entry used longest ago goes.
    """

    def __init__(self, entries: int = L1_ENTRIES, most: int = L1_SECONDS):
        self.entries, self.most = entries, most * 1_000_000
        self.first: OrderedDict[str, int] = OrderedDict()  # key, until when
        self.second: dict[str, int] = {}
        self.swept = 4 * entries

    def ask(self, key: str, at: int, ttl: int) -> tuple[str, int]:
        """(L1, L2 or miss; entries that had to go) of a request at this time."""
        if self.first.get(key, at) > at:
            self.first.move_to_end(key)
            return "L1", 0
        tier = "L2" if self.second.get(key, at) > at else "miss"
        if tier == "miss":
            self.second[key] = at + ttl
        self.first[key] = at + min(ttl, self.most)
        self.first.move_to_end(key)
        gone = max(0, len(self.first) - self.entries)
        for _ in range(gone):
            self.first.popitem(last=False)
        return tier, gone

    def sweep(self, at: int) -> None:
        """Forget what has died in the second tier; the next time when there is twice as much."""
        self.second = {k: until for k, until in self.second.items() if until > at}
        self.swept = max(4 * self.entries, 2 * len(self.second))


def tier_replay(requests: DataFrame, ttl_seconds: Column, entries: int = L1_ENTRIES, most: int = L1_SECONDS) -> DataFrame:
    """shard, id, at (microseconds), tier (L1, L2 or miss), evicted, size of requests(shard, key, ts, id).

    Each shard, as an instance of the service, has tiers of its own and streams through one task
    in time order; a task holds the first tier and the keys of the second that are still alive.
    """

    def run(batches):
        shard, tiers = None, Tiers(entries, most)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.shard != shard:
                    shard, tiers = r.shard, Tiers(entries, most)
                tier, gone = tiers.ask(r.key, r.at, r.ttl)
                out.append((r.shard, r.id, r.at, tier, gone, len(tiers.first)))
                if len(tiers.second) > tiers.swept:
                    tiers.sweep(r.at)
            yield pd.DataFrame(out, columns=["shard", "id", "at", "tier", "evicted", "size"])

    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    rows = requests.select("shard", F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "id", at, (ttl_seconds.cast("long") * 1_000_000).alias("ttl"))
    ordered = rows.repartition("shard").sortWithinPartitions("shard", "at", "id")
    return ordered.mapInPandas(run, "shard long, id long, at long, tier string, evicted long, size long")


def tier_stats(replayed: DataFrame) -> DataFrame:
    """shard, hits and misses of the first tier, hit rate (four decimals), evictions, size at the end."""
    hits = F.count_if(F.col("tier") == "L1")
    return replayed.groupBy("shard").agg(hits.alias("hits"), (F.count(F.lit(1)) - hits).alias("misses"), half_up(hits / F.count(F.lit(1)), 4).alias("rate"), F.sum("evicted").alias("evictions"), F.max_by("size", F.struct("at", "id")).alias("size"))


def retry_summary(attempts: DataFrame, most: int = 3) -> DataFrame:
    """call_id, tries, waited_ms, succeeded, gave_up of attempts(call_id, attempt_no, ok, wait_ms).

    Attempts count up to the first that succeeds and up to most; a call that none of them served gave up.
    """
    able = attempts.where(F.col("attempt_no").between(1, most))
    first = able.groupBy("call_id").agg(F.min(F.when(F.col("ok"), F.col("attempt_no"))).alias("_at"))
    used = able.join(first, "call_id").where(F.col("_at").isNull() | (F.col("attempt_no") <= F.col("_at")))
    done = F.max(F.coalesce("ok", F.lit(False))).alias("succeeded")
    out = used.groupBy("call_id").agg(F.count(F.lit(1)).alias("tries"), F.sum(F.coalesce("wait_ms", F.lit(0))).alias("waited_ms"), done)
    return out.withColumn("gave_up", ~F.col("succeeded"))


#: Fixed value: what a failed check adds to the next round's instructions.
AGAIN = "请修正以下问题后重新回答："


def checked_rounds(rounds: DataFrame, most: int = 2) -> DataFrame:
    """answer_id, rounds, passed, instructions of rounds(answer_id, round, raw): a checker's JSON for
    each round of an answer.

    The first round that passes ends it; after most rounds the last verdict stands. instructions
    is what the issues of a failed first round ask of the next one, null if that passed.
    """
    own = rounds.where(F.col("round").between(1, most)).select("answer_id", "round", fact_check_report(F.col("raw")).alias("r"))
    first = own.groupBy("answer_id").agg(F.min(F.when(F.col("r.passed"), F.col("round"))).alias("_at"), F.max("round").alias("_last"), F.min_by("r", "round").alias("_first"))
    asked = F.concat(F.lit(AGAIN), F.array_join(F.col("_first.issues"), "；"))
    return first.select("answer_id", F.coalesce("_at", "_last").alias("rounds"), F.col("_at").isNotNull().alias("passed"), F.when(~F.col("_first.passed"), asked).alias("instructions"))


def accuracy(cases: DataFrame) -> DataFrame:
    """category, total, correct, accuracy (four decimals) of cases(category, expected, returned), and all of them as null category."""
    ok = F.coalesce(F.col("expected") == F.col("returned"), F.lit(False))
    rows = cases.withColumn("_ok", ok).rollup("category").agg(F.count(F.lit(1)).alias("total"), F.count_if("_ok").alias("correct"))
    return rows.select("category", "total", "correct", half_up(F.col("correct") / F.col("total"), 4).alias("accuracy"))


def fact_check_report(raw: Column) -> Column:
    """Struct of a checker's JSON; a flag is true only for JSON true, malformed text fails all."""
    from tickloom.functions.text import extract_json, strict_true

    j = extract_json(raw)
    return F.struct(*[strict_true(j, k).alias(k) for k in ("dataAccurate", "targetMatched", "logicComplete", "passed")], F.coalesce(F.from_json(F.get_json_object(j, "$.issues"), "array<string>"), F.array().cast("array<string>")).alias("issues"))
