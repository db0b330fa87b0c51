"""Queries over bars made of events: a symbol is an event type, a bar an hour."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.numeric import half_up
from tickloom.operators import bars as B
from tickloom.operators import indicators as I
from tickloom.operators import monitor as M
from tickloom.session import table, workers_import


def hourly(spark, sf_dir):
    return B.numbered(B.ohlcv(table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")))


def ohlcv_bars(spark, sf_dir):
    return B.ohlcv(table(spark, sf_dir, "events"))


def pct_change(spark, sf_dir):
    return I.change(hourly(spark, sf_dir))


def moving_avg(spark, sf_dir):
    return I.moving_average(hourly(spark, sf_dir))


def moving_avg_head(spark, sf_dir):
    return I.moving_average_head(hourly(spark, sf_dir))


def bollinger(spark, sf_dir):
    return I.bollinger(hourly(spark, sf_dir))


def volume_ma(spark, sf_dir):
    return I.volume_average(hourly(spark, sf_dir))


def last_n(spark, sf_dir):
    return B.last_n(hourly(spark, sf_dir), 10).select("symbol", "bar_idx", "close")


def macd(spark, sf_dir):
    return I.macd(hourly(spark, sf_dir)).drop("macd_signal")


def macd_signal(spark, sf_dir):
    return I.macd(hourly(spark, sf_dir)).select("symbol", "macd_signal")


def rsi(spark, sf_dir):
    return I.rsi(hourly(spark, sf_dir))


def kdj(spark, sf_dir):
    return I.kdj(hourly(spark, sf_dir))


def trend_momentum(spark, sf_dir):
    own = hourly(spark, sf_dir)
    ma = I.moving_average(own).groupBy("symbol").agg(F.max_by("ma5", "bar_idx").alias("ma5"), F.max_by("ma20", "bar_idx").alias("ma20"))
    rows = ma.join(I.rsi(own), "symbol").join(I.kdj(own), "symbol").withColumn("trend", I.trend_of(F.col("ma5"), F.col("ma20")))
    return rows.select("symbol", "trend", I.momentum_of(F.col("rsi6"), F.col("kdj_k"), F.col("trend")).alias("momentum"))


def _facts(spark, sf_dir):
    own = hourly(spark, sf_dir)
    moved = I.change(own).groupBy("symbol").agg(F.max_by("pct_change", "bar_idx").alias("change"))
    return I.latest(own).join(moved, "symbol")


def alert_rules(spark, sf_dir):
    rows = _facts(spark, sf_dir).withColumn("message", M.messages())
    return rows.where("message is not null").select("symbol", "message")


def flagship(spark, sf_dir):
    return _facts(spark, sf_dir).withColumn("message", M.messages())


def trading_time_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where(M.trading_time(F.col("ts"))).select("event_id", "event_type", "value")


def monitor_cycles(spark, sf_dir):
    return M.cycles(table(spark, sf_dir, "events"))


def alert_dedup(spark, sf_dir):
    workers_import(spark)
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.concat(F.lit("user "), F.col("user_id") % 10).alias("message"), "ts", F.col("event_id").alias("id"))
    return M.dedup_alerts(own).select("symbol", "message", "id")


def recent_alerts(spark, sf_dir):
    """The last 20 retained alerts of each symbol, newest first in rank."""
    workers_import(spark)
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.concat(F.lit("user "), F.col("user_id") % 10).alias("message"), "ts", F.col("event_id").alias("id"))
    return M.newest(M.dedup_alerts(own), ["symbol"], [F.desc("ts"), F.desc("id")], 20).select("symbol", "id")


def weighted_score(spark, sf_dir):
    """Four ranks from the bars, weighted .35, .25, .25 and .15."""
    own = hourly(spark, sf_dir).groupBy("symbol").agg(F.max("high").alias("a"), F.min("low").alias("b"), F.sum("volume").alias("c"), F.count(F.lit(1)).alias("d"))
    score = F.col("a") * 0.35 + F.col("b") * 0.25 + F.col("c") * 0.25 + F.col("d") * 0.15
    return own.select("symbol", half_up(score, 4).alias("score"))


_BARS = """b0 AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, struct_pack(t := ts, e := event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, struct_pack(t := ts, e := event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx, floor(close * 100 + 0.5)::BIGINT AS c FROM b0)"""
_W = "OVER (PARTITION BY symbol ORDER BY bar_idx ROWS {} PRECEDING)"


def _r(x: str) -> str:
    return f"floor(({x}) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE"


def _ma(n: int) -> str:
    return f"CASE WHEN bar_idx >= {n - 1} THEN {_r(f'sum(c) {_W.format(n - 1)}::BIGINT::DOUBLE / {n}::DOUBLE / 100::DOUBLE'.replace('::BIGINT::DOUBLE /', ' /'))} END AS ma{n}"


_CLOSES = f"{_BARS},\ns AS (SELECT symbol, count(*) AS n, array_agg(close ORDER BY bar_idx) AS closes FROM b GROUP BY symbol)"

_MACD = f"""{_CLOSES},
seq AS (SELECT symbol, n, k - 1 AS step, closes[CASE WHEN k <= 35 THEN k ELSE k - 1 END] AS x FROM s, LATERAL (SELECT unnest(range(1, n + 2)) AS k) WHERE n > 34),
h AS (SELECT symbol, list_sum(closes[1:26]) AS ignored, list_reduce(closes[1:26], lambda a, x: a + x, 0.0::DOUBLE) / 26 AS head FROM s WHERE n > 34),
r AS (SELECT symbol, -1 AS step, head AS e12, head AS e26, 0.0::DOUBLE AS seed, 0.0::DOUBLE AS dif, 0.0::DOUBLE AS dea, 0.0::DOUBLE AS dif_before FROM h
 UNION ALL SELECT symbol, step, e12, e26, seed2, e12 - e26, CASE WHEN step = 34 THEN seed2 / 9 WHEN step > 34 THEN (dea * 8 + (e12 - e26) * 2) / 10 ELSE dea END, dif
 FROM (SELECT q.symbol, q.step, (r.e12 * 11.0::DOUBLE + q.x * 2) / 13.0::DOUBLE AS e12, (r.e26 * 25.0::DOUBLE + q.x * 2) / 27.0::DOUBLE AS e26, r.seed + CASE WHEN q.step BETWEEN 26 AND 34 THEN (r.e12 * 11.0::DOUBLE + q.x * 2) / 13.0::DOUBLE - (r.e26 * 25.0::DOUBLE + q.x * 2) / 27.0::DOUBLE ELSE 0 END AS seed2, r.dea, r.dif FROM r JOIN seq q ON q.symbol = r.symbol AND q.step = r.step + 1)),
f AS (SELECT s.symbol, s.n, {_r('r.dif')} AS dif, {_r('r.dea')} AS dea, {_r('(r.dif - r.dea) * 2')} AS bar, {_r('r.dif_before')} AS before FROM s LEFT JOIN r ON r.symbol = s.symbol AND r.step = s.n)"""

_RSI = ",\n".join(
    f"""i{p} AS (SELECT symbol, list_transform(range(2, n + 1), lambda i: closes[i] - closes[i - 1]) AS d FROM s WHERE n > {p}),
q{p} AS (SELECT symbol, {p}::BIGINT AS k, list_reduce(d[1:{p}], lambda a, x: a + greatest(x, 0.0::DOUBLE), 0.0::DOUBLE) / {p} AS gain, list_reduce(d[1:{p}], lambda a, x: a + greatest(-x, 0.0::DOUBLE), 0.0::DOUBLE) / {p} AS loss, 50.0::DOUBLE AS rsi FROM i{p}
 UNION ALL SELECT symbol, k, gain, loss, CASE WHEN loss = 0 THEN 100.0 ELSE 100 - 100.0 / (1 + gain / loss) END FROM (SELECT q.symbol, q.k + 1 AS k, (q.gain * {p - 1} + greatest(i.d[q.k + 1], 0.0::DOUBLE)) / {p} AS gain, (q.loss * {p - 1} + greatest(-i.d[q.k + 1], 0.0::DOUBLE)) / {p} AS loss FROM q{p} q JOIN i{p} i ON i.symbol = q.symbol AND q.k < len(i.d))),
r{p} AS (SELECT symbol, {_r('arg_max(rsi, k)')} AS rsi{p} FROM q{p} GROUP BY symbol)"""
    for p in I.RSI_PERIODS
)
_RSI_ROWS = "rs AS (SELECT s.symbol, rsi6, rsi12, rsi14, rsi24 FROM s LEFT JOIN r6 USING (symbol) LEFT JOIN r12 USING (symbol) LEFT JOIN r14 USING (symbol) LEFT JOIN r24 USING (symbol))"

_KDJ = f"""v AS (SELECT symbol, bar_idx, close, max(high) {_W.format(8)} AS hi, min(low) {_W.format(8)} AS lo FROM b),
w AS (SELECT symbol, bar_idx, CASE WHEN hi = lo THEN 50.0 ELSE (close - lo) / (hi - lo) * 100 END::DOUBLE AS rsv FROM v),
kd AS (SELECT DISTINCT symbol, -1::BIGINT AS i, 50.0::DOUBLE AS k, 50.0::DOUBLE AS d FROM w UNION ALL SELECT kd.symbol, w.bar_idx, (kd.k * 2 + w.rsv) / 3, (kd.d * 2 + (kd.k * 2 + w.rsv) / 3) / 3 FROM kd JOIN w ON w.symbol = kd.symbol AND w.bar_idx = kd.i + 1),
kf AS (SELECT symbol, CASE WHEN max(i) >= 8 THEN {_r('arg_max(k, i)')} END AS kdj_k, CASE WHEN max(i) >= 8 THEN {_r('arg_max(d, i)')} END AS kdj_d, CASE WHEN max(i) >= 8 THEN {_r('arg_max(k, i) * 3 - arg_max(d, i) * 2')} END AS kdj_j FROM kd GROUP BY symbol)"""

_BOLL = f"""bm AS (SELECT symbol, bar_idx, sum(c) {_W.format(19)} AS t, sum(c * c) {_W.format(19)} AS q FROM b),
bs AS (SELECT symbol, bar_idx, t / 20::DOUBLE / 100::DOUBLE AS m, sqrt((20 * q - t * t)::DOUBLE) / 20::DOUBLE / 100::DOUBLE * 2 AS s FROM bm WHERE bar_idx >= 19),
bl AS (SELECT symbol, bar_idx, {_r('m + s')} AS boll_upper, {_r('m')} AS boll_mid, {_r('m - s')} AS boll_lower FROM bs)"""
_VOL = f"vm AS (SELECT symbol, bar_idx, (sum(volume) {_W.format(4)} // 5)::BIGINT AS avg_volume5, (sum(volume) {_W.format(9)} // 10)::BIGINT AS avg_volume10 FROM b QUALIFY bar_idx >= 9)"
_CHANGE = f"pc AS (SELECT symbol, bar_idx, close, CASE WHEN p <> 0 THEN {_r('(close - p) / p * 100')} END AS pct_change FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx) AS p FROM b))"
_SIGNAL = "CASE WHEN n > 35 THEN CASE WHEN before < dea AND dea <= dif THEN 'golden_cross' WHEN before >= dea AND dea > dif THEN 'death_cross' ELSE 'none' END END"
_TRADING = "isodow(ts) <= 5 AND (hour(ts) * 60 + minute(ts) BETWEEN 570 AND 690 OR hour(ts) * 60 + minute(ts) BETWEEN 780 AND 900)"
_DEDUP = """a AS (SELECT event_type AS symbol, 'user ' || (user_id % 10) AS message, ts, event_id AS id, row_number() OVER (PARTITION BY event_type, user_id % 10 ORDER BY ts, event_id) AS k FROM events),
d AS (SELECT symbol, message, id, k, ts, ts AS held, true AS kept FROM a WHERE k = 1 UNION ALL SELECT a.symbol, a.message, a.id, a.k, a.ts, CASE WHEN a.ts > d.held + INTERVAL 30 MINUTE THEN a.ts ELSE d.held END, a.ts > d.held + INTERVAL 30 MINUTE FROM d JOIN a ON a.symbol = d.symbol AND a.message = d.message AND a.k = d.k + 1)"""

QUERIES = {f.__name__: f for f in (ohlcv_bars, pct_change, moving_avg, moving_avg_head, bollinger, volume_ma, last_n, macd, macd_signal, rsi, kdj, trend_momentum, alert_rules, trading_time_filter, monitor_cycles, alert_dedup, recent_alerts, weighted_score)}

ORACLES = {
    "ohlcv_bars": f"WITH {_BARS} SELECT symbol, ts, open, high, low, close, volume FROM b",
    "pct_change": f"WITH {_BARS}, {_CHANGE} SELECT symbol, bar_idx::INT AS bar_idx, close, pct_change FROM pc",
    "moving_avg": f"WITH {_BARS} SELECT symbol, bar_idx::INT AS bar_idx, {', '.join(map(_ma, (5, 10, 20, 60)))} FROM b",
    "moving_avg_head": "WITH " + _BARS + " SELECT symbol, " + ", ".join(f"CASE WHEN count(*) >= {n} THEN {_r(f'sum(CASE WHEN bar_idx < {n} THEN c END) / {n}::DOUBLE / 100::DOUBLE')} END AS ma{n}" for n in (5, 10, 20, 60)) + " FROM b WHERE bar_idx < 60 GROUP BY symbol",
    "bollinger": f"WITH {_BARS}, {_BOLL} SELECT symbol, bar_idx::INT AS bar_idx, boll_upper, boll_mid, boll_lower FROM bl",
    "volume_ma": f"WITH {_BARS}, {_VOL} SELECT symbol, bar_idx::INT AS bar_idx, avg_volume5, avg_volume10 FROM vm",
    "last_n": f"WITH {_BARS} SELECT symbol, bar_idx::INT AS bar_idx, close FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 10",
    "macd": f"WITH RECURSIVE {_MACD} SELECT symbol, dif AS macd_dif, dea AS macd_dea, bar AS macd_bar, CASE WHEN n > 34 THEN n - 34 END::INT AS macd_count FROM f",
    "macd_signal": f"WITH RECURSIVE {_MACD} SELECT symbol, {_SIGNAL} AS macd_signal FROM f",
    "rsi": f"WITH RECURSIVE {_CLOSES}, {_RSI}, {_RSI_ROWS} SELECT * FROM rs",
    "kdj": f"WITH RECURSIVE {_BARS}, {_KDJ} SELECT * FROM kf",
    "trend_momentum": f"""WITH RECURSIVE {_CLOSES}, {_RSI}, {_RSI_ROWS}, {_KDJ}, ma AS (SELECT symbol, bar_idx, {_ma(5)}, {_ma(20)} FROM b), l AS (SELECT symbol, arg_max_null(ma5, bar_idx) AS ma5, arg_max_null(ma20, bar_idx) AS ma20 FROM ma GROUP BY symbol),
t AS (SELECT symbol, CASE WHEN ma5 > ma20 * 1.01::DOUBLE THEN 'bullish' WHEN ma5 < ma20 * 0.99::DOUBLE THEN 'bearish' WHEN ma5 IS NOT NULL AND ma20 IS NOT NULL THEN 'neutral' END AS trend, rsi6, kdj_k FROM l JOIN rs USING (symbol) JOIN kf USING (symbol))
SELECT symbol, trend, CASE WHEN coalesce(rsi6 > 70, false) OR coalesce(kdj_k > 80, false) THEN CASE WHEN trend = 'bullish' THEN 'overbought_trend_up' ELSE 'overbought' END WHEN coalesce(rsi6 < 30, false) OR coalesce(kdj_k < 20, false) THEN CASE WHEN trend = 'bearish' THEN 'oversold_trend_down' ELSE 'oversold' END ELSE 'neutral' END AS momentum FROM t""",
    "alert_rules": f"""WITH RECURSIVE {_MACD}, {_RSI}, {_RSI_ROWS}, {_BOLL}, {_VOL}, {_CHANGE}, e AS (SELECT symbol, arg_max(close, bar_idx) AS price, arg_max(volume, bar_idx) AS volume FROM b GROUP BY symbol), g AS (SELECT symbol, {_SIGNAL} AS macd_signal FROM f),
x AS (SELECT e.*, macd_signal, rsi6, (SELECT arg_max(boll_upper, bar_idx) FROM bl WHERE bl.symbol = e.symbol) AS up, (SELECT arg_max(boll_lower, bar_idx) FROM bl WHERE bl.symbol = e.symbol) AS lo, (SELECT arg_max(avg_volume5, bar_idx) FROM vm WHERE vm.symbol = e.symbol) AS a5, (SELECT arg_max(pct_change, bar_idx) FROM pc WHERE pc.symbol = e.symbol) AS change FROM e JOIN g USING (symbol) JOIN rs USING (symbol)),
m AS (SELECT symbol, concat_ws('; ', CASE WHEN abs(change) >= 3.0 THEN printf('change %.2f%%', change) END, CASE WHEN a5 > 0 AND volume > a5 * 2.5 THEN printf('volume %d (mean %d)', volume, a5) END, CASE macd_signal WHEN 'golden_cross' THEN 'macd golden cross' WHEN 'death_cross' THEN 'macd death cross' END, CASE WHEN rsi6 > 75 THEN printf('rsi high %.1f', rsi6) WHEN rsi6 < 25 THEN printf('rsi low %.1f', rsi6) END, CASE WHEN price >= up * 0.995::DOUBLE THEN printf('upper band (%.2f)', price) END, CASE WHEN price <= lo * 1.005::DOUBLE THEN printf('lower band (%.2f)', price) END) AS message FROM x)
SELECT symbol, message FROM m WHERE message <> ''""",
    "trading_time_filter": f"SELECT event_id, event_type, value FROM events WHERE {_TRADING}",
    "monitor_cycles": f"SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS cycle, event_type AS symbol, arg_max(value, struct_pack(t := ts, e := event_id)) AS price, count(*) AS ticks FROM events WHERE {_TRADING} GROUP BY 1, 2",
    "alert_dedup": f"WITH RECURSIVE {_DEDUP} SELECT symbol, message, id FROM d WHERE kept",
    "recent_alerts": f"WITH RECURSIVE {_DEDUP} SELECT symbol, id FROM d WHERE kept QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, id DESC) <= 20",
    "weighted_score": f"WITH {_BARS}, g AS (SELECT symbol, max(high) AS a, min(low) AS b, sum(volume)::BIGINT AS c, count(*) AS d FROM b GROUP BY symbol) SELECT symbol, floor((a * 0.35::DOUBLE + b * 0.25::DOUBLE + c * 0.25::DOUBLE + d * 0.15::DOUBLE) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS score FROM g",
}
