"""Indicators against values worked out from their formulas, and against plain loops."""

import math

import pytest

from tickloom.operators import bars as B
from tickloom.operators import indicators as I
from tickloom.operators import monitor as M
from pyspark.sql import functions as F

SCHEMA = "symbol string, bar_idx int, open double, high double, low double, close double, volume long"


def made(n, base, trend, symbol="s"):
    close = [base + trend * i + 2 * math.sin(i / 2) for i in range(n)]
    return [(symbol, i, c - 0.5, c + 1, c - 1, c, 1000 + i) for i, c in enumerate(close)]


GOLDEN = {
    (65, 100, 0.5): ((3.29, 3.21, 0.18, 31, "golden_cross"), (92.41, 88.68, 88.13, 86.77), (77.73, 72.53, 88.11)),
    (60, 100, 0): ((-0.11, 0.09, -0.39, 26, "none"), (24.73, 37.10, 38.94, 43.54), (35.05, 49.20, 6.73)),
    (60, 100, 1): ((6.53, 6.58, -0.10, 26, "death_cross"), (100.0, 100.0, 100.0, 100.0), (89.14, 90.20, 87.03)),
    (60, 200, -0.5): ((-3.43, -3.16, -0.54, 26, "none"), (5.83, 9.82, 10.48, 12.22), (18.00, 24.01, 5.99)),
    (34, 100, 0.5): ((None, None, None, None, None), (66.21, 77.07, 78.39, 81.40), (74.93, 80.05, 64.68)),
    (35, 100, 0.5): ((2.38, 2.42, -0.09, 1, None), (66.22, 77.07, 78.39, 81.40), (66.41, 75.51, 48.23)),
}


def test_recurrences(spark):
    rows = [r for k in GOLDEN for r in made(*k, symbol=str(k))]
    bars = spark.createDataFrame(rows, SCHEMA)
    macd = {r["symbol"]: r[1:] for r in I.macd(bars).collect()}
    rsi = {r["symbol"]: r[1:] for r in I.rsi(bars).collect()}
    kdj = {r["symbol"]: r[1:] for r in I.kdj(bars).collect()}
    for k, (m, r, d) in GOLDEN.items():
        assert macd[str(k)] == m
        assert rsi[str(k)] == r
        assert kdj[str(k)] == d


def plain(closes, highs, lows):
    """MACD (dif, dea, before), RSI by period and (k, d) by one loop over all bars."""
    e12 = e26 = sum(closes[:26]) / 26
    dif = dea = seed = before = 0.0
    for k, c in enumerate(closes[:35] + closes[34:]):
        before = dif
        e12, e26 = (e12 * 11 + c * 2) / 13, (e26 * 25 + c * 2) / 27
        dif = e12 - e26
        seed += dif if 26 <= k <= 34 else 0
        dea = seed / 9 if k == 34 else (dea * 8 + dif * 2) / 10 if k > 34 else dea
    rsi, moves = [], [b - a for a, b in zip(closes, closes[1:])]
    for p in I.RSI_PERIODS:
        gain, loss = sum(max(x, 0.0) for x in moves[:p]) / p, sum(max(-x, 0.0) for x in moves[:p]) / p
        for x in moves[p:]:
            gain, loss = (gain * (p - 1) + max(x, 0.0)) / p, (loss * (p - 1) + max(-x, 0.0)) / p
        rsi.append(100.0 if loss == 0 else 100 - 100 / (1 + gain / loss))
    k = d = 50.0
    for i, c in enumerate(closes):
        hi, lo = max(highs[max(0, i - 8) : i + 1]), min(lows[max(0, i - 8) : i + 1])
        k = (2 * k + (50.0 if hi == lo else (c - lo) / (hi - lo) * 100)) / 3
        d = (2 * d + k) / 3
    return (dif, dea, before), rsi, (k, d)


def test_long_symbols_by_blocks(spark, monkeypatch):
    """Blocks of 7 and of 64 bars on several levels, and lengths around their edges: the loop's values."""
    import random

    from tickloom.operators import scans

    rng, rows, want = random.Random(3), [], {}
    for n in (35, 36, 41, 42, 98, 99, 343 + 34, 3000):
        price, own = 100.0, []
        for i in range(n):
            price = max(1.0, round(price + rng.uniform(-2, 2), 2))
            own.append((str(n), i, price, price + 1, price - 1, price, 1))
        rows += own
        want[str(n)] = plain([r[5] for r in own], [r[3] for r in own], [r[4] for r in own])
    bars = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for block in (7, 64, scans.BLOCK):
        monkeypatch.setattr(scans.last_state, "__defaults__", (*scans.last_state.__defaults__[:-1], block))
        out = I.macd(bars).join(I.rsi(bars), "symbol").join(I.kdj(bars), "symbol").collect()
        for r in out:
            (dif, dea, before), rsi, (k, d) = want[r["symbol"]]
            close = lambda a, b: abs(a - b) <= 0.005 + 1e-9  # noqa: E731  rounded to two decimals
            assert close(r["macd_dif"], dif) and close(r["macd_dea"], dea) and close(r["macd_bar"], 2 * (dif - dea))
            assert all(close(r[f"rsi{p}"], x) for p, x in zip(I.RSI_PERIODS, rsi))
            assert close(r["kdj_k"], k) and close(r["kdj_d"], d) and close(r["kdj_j"], 3 * k - 2 * d)
            assert r["macd_count"] == int(r["symbol"]) - 34


def test_short_series_have_no_values(spark):
    bars = spark.createDataFrame(made(5, 100, 1), SCHEMA)
    row = I.latest(bars).first().asDict()
    assert row["bars"] == 5 and row["price"] is not None
    assert all(row[k] is None for k in ("macd_dif", "rsi6", "kdj_k", "boll_mid", "avg_volume5"))


def test_moving_averages_differ(spark):
    bars = spark.createDataFrame(made(30, 10, 1), SCHEMA)
    head = I.moving_average_head(bars).first()
    tail = I.moving_average(bars).where("bar_idx = 29").first()
    assert head["ma5"] < tail["ma5"] and head["ma60"] is None and tail["ma60"] is None


@pytest.mark.parametrize("short,long,want", [(102, 100, "bullish"), (98, 100, "bearish"), (100.5, 100, "neutral"), (None, 100, None)])
def test_trend(spark, short, long, want):
    df = spark.createDataFrame([(float(short) if short else None, float(long))], "a double, b double")
    assert df.select(I.trend_of(F.col("a"), F.col("b")).alias("t")).first()["t"] == want


def test_alert_messages_and_order(spark):
    kinds = "change double, volume long, avg_volume5 long, macd_signal string, rsi6 double, price double, boll_upper double, boll_lower double"
    rows = [(3.0, 100, 10, "golden_cross", 80.0, 10.0, 10.0, 5.0), (2.9, 25, 10, "none", 50.0, 7.0, 10.0, 5.0), (None,) * 8, (-4.5, 1, 10, "death_cross", 20.0, 5.0, 10.0, 5.0)]
    got = [r["m"] for r in spark.createDataFrame(rows, kinds).select(M.messages().alias("m")).collect()]
    assert got[0] == "change 3.00%; volume 100 (mean 10); macd golden cross; rsi high 80.0; upper band (10.00)"
    assert got[1] is None and got[2] is None
    assert got[3] == "change -4.50%; macd death cross; rsi low 20.0; lower band (5.00)"


def test_suppress_counts_from_what_stayed():
    assert M.suppress([0, 1000, 1800, 1801, 3700], 1800) == [0, 3, 4]
    assert M.suppress([], 10) == []


def test_suppression_by_pointer_jumping(spark, monkeypatch):
    """Against the loop: busy and quiet keys, equal times, gaps at the limit, null keys, short stretches."""
    import random
    from datetime import datetime, timedelta

    rng, rows, at = random.Random(4), [], datetime(2024, 1, 1)
    for key, gap in (("busy", 400), ("quiet", 9000), ("mixed", 1800), (None, 900)):
        t = 0
        for k in range(300):
            t += rng.choice([0, 1, gap, 1800, 1801, rng.randrange(gap + 1), 200_000 if k % 60 == 59 else 0])
            rows.append((key, "m" if k % 3 else None, at + timedelta(seconds=t), rng.randrange(10**6)))
    rows += [rows[5], ("busy", "m", None, 1), ("one", "m", at, 7)]
    want, by = set(), {}
    for s, m, t, i in set(rows):
        if t is not None:
            by.setdefault((s, m), []).append((t, i))
    for (s, m), own in by.items():
        own.sort()
        want |= {(s, m, *own[k]) for k in M.suppress([int((t - at).total_seconds() * 1e6) for t, _ in own], 1800 * 1_000_000)}
    alerts = spark.createDataFrame(rows, "symbol string, message string, ts timestamp, id long").repartition(4)
    for stretch in (M.STRETCH, 1):
        monkeypatch.setattr(M, "STRETCH", stretch)
        got = [tuple(r) for r in M.dedup_alerts(alerts).collect()]
        assert len(got) == len(want) and set(got) == want
    assert M.dedup_alerts(alerts.limit(0)).count() == 0


def test_trading_time(spark):
    rows = [("2024-01-05 09:30:00", True), ("2024-01-05 11:30:59", True), ("2024-01-05 11:31:00", False), ("2024-01-05 15:00:00", True), ("2024-01-06 10:00:00", False)]
    df = spark.createDataFrame(rows, "t string, want boolean").select(M.trading_time(F.to_timestamp("t")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())


def test_bars_of_ticks_and_empty_tables(spark):
    kinds = "event_id long, ts timestamp, event_type string, value double"
    from datetime import datetime as D

    ticks = spark.createDataFrame([(2, D(2024, 1, 1, 0, 5), "a", 3.0), (1, D(2024, 1, 1, 0, 5), "a", 1.0), (3, D(2024, 1, 1, 0, 59), "a", 2.0), (4, D(2024, 1, 1, 1, 0), "a", 9.0)], kinds)
    got = [tuple(r)[2:] for r in B.ohlcv(ticks).orderBy("ts").collect()]
    assert got == [(1.0, 3.0, 1.0, 2.0, 3), (9.0, 9.0, 9.0, 9.0, 1)]
    assert B.numbered(B.ohlcv(spark.createDataFrame([], kinds))).count() == 0
