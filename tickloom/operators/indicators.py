"""Technical indicators over numbered bars (symbol, bar_idx, open, high, low, close, volume).

Frame indicators are window functions. Recurrences (MACD, RSI, KDJ) are affine maps, folded with the
higher-order function ``aggregate`` block by block and composed (see scans): no Python, linear in
the bars, and no array of a whole symbol, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import cents, half_up, percent_change
from tickloom.operators import scans

MIN_BARS = 34
FAST, SLOW, SIGNAL = 12, 26, 9
RSI_PERIODS = (6, 12, 14, 24)
KDJ_BARS = 9
BOLLINGER_BARS, BOLLINGER_WIDTH = 20, 2


def _back(n: int):
    return Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(1 - n, 0)


def _mean(n: int) -> Column:
    return F.sum(cents(F.col("close"))).over(_back(n)) / F.lit(n) / F.lit(100)


def change(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("bar_idx"))
    return bars.select("symbol", "bar_idx", "close", percent_change(F.col("close"), before).alias("pct_change"))


def moving_average(bars: DataFrame, periods=(5, 10, 20, 60)) -> DataFrame:
    """ma<n> over the last n bars; null until there are n."""
    full = [F.when(F.col("bar_idx") >= n - 1, half_up(_mean(n))).alias(f"ma{n}") for n in periods]
    return bars.select("symbol", "bar_idx", *full)


def moving_average_head(bars: DataFrame, periods=(5, 10, 20, 60)) -> DataFrame:
    """For each symbol the mean of its first n closes, null for a symbol with fewer bars."""
    first = bars.where(F.col("bar_idx") < max(periods))
    means = [F.when(F.count(F.lit(1)) >= n, half_up(F.sum(F.when(F.col("bar_idx") < n, cents(F.col("close")))) / F.lit(n) / F.lit(100))).alias(f"ma{n}") for n in periods]
    return first.groupBy("symbol").agg(*means)


def bollinger(bars: DataFrame, n: int = BOLLINGER_BARS, width: int = BOLLINGER_WIDTH) -> DataFrame:
    """Bands of width population deviations around the mean of n closes; null until there are n.

    The variance is taken of whole cents, so that it is exact whatever the order of the sums.
    """
    c = cents(F.col("close"))
    total, squares = F.sum(c).over(_back(n)), F.sum(c * c).over(_back(n))
    mid = total / F.lit(n) / F.lit(100)
    spread = F.sqrt((F.lit(n) * squares - total * total).cast("double")) / F.lit(n) / F.lit(100) * width
    rows = bars.select("symbol", "bar_idx", mid.alias("m"), spread.alias("s")).where(F.col("bar_idx") >= n - 1)
    return rows.select("symbol", "bar_idx", half_up(F.col("m") + F.col("s")).alias("boll_upper"), half_up(F.col("m")).alias("boll_mid"), half_up(F.col("m") - F.col("s")).alias("boll_lower"))


def volume_average(bars: DataFrame) -> DataFrame:
    """Whole-number means of the last 5 and 10 volumes, from the tenth bar on."""
    rows = bars.select("symbol", "bar_idx", F.expr("sum(volume) over (partition by symbol order by bar_idx rows 4 preceding) div 5").alias("avg_volume5"), F.expr("sum(volume) over (partition by symbol order by bar_idx rows 9 preceding) div 10").alias("avg_volume10"))
    return rows.where("bar_idx >= 9")


def _ema(before: Column, close: Column, n: int) -> Column:
    return (before * F.lit(float(n - 1)) + close * 2) / F.lit(float(n + 1))


def _head(rows: DataFrame, n: int, *facts: str) -> DataFrame:
    """symbol, n, and the facts of the first n rows by bar_idx, an array each."""
    first = F.array_sort(F.collect_list(F.struct("bar_idx", *facts)))
    own = rows.where(F.col("bar_idx") < n).groupBy("symbol").agg(first.alias("_b"))
    return own.select("symbol", F.size("_b").alias("n"), *[F.col(f"_b.{f}").alias(f) for f in facts])


_MACD = ("e12", "e26", "dea", "before")


def _macd_start(closes: Column) -> Column:
    """The state after the first 35 closes: both averages start from the mean of the first 26 and run
    over these again; bars 26 to 34 seed the signal line with the mean of their nine differences."""
    zero = F.lit(0.0)
    mean = F.aggregate(F.slice(closes, 1, SLOW), zero, lambda a, x: a + x) / SLOW
    begin = F.struct(F.lit(0).alias("step"), mean.alias("e12"), mean.alias("e26"), zero.alias("seed"), zero.alias("dif"))

    def fold(s: Column, close: Column) -> Column:
        e12, e26 = _ema(s["e12"], close, FAST), _ema(s["e26"], close, SLOW)
        seed = F.when(s["step"] >= SLOW, s["seed"] + (e12 - e26)).otherwise(s["seed"])
        return F.struct((s["step"] + 1).alias("step"), e12.alias("e12"), e26.alias("e26"), seed.alias("seed"), (e12 - e26).alias("dif"))

    # Through an array of one, so that the fold is not repeated for each field.
    done = F.transform(F.array(F.aggregate(closes, begin, fold)), lambda s: F.struct(F.lit(0).cast("long").alias("n"), s["e12"].alias("e12"), s["e26"].alias("e26"), (s["seed"] / SIGNAL).alias("dea"), s["dif"].alias("before")))
    return F.element_at(done, 1)


def _macd_shift(s: Column, m: Column) -> Column:
    """before is the difference one step back: of the state before the stretch, where that has one step."""
    a, b, keep, weight = 1 - 2 / (FAST + 1), 1 - 2 / (SLOW + 1), (SIGNAL - 1) / (SIGNAL + 1), 2 / (SIGNAL + 1)
    n = m["n"]
    dea = scans.steps(keep, n) * s["dea"] + scans.carried(a, keep, weight, n) * s["e12"] - scans.carried(b, keep, weight, n) * s["e26"] + m["dea"]
    before = scans.steps(a, n - 1) * s["e12"] - scans.steps(b, n - 1) * s["e26"] + m["before"]
    return F.struct((s["n"] + n).alias("n"), (scans.steps(a, n) * s["e12"] + m["e12"]).alias("e12"), (scans.steps(b, n) * s["e26"] + m["e26"]).alias("e26"), dea.alias("dea"), before.alias("before"))


def macd(bars: DataFrame) -> DataFrame:
    """symbol, macd_dif, macd_dea, macd_bar of the last bar, macd_count and macd_signal.

    Null with fewer than 35 bars. The main run takes bar 34 again as its first one, as in the source
    of these formulas. The signal compares rounded values of two points at least: the difference
    crosses today's signal line from below (golden) or above (death).
    """

    def step(s: Column, r: Column) -> Column:
        e12, e26 = _ema(s["e12"], r["close"], FAST), _ema(s["e26"], r["close"], SLOW)
        dea = (s["dea"] * (SIGNAL - 1) + (e12 - e26) * 2) / (SIGNAL + 1)
        return F.struct((s["n"] + 1).alias("n"), e12.alias("e12"), e26.alias("e26"), dea.alias("dea"), (s["e12"] - s["e26"]).alias("before"))

    head = _head(bars, MIN_BARS + 1, "close")
    starts = head.where(F.col("n") > MIN_BARS).select("symbol", _macd_start(F.col("close")).alias("start"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in _MACD])
    main = bars.where(F.col("bar_idx") >= MIN_BARS).select("symbol", (F.col("bar_idx") - MIN_BARS).alias("at"), "close")
    rows = head.select("symbol").join(scans.last_state(main, zero, step, _macd_shift, starts=starts), "symbol", "left")
    s = F.col("state")
    dif, dea, before = half_up(s["e12"] - s["e26"]), half_up(s["dea"]), half_up(s["before"])
    signal = F.when((before < dea) & (dea <= dif), "golden_cross").when((before >= dea) & (dea > dif), "death_cross").otherwise("none")
    return rows.select(
        "symbol",
        dif.alias("macd_dif"),
        dea.alias("macd_dea"),
        half_up((s["e12"] - s["e26"] - s["dea"]) * 2).alias("macd_bar"),
        s["n"].cast("int").alias("macd_count"),
        F.when(s["n"] > 1, signal).alias("macd_signal"),
    )


def _up(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def rsi(bars: DataFrame, periods=RSI_PERIODS) -> DataFrame:
    """symbol and rsi<period>, Wilder's index: null with period closes or fewer, 50 with one more.

    The first period changes are averaged; each later one moves the averages by a period's share.
    """
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    moves = bars.select("symbol", "bar_idx", (F.col("close") - F.lag("close").over(w)).alias("d"))

    def step(s: Column, r: Column) -> Column:
        out = []
        for p in periods:
            live = r["at"] > p  # the bars before it are in the start
            for k, own in (("g", _up(r["d"])), ("l", _up(-r["d"]))):
                out.append(F.when(live, (s[f"{k}{p}"] * (p - 1) + own) / p).otherwise(s[f"{k}{p}"]).alias(f"{k}{p}"))
            out.append((s[f"n{p}"] + live.cast("long")).alias(f"n{p}"))
        return F.struct(*out)

    def shift(s: Column, m: Column) -> Column:
        out = []
        for p in periods:
            keep = scans.steps((p - 1) / p, m[f"n{p}"])
            out += [(keep * s[f"{k}{p}"] + m[f"{k}{p}"]).alias(f"{k}{p}") for k in "gl"]
            out.append((s[f"n{p}"] + m[f"n{p}"]).alias(f"n{p}"))
        return F.struct(*out)

    def struct(of) -> Column:
        return F.struct(*[of(k, p).alias(f"{k}{p}") for p in periods for k in ("g", "l", "n")])

    none = lambda k: F.lit(0).cast("long") if k == "n" else F.lit(0.0)
    # The first row's change is null.
    head = _head(moves, max(periods) + 1, "d")
    total = lambda f, p: F.aggregate(F.slice("d", 2, p), F.lit(0.0), lambda a, x: a + f(x)) / p
    first = {"g": _up, "l": lambda x: _up(-x)}
    starts = head.select("symbol", struct(lambda k, p: none(k) if k == "n" else F.when(F.col("n") > p, total(first[k], p))).alias("start"))
    main = moves.where("bar_idx > 0").select("symbol", F.col("bar_idx").alias("at"), "d")
    rows = scans.last_state(main, struct(lambda k, p: none(k)), step, shift, starts=starts)
    s = F.col("state")

    def of(p: int) -> Column:
        gain, loss = s[f"g{p}"], s[f"l{p}"]
        index = F.when(loss == 0, F.lit(100.0)).otherwise(100 - F.lit(100.0) / (1 + gain / F.when(loss != 0, loss)))
        return F.when(gain.isNotNull(), half_up(F.when(s[f"n{p}"] == 0, F.lit(50.0)).otherwise(index)))

    return rows.select("symbol", *[of(p).alias(f"rsi{p}") for p in periods])


def kdj(bars: DataFrame, n: int = KDJ_BARS) -> DataFrame:
    """symbol, kdj_k, kdj_d, kdj_j after the last bar; null with fewer than n bars.

    Early bars use what there is. Highest and lowest come from a frame, the two smoothings
    from a scan.
    """
    w = _back(n)
    high, low = F.max("high").over(w), F.min("low").over(w)
    raw = F.when(high == low, F.lit(50.0)).otherwise((F.col("close") - low) / F.when(high != low, high - low) * 100)
    rows = bars.select("symbol", F.col("bar_idx").alias("at"), raw.alias("rsv"))
    keep = 2 / 3

    def struct(steps: Column, k: Column, d: Column) -> Column:
        return F.struct(steps.cast("long").alias("n"), k.alias("k"), d.alias("d"))

    def step(s: Column, r: Column) -> Column:
        k = (s["k"] * 2 + r["rsv"]) / 3
        return struct(s["n"] + 1, k, (s["d"] * 2 + k) / 3)

    def shift(s: Column, m: Column) -> Column:
        left = scans.steps(keep, m["n"])
        return struct(s["n"] + m["n"], left * s["k"] + m["k"], left * s["d"] + scans.carried(keep, keep, 1 / 3, m["n"]) * s["k"] + m["d"])

    zero, fifty = F.lit(0.0), F.lit(50.0)
    rows = scans.last_state(rows, struct(F.lit(0), zero, zero), step, shift, struct(F.lit(0), fifty, fifty))
    rows = rows.select("symbol", F.when(F.col("state.n") >= n, F.col("state")).alias("s"))
    return rows.select("symbol", half_up(F.col("s.k")).alias("kdj_k"), half_up(F.col("s.d")).alias("kdj_d"), half_up(F.col("s.k") * 3 - F.col("s.d") * 2).alias("kdj_j"))


def trend_of(short: Column, long: Column) -> Column:
    return F.when(short > long * 1.01, "bullish").when(short < long * 0.99, "bearish").when(short.isNotNull() & long.isNotNull(), "neutral")


def momentum_of(rsi6: Column, k: Column, trend: Column) -> Column:
    """Overbought wins over oversold; the trend in the same direction shows in the name."""
    high = F.coalesce(rsi6 > 70, F.lit(False)) | F.coalesce(k > 80, F.lit(False))
    low = F.coalesce(rsi6 < 30, F.lit(False)) | F.coalesce(k < 20, F.lit(False))
    with_trend = lambda name, way, long: F.when(F.coalesce(trend == way, F.lit(False)), long).otherwise(name)
    return F.when(high, with_trend("overbought", "bullish", "overbought_trend_up")).when(low, with_trend("oversold", "bearish", "oversold_trend_down")).otherwise("neutral")


def latest(bars: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    """One row per symbol with every indicator after its last bar, null below min_bars bars.

    The bars are grouped by symbol once; all parts share that partitioning.
    """
    last = lambda rows, *cols: rows.groupBy("symbol").agg(*[F.max_by(c, "bar_idx").alias(c) for c in cols])
    out = macd(bars).join(rsi(bars), "symbol").join(kdj(bars), "symbol", "left")
    out = out.join(last(bollinger(bars), "boll_upper", "boll_mid", "boll_lower"), "symbol", "left")
    out = out.join(last(volume_average(bars), "avg_volume5", "avg_volume10"), "symbol", "left")
    ends = bars.groupBy("symbol").agg(F.max_by("close", "bar_idx").alias("price"), F.max_by("volume", "bar_idx").alias("volume"), F.count(F.lit(1)).alias("bars"))
    facts = [c for c in out.columns if c != "symbol"]
    out = out.join(ends, "symbol")
    return out.select("symbol", "bars", "price", "volume", *[F.when(F.col("bars") >= min_bars, F.col(c)).alias(c) for c in facts])
