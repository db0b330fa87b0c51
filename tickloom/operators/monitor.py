"""Alert rules, trading hours, suppression of repeats and bounded histories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import cut


@dataclass(frozen=True)
class Rules:
    change: float = 3.0
    #: Times the five-bar mean volume, both in the same unit.
    volume: float = 2.5
    rsi_high: float = 75.0
    rsi_low: float = 25.0
    near_upper: float = 0.995
    near_lower: float = 1.005


def messages(rules: Rules = Rules()) -> Column:
    """The alert text over change, volume, avg_volume5, macd_signal, rsi6, price and bands.

    Parts stand in the order of the rules, joined by "; "; null where no rule fires. Missing facts
    fire nothing.
    """
    c = F.col
    parts = F.array(
        F.when(F.abs("change") >= rules.change, F.format_string("change %.2f%%", c("change"))),
        F.when((c("avg_volume5") > 0) & (c("volume") > c("avg_volume5") * rules.volume), F.format_string("volume %d (mean %d)", c("volume"), c("avg_volume5"))),
        F.when(c("macd_signal") == "golden_cross", "macd golden cross").when(c("macd_signal") == "death_cross", "macd death cross"),
        F.when(c("rsi6") > rules.rsi_high, F.format_string("rsi high %.1f", c("rsi6"))).when(c("rsi6") < rules.rsi_low, F.format_string("rsi low %.1f", c("rsi6"))),
        F.when(c("price") >= c("boll_upper") * rules.near_upper, F.format_string("upper band (%.2f)", c("price"))),
        F.when(c("price") <= c("boll_lower") * rules.near_lower, F.format_string("lower band (%.2f)", c("price"))),
    )
    return F.nullif(F.array_join(F.array_compact(parts), "; "), F.lit(""))


def trading_time(ts: Column) -> Column:
    """Monday to Friday, 9:30-11:30 or 13:00-15:00, ends included."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (F.weekday(ts) < 5) & (minute.between(570, 690) | minute.between(780, 900))


#: Symbols that one poll looks at.
POLLED = 20


def watched(ticks: DataFrame, watchlist: DataFrame, most: int = POLLED) -> DataFrame:
    """ticks of the first most rows of watchlist(symbol, pos) by pos, whose symbol is not null."""
    first = watchlist.orderBy("pos", "symbol").limit(most).where("symbol is not null").select(F.col("symbol").alias("_s")).distinct()
    return ticks.join(F.broadcast(first), F.col("event_type") == F.col("_s"), "left_semi")  # most rows


def cycles(ticks: DataFrame, width: str = "30 minutes", watchlist: DataFrame | None = None, most: int = POLLED) -> DataFrame:
    """Polls in trading time: cycle, symbol, last price and ticks of each tumbling window; with a
    watchlist, of its first symbols only."""
    rows = ticks if watchlist is None else watched(ticks, watchlist, most)
    rows = rows.where(trading_time(F.col("ts")))
    at = F.struct("ts", "event_id")
    rows = rows.groupBy(F.window("ts", width), F.col("event_type").alias("symbol")).agg(F.max_by("value", at).alias("price"), F.count(F.lit(1)).alias("ticks"))
    return rows.select(F.col("window.start").alias("cycle"), "symbol", "price", "ticks")


def suppress(times: list[int], within: int) -> list[int]:
    """Which of the rising times stay: those more than within after the one that stayed last."""
    kept, last = [], None
    for k, t in enumerate(times):
        if last is None or t - last > within:
            kept.append(k)
            last = t
    return kept


#: Microseconds of a stretch of a key's alerts that is ordered by one task.
STRETCH = 86_400_000_000


def _successors(alerts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """alerts(symbol, message, id, _t, _n) → (edges, roots).

    roots(node): alerts that nothing precedes by limit or less; they stay whatever came before.
    edges(node, next): each alert's first one over limit later, if that is not a root. A probe at
    the end of each alert's time is sorted among the alerts of its stretch, latest first, where
    the alert passed last is the one; past a stretch's last alert it is the first of the next stretch.
    """
    key, width = ["symbol", "message"], max(STRETCH, limit)
    part = lambda t: F.floor(t / width).alias("_p")
    alert = F.struct("_t", "id", "_n")
    own = alerts.select(*key, part(F.col("_t")), F.col("_t").alias("_at"), F.lit(1).alias("_kind"), "id", F.col("_n").alias("_node"), alert.alias("_a"))
    probes = alerts.select(*key, part(F.col("_t") + limit), (F.col("_t") + limit).alias("_at"), F.lit(0).alias("_kind"), "id", F.col("_n").alias("_node"), F.lit(None).cast(own.schema["_a"].dataType).alias("_a"))
    both = own.unionByName(probes)
    # Of one time probes come before alerts, for these are not later; of alerts the smallest id is passed last.
    back = Window.partitionBy(*key, "_p").orderBy(F.desc("_at"), "_kind", F.desc("id"))
    ahead = Window.partitionBy(*key, "_p").orderBy("_at", "id")
    stretches = both.groupBy(*key, "_p").agg(F.min("_a").alias("_first"), F.max(F.when(F.col("_kind") == 1, F.col("_at"))).alias("_last"))
    by = lambda *o: Window.partitionBy(*key).orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731  a row a stretch
    stretches = stretches.select(*key, "_p", F.last("_first", True).over(by(F.desc("_p"))).alias("_then"), F.last("_last", True).over(by("_p")).alias("_before"))
    stretches = cut(stretches.select(*[F.col(c).alias(f"_k_{c}") for c in (*key, "_p")], "_then", "_before"))
    same = lambda d: [d[c].eqNullSafe(stretches[f"_k_{c}"]) for c in (*key, "_p")]

    passed = both.withColumn("_s", F.last("_a", True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_kind = 0")
    edges = passed.join(stretches, same(passed)).select("_node", F.coalesce("_s", "_then")["_n"].alias("next"))
    earlier = own.withColumn("_e", F.lag("_at").over(ahead))
    roots = earlier.join(stretches, same(earlier)).select("_node", "_at", F.coalesce("_e", "_before").alias("_e"))
    roots = cut(roots.where(F.col("_e").isNull() | (F.col("_at") - F.col("_e") > limit)).select(F.col("_node").alias("node")))
    edges = edges.where("next is not null").join(roots.withColumnRenamed("node", "next"), "next", "left_anti")
    return cut(edges.select(F.col("_node").alias("node"), "next")), roots


def dedup_alerts(alerts: DataFrame, minutes: int = 30) -> DataFrame:
    """alerts(symbol, message, ts, id) without those within minutes of a retained equal one.

    Exactly that far is still a repeat; equal rows and rows without a time are repeats of nothing
    and are left out. What stays depends on what stayed before: on the path of successors from
    the first alert, and from every one that nothing precedes closely. Paths are followed by
    pointer jumping: each round adds what the known ones reach in 1, 2, 4, .. steps and doubles the
    steps, so that rounds are the logarithm of the longest path, and no key is one task's work.
    """
    own = cut(alerts.where("ts is not null").select("symbol", "message", "ts", "id").distinct())
    own = own.select("*", F.unix_micros(F.col("ts").cast("timestamp")).alias("_t"), F.monotonically_increasing_id().alias("_n"))
    jumps, kept = _successors(own, minutes * 60_000_000)
    while True:
        found = cut(jumps.join(kept, "node").select(F.col("next").alias("node")).distinct().join(kept, "node", "left_anti"))
        if found.isEmpty():
            break
        kept = cut(kept.unionByName(found))
        jumps = cut(jumps.join(jumps.select(F.col("node").alias("next"), F.col("next").alias("then")), "next").select("node", F.col("then").alias("next")))
    return own.join(kept, F.col("_n") == F.col("node"), "left_semi").select("symbol", "message", "ts", "id")


def newest(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """A bounded history: the n last rows of each key in the given (rising) order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
