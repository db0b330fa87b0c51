"""OHLCV bars from ticks, and their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ohlcv(ticks: DataFrame, symbol: str = "event_type", ts: str = "ts", price: str = "value", tick_id: str = "event_id", width: str = "1 hour") -> DataFrame:
    """symbol, ts (start of the bar), open, high, low, close, volume (number of ticks).

    One shuffle: every aggregate has a partial form, so that a busy symbol is reduced on the
    map side to a row for each bar and task.
    """
    at = F.struct(F.col(ts), F.col(tick_id))
    return (
        ticks.groupBy(F.col(symbol).alias("symbol"), F.window(ts, width).start.alias("_start"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(F.lit(1)).alias("volume"))
        .withColumnRenamed("_start", "ts")
        .select("symbol", "ts", "open", "high", "low", "close", "volume")
    )


def numbered(bars: DataFrame) -> DataFrame:
    """bars with bar_idx, from 0 in time order for each symbol; bars without ticks do not exist."""
    return bars.withColumn("bar_idx", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)


def last_n(rows: DataFrame, n: int, key: str = "symbol", order: str = "ts") -> DataFrame:
    """The n latest rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
