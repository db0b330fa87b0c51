"""Decoders of market-data responses: quotes, bars, statements, sectors. Fetching is elsewhere."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import half_up


class Fetcher(Protocol):
    """How responses are obtained; only local stand-ins are built in."""

    def get(self, url: str) -> str | None: ...


class FileFetcher:
    """Responses kept in a mapping of urls, for tests and replays."""

    def __init__(self, responses: dict[str, str]):
        self.responses = responses

    def get(self, url: str) -> str | None:
        return self.responses.get(url) or None


def _num(text: Column) -> Column:
    """A double; "-", "--" and anything else that is no number give null."""
    return F.trim(text).try_cast("double")


def quoted_csv_quote(response: Column) -> Column:
    """Struct of a comma-separated quote between outer quotes; null with fewer than 10 fields."""
    f = F.split(F.regexp_extract(response, '(?s)"(.*)"', 1), ",")
    now, before = _num(f[3]), _num(f[2])
    volume = F.floor(_num(F.get(f, F.lit(8))) / 100).cast("long")
    out = F.struct(f[0].alias("name"), half_up(now).alias("price"), half_up(_num(F.get(f, F.lit(1)))).alias("open"), half_up(_num(F.get(f, F.lit(4)))).alias("high"), half_up(_num(F.get(f, F.lit(5)))).alias("low"), F.when(before != 0, half_up((now - before) / before * 100)).alias("change"), volume.alias("volume"))
    return F.when(F.size(f) >= 10, out)


def json_quote(response: Column) -> Column:
    """Struct of a JSON quote with numbered fields; null unless data is an object."""
    data = F.get_json_object(response, "$.data")
    field = lambda k: F.get_json_object(data, f"$.f{k}")
    v = lambda k: _num(field(k))
    out = F.struct(field(57).alias("code"), field(58).alias("name"), half_up(v(43)).alias("price"), half_up(v(46)).alias("open"), half_up(v(44)).alias("high"), half_up(v(45)).alias("low"), half_up(v(170)).alias("change"), v(47).cast("long").alias("volume"), v(48).alias("turnover"), v(116).alias("market_cap"), v(162).alias("pe"))
    return F.when(data.startswith("{"), out)


def csv_bars(responses: DataFrame, symbol: str = "symbol", response: str = "response") -> DataFrame:
    """symbol, bar_idx, date, open, close, high, low, volume from bars as text in JSON.

    Items with fewer than six fields or without a price are dropped; lots become shares (x 100),
    a missing volume 0; malformed responses give no rows.
    """
    items = F.from_json(F.get_json_object(response, "$.data.klines"), "array<string>")
    rows = responses.select(symbol, F.posexplode(items).alias("bar_idx", "_item")).withColumn("_f", F.split(F.trim("_item"), ","))
    f = lambda k: _num(F.get("_f", F.lit(k)))
    out = rows.where(F.size("_f") >= 6).select(symbol, "bar_idx", F.col("_f")[0].alias("date"), f(1).alias("open"), f(2).alias("close"), f(3).alias("high"), f(4).alias("low"), F.coalesce(f(5) * 100, F.lit(0.0)).cast("long").alias("volume"))
    return out.where("open is not null and close is not null and high is not null and low is not null")


def json_bars(responses: DataFrame, symbol: str = "symbol", response: str = "response") -> DataFrame:
    """The same from a JSON array of objects, whose missing numbers count as 0."""
    items = F.from_json(F.col(response), "array<struct<day: string, open: string, close: string, high: string, low: string, volume: string>>")
    rows = responses.select(symbol, F.posexplode(items).alias("bar_idx", "b"))
    zero = lambda k: F.coalesce(_num(F.col(f"b.{k}")), F.lit(0.0)).alias(k)
    return rows.select(symbol, "bar_idx", F.col("b.day").alias("date"), *[zero(k) for k in ("open", "close", "high", "low")], F.coalesce(_num(F.col("b.volume")), F.lit(0.0)).cast("long").alias("volume"))


def statement(response: Column) -> Column:
    """Struct of the latest row of a financial response; missing numbers are 0."""
    row = F.get(F.from_json(F.get_json_object(response, "$.result.data"), "array<map<string, string>>"), F.lit(0))
    v = lambda k: F.coalesce(_num(row[k]), F.lit(0.0)).alias(k)
    return F.when(row.isNotNull(), F.struct(row["year"].alias("year"), *[v(k) for k in ("revenue", "profit", "gross_margin", "net_margin", "roe", "debt_ratio")]))


def sectors(responses: DataFrame, page: int = 1, size: int = 20, response: str = "response") -> DataFrame:
    """code, name, price, change of one page of a sector list."""
    items = F.from_json(F.get_json_object(response, "$.data.diff"), "array<struct<f12: string, f14: string, f2: string, f3: string>>")
    rows = responses.select(F.posexplode(items).alias("pos", "s")).where(F.col("pos").between((page - 1) * size, page * size - 1))
    return rows.select("pos", F.col("s.f12").alias("code"), F.col("s.f14").alias("name"), _num(F.col("s.f2")).alias("price"), _num(F.col("s.f3")).alias("change"))
