"""Reader-facing wording of signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wordings of signal codes.
MACD = {"golden_cross": "金叉（买入信号）", "death_cross": "死叉（卖出信号）"}
TREND = {"bullish": "多头排列（看涨）", "bearish": "空头排列（看跌）"}
MOMENTUM = {
    "overbought": "超买（震荡/弱趋势，回调风险较高）",
    "overbought_trend_up": "超买（多头趋势延续中，KDJ可能高位钝化，仅为预警）",
    "oversold": "超卖（可能反弹）",
    "oversold_trend_down": "超卖（空头延续中，可能继续下探，需等明确止跌信号）",
}


def worded(code: Column, words: dict[str, str], other: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, code), F.lit(other))


def macd(code: Column) -> Column:
    return worded(code, MACD, "无明确信号")


def trend(code: Column) -> Column:
    return worded(code, TREND, "震荡（中性）")


def momentum(code: Column) -> Column:
    return worded(code, MOMENTUM, "中性")


def rsi(value: Column) -> Column:
    return F.when(value.isNull(), "无数据").when(value > 70, "超买区").when(value < 30, "超卖区").otherwise("正常区间")
