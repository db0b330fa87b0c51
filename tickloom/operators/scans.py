"""Recurrences over long series, as affine maps that are composed block by block.

A recurrence whose state is an affine map of the state before (exponential and Wilder averages,
smoothings of smoothings) gives an affine map for any stretch of rows. Stretches of BLOCK rows are
folded from a zero state, each on its own; blocks are put together BLOCK at a time, and so on, so that
no array holds more than BLOCK cells, and a series of BLOCK ** LEVELS rows is one of its length in
several groups, not one task's array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, LEVELS = 1024, 3


def last_state(rows: DataFrame, zero: Column, step: Callable[[Column, Column], Column], shift: Callable[[Column, Column], Column], start: Column | None = None, starts: DataFrame | None = None, key: str = "symbol", at: str = "at", block: int = BLOCK) -> DataFrame:
    """(key, state) after all rows of each key, in the order of at, which counts from 0.

    zero: a struct, the state that nothing has been added to, with its number of steps. step(state,
    row) takes one row. shift(state, stretch) is the state after a stretch that was folded from zero.
    start is the state before the first row: of all keys, or the column ``start`` of starts(key, start).
    Keys without rows are not there, unless starts has them.
    """
    cells = F.array_sort(F.collect_list(F.struct(at, *[c for c in rows.columns if c not in (key, at)])))
    own = rows.groupBy(key, F.floor(F.col(at) / block).alias("_b")).agg(cells.alias("_c")).select(key, "_b", F.aggregate("_c", zero, step).alias("_m"))
    for _ in range(LEVELS - 2):
        cells = F.array_sort(F.collect_list(F.struct("_b", "_m")))
        own = own.groupBy(key, F.floor(F.col("_b") / block).alias("_up")).agg(cells.alias("_c"))
        own = own.select(key, F.col("_up").alias("_b"), F.aggregate("_c", zero, lambda s, c: shift(s, c["_m"])).alias("_m"))
    own = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_b", "_m"))).alias("_c"))
    if starts is not None:
        own, start = starts.select(key, "start").join(own, key, "left"), F.col("start")
    none = F.array().cast(dict(own.dtypes)["_c"])
    return own.select(key, F.aggregate(F.coalesce("_c", none), start, lambda s, c: shift(s, c["_m"])).alias("state"))


def steps(factor: float, n: Column) -> Column:
    """factor to the power n: what n steps leave of a state."""
    return F.pow(F.lit(factor), n)


def carried(factor: float, into: float, weight: float, n: Column) -> Column:
    """What n steps carry of a state that decays by factor into one that decays by into and takes weight
    of the first after each step: weight times the sum over j of into ** (n - j) * factor ** j."""
    if factor == into:
        return weight * n * steps(factor, n)
    return weight * factor * (steps(factor, n) - steps(into, n)) / (factor - into)
