"""Instrument codes: ``1.`` marks the first exchange (sh), ``0.`` the second (sz)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIX = r"^\d{6}$"

#: Keywords and the codes they stand for; the first that a text contains wins.
KEYWORDS = (("茅台", "1.600519"), ("宁德", "0.300750"), ("平安", "1.601318"), ("比亚迪", "0.002594"), ("五粮液", "0.000858"), ("招商银行", "1.600036"))

#: Period of a bar in minutes and the provider's code for it.
PERIODS = {240: 101, 1200: 102, 7200: 103}


def _exchange(digits: Column) -> Column:
    return F.concat(F.when(digits.startswith("6"), "1.").otherwise("0."), digits)


def normalize_code(raw: Column) -> Column:
    """Any customary spelling to ``1.600519`` form; other text trimmed and upper-cased, null to ""."""
    s = F.upper(F.trim(raw))
    return (
        F.when(raw.isNull(), "")
        .when(s.rlike(r"^SH\d{6}$"), F.concat(F.lit("1."), F.substring(s, 3, 6)))
        .when(s.rlike(r"^SZ\d{6}$"), F.concat(F.lit("0."), F.substring(s, 3, 6)))
        .when(s.rlike(r"^\d{6}\.SH$"), F.concat(F.lit("1."), F.substring(s, 1, 6)))
        .when(s.rlike(r"^\d{6}\.SZ$"), F.concat(F.lit("0."), F.substring(s, 1, 6)))
        .when(s.rlike(SIX), _exchange(s))
        .otherwise(s)
    )


def secid(raw: Column, for_null: str | None = "") -> Column:
    """A code with a dot as it is, six digits with their exchange, anything else as it is."""
    return F.when(raw.isNull(), F.lit(for_null)).when(raw.contains("."), raw).when(raw.rlike(SIX), _exchange(raw)).otherwise(raw)


def exchange_symbol(code: Column) -> Column:
    return F.concat(F.when(code.startswith("1."), "sh").otherwise("sz"), F.substr(code, F.lit(3)))


def input_to_secid(text: Column, resolved: Column) -> Column:
    """Ideographs mean a name: take the code in the resolver's answer, else the text's own code."""
    found = F.nullif(F.regexp_extract(resolved, r"(\d+\.\d+)", 1), F.lit(""))
    return F.when(text.rlike("[\\u4e00-\\u9fa5]"), found).otherwise(secid(text))


def keyword_secid(keyword: Column, rules=KEYWORDS) -> Column:
    out = F.when(keyword.rlike(r"^\d+\.\d+$"), keyword).when(keyword.rlike(SIX), _exchange(keyword))
    for part, code in rules:
        out = out.when(keyword.contains(part), code)
    return out


def period_code(minutes: Column) -> Column:
    out = F.lit(101)
    for n, code in PERIODS.items():
        out = F.when(minutes == n, code).otherwise(out)
    return out
