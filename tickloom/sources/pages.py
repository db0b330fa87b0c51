"""Links and tables out of fetched HTML; rendering in a browser is left to whoever fetches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KIND = "array<struct<href: string, text: string>>"


def links(pages: DataFrame, needles: tuple[str, ...], shortest: int = 6, most: int = 5) -> DataFrame:
    """page_id, pos, title, url: the first ``most`` links of each page, in document order, whose
    trimmed text has ``shortest`` characters and whose absolute url contains one of the needles.

    Column expressions only: tags inside a link are taken out, common entities resolved.
    """
    href = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*\"([^\"]*)\"[^>]*>.*?</a>"), 1)
    body = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*\"[^\"]*\"[^>]*>(.*?)</a>"), 1)
    rows = pages.select("page_id", "url", F.posexplode(F.arrays_zip(href.alias("href"), body.alias("body"))).alias("pos", "l"))
    text = F.regexp_replace("l.body", "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.btrim(F.regexp_replace(text, r"\s+", " "))
    own = F.replace(F.col("l.href"), F.lit("&amp;"), F.lit("&"))
    root = F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]*)", 1)
    url = F.when(own.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), own).when(own.startswith("/"), F.concat(root, own)).when(own == "", F.lit("")).otherwise(F.concat(root, F.lit("/"), own))
    rows = rows.select("page_id", "pos", text.alias("title"), url.alias("url"))
    fits = F.lit(False)
    for n in needles:
        fits = fits | F.col("url").contains(n)
    rows = rows.where((F.length("title") >= shortest) & (F.col("url") != "") & fits)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("page_id", "rank", "title", "url")


class _Tables(HTMLParser):
    """All tables of a page as lists of rows of cell texts."""

    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append("".join(self.cell).strip())
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def amount(text: str) -> float:
    """Digits of a cell in units of ten thousand; 0 if there are none."""
    digits = re.sub(r"[^0-9.\-]", "", text or "")
    try:
        return float(digits) * 10_000
    except ValueError:
        return 0.0


def financial_table(html: str | None) -> tuple[float, float] | None:
    """(revenue, profit): second cells of the first two rows of the first table with revenue above 0."""
    parser = _Tables()
    parser.feed(html or "")
    for rows in parser.tables:
        if len(rows) >= 2 and len(rows[0]) > 1 and amount(rows[0][1]) > 0:
            return amount(rows[0][1]), amount(rows[1][1]) if len(rows[1]) > 1 else 0.0
    return None


def financials(pages: DataFrame) -> DataFrame:
    """page_id, revenue, profit of pages that have such a table."""

    @F.pandas_udf("struct<revenue: double, profit: double>")
    def read(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([financial_table(x) or (None, None) for x in html], columns=["revenue", "profit"])

    rows = pages.where(F.col("html").contains("<table")).select("page_id", read("html").alias("f"))
    return rows.select("page_id", "f.revenue", "f.profit").where("revenue is not null")
