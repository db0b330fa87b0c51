"""Named analytics for callers: quotes, indicators, statements, news, codes and ingest.

What a dialogue system offers a model as tools, as DataFrame functions over many instruments at
once. The language model itself, embeddings and reranking are columns or functions that the
caller brings; the defaults are rules.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import labels
from tickloom.functions.codes import normalize_code
from tickloom.functions.text import clean, clean_lines, token_count
from tickloom.operators import indicators as I
from tickloom.operators import ops, relational, retrieval, text_prep
from tickloom.sources import files, market, pages, sinks

#: Bars that the indicator tool asks for; it needs as many.
INDICATOR_BARS = 60
#: Hours that retrieved context lives, by kind, and at most.
CONTEXT_HOURS = {"STOCK_QUOTE": 1, "STOCK_KLINE": 1, "LLM_ANALYSIS": 1, "STOCK_NEWS": 24, "FINANCIAL": 72}
CONTEXT_MOST = 72


def get_quotes(responses: DataFrame) -> DataFrame:
    """responses(code, response) decoded from either provider's form."""
    both = responses.select("code", market.quoted_csv_quote(F.col("response")).alias("a"), market.json_quote(F.col("response")).alias("b"))
    first = lambda k: F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k)
    return both.select("code", *[first(k) for k in ("name", "price", "open", "high", "low", "change", "volume")])


def get_indicators(bars: DataFrame, min_bars: int = INDICATOR_BARS) -> DataFrame:
    """Indicators of each symbol's last bar with their wording; none below min_bars bars."""
    ma = I.moving_average(bars).groupBy("symbol").agg(F.max_by("ma5", "bar_idx").alias("ma5"), F.max_by("ma10", "bar_idx").alias("ma10"))
    rows = I.latest(bars, min_bars).where(F.col("bars") >= min_bars).join(ma, "symbol").withColumn("trend", I.trend_of(F.col("ma5"), F.col("ma10")))
    rows = rows.withColumn("momentum", I.momentum_of(F.col("rsi6"), F.col("kdj_k"), F.col("trend")))
    return rows.select("*", labels.macd(F.col("macd_signal")).alias("macd_text"), labels.rsi(F.col("rsi6")).alias("rsi_text"), labels.trend(F.col("trend")).alias("trend_text"), labels.momentum(F.col("momentum")).alias("momentum_text"))


def get_financials(responses: DataFrame) -> DataFrame:
    return responses.select("code", market.statement(F.col("response")).alias("s")).where("s is not null").select("code", "s.*")


def get_news(fetched_pages: DataFrame, most: int = 5) -> DataFrame:
    return pages.links(fetched_pages, ("sina.com", "finance"), most=most)


def resolve_codes(names: DataFrame, registry: DataFrame, watchlist: DataFrame) -> DataFrame:
    return relational.resolve(names, registry, watchlist)


def rule_extractor(text: DataFrame, registry: DataFrame) -> DataFrame:
    """text(id, text) with the instrument it names: the longest registry name, then the first."""
    hits = relational.names_in_texts(text, registry)
    return hits.groupBy("id").agg(F.max_by(F.struct("name", "code"), F.struct(F.length("name"), "name")).alias("t")).select("id", "t.name", "t.code")


#: Seconds that what was extracted from a question is used again.
EXTRACTED_SECONDS = 1800


def extract(questions: DataFrame, registry: DataFrame, extractor: Callable[[str], tuple[str, str] | None] | None = None, seconds: int = EXTRACTED_SECONDS) -> DataFrame:
    """id, name, code, asked of questions(id, ts, text): the instrument each question names.

    extractor(text) gives (name, code), either of them empty, as a language model might. It is
    asked once for equal texts while its last answer is no older than seconds; asked tells for
    which rows. A name without a code is looked up in registry(name, code), and where the
    extractor raises, or there is none, the registry's names are sought in the text.
    """
    text = F.trim("text")
    filled = questions.where(text != "").select("id", "ts", text.alias("text"))
    by_rule = rule_extractor(filled.select("text").distinct().select(F.col("text").alias("id"), "text"), registry).select(F.col("id").alias("text"), F.col("name").alias("r_name"), F.col("code").alias("r_code"))
    hits = ops.cache_replay(filled.select(F.col("text").alias("key"), "ts", "id"), F.lit(seconds))
    rows = filled.join(hits.select("id", "hit"), "id")
    if extractor is None:
        found = rows.join(by_rule, "text", "left").select("id", F.col("r_name").alias("name"), F.col("r_code").alias("code"), (~F.col("hit")).alias("asked"))
    else:
        @F.pandas_udf("struct<name: string, code: string, failed: boolean>")
        def call(texts: pd.Series) -> pd.DataFrame:
            out = []
            for t in texts:
                try:
                    name, code = extractor(t) or ("", "")
                    out.append((name or "", code or "", False))
                except Exception:  # whatever the extractor raises, the rule answers
                    out.append(("", "", True))
            return pd.DataFrame(out, columns=["name", "code", "failed"])

        answers = rows.where("not hit").select("id", "text", "ts", call("text").alias("a"))
        known = registry.groupBy(F.col("name").alias("k_name")).agg(F.min("code").alias("k_code"))
        answers = answers.join(known, F.col("a.name") == F.col("k_name"), "left").join(by_rule, "text", "left")
        code = F.when(F.col("a.failed"), F.col("r_code")).otherwise(F.coalesce(F.nullif(normalize_code(F.col("a.code")), F.lit("")), F.when(F.col("a.name") != "", F.col("k_code"))))
        name = F.when(F.col("a.failed"), F.col("r_name")).otherwise(F.nullif(F.col("a.name"), F.lit("")))
        answers = answers.select(F.col("id").alias("_id"), name.alias("name"), code.alias("code"))
        # A hit takes the answer of the last row of its text that was asked for.
        last = Window.partitionBy("text").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
        source = rows.withColumn("_from", F.last(F.when(~F.col("hit"), F.col("id")), ignorenulls=True).over(last))
        found = source.join(answers, F.col("_from") == F.col("_id"), "left").select("id", "name", "code", (~F.col("hit")).alias("asked"))
    blank = questions.where(F.coalesce(text == "", F.lit(True))).select("id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("code"), F.lit(False).alias("asked"))
    return found.unionByName(blank)


def context_hours(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, h in CONTEXT_HOURS.items():
        out = F.when(kind == k, min(h, CONTEXT_MOST)).otherwise(out)
    return out


def context_cache(requests: DataFrame) -> DataFrame:
    """id, hit of requests(session, kind, ts, id): a session's cache of retrieved context, each kind
    with its own hours; a kind that is not kept always misses."""
    hours = context_hours(F.col("kind"))
    kept = requests.where(hours.isNotNull()).select(F.concat_ws("/", "session", "kind").alias("key"), "ts", "id", "kind")
    hits = ops.cache_replay(kept, hours * 3600).select("id", "hit")
    return hits.unionByName(requests.where(hours.isNull()).select("id", F.lit(False).alias("hit")))


#: Fixed value: days of bars that a caller may ask for.
MOST_DAYS = 120


def kline_days(n: Column) -> Column:
    return F.least(F.lit(MOST_DAYS), n)


def rounds(n: Column) -> Column:
    return F.least(F.lit(200), F.greatest(F.lit(1), n))


def ingest(docs: DataFrame, size: int = 400, overlap: float = 0.20) -> tuple[DataFrame, DataFrame]:
    """(chunks, refused) of docs(doc_id, text): cleaned and cut; blank ones are refused."""
    cleaned = docs.select("doc_id", clean(F.col("text")).alias("text"))
    chunks = text_prep.chunk_documents(cleaned.where("text <> ''"), size, overlap)
    return chunks, cleaned.where("text = ''").select("doc_id", token_count(F.col("text")).alias("tokens"))


#: Files up to which every task gets their ids.
FILES = 100_000


def ingest_files(spark: SparkSession, path: str, folder: str, embed: Callable[[list[str]], list[list[float]]], source: str = "", size: int = 400, overlap: float = 0.20) -> DataFrame:
    """Read documents, cut them, embed the chunks, add both to what folder holds, and return the manifest.

    folder gets chunks with their vectors, a text index, and the manifest: doc_id, name, bytes,
    format, chunks, path, source, status. A doc_id is 128 bits of its path's hash. A file of another format, and one without text, is
    refused, which its status says, and leaves nothing else behind.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    own_id = F.substring(F.sha2("path", 256), 1, 32).alias("doc_id")
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.element_at(F.split(name, "\\."), -1))
    rows = raw.load(path).select(own_id, "path", name.alias("name"), F.col("length").alias("bytes"), kind.alias("format"))
    # Lines of txt files are cleaned where they are read and meet in order; no file of this kind is held.
    read = files.lines(spark, path).select(own_id, "part", "k", F.posexplode(F.split(clean_lines(F.regexp_replace("line", "\\r\\z", "")), "\n")).alias("sub", "line"))
    packed = raw.option("pathGlobFilter", files.PACKED).load(path)
    texts = packed.select(own_id, clean(files.texts("path", "content")).alias("text")).where("text <> ''")
    chunks = text_prep.chunk_lines(read, ("part", "k", "sub"), size, overlap).unionByName(text_prep.chunk_documents(texts, size, overlap))
    chunks = retrieval.embedded(chunks, embed)
    sinks.append(chunks.withColumn("source", F.lit(source)), f"{folder}/chunks")
    # Ids of files that every task can hold go to the chunks, so that no text is shuffled to find them.
    near = F.broadcast if rows.count() <= FILES else lambda d: d
    stored = spark.read.parquet(f"{folder}/chunks").join(near(rows.select("doc_id")), "doc_id", "left_semi")
    sinks.write_index(stored.select("chunk_id", "content"), f"{folder}/index", add=True)
    counts = stored.groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("chunks"))
    status = F.when(~F.col("format").isin(*files.SUPPORTED), "unsupported").when(F.col("chunks").isNull(), "empty").otherwise("ok")
    manifest = rows.join(counts, "doc_id", "left").select("doc_id", "name", "bytes", "format", F.coalesce("chunks", F.lit(0)).alias("chunks"), "path", F.lit(source).alias("source"), status.alias("status"))
    sinks.append(manifest, f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest").join(rows.select("doc_id"), "doc_id", "left_semi")
