"""Pairings of tables: fallback sources, upserts, reports, name resolution and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.search import contained


def fallback(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Rows of primary, and of secondary where primary has no row of the key."""
    return primary.unionByName(secondary.join(primary.select(key).distinct(), key, "left_anti"))


def upsert(table: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """table with incoming rows instead of those of the same key; of incoming ones the last wins."""
    w = Window.partitionBy(key).orderBy(*[o for o in order])
    last = incoming.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return last.unionByName(table.join(last.select(key), key, "left_anti"))


def insert_new(table: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Incoming rows whose key the table lacks, the first of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    first = incoming.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.join(table.select(key), key, "left_anti")


def sync(table: DataFrame, desired: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to write, obsolete rows to delete) that turn table into desired."""
    return desired, table.join(desired.select(key), key, "left_anti")


def names_in_texts(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """texts(id, text) with the name and code of each registry name that text contains, also inside
    a word. Names without a character are in no text."""
    hits = contained(texts, registry.select(F.col("name").alias("needle")))
    return hits.withColumnRenamed("needle", "name").join(registry.select("name", "code"), "name").select("id", "name", "code")


def resolve(names: DataFrame, registry: DataFrame, fallback_registry: DataFrame) -> DataFrame:
    """names(name) with code: an equal registry name, else one that contains it or is contained
    (the first by name), else the same in the second registry; null if none."""
    own = names.select("name").distinct()

    def within(other: DataFrame, step: int) -> DataFrame:
        known = other.select(F.col("name").alias("r_name"), "code").where("r_name is not null")
        inside = contained(own.select(F.col("name").alias("id"), F.col("name").alias("text")), known.select(F.col("r_name").alias("needle")))
        around = contained(known.select(F.col("r_name").alias("id"), F.col("r_name").alias("text")), own.select(F.col("name").alias("needle")))
        pairs = inside.select(F.col("id").alias("name"), F.col("needle").alias("r_name")).union(around.select("needle", "id")).distinct()
        loose = (F.col("name") != F.col("r_name")).cast("int")
        return pairs.join(known, "r_name").select("name", F.struct(F.lit(step).alias("step"), loose.alias("loose"), F.col("r_name"), F.col("code")).alias("hit"))

    hits = within(registry, 1).unionByName(within(fallback_registry, 2))
    best = hits.groupBy("name").agg(F.min("hit").alias("hit"))
    return own.join(best, "name", "left").select("name", F.col("hit.code").alias("code"), F.col("hit.r_name").alias("matched"))


def report(quotes: DataFrame, news: DataFrame, threshold: float = 3.0, headlines: int = 3) -> DataFrame:
    """quotes(code, name, price, change) with an alert flag and the first headlines, if any.

    news(code, title, pos). A code without news keeps its row.
    """
    w = Window.partitionBy("code").orderBy("pos", "title")
    few = news.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= headlines)
    few = few.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("_n", "title"))).alias("_t")).select("code", F.array_join(F.col("_t.title"), " | ").alias("headlines"))
    return quotes.join(few, "code", "left").withColumn("alert", F.coalesce(F.abs("change") > threshold, F.lit(False)))


def evidence(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """claims(claim_id, ref_no, fragment) with chunk_id: hits(chunk_id, rank, content) of that
    rank, else the best ranked that contains the fragment; null if none or the fragment is blank."""
    direct = claims.join(hits.select(F.col("rank").alias("ref_no"), F.col("chunk_id").alias("direct")), "ref_no", "left")
    fragment = F.trim("fragment")
    open_ = direct.where(F.col("direct").isNull() & (fragment != "")).select("claim_id", fragment.alias("needle"))
    found = contained(hits.select(F.col("chunk_id").alias("id"), F.col("content").alias("text")), open_)
    ranked = found.join(hits.select(F.col("chunk_id").alias("id"), "rank"), "id").groupBy("needle").agg(F.min_by("id", F.struct("rank", "id")).alias("by_text"))
    by_text = open_.join(ranked, "needle").select("claim_id", "by_text")
    return direct.join(by_text, "claim_id", "left").select("claim_id", F.coalesce("direct", "by_text").alias("chunk_id"))


def suggestions(outputs: DataFrame) -> DataFrame:
    """id, no, block, basis, evidence, ref_id: numbered blocks of a text and their fields."""
    # How the output that is read here names its parts.
    head = "建议\\s*\\d+\\s*[:：]"
    blocks = F.regexp_extract_all("text", F.lit(f"(?ms)({head}.*?)(?=(?:\\n\\s*{head})|\\z)"), 1)
    rows = outputs.select("id", F.posexplode(blocks).alias("pos", "block"))
    field = lambda name: F.trim(F.regexp_extract("block", f"【{name}】\\s*(.+?)(?=\\n|$)", 1))
    return rows.select("id", (F.col("pos") + 1).alias("no"), F.trim("block").alias("block"), field("规范依据").alias("basis"), field("原文片段").alias("evidence"), field("引用ID").alias("ref_id"))
