"""Exact dedup: 128-bit content hashes find groups, bytes confirm them, the smallest id stays.

Null text counts as empty. Each run of ASCII white space counts as one space. Rows without a
doc_id never stand before rows with one; a group of nothing but such rows keeps one of them.
Rows that repeat the id of the row that stays go too, so that exactly one row of a group stays.
An empty table gives an empty result. Columns other than doc_id and text are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, SMALL, aside, back, cut, join_groups

#: Parts that the texts of one hash are dealt to before they are compared, where they are shuffled.
DEALT = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _hashed(docs: DataFrame) -> DataFrame:
    text = docs.select("doc_id", normalised(F.col("text")).alias("_t"))
    return text.withColumn("h", F.md5(F.col("_t").cast("binary")))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h", "_t").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


def _copies(text: DataFrame, copied: DataFrame, small: int) -> DataFrame:
    """(h, _t, n, first): the different texts of each copied hash, compared byte by byte.

    While there are few copied hashes they are sent to every task: the copies are found where they
    lie and each task collapses its own before they move. Beyond that, copied texts move once, by
    hash and one of DEALT parts, so that a large group is collapsed in many tasks.
    """
    if copied.count() <= small:
        return _counted(text.join(F.broadcast(copied), "h", "left_semi"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(DEALT)).alias("part")
    parts = copied.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))).alias("part"))
    some = text.select("*", part).join(parts, ["h", "part"], "left_semi")
    some = some.groupBy("h", "part", "_t").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return some.groupBy("h", "_t").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def classes(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, h (the 128-bit hash).

    Hashes and ids of all documents are written once; texts move only where documents share a
    hash (see ``_copies``). Should one hash turn out to hold several texts, its documents are told
    apart by their text instead. Documents meet their group by ``join_groups``: a hot one is sent
    to them.
    """
    text = _hashed(docs)
    slim = cut(text.select("doc_id", "h", F.sha2(F.col("_t").cast("binary"), 256).alias("text_sha256")))
    groups = cut(slim.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")))
    texts = _copies(text, groups.where("n > 1").select("h"), small)
    mixed = cut(texts.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h"))
    if mixed.isEmpty():
        out = join_groups(slim, groups, "h", "n")
    else:
        # Equal bytes, not equal hashes, make a class.
        out = join_groups(slim.join(mixed, "h", "left_anti"), groups.join(mixed, "h", "left_anti"), "h", "n")
        told = text.join(mixed, "h", "left_semi")
        told = told.withColumn("text_sha256", F.sha2(F.col("_t").cast("binary"), 256)).join(_counted(told), ["h", "_t"])
        out = out.unionByName(told.select(*out.columns))
    return out.select("doc_id", F.col("first").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("first")).alias("kept"), "text_sha256", "h")


def dedup(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """The documents without later copies, with all their columns.

    What goes is told by (doc_id, hash): sent to every task while short, so that texts stay where
    they are, else joined by a shuffle.
    """
    told = cut(classes(docs, small).select("doc_id", "h", "kept"))
    own, names = aside(docs)
    own = own.withColumn("hash", F.md5(normalised(F.col(names["text"])).cast("binary")))
    same = F.col(names["doc_id"]).eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("h"))
    by_id = told.groupBy("doc_id", "h").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
    gone = cut(by_id.where("not kept").select("doc_id", "h"))
    many = cut(by_id.where("kept and copies > 1").select("doc_id", "h"))
    rows = own.join(F.broadcast(gone) if gone.count() <= small else gone, same, "left_anti")
    if many.isEmpty():
        return back(rows, names)
    # Of rows that repeat the id and text of the row that stays, one.
    once = rows.join(many, same, "left_anti")
    again = rows.join(many, same, "left_semi").withColumn("t", normalised(F.col(names["text"])))
    return back(once, names).unionByName(back(again.dropDuplicates([names["doc_id"], "t"]), names))
