"""Mixing sources to target weights, in DataFrame operations only.

Rows get hash-random keys; each source is sorted by key in ranges of keys, so that one large
source spreads over many tasks; two levels of prefix sums (per range, then inside it) give each
document the words before it; the source's exact budget cuts there. A budget of more than one
pass takes every document once per whole pass and the rest in key order.

Null text has size 0 and is never taken. A null source is a source of its own, last in order.
Nulls and repeats among ids are keyed by their text, too; rows that repeat both share a key, but
every row is a document of its own. A source without words gets target 0. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, back, cut, prefix_sums, words

#: Rows of a range of keys, about, where one source has them all; each range is sorted on its own.
IN_RANGE = 1 << 17
#: Bits of a key, and those that tell its range, at least.
BITS, LEAST = 60, 10


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def key_of(doc_id: Column, text: Column, seed: int) -> Column:
    """BITS random bits from the id and the text, so that rows that repeat or lack an id spread, too."""
    own = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(totals: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """totals(no_source, source, source_size) with target: share of all words dealt by weight.

    Weights repeat over the sources in code point order. A target stops at most times its
    source; what is over goes to the others by weight until none is above. That is
    min(cap, level * weight) for the one level that spends the total, found by sorting the
    sources by cap / weight and running sums over them, both distributed.
    """
    ranked = prefix_sums(totals, [F.col("no_source"), F.col("source")], {"rank": "1"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    whole = ranked.agg((F.coalesce(F.sum("source_size"), F.lit(0)) * share).alias("t"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()
    steps = prefix_sums(ranked.withColumn("ratio", F.col("cap") / F.col("weight")), [F.col("ratio"), F.col("rank")], {"caps": "cap", "spent": "weight"})
    level = F.when(F.lit(whole["w"]) > F.col("spent"), (F.lit(whole["t"]) - F.col("caps")) / (F.lit(whole["w"]) - F.col("spent")))
    at = steps.withColumn("level", level).where("level <= ratio").agg(F.min_by("level", F.struct("ratio", "rank"))).first()[0]
    dealt = F.col("cap") if at is None else F.least(F.col("cap"), F.lit(float(at)) * F.col("weight"))
    return ranked.select("no_source", "source", "source_size", dealt.alias("target"))


def plan(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    slim = docs.select("doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"), size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), F.col("text"), seed).alias("key"))
    slim = cut(slim)
    bits = max(LEAST, (slim.count() // IN_RANGE).bit_length())
    slim = slim.withColumn("range", F.shiftright("key", BITS - bits))
    by = ["no_source", "source"]
    ranges = slim.groupBy(*by, "range").agg(F.sum("size").alias("in_range"))
    totals = ranges.groupBy(*by).agg(F.sum("in_range").alias("source_size"))
    dealt = targets(totals, list(weights), share, most)
    ahead = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("in_range").over(ahead), F.lit(0))).join(dealt, by)
    inside = Window.partitionBy(*by, "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = slim.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, [*by, "range"])
    budget = F.floor(F.col("target") + 0.5).cast("long")
    rows = rows.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    rest = budget - F.col("passes") * F.col("source_size") - F.col("before") - F.col("inside")
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return rows.select("doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed documents with all their columns: one row per whole pass, and the row that the
    budget cuts ends after its last word in the budget. Documents that the mix leaves out go.
    """
    dealt = cut(plan(docs, weights, share, most, seed).where("taken > 0"))
    own, names = aside(docs)
    doc, source, text = (F.col(names[c]) for c in ("doc_id", "source", "text"))
    own = own.withColumn("words", size_of(text))
    same = doc.eqNullSafe(F.col("doc_id")) & source.eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    if not dealt.groupBy("doc_id", "source", "size").count().where("count > 1").isEmpty():
        # Rows with one id, source and size may be dealt different words; which gets which is free.
        dealt = dealt.withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.desc("taken"))))
        own = own.withColumn("copy", F.row_number().over(Window.partitionBy(doc, source, "words").orderBy(text)))
        same = same & (F.col("copy") == F.col("at"))
    rows = own.join(dealt, same)
    whole, part = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    rows = rows.withColumn("cut", F.explode(F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))))
    # Each word with the white space before it, so that what is left of a text is as it was.
    spaced = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    return back(rows.withColumn(names["text"], F.when(F.col("cut") == 0, text).otherwise(F.array_join(F.slice(spaced, 1, F.col("cut")), ""))), names)
