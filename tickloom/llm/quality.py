"""Quality rules over documents and over the lines of whole hosts, in DataFrame operations only.

A document's host is its source. Lines are normalised (white space collapsed and trimmed, all
lower case) and hashed; for each host and line, documents with different texts are counted, so
that exact copies, which dedup removes later, do not condemn their own lines. Lines in more
documents than the host's limit are removed; a document that loses more than ``depleted`` of its
words to this is rejected, and so is one that fails the base rules.

Null text has no words and fails the base rules. A null source is a host of its own. Rows that
repeat a document count once. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, SMALL, aside, back, cut, let, words

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    repeat_percent: int = 50
    #: A line may be in this share of a host's documents, and in so many of them anyhow: a few, that
    #: hosts of a handful of pages are not judged by chance.
    line_docs: int = 5
    line_share: float = 0.02
    depleted: float = 0.5


def _line(raw: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(raw, BLANKS, " ")))


def repeated(w: Column) -> Column:
    """Number of words of w in three-word windows that w has twice or more.

    Windows are hashed and sorted with their places; equal neighbours are the repeated ones.
    """
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def places(s: Column) -> Column:
        twice = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
        return F.transform(F.filter(s, lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"])

    def covered(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        words = let(let(F.sort_array(placed), places), lambda p: F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2))))
        return F.when(F.size(F.array_distinct(h)) == n - 2, 0).otherwise(F.size(words))  # most texts repeat none

    return F.when(n < 3, 0).otherwise(let(hashes, covered))


def base(text: Column, limits: Limits = Limits()) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(text, F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")

    def facts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated(w).cast("long").alias("n_repeat_words"),
        )

    def judged(b: Column) -> Column:
        failed = (b["n_words"] < limits.min_words) | (100 * b["n_repeat_words"] > limits.repeat_percent * b["n_words"])
        return F.struct(*[b[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"))

    return let(let(words(text), facts), judged)


def frequent_lines(docs: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """(one row per document and line that is not blank; lines above their host's limit)."""
    host = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", host.alias("host"), F.xxhash64(text).alias("doc"), text.alias("_t"))
    lines = rows.select("doc_id", "host", "doc", F.posexplode(F.transform(F.split("_t", "\n"), _line)).alias("at", "_l")).where("_l <> ''")
    lines = lines.select("doc_id", "host", "doc", "at", F.xxhash64("_l").alias("line"), F.size(F.split("_l", " ")).alias("words"))
    many = lines.groupBy("host", "line").agg(F.countDistinct("doc").alias("docs"))
    hosts = rows.groupBy("host").agg(F.countDistinct("doc").alias("all_docs"))
    # Only lines above the floor, a small part, meet the hosts' sizes.
    over = many.where(F.col("docs") > limits.line_docs).join(hosts, "host").where(F.col("docs") > F.col("all_docs") * F.lit(limits.line_share))
    return lines, cut(over.select("host", "line", "docs"))


FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _bad(text: Column, listed: Column) -> Column:
    """Structs (at, words) of the lines of text whose hash is in listed; null if listed is."""
    found = F.transform(F.split(text, "\n"), lambda raw, k: let(_line(raw), lambda x: F.struct(k.alias("at"), F.size(F.split(x, " ")).alias("words"), F.xxhash64(x).alias("line"))))
    return F.when(listed.isNotNull(), F.filter(found, lambda x: F.array_contains(listed, x["line"])))


def _facts(text: Column, bad: Column, limits: Limits) -> Column:
    """Struct of the base facts, n_removed, rule, and bad; to be evaluated once per row."""

    def judged(b: Column, x: Column) -> Column:
        lost = F.coalesce(F.aggregate(x, F.lit(0), lambda a, e: a + e["words"]), F.lit(0)).cast("long")
        depleted = lost > b["n_words"] * F.lit(limits.depleted)
        rule = F.when(b["base_failed"], "base").when(depleted, "depleted")
        return F.struct(*[b[k].alias(k) for k in FACTS], lost.alias("n_removed"), rule.alias("rule"), x.alias("bad"))

    return let(base(text, limits), lambda b: let(bad, lambda x: judged(b, x)))


def _judged(docs: DataFrame, limits: Limits, small: int) -> tuple[DataFrame, dict[str, str], Column]:
    """(docs with new names, these names, the struct of ``_facts``).

    For the counts only hashes of lines are shuffled. A host has few lines above a share of its
    documents (the lines of a document over the share, at most), so their table is small unless
    there are very many hosts: up to ``small`` lines by count they are sent to every task, a list
    a host, and texts stay where they are. Beyond that, documents with such lines are found by a
    join of line hashes and meet their documents by id, host and text hash; both ways agree.
    """
    lines, over = frequent_lines(docs, limits)
    own, names = aside(docs)
    text, source = F.col(names["text"]), F.col(names["source"])
    rows = own.withColumn("on", F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    if over.count() <= small:
        listed = over.groupBy("host").agg(F.collect_list("line").alias("listed"))
        rows = rows.join(F.broadcast(listed), F.col("on") == F.col("host"), "left")
        return rows, names, _facts(text, _bad(text, F.col("listed")), limits)
    hit = lines.join(over.drop("docs"), ["host", "line"]).groupBy("doc_id", "host", "doc").agg(F.collect_set(F.struct("at", "words")).alias("bad"))
    rows = rows.withColumn("key", F.xxhash64(F.coalesce(text, F.lit(""))))
    rows = rows.join(hit, F.col(names["doc_id"]).eqNullSafe(F.col("doc_id")) & (F.col("on") == F.col("host")) & (F.col("key") == F.col("doc")), "left")
    return rows, names, _facts(text, F.col("bad"), limits)


def judge(docs: DataFrame, limits: Limits = Limits(), small: int = SMALL) -> DataFrame:
    """docs with the base facts, n_removed (words in removed lines), rule and kept, which take the
    place of columns of these names."""
    rows, names, facts = _judged(docs, limits, small)
    new = [*FACTS, "n_removed", "rule"]
    own = {c: n for c, n in names.items() if c not in {*new, "kept"}}
    # A generator's input is computed once per row; a projection may be merged into each use of it.
    rows = rows.select(*own.values(), F.inline(F.array(facts)))
    return rows.select(*[F.col(n).alias(c) for c, n in own.items()], *new, F.col("rule").isNull().alias("kept"))


def clean(docs: DataFrame, limits: Limits = Limits(), small: int = SMALL) -> DataFrame:
    """The documents that pass, without lines above the limit, with their own columns."""
    rows, names, facts = _judged(docs, limits, small)
    text = F.col(names["text"])

    def left(f: Column) -> Column:
        gone = F.transform(f["bad"], lambda x: x["at"])
        some = F.array_join(F.filter(F.split(text, "\n"), lambda x, k: ~F.array_contains(gone, k)), "\n")
        return F.when(f["rule"].isNull(), F.array(F.when(f["n_removed"] > 0, some).otherwise(text)))

    rows = rows.select(*[n for c, n in names.items() if c != "text"], F.explode(let(facts, left)).alias(names["text"]))
    return back(rows, names)
