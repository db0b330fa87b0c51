"""Line dedup: winnowing over line hashes finds later repeated runs of lines, which are deleted.

Lines are normalised (white space collapsed and trimmed, A-Z lower-cased) and blank lines are
left out. A run is deleted if it holds MIN_WORDS words or more and stands at an earlier place,
too, in (doc_id, line) order, that does not overlap it: so the first place of a run keeps all of
it, in texts that repeat themselves as well, unless it holds a copy of something still earlier.

A window is the shortest run of lines from a given line on that holds MIN_WORDS words. The line of
the smallest hash in a window (the last of equals) is selected, so any run of MIN_WORDS words that
two places share has a selected line, its fingerprint, in both. Only selected lines make rows, some
2 in every w + 1 lines for windows of w lines, and only those whose hash stands at two places are
followed. Their matches are extended both ways: to the left by every window that selected the
line, to the right by windows that go on line by line up to where the next one ends. Equal extents
are joined by a 128-bit hash of their lines, and the first place of each is kept. What these
extents cover together is what all maximal runs cover, without comparing all pairs of places.

Fewer words than MIN_WORDS never make a run. Null and empty texts have no lines. Rows without a
doc_id come before others. Rows that repeat a doc_id and a text count as one place; rows that
repeat a doc_id with another text are told apart. Long texts are read whole, line by
line. Other columns are kept as they are by ``dedup`` and play no part, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, back, cut, join_groups, prepare

MIN_WORDS = 50
_EXTENT = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("key", pa.binary())])


def selected(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, list[tuple[int, int, bytes]]]]:
    """(line, its hash, extents) of each selected line; an extent is (first line, last line, key).

    Line numbers count every line of the text, blank ones too.
    """
    at, sizes, hashes = [], [], []
    for k, raw in enumerate(text.split("\n")):
        w = raw.encode("utf-8").lower().split()
        if w:
            at.append(k)
            sizes.append(len(w))
            hashes.append(xxhash.xxh64_intdigest(b" ".join(w), 7))
    n, packed = len(at), struct.pack(f"<{len(at)}Q", *hashes)
    found: dict[int, list[tuple[int, int, bytes]]] = {}
    end, held, best = 0, 0, -1
    for first in range(n):
        before = end
        while held < min_words and end < n:
            held += sizes[end]
            end += 1
        if held < min_words:
            break
        # The smallest hash: that of the window before, unless it has left, or one of the lines that came.
        if best < first:
            best, before = first, first + 1
        for k in range(before, end):
            if hashes[k] <= hashes[best]:
                best = k
        held -= sizes[first]
        extents = found.setdefault(best, [])
        stop, more = end, held
        while True:
            extents.append((at[first], at[stop - 1], hashlib.blake2b(packed[8 * first : 8 * stop], digest_size=16).digest()))
            if stop == n or more + sizes[stop] >= min_words:
                break
            more += sizes[stop]
            stop += 1
    return [(at[k], hashes[k], extents) for k, extents in found.items()]


def _selected(min_words: int):
    def run(batches):
        for b in batches:
            docs, owns, ats, prints, ends, extents = [], [], [], [], [0], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                own = xxhash.xxh64_intdigest(text.encode("utf-8"), 42)  # as F.xxhash64
                for at, print_, some in selected(text, min_words):
                    extents += some
                    for c, x in zip((docs, owns, ats, prints, ends), (doc, own, at, print_, len(extents))):
                        c.append(x)
            columns = [np.array(c, np.int64) for c in ([x[0] for x in extents], [x[1] for x in extents])]
            flat = pa.StructArray.from_arrays([*map(pa.array, columns), pa.array([x[2] for x in extents], pa.binary())], fields=list(_EXTENT))
            signed = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (owns, prints)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), signed[0], pa.array(ats, pa.int64()), signed[1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "own", "at", "print", "extents"])

    return run


def runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs to delete: doc_id, own (hash of the text), first_line, last_line, and source_doc_id,
    source_line: where the run's first window stands for the first time. Both ends count.
    Runs that overlap or touch are one."""
    prepare(docs.sparkSession)
    found = cut(docs.select("doc_id", "text").mapInArrow(_selected(min_words), "doc_id long, own long, at long, print long, extents array<struct<first: long, last: long, key: binary>>"))
    spot = F.xxhash64("doc_id", "own", "at")
    prints = cut(found.groupBy("print").agg(F.min(spot).alias("a"), F.max(spot).alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("print", "n"))
    near = cut(join_groups(found, prints, "print", "n").select("doc_id", "own", F.inline("extents")))
    place = F.struct("doc_id", "own", "first", "last")
    origin = near.groupBy("key").agg(F.min(place).alias("from"), F.max(place).alias("to"), F.count(F.lit(1)).alias("n")).where("from <> to")
    later = join_groups(near, cut(origin.select("key", "from", "n")), "key", "n")
    same = F.col("doc_id").eqNullSafe(F.col("from.doc_id")) & (F.col("own") == F.col("from.own"))
    later = later.where(~same | (F.col("first") > F.col("from.last")))
    doc = Window.partitionBy("doc_id", "own").orderBy("first", "last")
    reach = F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    later = later.select("doc_id", "own", "first", "last", "from").withColumn("new", F.coalesce((F.col("first") > reach + 1).cast("int"), F.lit(1)))
    later = later.withColumn("run", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    out = later.groupBy("doc_id", "own", "run").agg(F.min("first").alias("first_line"), F.max("last").alias("last_line"), F.min_by("from", F.struct("first", "last")).alias("f"))
    return out.select("doc_id", "own", "first_line", "last_line", F.col("f.doc_id").alias("source_doc_id"), F.col("f.first").alias("source_line"))


def _without(names: dict[str, str]):
    columns, at = list(names.values()), list(names).index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, s in enumerate(b.column(len(columns)).to_pylist()):
                if s:
                    gone = {k for x in s for k in range(x["first_line"], x["last_line"] + 1)}
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone)
            out = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(out, columns)

    return run


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later repeated runs of lines deleted from text; all columns and rows stay."""
    spans = runs(docs, min_words).groupBy("doc_id", "own").agg(F.collect_list(F.struct("first_line", "last_line")).alias("spans"))
    own, names = aside(docs)
    both = own.join(spans, F.col(names["doc_id"]).eqNullSafe(F.col("doc_id")) & (F.xxhash64(names["text"]) == F.col("own")), "left")
    return back(both.select(*names.values(), "spans").mapInArrow(_without(names), own.schema), names)
