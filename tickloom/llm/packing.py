"""Packing documents into fixed sequences: first-fit decreasing in randomised groups.

Every document is encoded whole, ends with its end id, and is cut at multiples of the sequence
length. Pieces of a random group of documents (by a hash of the document) are sorted from the
longest; a tournament tree over the free room of the group's bins finds the first bin that has
room in a logarithmic number of steps. Groups are independent tasks of bounded size.

Null text is an empty document: its end id alone. Every row is a document of its own, so rows
that repeat a doc_id are packed again; ``copy`` tells them apart: 0, or the place among them by
ids and, of equal ones, by where they were read. A null doc_id is carried along. Long texts
are encoded whole and cut into as many pieces as they need. Other columns play no part, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut, prepare

LENGTH = 2048
END = 1
#: Documents in a group, on average.
GROUP = 4096
#: Bits of a checksum that tell the part of rows of one id that are numbered together.
PARTS = 12
#: Columns of a piece as it is cut: _row is where its document was read, _crc the CRC-32 of all its ids.
PIECE = ("doc_id", "_row", "_crc", "start", "length", "ids_crc32", "doc_tokens")
KEPT = ["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens"]


class Bins:
    """A tournament tree: each inner node holds the most room of any bin below it."""

    def __init__(self, most: int, room: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)

    def place(self, need: int) -> tuple[int, int]:
        """(bin, room it had): the first bin with room, from which need is taken."""
        tree, k = self.tree, 1
        while k < self.leaves:
            k *= 2
            if tree[k] < need:
                k += 1
        had = tree[k]
        tree[k] = had - need
        at = k - self.leaves
        while k > 1:
            k >>= 1
            tree[k] = max(tree[2 * k], tree[2 * k + 1])
        return at, had


def first_fit(lengths: list[int], room: int = LENGTH) -> list[tuple[int, int]]:
    """(bin, offset) of each length, given in decreasing order."""
    bins = Bins(max(1, len(lengths)), room)
    return [(at, room - had) for at, had in map(bins.place, lengths)]


def _pieces(path: str, length: int, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        coder = tokens.ranks(path)
        for b in batches:
            rows = [[] for _ in PIECE]
            for doc, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids = coder.encode(text.as_py()) + tail
                whole = zlib.crc32(ids)
                for at in range(0, len(ids), 4 * length):
                    part = ids[at : at + 4 * length]
                    for out, x in zip(rows, (doc, row, whole, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4)):
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], list(PIECE))

    return run


def _pack(length: int):
    def run(key: tuple, pieces: pa.Table) -> pa.Table:
        pieces = pieces.select(KEPT).sort_by([("length", "descending"), ("doc_id", "ascending"), ("copy", "ascending"), ("start", "ascending")])
        placed = np.array(first_fit(pieces["length"].to_pylist(), length), np.int64)
        sequence = (key[0].as_py() << 32) + placed[:, 0]
        return pieces.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(placed[:, 1]))

    return run


def numbered(pieces: DataFrame) -> DataFrame:
    """pieces with copy in place of _row: 0, or the place among rows that repeat a doc_id."""
    heads = pieces.where("start = 0").select("doc_id", "_row", "_crc", "doc_tokens")
    twice = cut(heads.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id")))
    plain = [c for c in pieces.columns if c not in ("_row", "_crc")]
    if twice.isEmpty():
        return pieces.select(F.lit(0).cast("long").alias("copy"), *plain)
    # An id may hold any share of the rows: they are numbered in parts by their checksum, and parts by running sums.
    own = heads.join(twice, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").withColumn("_part", F.shiftright("_crc", 32 - PARTS))
    before = Window.partitionBy("doc_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("doc_id", "_part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select(F.col("doc_id").alias("_id"), F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("doc_id", "_part").orderBy("_crc", "doc_tokens", "_row")) - 1
    rows = own.withColumn("_inside", inside).join(parts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_part") == F.col("_p")))
    copies = rows.select(F.col("_row").alias("_at"), (F.col("_ahead") + F.col("_inside")).alias("copy"))
    return pieces.join(copies, F.col("_row") == F.col("_at"), "left").select(F.coalesce("copy", F.lit(0)).cast("long").alias("copy"), *plain)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, group: int = GROUP, seed: int = 5) -> DataFrame:
    """One row per piece: doc_id, copy, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), "text")
    pieces = cut(rows.mapInArrow(_pieces(path, length, end), ", ".join(f"{c} long" for c in PIECE)))
    groups = max(1, -(-pieces.where("start = 0").count() // group))
    pieces = numbered(pieces).withColumn("group", F.pmod(F.xxhash64("doc_id", "copy", F.lit(seed)), F.lit(groups)))
    return pieces.groupBy("group").applyInArrow(_pack(length), ", ".join(f"{c} long" for c in (*KEPT, "sequence_id", "offset")))
