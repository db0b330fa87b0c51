"""SimHash near-dedup: tiled exact comparison of fingerprints with exclusive-or and bit counts.

Different fingerprints are laid into cells by the population counts of their four 16-bit words.
Two fingerprints within the radius have population counts that differ by no more than the
radius in sum, so only tile pairs of near cells are compared; all others are skipped. Large
cells are dealt into tiles of bounded size. Each tile pair is one row, compared with numpy, and
gives a spanning forest of its links, never all pairs of a dense group. Connected components of
these links are those of all links.

Null and wordless texts have fingerprint zero and are linked like any other. Rows without a
doc_id take part, and a component of nothing but them has a null id. Repeated rows share their
fingerprint. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL, aside, back, cut, join_groups, prepare
from .components import FINISH, components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Words of a fingerprint whose population counts make a cell; fingerprints in a tile.
PARTS, TILE = 4, 1024
#: Hashes of one text whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is set if it is in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules only
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    votes, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    grams = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for b in batches:
        out = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long)."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def forest(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join what links of left to right within the radius join, one fewer than nodes at most."""
    near = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
    a, b = np.nonzero(near)
    if not len(a):
        return []
    both, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = place[a], place[len(left) + b]
    label = np.arange(len(both))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)  # roots follow, so that chains halve
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(len(both)))[0]
    return list(zip(both[moved].view(np.int64).tolist(), both[label[moved]].view(np.int64).tolist()))


def _compare(radius: int):
    def run(batches):
        for b in batches:
            sides = []
            for k in range(2):
                c = b.column(k)
                sides.append((c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False).view(np.uint64)))
            (oa, va), (ob, vb) = sides
            src, dst = [], []
            for i in range(b.num_rows):
                for x, y in forest(va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]], radius):
                    src.append(x)
                    dst.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def offsets(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of cells within the radius, one of each pair of opposites, and none at all."""
    found = [()]
    for _ in range(parts):
        found = [(*d, x) for d in found for x in range(-radius, radius + 1) if sum(map(abs, d)) + abs(x) <= radius]
    return [d for d in found if d >= (0,) * parts]


def links(distinct: DataFrame, radius: int = RADIUS, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """distinct(fp), no repeats → (src, dst) that connect what links within the radius connect.

    Pairs of tiles are made from the cells' numbers of tiles alone, so that the pairs of a crowded
    cell are dealt evenly over all tasks before any fingerprints meet them. Then each side is
    fetched by (cell, tile), a key that no more pairs share than near cells have tiles.
    """
    width = 64 // parts
    mask = (1 << width) - 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit(mask))) for k in range(parts)]
    number = sum((c * 65**k for k, c in enumerate(counts)), F.lit(0).cast("long"))
    cells = cut(distinct.select("fp", number.alias("cell")))
    # One row a cell: there are (width + 1) ** parts of them at most.
    many = cut(cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles")))
    dealt = cells.join(F.broadcast(many), "cell") if (width + 1) ** parts <= SMALL else cells.join(many, "cell")
    tiles = cut(dealt.groupBy("cell", F.pmod(F.xxhash64("fp"), "tiles").alias("tile")).agg(F.collect_list("fp").alias("fps")))
    steps = F.array(*[F.lit(sum(x * 65**k for k, x in enumerate(d))).cast("long") for d in offsets(parts, radius)])
    near = many.select(F.explode(F.transform(steps, lambda s: F.col("cell") + s)).alias("to"), "cell", "tiles")
    near = near.join(many.select(F.col("cell").alias("to"), F.col("tiles").alias("others")), "to")
    near = near.select("cell", "to", "others", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"))
    n = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = near.repartition(n, F.xxhash64("cell", "to", "tile"))
    pairs = near.select("cell", "tile", "to", F.explode(F.sequence(F.when(F.col("cell") == F.col("to"), F.col("tile")).otherwise(F.lit(0)).cast("long"), F.col("others") - 1)).alias("other"))
    left, right = tiles.withColumnRenamed("fps", "left"), tiles.select(F.col("cell").alias("to"), F.col("tile").alias("other"), F.col("fps").alias("right"))
    pairs = pairs.join(left, ["cell", "tile"]).join(right, ["to", "other"])
    return pairs.select("left", "right").mapInArrow(_compare(radius), "src long, dst long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id, root), one row per document: the smallest doc_id that links reach,
    and the fingerprint that stands for the component, as components of repeated ids may share the first."""
    own = cut(fingerprints(docs))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct.select("fp"), radius), FINISH)
    placed = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    least = cut(placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("fps")))
    ids = cut(join_groups(placed, least, "root", "fps").select("fp", "n", "component_id", "root"))
    return join_groups(own, ids, "fp", "n").select("doc_id", "fp", "component_id", "root")


def _printed(at: int):
    """Batches with the fingerprint of column ``at`` as a last column."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(at)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], [*b.schema.names, "fp"])

    return run


def dedup(docs: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with all its columns.

    What goes is told by doc_id and sent to every task while short, so that texts stay where they
    are. Rows that repeat a doc_id are told apart by their fingerprints: each goes or stays with
    its own component, and of those in one component the one with the smallest text stays. Rows
    without a doc_id stay.
    """
    told = near_duplicates(docs, radius).where("doc_id is not null")
    told = cut(told.groupBy("doc_id", "fp", "component_id", "root").agg(F.count(F.lit(1)).alias("copies")))
    own, names = aside(docs)
    doc, text = F.col(names["doc_id"]), F.col(names["text"])
    sent = lambda ids: F.broadcast(ids) if ids.count() <= small else ids
    twice = cut(told.groupBy("doc_id").agg(F.sum("copies").alias("rows")).where("rows > 1").select("doc_id"))
    gone = cut(told.where("doc_id <> component_id").select("doc_id").unionByName(twice).distinct())
    once = back(own.join(sent(gone), doc == F.col("doc_id"), "left_anti"), names)
    if twice.isEmpty():
        return once
    rows = own.join(sent(twice), doc == F.col("doc_id"), "left_semi")
    rows = rows.mapInArrow(_printed(list(names).index("text")), T.StructType([*rows.schema.fields, T.StructField("fp", T.LongType())]))
    rows = rows.join(told.where("doc_id = component_id").drop("copies"), (doc == F.col("doc_id")) & (rows["fp"] == told["fp"]))
    first = F.row_number().over(Window.partitionBy("doc_id", "root").orderBy(F.coalesce(text, F.lit(""))))
    return once.unionByName(back(rows.withColumn("at", first).where("at = 1"), names))
