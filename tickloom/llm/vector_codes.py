"""Product codes of vectors: delta-maintained Lloyd over equal consecutive parts.

Components become integers floor(scale * x); vectors are cut into parts, and each part has a
codebook of its own. It starts as that part of the vectors of the smallest ids. A round gives
every part the nearest entry (squared distance, ties to the lower index) and replaces entries by
the floor of the mean of their parts; entries without parts stay.

Integer sums and counts of every entry are kept between rounds, and so is each part's entry, in a
table that a round writes anew. Only parts whose entry changed contribute: minus at the old one,
plus at the new one, added up in each task before they are shuffled. So a round shuffles no more
than parts * entries rows a task, and fewer as assignments settle; a round without a change ends
the fit, for all later ones would repeat it. All arithmetic is of whole numbers and exact, so
results don't depend on partitions or on retries. The driver holds the codebooks, whose size is
fixed by the parameters, and one row an entry; vectors never leave their tasks.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors that are
shorter than the longest count as if zeros followed, up to a multiple of the number of parts; so
does an empty one. Rows that repeat an id are rows of their own, ordered by their vectors where
they are among the first; ids that are null come last. Null labels are one label. Components
beyond 2**26 / scale raise an error, for squared distances would not be exact. With fewer vectors
than entries the codebook has as many entries as there are vectors; an empty table gives an empty
result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups, prepare, remove, shared_dir

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Sizes of integer components for which distances of 2**9 components fit 64 bits.
LARGEST = 1 << 26
#: Numbers that a comparison of vectors with a codebook may hold at once.
AT_ONCE = 1 << 22


@dataclass
class Codes:
    """rows: the kept rows with id, label, code (hexadecimal, two digits a part) and error;
    codebooks: for each part an array of entries by components."""

    rows: DataFrame
    codebooks: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.codebooks for x in book.ravel().tolist()).encode()).hexdigest()


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each point; of equally near entries the first."""
    at, far = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    if not points.shape[1]:
        return at, far
    top = int(max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)))
    exact = points.shape[1] * (2 * top) ** 2 < 1 << 53  # then sums of doubles are of whole numbers
    step = max(1, AT_ONCE // (len(book) * (1 if exact else points.shape[1])))
    for k in range(0, len(points), step):
        some = points[k : k + step]
        if exact:
            x, c = some.astype(np.float64), book.astype(np.float64)
            apart = (c * c).sum(axis=1) - 2 * (x @ c.T)
            at[k : k + step] = best = apart.argmin(axis=1)
            far[k : k + step] = (apart[np.arange(len(x)), best] + (x * x).sum(axis=1)).astype(np.int64)
        else:
            apart = ((some[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
            at[k : k + step] = best = apart.argmin(axis=1)
            far[k : k + step] = apart[np.arange(len(some)), best]
    return at, far


def _whole(width: int, scale: int):
    """Batches of (id, label, vector) with vectors as little-endian 32-bit whole numbers of one width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.floor(np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) * scale) if len(v.values) else np.zeros(0) for v in b.column(2)]
            if any(len(r) and np.abs(r).max() > LARGEST for r in rows):
                raise ValueError(f"a component is beyond {LARGEST / scale:g}, where distances are not exact")
            held = [np.pad(r, (0, width - len(r))).astype("<i4").tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held, pa.binary())], ["id", "label", "vector"])

    return run


#: A round's file: kept rows with their vector and entries, and rows with a task's contributions to one entry.
_ROUND = "vector binary, code binary, part int, entry int, n long, sums array<bigint>"


def _assign(books: list[np.ndarray], kinds: list[str]):
    """Rows with their nearest entries; then what changed, summed by part and entry over the task."""
    parts, width = len(books), sum(b.shape[1] for b in books)
    per, entries = width // parts, len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, per), np.int64)
        touched = np.zeros((parts, entries), bool)
        empty = None
        for b in batches:
            empty = b.slice(0, 0)
            points = np.frombuffer(b"".join(b.column(2).to_pylist()), "<i4").reshape(b.num_rows, width).astype(np.int64)
            old = b.column(3).to_pylist()
            new = np.zeros((b.num_rows, parts), np.uint16)
            for p, book in enumerate(books):
                own = points[:, p * per : (p + 1) * per]
                new[:, p] = nearest(own, book)[0]
            was = np.array([np.frombuffer(c, "<u2") if c is not None else np.full(parts, entries) for c in old], np.int64).reshape(b.num_rows, parts)
            for p in range(parts):
                moved = np.flatnonzero(was[:, p] != new[:, p])
                own, to, from_ = points[moved, p * per : (p + 1) * per], new[moved, p].astype(np.int64), was[moved, p]
                left = from_ < entries  # in the first round parts leave nothing
                for sign, at, some in ((1, to, own), (-1, from_[left], own[left])):
                    np.add.at(counts[p], at, sign)
                    np.add.at(sums[p], at, sign * some)
                    touched[p, at] = True
            n = b.num_rows
            nulls = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r.astype("<u2").tobytes() for r in new], pa.binary()), *nulls], kinds)
        if empty is not None and touched.any():
            p, e = np.nonzero(touched)
            n = len(p)
            columns = [pa.nulls(n, empty.schema.field(k).type) for k in range(3)] + [pa.nulls(n, pa.binary())]
            columns += [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e], pa.int64()), pa.array(list(sums[p, e]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, kinds)

    return run


def _coded(books: list[np.ndarray]):
    width = sum(b.shape[1] for b in books)
    per = width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = np.frombuffer(b"".join(b.column(2).to_pylist()), "<i4").reshape(b.num_rows, width).astype(np.int64)
            found = [nearest(points[:, p * per : (p + 1) * per], book) for p, book in enumerate(books)]
            digits = [pa.array([f"{x:02x}" for x in at.tolist()], pa.string()) for at, _ in found]
            code = ["".join(x) for x in zip(*(d.to_pylist() for d in digits))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(sum(far for _, far in found), pa.int64())], ["id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of all kept rows after so many rounds; entries may be 256 at most."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part")
    spark = vectors.sparkSession
    prepare(spark)
    own = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(finite(F.col("vector")))
    kinds = dict(own.dtypes)
    longest = own.agg(F.max(F.size("vector"))).first()[0]
    width = -(-(longest or 0) // parts) * parts
    whole = cut(own.mapInArrow(_whole(width, scale), f"id {kinds['id']}, label {kinds['label']}, vector binary"))
    first = whole.orderBy(F.col("id").asc_nulls_last(), F.hex("vector")).limit(entries).collect()  # entries rows
    if not first:
        return Codes(whole.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), [np.zeros((0, width // parts), np.int64)] * parts)
    start = np.stack([np.frombuffer(r["vector"], "<i4") for r in first]).astype(np.int64)
    per = width // parts
    books = [start[:, p * per : (p + 1) * per].copy() for p in range(parts)]
    names = ["id", "label", "vector", "code", "part", "entry", "n", "sums"]
    schema = f"id {kinds['id']}, label {kinds['label']}, {_ROUND}"
    held, before, sums = whole.withColumn("code", F.lit(None).cast("binary")), None, None
    for _ in range(rounds):
        folder = f"{shared_dir(spark).rstrip('/')}/lloyd-{uuid.uuid4().hex}"
        held.mapInArrow(_assign(books, names), schema).write.parquet(folder)
        written = spark.read.schema(schema).parquet(folder)
        if before:
            remove(spark, before)
        before = folder
        held = written.where("part is null").select("id", "label", "vector", "code")
        # Counts stand at place -1 of the sums, so that both are added up alike.
        moved = written.where("part is not null").select("part", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "x"))
        delta = moved.groupBy("part", "entry", "at").agg(F.sum("x").alias("x"))
        if delta.isEmpty():
            break
        sums = cut(delta if sums is None else sums.unionByName(delta).groupBy("part", "entry", "at").agg(F.sum("x").alias("x")))
        table = np.zeros((parts, len(first), per + 1), np.int64)
        for r in sums.collect():  # parts * entries * (components + 1) numbers
            table[r["part"], r["entry"], r["at"]] = r["x"]
        for p, book in enumerate(books):
            some = table[p, :, 0] > 0
            book[some] = table[p, some, 1:] // table[p, some, :1]
    rows = cut(whole.mapInArrow(_coded(books), f"id {kinds['id']}, label {kinds['label']}, code string, error long"))
    if before:
        remove(spark, before)
    return Codes(rows, books)


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows with label_error, the error summed over equal labels, nulls together; rows are read twice."""
    name = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    keyed = rows.withColumn("_key", name)
    sums = cut(keyed.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    return join_groups(keyed, sums, "_key", "_n").drop("_key", "_n")


def decoded(code: str, codebooks: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for."""
    at = bytes.fromhex(code)
    return np.concatenate([book[k] for k, book in zip(at, codebooks)]) / scale
