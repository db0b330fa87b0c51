"""Chunking and bigram fingerprints of texts, as vectorised Python functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import cut

#: Fingerprints at most so many bits apart are near duplicates.
NEAR = 22
_END = re.compile("(?<=[。；！？.!?])")
_U = np.uint64


def _mix(grams: np.ndarray) -> np.ndarray:
    """64-bit FNV-1a over the two code units of each row, then the splitmix64 finaliser."""
    h = np.full(len(grams), 0xCBF29CE484222325, _U)
    for k in range(grams.shape[1]):
        h = (h ^ grams[:, k].astype(_U)) * _U(0x100000001B3)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> _U(shift))) * _U(factor)
    return h ^ (h >> _U(31))


def fingerprint(text: str | None) -> int:
    """Signed 64 bits: each is the majority among the text's bigrams; 0 for blank text."""
    if text is None or not text.strip():
        return 0
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    if len(units) < 2:
        return 0
    codes, times = np.unique(units[:-1].astype(np.uint32) << 16 | units[1:], return_counts=True)
    pairs = np.stack([codes >> 16, codes & 0xFFFF], 1)
    bits = np.unpackbits(_mix(pairs).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = times @ (2 * bits.astype(np.int64) - 1)
    return int(np.packbits(votes > 0, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _simhash(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint).astype("int64")


def simhash(text: Column | str) -> Column:
    return _simhash(text)


#: Fingerprints in a tile, of fingerprints alone, and those of a side that are compared at once.
TILE, WIDE, AT_ONCE = 2048, 16384, 16


def _tile_pairs(rows: DataFrame, column: str, size: int | None = None) -> DataFrame:
    """(left, right, same) for each two tiles of rows(column, ...): arrays of structs of the rows, of one
    column arrays of its values.

    Pairs are dealt to tasks by their numbers alone before any fingerprints meet them.
    """
    spark = rows.sparkSession
    n = max(1, -(-rows.count() // (size or TILE)))
    tile = F.pmod(F.xxhash64(column), F.lit(n)).alias("tile")
    tiles = rows.groupBy(tile).agg(F.collect_list(F.struct(*rows.columns) if len(rows.columns) > 1 else F.col(column)).alias("rows"))
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence("id", F.lit(n - 1).cast("long"))).alias("j")).repartition(width, F.xxhash64("i", "j"))
    left, right = (tiles.select(F.col("tile").alias(k), F.col("rows").alias(name)) for k, name in (("i", "left"), ("j", "right")))
    return pairs.join(left, "i").join(right, "j").select("left", "right", (F.col("i") == F.col("j")).alias("same"))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(left, right, ..) of each row, arrays as numpy without Python objects for their values."""
    for b in batches:
        for row in range(b.num_rows):
            yield tuple(c[row].values.to_numpy().view(_U) if pa.types.is_list(c.type) else c[row].as_py() for c in b.columns)


def _near(left: np.ndarray, right: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, whether fingerprints from the left's i-th on and all of the right are near), AT_ONCE of the left at once."""
    for i in range(0, len(left), AT_ONCE):
        yield i, np.bitwise_count(left[i : i + AT_ONCE, None] ^ right[None, :]) <= most


def _bitmaps(left: np.ndarray, right: np.ndarray, masks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mask (a bitmap of the right for each key that it has there, and a blank one; the row of it for each of the left)."""
    out = []
    for mask in masks:
        keys, at = np.unique(right & mask, return_inverse=True)
        bits = np.zeros((len(keys) + 1, -(-len(right) // 64) * 64), bool)
        bits[at, np.arange(len(right))] = True
        asked = left & mask
        place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        out.append((np.packbits(bits, axis=1).view(_U), np.where(keys[place] == asked, place, len(keys))))
    return out


def _links(left: np.ndarray, right: np.ndarray, most: int, masks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many of the right are near each of the left, and of the left each of the right; with masks
    those alone that have some mask's bits in common. Bits of whole rows are counted in place."""
    n, m = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    x, apart = np.empty((AT_ONCE, len(right)), _U), np.empty((AT_ONCE, len(right)), np.uint8)
    held = np.zeros((AT_ONCE, -(-len(right) // 64) * 64), bool)
    maps = None if masks is None else _bitmaps(left, right, masks)
    for i in range(0, len(left), AT_ONCE):
        rows = slice(0, min(AT_ONCE, len(left) - i))
        near = held[rows, : len(right)]
        np.bitwise_xor(left[i : i + AT_ONCE, None], right[None, :], out=x[rows])
        np.less_equal(np.bitwise_count(x[rows], out=apart[rows]), most, out=near)
        bits = held[rows].view(_U)
        if maps is not None:
            some = np.zeros((len(near), held.shape[1] // 64), _U)
            for own, at in maps:
                some |= own[at[i : i + AT_ONCE]]
            bits = some & np.packbits(held[rows], axis=1).view(_U)
            near = np.unpackbits(bits.view(np.uint8), axis=1, count=len(right))
        n[i : i + AT_ONCE] = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        m += np.add.reduce(near.view(np.uint8), axis=0, dtype=np.uint8)
    return n, m


def _counted(most: int, masks: np.ndarray | None = None):
    """(left, right, same) → (fp, n); with masks pairs count that agree in some table."""

    def run(batches):
        for left, right, same in _fingerprints(batches):
            n, m = _links(left, right, most, masks)
            for fps, times in ((left, n - 1),) if same else ((left, n), (right, m)):
                yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(times)], ["fp", "n"])

    return run


def _side(cells, names: tuple[str, ...]) -> list[np.ndarray]:
    """Columns of cells; ids may be of any type that has an order."""
    return [np.array([c[n] for c in cells], np.int64 if n == "fp" else object) for n in names]


#: Tables of a sampling index, and bits of the fingerprint that make a table's key.
TABLES, SAMPLED = 72, 8
#: Rows of a bucket beyond which its tiles are dealt as pairs of their own.
FULL = 2048


def sampled_bits(tables: int, bits: int, seed: int = 7) -> list[list[int]]:
    """For each table the bits that it samples, by a fixed sequence."""
    rng = np.random.default_rng(seed)
    return [sorted(rng.choice(64, bits, replace=False).tolist()) for _ in range(tables)]


def chance(distance: int, tables: int = TABLES, bits: int = SAMPLED) -> float:
    """The chance that fingerprints so many bits apart agree on all bits of some table."""
    one = np.prod([(64 - distance - k) / (64 - k) for k in range(bits)]) if distance <= 64 - bits else 0.0
    return float(1 - (1 - one) ** tables)


def _agreements(masks: np.ndarray) -> np.ndarray:
    """[word, quarter of 16 bits, value]: a bit for each of 64 tables a word, set where the value has none of the table's bits."""
    out = np.zeros((-(-len(masks) // 64), 4, 1 << 16), _U)
    values = np.arange(1 << 16, dtype=_U)
    for t, mask in enumerate(masks):
        for quarter in range(4):
            free = values & (mask >> _U(16 * quarter) & _U(0xFFFF)) == 0
            out[t // 64, quarter] |= free.astype(_U) << _U(t % 64)
    return out


def _first(x: np.ndarray, table: int, agreed: np.ndarray) -> np.ndarray:
    """Whether no table before this one has fingerprints agree that differ by x: a look-up a quarter of x
    instead of a comparison a table."""
    out = np.ones(len(x), bool)
    quarters = np.ascontiguousarray(x).view("<u2").reshape(-1, 4)
    for word in range(-(-table // 64)):
        before = _U((1 << min(64, table - 64 * word)) - 1)
        own = agreed[word]
        out &= own[0][quarters[:, 0]] & own[1][quarters[:, 1]] & own[2][quarters[:, 2]] & own[3][quarters[:, 3]] & before == 0
    return out


def near_candidates(rows: DataFrame, most: int = NEAR, tables: int = TABLES, bits: int = SAMPLED, chunk: int = FULL, counted: bool = False) -> DataFrame:
    """fp_a < fp_b, distance of rows(fp): pairs of different fingerprints at most most bits apart that
    agree on all bits that some table samples; found by no more than one table each.

    A multi-table index of sampled bits: of pairs at 22 bits, the farthest, tables find a share of
    ``chance(22)``, of nearer ones more. Buckets are cut into tiles, and each pair of a bucket's tiles
    is a row dealt to some task, so that a crowded bucket is not one task's work. What is found
    is verified there; a pair is given by the first table that its fingerprints agree in, so
    that none comes twice and nothing has to be made distinct. counted: fp and n, how many pairs it
    is in, instead of the pairs, whose number grows with the square of dense groups; where the buckets
    hold more pairs than there are, each pair of tiles is compared once, and bitmaps of the tables' keys
    say which of its fingerprints some table has together.
    ``near_links`` is the exact way.
    """
    spark = rows.sparkSession
    sampled = sampled_bits(tables, bits)
    masks = np.array([sum(1 << b for b in own) for own in sampled], _U)
    own = cut(rows.where("fp <> 0").select("fp").distinct())
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(int(np.int64(masks[t].view(np.int64))))).alias("key")) for t in range(tables)])
    cells = own.select("fp", F.explode(keys).alias("k")).select("k.table", "k.key", "fp")
    sizes = cut(cells.groupBy("table", "key").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("tiles"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    if counted:
        met, n = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("n").cast("double")), F.lit(0.0))).first()[0], own.count()
        if met > float(n) ** 2:
            return _tile_pairs(own, "fp", WIDE).mapInArrow(_counted(most, masks), "fp long, n long")
    dealt = cells.join(sizes.select("table", "key", "tiles"), ["table", "key"]).withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles"))
    tiles = cut(dealt.groupBy("table", "key", "tile").agg(F.collect_list("fp").alias("fps")))
    numbers = sizes.select("table", "key", "tiles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("i"))
    numbers = numbers.select("table", "key", "i", F.explode(F.sequence("i", F.col("tiles") - 1)).alias("j"))
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbers = numbers.repartition(width, F.xxhash64("table", "key", "i", "j"))
    left, right = (tiles.select("table", "key", F.col("tile").alias(k), F.col("fps").alias(name)) for k, name in (("i", "left"), ("j", "right")))
    pairs = numbers.join(left, ["table", "key", "i"]).join(right, ["table", "key", "j"]).select("table", (F.col("i") == F.col("j")).alias("same"), "left", "right")

    def run(batches):
        agreed = _agreements(masks)
        for table, same, a, b in _fingerprints(batches):
            ends = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            for at, near in _near(a, b, most):
                i, j = np.nonzero(np.triu(near, at + 1) if same else near)
                i += at
                x = a[i] ^ b[j]
                first = _first(x, table, agreed)
                i, j = i[first], j[first]
                if counted:
                    for side, own in zip(ends, (i, j)):
                        side += np.bincount(own, minlength=len(side))
                else:
                    p, q = a[i].view(np.int64), b[j].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(np.bitwise_count(x[first]).astype(np.int32))], ["fp_a", "fp_b", "distance"])
            if counted:
                fps, n = np.concatenate([a, b]).view(np.int64), np.concatenate(ends)
                yield pa.RecordBatch.from_arrays([pa.array(fps[n > 0]), pa.array(n[n > 0])], ["fp", "n"])

    return pairs.mapInArrow(run, "fp long, n long" if counted else "fp_a long, fp_b long, distance int")


def sampled_links(rows: DataFrame, most: int = NEAR, tables: int = TABLES, bits: int = SAMPLED) -> DataFrame:
    """``near_links`` by the sampling index: the same columns, with links that it finds."""
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")))
    ends = near_candidates(classes.select("fp"), most, tables, bits, counted=True).groupBy("fp").agg(F.sum("n").alias("links"))
    classes = classes.join(ends, "fp", "left").select(F.col("fp").alias("_fp"), "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return rows.select("id", "fp").join(classes, F.col("fp").eqNullSafe(F.col("_fp"))).drop("_fp")


def near_pairs(rows: DataFrame, most: int = NEAR) -> DataFrame:
    """id_a < id_b, distance for rows(id, fp) at most most bits apart; zero never matches.

    By pigeonhole, fingerprints at most ``most`` bits apart agree on all but that many of
    ``most + 1`` bands, and bands of 2 or 3 bits prune nothing; so tiles are compared whole, each
    pair of tiles one task row. Use it for candidate sets: both the work and the result are
    quadratic. ``near_links`` counts instead.
    """

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                (ids, a), (ids2, b) = _side(r.left, ("id", "fp")), _side(r.right, ("id", "fp"))
                far = np.bitwise_count(a.view(_U)[:, None] ^ b.view(_U)[None, :])
                i, j = np.nonzero(far <= most)
                x, y = ids[i], ids2[j]
                keep = (x < y) if r.same else (x != y)
                yield pd.DataFrame({"id_a": np.minimum(x, y)[keep], "id_b": np.maximum(x, y)[keep], "distance": far[i, j][keep].astype(np.int32)})

    kind = dict(rows.dtypes)["id"]
    return _tile_pairs(rows.where("fp <> 0").select("id", "fp"), "id").mapInPandas(run, f"id_a {kind}, id_b {kind}, distance int")


def near_links(rows: DataFrame, most: int = NEAR) -> DataFrame:
    """One row for each of rows(id, fp): id, fp, class_id (the smallest id of this fingerprint), copies
    (rows that have it) and links: how many other fingerprints are at most most bits from it.

    No link between different fingerprints is lost, and the result has as many rows as the
    input, however dense the groups are. A zero fingerprint and a null one have no links.
    """
    own = cut(rows.groupBy("fp").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")))

    found = _tile_pairs(own.where("fp <> 0").select("fp"), "fp", WIDE).mapInArrow(_counted(most), "fp long, n long").groupBy("fp").agg(F.sum("n").alias("links"))
    classes = own.join(found, "fp", "left").select(F.col("fp").alias("_fp"), "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return rows.select("id", "fp").join(classes, F.col("fp").eqNullSafe(F.col("_fp"))).drop("_fp")


def split_sentences(text: str) -> list[str]:
    return [s for s in (p.strip() for p in _END.split(text)) if s]


def approximate_tokens(text: str) -> int:
    return max(1, len(text) // 2) if text else 0


def chunks(text: str | None, size: int = 400, overlap: float = 0.20, count=approximate_tokens) -> list[tuple[str, int]]:
    """(content, tokens): sentences are gathered until size is reached, so a chunk may pass it by
    a sentence; the next one starts so many sentences back that overlap is reached, and one
    sentence on at least.

    Both ends of the chunk from every sentence on are looked up in the running sums of tokens.
    """
    parts = split_sentences(text or "")
    if not parts:
        return []
    upto = np.concatenate([[0], np.cumsum([count(p) for p in parts])])
    on = np.arange(1, len(parts) + 1)
    until = np.clip(np.searchsorted(upto, upto[:-1] + size), on, len(parts))
    after = np.maximum(on, np.searchsorted(upto, upto[until] - max(0, int(np.floor(size * overlap + 0.5))), "right") - 1)
    found = [0]
    while until[found[-1]] < len(parts):
        found.append(after[found[-1]])
    return [("".join(parts[k : until[k]]), int(upto[until[k]] - upto[k])) for k in found]


class Gathered:
    """``chunks`` of sentences that come one by one: (number, content, tokens) as soon as a chunk is whole."""

    def __init__(self, size: int, overlap: float, count):
        self.size, self.back, self.count = size, max(0, int(np.floor(size * overlap + 0.5))), count
        self.parts, self.costs, self.sum, self.n, self.given = [], [], 0, 0, False

    def _whole(self) -> list[tuple[int, str, int]]:
        self.given, self.n = True, self.n + 1
        return [(self.n - 1, "".join(self.parts), int(self.sum))]

    def add(self, part: str) -> list[tuple[int, str, int]]:
        part, out = part.strip(), []
        if not part:
            return out
        while self.given:  # so the last chunk does not end the text: the next starts so far back, and one on at least
            first, kept = len(self.parts), 0
            while first > 1 and kept < self.back:
                first -= 1
                kept += self.costs[first]
            self.parts, self.costs, self.sum, self.given = self.parts[first:], self.costs[first:], kept, False
            if self.parts and self.sum >= self.size:
                out += self._whole()
        self.parts.append(part)
        self.costs.append(self.count(part))
        self.sum += self.costs[-1]
        return out + (self._whole() if self.sum >= self.size else [])

    def rest(self) -> list[tuple[int, str, int]]:
        return self._whole() if self.parts and not self.given else []


def _chunk_rows(ids: list[pa.Array], numbers: list[int], rows: list[tuple[int, str, int]]) -> pa.RecordBatch:
    pos, content, tokens = zip(*rows)
    own = pa.concat_arrays(ids).take(pa.array(numbers, pa.int64()))
    return pa.RecordBatch.from_arrays([own, pa.array(pos, pa.int32()), pa.array(content, pa.string()), pa.array(tokens, pa.int32())], ["doc_id", "pos", "content", "tokens"])


def chunk_documents(docs: DataFrame, size: int = 400, overlap: float = 0.20, count=approximate_tokens) -> DataFrame:
    """doc_id, chunk_no (from 1), chunk_id, content, tokens for docs(doc_id, text). count: tokens of a string."""

    # Spark cuts at sentence marks; a task's sentences pass a worker in order, which holds a chunk's.
    parts = F.split("text", _END.pattern)
    rows = docs.where("text is not null").select("doc_id", F.posexplode(parts).alias("pos", "part"))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        own, ids, found = None, None, []
        for b in batches:
            rows, numbers = [], []
            for k, (pos, part) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if pos == 0:
                    if own is not None:
                        rows += own.rest()
                        numbers += [number] * (len(rows) - len(numbers))
                    own, number = Gathered(size, overlap, count), len(found)
                    found.append(b.column(0).slice(k, 1))
                rows += own.add(part)
                numbers += [number] * (len(rows) - len(numbers))
            if rows:
                yield _chunk_rows(found, numbers, rows)
            found, number = ([found[number]], 0) if found else ([], 0)
        if own is not None and (rows := own.rest()):
            yield _chunk_rows(found, [number] * len(rows), rows)

    return _named(rows.mapInArrow(run, f"doc_id {kind}, {_CHUNK}"))


def chunk_lines(lines: DataFrame, order: tuple[str, ...], size: int = 400, overlap: float = 0.20, count=approximate_tokens) -> DataFrame:
    """``chunk_documents`` of texts that come as lines(doc_id, line, ..) by order: lines without blanks at their
    ends, of which blank ones together stand for one, as ``clean`` joins them.

    Lines are shuffled by their document and sorted; a worker then holds a sentence and a chunk, not a text.
    """
    kind = dict(lines.dtypes)["doc_id"]
    rows = lines.repartition("doc_id").sortWithinPartitions("doc_id", *order).select("doc_id", F.posexplode(F.split("line", _END.pattern)).alias("pos", "part"))

    def run(batches):
        own, now, found, held, blank = None, None, [], [], False
        for b in batches:
            rows, numbers = [], []
            for k, (doc, pos, part) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                if own is None or doc != now:
                    if own is not None:
                        rows += own.add("".join(held)) + own.rest()
                        numbers += [number] * (len(rows) - len(numbers))
                    own, now, number, held, blank = Gathered(size, overlap, count), doc, len(found), [], False
                    found.append(b.column(0).slice(k, 1))
                if pos:  # what came before in this line ended a sentence
                    rows += own.add("".join(held))
                    numbers += [number] * (len(rows) - len(numbers))
                    held = []
                elif not part:
                    blank = True
                    continue
                elif held:
                    held.append("\n\n" if blank else "\n")
                blank = False
                held.append(part)
            if rows:
                yield _chunk_rows(found, numbers, rows)
            found, number = ([found[number]], 0) if found else ([], 0)
        if own is not None and (rows := own.add("".join(held)) + own.rest()):
            yield _chunk_rows(found, [number] * len(rows), rows)

    return _named(rows.mapInArrow(run, f"doc_id {kind}, {_CHUNK}"))


_CHUNK = "pos int, content string, tokens int"


def _named(rows: DataFrame) -> DataFrame:
    name = F.concat(F.lit("chunk-"), F.substring(F.sha2(F.concat_ws("/", F.col("doc_id"), F.col("pos") + 1), 256), 1, 16))
    return rows.select("doc_id", (F.col("pos") + 1).alias("chunk_no"), name.alias("chunk_id"), "content", "tokens")
