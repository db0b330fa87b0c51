"""Which of many strings stand in which of many texts, exactly and at any size of either side.

Strings that are few by count (BLOCK) and by characters are sent to every task as an automaton,
which reads each text once. More strings are sought by a join, with the same result:

Strings of GRAM characters at most, by a trie of hashes: from every place of a text a hash grows by a
character at a time and goes on while some string begins so; where it may be a string's, the characters
themselves are a candidate, and one shuffle by them finds which candidates are strings. What begins and
what ends a string goes to the tasks as two bitmaps of fixed size, of which the second is asked PROBES
times, so that few candidates are none; where very many strings fill them, more rows are shuffled and
the result is the same. What is shuffled grows with the result, and a text is read once.

Longer strings, by an inverted table of their rarest grams: a gram is GRAM characters, and every string
is filed under the one of its grams that fewest texts hold, by a count over all texts that each task
adds up before it is shuffled. The texts give the grams that they hold of these; pairs that share one
are verified by searching the text. A gram is a 64-bit hash, and which hashes are asked for goes to the
tasks as a bitmap, too. Texts are read three times, to count grams, to find candidates and to verify
them. A gram that many texts hold is spread over SALTS parts, and the strings filed under it are copied
to each.

Strings of the join stay in DataFrames, whatever their number; the driver holds the bitmaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut, workers_import

#: Strings of an automaton, and their characters: what a task holds besides a batch of texts.
BLOCK, CHARACTERS = 100_000, 1 << 24
#: Characters of a gram, and parts that texts of a common one are spread over.
GRAM, SALTS = 32, 32
#: Characters after which a place goes on only if a string begins so, and bits that a whole string sets.
STEPS, PROBES = (2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 28), 4
#: Texts of a gram from which it is spread.
COMMON = 1000
#: Bits of the bitmap, of which Spark's functions make buckets of 2**15.
BITS = 1 << 27
#: Characters of texts that are cut into grams at once, and grams that a task counts before it passes them on.
AT_ONCE, COUNTED = 1 << 20, 1 << 20
_U = np.uint64


class _Plain:
    """The same answers, string after string, where the automaton package is missing."""

    def __init__(self, needles: list[str]):
        self.needles = needles

    def iter(self, text: str):
        return ((0, n) for n in self.needles if n in text)


def _automaton(needles: list[str]):
    try:
        import ahocorasick
    except ImportError:
        return _Plain(needles)
    found = ahocorasick.Automaton()
    for n in needles:
        found.add_word(n, n)
    found.make_automaton()
    return found


def _sought(shared):
    def run(batches):
        automaton = _automaton(shared.value)
        for b in batches:
            ids, texts = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                hits = {n for _, n in automaton.iter(text)} if text else ()
                ids += [k] * len(hits)
                texts += hits
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(texts, pa.string())], ["id", "needle"])

    return run


def _longer(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one code point longer."""
    h = (h ^ points) * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(29))


def hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n of these code points: of two halves, of which an odd run's overlap."""
    width = max(0, len(points) - n + 1)
    if not width:
        return np.zeros(0, _U)
    h, m = _longer(np.full(len(points), n, _U), points.astype(_U)), 1
    while m < n:
        step = min(m, n - m)
        h = _longer(h[: len(h) - step] * _U(0xC2B2AE3D27D4EB4F), h[step:])
        m += step
    return h


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(needle) → (needle, its different grams)."""
    for b in batches:
        own = [np.unique(hashes(p, min(len(p), GRAM))).view(np.int64) for p in map(_points, b.column(0).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int64()))], ["needle", "grams"])


def _asked_of(points: np.ndarray, sizes: list[int], bitmap: np.ndarray) -> np.ndarray:
    """The different grams of a text that the bitmap has."""
    found = [np.zeros(0, _U)]
    for n in sizes:
        for k in range(0, max(0, len(points) - n + 1), AT_ONCE):
            h = hashes(points[k : k + AT_ONCE + n - 1], n)
            at = h & _U(BITS - 1)
            found.append(np.unique(h[bitmap[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1 > 0]))
    return np.unique(np.concatenate(found))


def _counted(shared, sizes: list[int]):
    """(id, of, text) → (gram, n): texts that hold a gram, added up over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = np.zeros(0, _U), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(counts)], ["gram", "n"])

        for b in batches:
            own = np.concatenate([np.zeros(0, _U), *(_asked_of(_points(t), sizes, shared.value) for t in b.column(2).to_pylist())])
            fresh, times = np.unique(own, return_counts=True)
            both, at = np.unique(np.concatenate([grams, fresh]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, times]), len(both)).astype(np.int64)
            grams = both
            if len(grams) > COUNTED:
                yield rows()
                grams, counts = np.zeros(0, _U), np.zeros(0, np.int64)
        yield rows()

    return run


def _held(shared, sizes: list[int]):
    """(id, of, text) → (id, of, gram) for the different grams of the text that the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [_asked_of(_points(t), sizes, shared.value) for t in b.column(2).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(own)), list(map(len, own))))
            flat = np.concatenate([np.zeros(0, _U), *own]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(flat)], ["id", "of", "gram"])

    return run


def _begun(n: int, h: np.ndarray) -> np.ndarray:
    """What stands in the bitmap of beginnings for hashes of n characters."""
    return (h + _U(n)) * _U(0xC2B2AE3D27D4EB4F) >> _U(31)


def _probed(h: np.ndarray, k: int) -> np.ndarray:
    """What a whole string's hash sets as its k-th bit."""
    return (h ^ h >> _U(32)) * _U(0xD6E8FEB86659FD93 + 2 * k) >> _U(23)


def _bit(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & _U(BITS - 1)
    return bitmap[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1 > 0


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(needle) → (whole, gram): the bits that needles set among whole ones and among beginnings."""
    for b in batches:
        own, whole, begun = b.column(0).to_pylist(), [], []
        points, size = _points("".join(own)).astype(_U), np.array(list(map(len, own)), np.int64)
        first, h = np.cumsum(size) - size, np.full(len(own), GRAM, _U)
        for n in range(1, max(size, default=0) + 1):
            first, h, size = first[size >= n], h[size >= n], size[size >= n]
            h = _longer(h, points[first + (n - 1)])
            whole += [_probed(h[size == n], k) for k in range(PROBES)]
            if n in STEPS:
                begun.append(_begun(n, h[size > n]))
        whole = np.concatenate([np.zeros(0, _U), *whole])
        both = np.concatenate([whole, *begun]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both)) < len(whole)), pa.array(both)], ["whole", "gram"])


def _candidates(points: np.ndarray, starts: int, sizes: list[int], whole: np.ndarray, begun: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Places below starts at which n characters may be a string, and n."""
    at, h = np.arange(starts), np.full(starts, GRAM, _U)
    for n in range(1, sizes[-1] + 1):
        here = np.searchsorted(at, len(points) - n, "right")
        at, h = at[:here], h[:here]
        h = _longer(h, points[at + (n - 1)].astype(_U))
        if n in sizes:
            hits = np.flatnonzero(_bit(whole, _probed(h, 0)))
            for k in range(1, PROBES):
                hits = hits[_bit(whole, _probed(h[hits], k))]
            yield at[hits], n
        if n in STEPS:
            on = _bit(begun, _begun(n, h))
            at, h = at[on], h[on]


def _spelt(shared, sizes: list[int]):
    """(id, text) → (id, needle) for the different candidates of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, begun = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            all_, ends = "".join(texts), np.cumsum(list(map(len, texts)))
            found: set[tuple[int, str]] = set()
            for k in range(0, len(all_), AT_ONCE):
                points = _points(all_[k : k + AT_ONCE + GRAM])
                for at, n in _candidates(points, min(AT_ONCE, len(points)), sizes, whole, begun):
                    of = np.searchsorted(ends, at + k, "right")
                    own = at + (k + n) <= ends[of]  # not over the end of its text
                    found.update(zip(of[own].tolist(), [all_[x : x + n] for x in (at[own] + k).tolist()]))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string())], ["id", "needle"])

    return run


def _bitmap(grams: DataFrame) -> np.ndarray:
    """BITS bits, set where some gram of grams(gram) has its last bits; BITS / 8 bytes at the driver."""
    bit = F.pmod("gram", F.lit(BITS).cast("long")) + 1  # these functions count from 1
    rows = grams.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("b")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        at = (r["k"] - 1) * 4096
        out[at : at + len(r["b"])] = np.frombuffer(r["b"], np.uint8)
    return out


def filed(needles: DataFrame, rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """((gram, needle): each different needle under the gram of it that fewest of rows(id, of, text)
    hold, if any does; the lengths of grams). A needle with a gram that no text holds is in none."""
    spark = needles.sparkSession
    own = cut(needles.where("needle <> ''").select("needle").distinct())
    sizes = [r["n"] for r in own.select(F.least(F.char_length("needle"), F.lit(GRAM)).alias("n")).distinct().orderBy("n").collect()]  # GRAM at most
    cells = cut(own.mapInArrow(_asked, "needle string, grams array<long>").select("needle", F.explode("grams").alias("gram")))
    shared = spark.sparkContext.broadcast(_bitmap(cells))
    counts = rows.mapInArrow(_counted(shared, sizes), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    best = cells.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram").alias("gram"))).alias("r"))
    return best.where("r.n > 0").select("r.gram", "needle"), sizes


def contained(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(id, needle) for texts(id, text) and needles(needle): each different needle in each text.

    Nulls, and needles without a character, are in no text. Of rows that repeat an id each may hold
    a needle.
    """
    spark = texts.sparkSession
    workers_import(spark)
    own = needles.where("needle <> ''").select("needle").distinct()
    n, characters = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("needle")), F.lit(0))).first()
    rows = texts.select("id", "text")
    schema = f"id {dict(rows.dtypes)['id']}, needle string"
    if not n:
        return spark.createDataFrame([], schema)
    if n > BLOCK or characters > CHARACTERS:
        return joined(rows, own)
    some = [r["needle"] for r in own.collect()]  # BLOCK at most
    return rows.mapInArrow(_sought(spark.sparkContext.broadcast(some)), schema).distinct()


def joined(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """``contained`` by hashes of whole needles and by the longer ones' rarest grams, for any number of needles."""
    spark = texts.sparkSession
    workers_import(spark)
    rows = texts.where("id is not null and text is not null").select("id", "text")
    own = cut(needles.where("needle <> ''").select("needle").distinct())
    long = F.char_length("needle") > GRAM
    # Lengths up to GRAM, and whether there are longer ones.
    sizes = sorted(r["n"] for r in own.select(F.least(F.char_length("needle"), F.lit(GRAM + 1)).alias("n")).distinct().collect())
    short, found = [n for n in sizes if n <= GRAM], []
    if short:
        found.append(_short(rows, own.where(~long), short))
    if sizes and sizes[-1] > GRAM:
        found.append(_long(rows, own.where(long)))
    if not found:
        return spark.createDataFrame([], f"id {dict(rows.dtypes)['id']}, needle string")
    out = found[0].unionByName(found[1]) if len(found) > 1 else found[0]
    # A row gives a needle once; only rows that repeat an id can give it again.
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return out if again.isEmpty() else out.distinct()


def _short(rows: DataFrame, needles: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, needle) for needles of these lengths, which differ."""
    marks = needles.mapInArrow(_marks, "whole boolean, gram long")
    shared = rows.sparkSession.sparkContext.broadcast((_bitmap(marks.where("whole")), _bitmap(marks.where("not whole"))))
    return rows.mapInArrow(_spelt(shared, sizes), f"id {dict(rows.dtypes)['id']}, needle string").join(needles, "needle", "left_semi").select("id", "needle")


def _long(rows: DataFrame, needles: DataFrame) -> DataFrame:
    """(id, needle) for needles of GRAM characters and more, by the rarest gram of each."""
    spark = rows.sparkSession
    rows = rows.select("id", F.xxhash64("text").alias("of"), "text")
    kind = dict(rows.dtypes)["id"]
    table, sizes = filed(needles, rows)
    table = cut(table)
    shared = spark.sparkContext.broadcast(_bitmap(table))
    held = cut(rows.mapInArrow(_held(shared, sizes), f"id {kind}, of long, gram long"))
    common = cut(held.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON).select("gram", F.lit(SALTS).alias("parts")))
    copies = table.join(common, "gram", "left").select("gram", "needle", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    spread = held.join(common, "gram", "left").select("id", "of", "gram", F.pmod(F.xxhash64("id", "of"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    # Candidates of a text come together, so that it is fetched once, whatever it holds.
    lists = spread.join(copies, ["gram", "part"]).groupBy("id", "of").agg(F.collect_set("needle").alias("needles"))
    found = rows.join(lists, ["id", "of"]).select("id", F.explode(F.filter("needles", lambda n: F.contains(F.col("text"), n))).alias("needle"))
    return found.distinct()
