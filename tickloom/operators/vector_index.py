"""An inverted-file index of vectors: every row in the list of its nearest centroid, lists as folders.

``write`` fits centroids by spherical k-means over a bounded sample (SAMPLE rows, the first by a
hash of their id, so that reruns agree) and files every row of the corpus, sampled or not, under
its list. ``search`` reads the folders of each query's nearest lists only and scores what lies
there exactly, as ``retrieval.vector_topk`` does. With all lists probed both give the same rows;
with fewer, rows whose list is not probed are missed: ``recall`` measures how many. How many lists
a query needs depends on the vectors: ``write`` finds the least number that gives TARGET of the
sample's own neighbours to JUDGES of its rows and stores it with the centroids. Neighbours in a
sample are farther apart than in the corpus, so the corpus needs no more.

Centroids (LISTS at most) are the only thing that every task gets. Lists of any length are cut into
tiles that are dealt to tasks, so a crowded list is not one task's work. Vectors of several
lengths share an index, each length with centroids of its own; a length that the sample lacks is
one list. Null vectors and ids are left out. Zero vectors lie in the first list of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.retrieval import QUERIES, TILE, best_of_tiles, top
from tickloom.session import workers_import
from tickloom.sources.sinks import exists, remove

#: Rows that centroids are fitted on, lists at most, and rounds of the fit.
SAMPLE, LISTS, ROUNDS = 32_768, 4096, 10
#: Similarities that the driver holds at once.
AT_ONCE = 1 << 22
#: What calibration asks for, of how many rows' how many neighbours.
TARGET, JUDGES, NEIGHBOURS = 0.95, 500, 20
#: Copies of vectors that a task hands on at once.
ROWS = 1 << 13
#: Tasks that write one list.
WRITERS = 8


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm == 0, 1, norm)


def _parts(rows: int, columns: int) -> Iterator[slice]:
    """Slices of rows whose similarities to so many columns are AT_ONCE, about."""
    step = max(1, AT_ONCE // max(1, columns))
    return (slice(k, k + step) for k in range(0, rows, step))


def closest(own: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.concatenate([(own[p] @ found.T).argmax(axis=1) for p in _parts(len(own), len(found))])


def centroids(vectors: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by cosine; they start evenly spread over the rows, and empty ones keep their place."""
    own = unit(np.asarray(vectors, np.float64))
    found = own[np.linspace(0, len(own) - 1, min(lists, len(own))).astype(int)].copy()
    for _ in range(rounds):
        at = closest(own, found)
        sums = np.zeros_like(found)
        np.add.at(sums, at, own)
        some = np.linalg.norm(sums, axis=1) > 0
        found[some] = unit(sums[some])
    return found


class Lists:
    """Centroids by length of vector, and the first list's number of each."""

    def __init__(self, rows: list[tuple[int, int, list[float], int]]):
        by: dict[int, list] = {}
        for dim, number, vector, probes in sorted(rows):
            by.setdefault(dim, []).append((number, vector))
        self.probes = {dim: probes for dim, _, _, probes in rows}
        self.first = {dim: cells[0][0] for dim, cells in by.items()}
        self.centroids = {dim: np.array([v for _, v in cells], np.float64) for dim, cells in by.items()}

    def nearest(self, vectors: list, n: int | None) -> list[list[int]]:
        """The numbers of the n nearest lists of each vector; n None: as many as its length needs."""
        out: list = [None] * len(vectors)
        sizes = np.array([len(v) for v in vectors])
        for dim in set(sizes.tolist()):
            at = np.flatnonzero(sizes == dim)
            if dim not in self.centroids:  # not in the sample: one list, below zero
                for k in at:
                    out[k] = [-1 - dim]
                continue
            near = unit(np.array([vectors[k] for k in at], np.float64)) @ self.centroids[dim].T
            order = np.argsort(-near, axis=1, kind="stable")[:, : n or self.probes[dim]] + self.first[dim]
            for k, own in zip(at, order.tolist()):
                out[k] = own
        return out


def probes_for(vectors: np.ndarray, found: np.ndarray, target: float = TARGET) -> int:
    """The least number of nearest lists that hold target of the rows' nearest neighbours, on average."""
    own = unit(np.asarray(vectors, np.float64))
    at = closest(own, found)
    judges = own[np.linspace(0, len(own) - 1, min(JUDGES, len(own))).astype(int)]
    needed = []
    for p in _parts(len(judges), max(len(own), len(found))):
        place = np.argsort(np.argsort(-(judges[p] @ found.T), axis=1, kind="stable"), axis=1)  # of each list for each judge
        score = judges[p] @ own.T
        near = np.argpartition(-score, min(NEIGHBOURS, score.shape[1]) - 1, axis=1)[:, :NEIGHBOURS]
        needed.append(np.take_along_axis(place, at[near], axis=1).ravel())
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def _filed(shared, n: int | None, name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # A row comes once a list, with its vector: so few at a time that all lists' copies are ROWS.
            step = max(1, ROWS // (n or max(shared.value.probes.values(), default=1)))
            for part in (pdf.iloc[a : a + step] for a in range(0, len(pdf), step)):
                lists = shared.value.nearest(part["vector"].tolist(), n)
                yield part.assign(list=pd.Series(lists, index=part.index, dtype=object)).explode("list").astype({"list": "int32"})[["list", name, "vector"]]

    return run


def _assigned(rows: DataFrame, name: str, lists: Lists, n: int | None) -> DataFrame:
    spark = rows.sparkSession
    workers_import(spark)
    own = rows.where(F.col("vector").isNotNull() & F.col(name).isNotNull()).select(name, F.col("vector").cast("array<double>").alias("vector"))
    return own.mapInPandas(_filed(spark.sparkContext.broadcast(lists), n, name), f"list int, {name} {dict(rows.dtypes)[name]}, vector array<double>")


def _lists(spark: SparkSession, path: str) -> Lists:
    rows = spark.read.parquet(f"{path}-lists").collect()  # LISTS and the sample's lengths, at most
    return Lists([(r["dim"], r["list"], r["vector"], r["probes"]) for r in rows])


def fit(corpus: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """(dim, list, vector, probes): centroids and the length's number of probes. lists: a root of the
    rows, LISTS at most, where it is not given."""
    own = corpus.where("vector is not null and chunk_id is not null")
    n = own.count()
    wanted = min(lists or max(1, round(n**0.5)), LISTS)
    some = own.orderBy(F.xxhash64("chunk_id"), "chunk_id").select(F.col("vector").cast("array<double>").alias("vector")).limit(sample).toArrow()["vector"]
    by: dict[int, list] = {}
    for v in some.chunks:
        flat, ends = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
        for a, b in zip(ends, ends[1:]):
            by.setdefault(int(b - a), []).append(flat[a:b])
    rows, number = [], 0
    for dim, vectors in sorted(by.items()):
        own = np.array(vectors)
        found = centroids(own, max(1, round(wanted * len(own) / len(some))))
        probes = probes_for(own, found)
        for c in found:
            rows.append((dim, number, c.tolist(), probes))
            number += 1
    return corpus.sparkSession.createDataFrame(rows, "dim int, list int, vector array<double>, probes int")


def write(corpus: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, add: bool = False) -> None:
    """Index corpus(chunk_id, vector) at path. add keeps what is there and its centroids; ids that are
    there already are replaced."""
    spark = corpus.sparkSession
    if not (add and exists(spark, path)):
        remove(spark, path)
        fit(corpus, lists, sample).write.mode("overwrite").parquet(f"{path}-lists")
        add = False
    rows = _assigned(corpus, "chunk_id", _lists(spark, path), 1)
    batch = spark.read.parquet(path).agg(F.max("added")).first()[0] + 1 if add else 0
    rows = rows.select("*", F.lit(batch).alias("added")).repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(WRITERS)))
    rows.sortWithinPartitions("list").write.mode("append").partitionBy("list").parquet(path)


def _live(spark: SparkSession, path: str) -> DataFrame:
    """The index without rows of an id that was added again."""
    rows = spark.read.parquet(path)
    if not rows.where("added > 0").isEmpty():
        last = rows.groupBy("chunk_id").agg(F.max("added").alias("added"))
        rows = rows.join(last, ["chunk_id", "added"], "left_semi")
    return rows.select("list", "chunk_id", "vector")


def search(queries: DataFrame, path: str, k: int = 20, probes: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank for queries(query_id, vector), as ``retrieval.vector_topk``
    from the probes nearest lists of each query, by default as many as ``write`` found to be needed."""
    spark = queries.sparkSession
    lists = _lists(spark, path)
    asked = _assigned(queries, "query_id", lists, probes)
    wanted = [r["list"] for r in asked.select("list").distinct().collect()]  # LISTS, and lengths, at most
    rows = _live(spark, path).where(F.col("list").isin(wanted))
    sizes = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("n"))  # one row a list
    tiles = rows.join(F.broadcast(sizes), "list").groupBy("list", F.pmod(F.xxhash64("chunk_id"), "n").alias("corpus_no"))
    tiles = tiles.agg(F.collect_list(F.struct(F.col("chunk_id").alias("id"), "vector")).alias("corpus"))
    sizes = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("n"))
    blocks = asked.join(F.broadcast(sizes), "list").groupBy("list", F.pmod(F.xxhash64("query_id"), "n").alias("asked_no"))
    blocks = blocks.agg(F.collect_list(F.struct(F.col("query_id").alias("id"), "vector")).alias("asked"))
    types = dict(queries.dtypes)["query_id"], dict(rows.dtypes)["chunk_id"]
    return top(best_of_tiles(blocks, tiles, "list", k, *types), k, "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact(query_id, chunk_id) that found has."""
    hit = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return float(hit.agg(F.coalesce(F.sum("hit") / F.count(F.lit(1)), F.lit(1.0))).first()[0])
