"""Exact nearest vectors in few dimensions, by boxes of a k-d partition.

``topk`` gives the rows of ``retrieval.vector_topk`` without comparing every query with every
vector. Unit vectors are dealt to cells by a k-d tree that is fitted on a bounded sample (SAMPLE rows,
the first by a hash of the vector), every row of the corpus to one cell, and cells are cut into tiles.
A tile's box bounds the cosine of whatever lies in it: (2 - d * d) / 2 where the box is d away.

1. The tiles with the best bounds that hold k vectors give each query a score that k rows reach.
2. Tiles whose bound can still reach it, rounded as scores are, are searched; no others can matter.

In up to some ten dimensions these are a few tiles; in many, boxes bound little and nearly all tiles are
searched. Of equal vectors the k smallest ids are all that a result can hold, and equal queries
have equal results, so that copies cost nothing. The driver and each task hold the tree (CELLS at
most) and one box a tile. Null vectors and ids, and vectors with a component that is not finite, match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.retrieval import QUERIES, TILE, best_of_tiles, top
from tickloom.operators.vector_index import unit
from tickloom.session import cut, workers_import

#: Rows that the tree is fitted on, its cells at most, and vectors of a cell that are wanted.
SAMPLE, CELLS, WANTED = 32_768, 4096, 1024
#: What cosines, times a million, may differ by.
MARGIN = 1e-3
#: Distances of queries to boxes that a task holds at once.
AT_ONCE = 1 << 20


def tree(vectors: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, threshold) of the inner nodes of a complete binary tree: medians of the widest dimension."""
    dims, ends = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    rows = [np.arange(len(vectors))]
    for node in range(len(dims)):
        own = vectors[rows[node]]
        if len(own):
            dims[node] = np.argmax(own.max(axis=0) - own.min(axis=0))
            ends[node] = np.median(own[:, dims[node]])
        right = own[:, dims[node]] > ends[node]
        rows += [rows[node][~right], rows[node][right]]
    return dims, ends


def cell_of(vectors: np.ndarray, dims: np.ndarray, ends: np.ndarray) -> np.ndarray:
    node = np.zeros(len(vectors), np.int64)
    for _ in range((len(dims) + 1).bit_length() - 1):
        node = 2 * node + 1 + (vectors[np.arange(len(vectors)), dims[node]] > ends[node])
    return node - len(dims)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest rounded score, in millionths, that a unit vector of each box can have with each query."""
    apart = np.zeros((len(queries), len(low)))
    for k in range(queries.shape[1]):
        apart += np.maximum(0, np.maximum(low[None, :, k] - queries[:, None, k], queries[:, None, k] - high[None, :, k])) ** 2
    return np.floor((2 - apart / 2) / 2 * 1e6 + 0.5 + MARGIN)


def _dealt(shared, name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=cell_of(unit(np.array(pdf["vector"].tolist(), np.float64)), *shared.value))[["cell", name, "vector"]]

    return run


def _boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            own = unit(np.array([c["vector"] for c in r.corpus], np.float64))
            yield pd.DataFrame({"tile": [r.tile], "n": [len(own)], "low": [own.min(axis=0)], "high": [own.max(axis=0)]})


def _slices(pdf: pd.DataFrame, boxes: int) -> Iterator[pd.DataFrame]:
    step = max(1, AT_ONCE // max(1, boxes))
    return (pdf.iloc[a : a + step] for a in range(0, len(pdf), step))


def _reaching(shared, k: int, first: bool):
    """(query_id, vector, need) → (tile, query_id, vector): the first tiles, or all that can reach need."""
    tiles, sizes, low, high = shared.value

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own in _slices(pdf, len(tiles)):
                best = bounds(unit(np.array(own["vector"].tolist(), np.float64)), low, high)
                if first:
                    order = np.argsort(-best, axis=1, kind="stable")
                    held = np.cumsum(sizes[order], axis=1)
                    i, j = np.nonzero(held - sizes[order] < k)
                    j = order[i, j]
                else:
                    i, j = np.nonzero(best >= own["need"].to_numpy()[:, None])
                for a in range(0, len(i), 1 << 16):
                    part = own.iloc[i[a : a + (1 << 16)]]
                    yield pd.DataFrame({"tile": tiles[j[a : a + (1 << 16)]], "query_id": part["query_id"].to_numpy(), "vector": part["vector"].to_numpy()})

    return run


def topk(queries: DataFrame, corpus: DataFrame, k: int = 20) -> DataFrame:
    """query_id, chunk_id, score, rank as ``retrieval.vector_topk`` of queries(query_id, vector) and
    corpus(chunk_id, vector), where all vectors have one length."""
    spark = queries.sparkSession
    workers_import(spark)
    finite = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kinds = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["chunk_id"]
    # Of equal vectors the k smallest ids.
    copies = Window.partitionBy("vector").orderBy("chunk_id")
    own = corpus.where(finite & F.col("chunk_id").isNotNull()).select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    own = cut(own.withColumn("_r", F.row_number().over(copies)).where(F.col("_r") <= k).drop("_r"))
    asked = queries.where(finite & F.col("query_id").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    same = cut(asked.groupBy("vector").agg(F.min("query_id").alias("query_id")))
    n = own.count()
    if not n:
        return spark.createDataFrame([], f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double, rank int")
    depth = max(0, min(CELLS, n // WANTED).bit_length() - 1)
    some = unit(np.array([r["vector"] for r in own.orderBy(F.xxhash64("vector"), "chunk_id").select("vector").limit(SAMPLE).collect()], np.float64))
    shared = spark.sparkContext.broadcast(tree(some, depth))
    cells = cut(own.mapInPandas(_dealt(shared, "chunk_id"), f"cell long, chunk_id {kinds[1]}, vector array<double>"))
    parts = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("n"))
    tile = F.concat_ws("/", "cell", F.pmod(F.xxhash64("chunk_id"), "n")).alias("tile")
    tiles = cells.join(F.broadcast(parts), "cell").groupBy(tile).agg(F.collect_list(F.struct(F.col("chunk_id").alias("id"), "vector")).alias("corpus"))
    tiles = cut(tiles.withColumn("corpus_no", F.lit(0)))
    boxes = tiles.select("tile", "corpus").mapInPandas(_boxes, "tile string, n long, low array<double>, high array<double>").orderBy("tile").toPandas()  # a row a tile
    shared = spark.sparkContext.broadcast((boxes["tile"].to_numpy(), boxes["n"].to_numpy(), np.array(boxes["low"].tolist()), np.array(boxes["high"].tolist())))

    def best(rows: DataFrame, first: bool) -> DataFrame:
        met = cut(rows.mapInPandas(_reaching(shared, k, first), f"tile string, query_id {kinds[0]}, vector array<double>"))
        sizes = met.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("n"))  # a row a tile
        blocks = met.join(F.broadcast(sizes), "tile").groupBy("tile", F.pmod(F.xxhash64("query_id"), "n").alias("asked_no"))
        blocks = blocks.agg(F.collect_list(F.struct(F.col("query_id").alias("id"), "vector")).alias("asked"))
        return top(best_of_tiles(blocks, tiles, "tile", k, *kinds), k, "score")

    need = best(same, True).groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.floor(F.col("score") * 1e6 + 0.5))).alias("need"))
    found = best(same.join(need, "query_id", "left").select("query_id", "vector", F.coalesce("need", F.lit(-1)).alias("need")), False)
    names = asked.join(same.select("vector", F.col("query_id").alias("_same")), "vector").select("query_id", "_same")
    return names.join(found.withColumnRenamed("query_id", "_same"), "_same").select("query_id", "chunk_id", "score", "rank")
