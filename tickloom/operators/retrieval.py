"""Vector and BM25 search, rank fusion, boosts, near-duplicate penalty and reranking.

Corpora are DataFrames of chunks; queries are DataFrames too, many at a time. Every score is
followed by the chunk id as tie-break, so that results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as _arrow_type

from tickloom.functions.numeric import half_up
from tickloom.functions.text import recency, terms
from tickloom.operators import text_prep
from tickloom.session import cut, workers_import


@dataclass(frozen=True)
class Fusion:
    vector_weight: float = 0.7
    bm25_weight: float = 0.3
    code_boost: float = 0.30
    name_boost: float = 0.25
    duplicate_penalty: float = 0.50
    limit: int = 30
    bm25_k: int = 20
    k1: float = 1.2
    b: float = 0.75


def top(rows: DataFrame, k: int, by: str, group: str = "query_id", tie: str = "chunk_id", rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(by), F.asc(tie))
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


#: Vectors in a block of queries and in a tile of the corpus, and queries whose products a task holds at once.
QUERIES, TILE, AT_ONCE = 1024, 4096, 128


def _blocks(rows: DataFrame, ident: str, size: int, name: str) -> DataFrame:
    """(size of the vectors, number of the block, array of structs of ident and vector)."""
    spark, own = rows.sparkSession, rows.where("vector is not null").select(ident, "vector")
    n = F.lit(max(1, -(-own.count() // size)))
    return own.groupBy(F.size("vector").alias("dim"), F.pmod(F.xxhash64(ident), n).alias(f"{name}_no")).agg(F.collect_list(F.struct(F.col(ident).alias("id"), "vector")).alias(name))


def _similar(k: int):
    def unit(cells) -> tuple[np.ndarray, np.ndarray]:
        v = np.array([c["vector"] for c in cells], np.float64)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        ids = np.array([c["id"] for c in cells], dtype=object)
        return ids, v / np.where(norm == 0, 1, norm)

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                (asked, q), (ids, own) = unit(r.asked), unit(r.corpus)
                order = np.argsort(ids, kind="stable")  # of equal scores the smaller id comes first
                ids, own = ids[order], own[order]
                for a in range(0, len(q), AT_ONCE):
                    score = np.floor((q[a : a + AT_ONCE] @ own.T + 1) / 2 * 1e6 + 0.5)
                    score[np.isnan(score)] = -1  # of vectors that are not finite: no hits
                    # Scores that reach the k-th best, of which the first k by score and place.
                    last = np.partition(score, len(own) - k, axis=1)[:, len(own) - k] if k < len(own) else score.min(axis=1)
                    i, j = np.nonzero(score >= last[:, None])
                    order = np.lexsort((j, -score[i, j], i))
                    i, j = i[order], j[order]
                    best = (np.arange(len(i)) - np.searchsorted(i, i) < k) & (score[i, j] >= 0)
                    i, j = i[best], j[best]
                    yield pd.DataFrame({"query_id": asked[a + i], "chunk_id": ids[j], "score": score[i, j] / 1e6})

    return run


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 20) -> DataFrame:
    """query_id, chunk_id, score ((cosine + 1) / 2, to 6 decimals), rank.

    queries(query_id, vector), corpus(chunk_id, vector). Blocks of queries meet tiles of the
    corpus, each pair a row dealt to some task, which returns the k best of the tile for each
    query by the rounded score and the chunk id; the k best of these follow. No vector reaches
    the driver. Null vectors and those of another length than the query's match nothing.
    """
    asked, tiles = _blocks(queries, "query_id", QUERIES, "asked"), _blocks(corpus, "chunk_id", TILE, "corpus")
    return top(best_of_tiles(asked, tiles, "dim", k, dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["chunk_id"]), k, "score")


def best_of_tiles(asked: DataFrame, tiles: DataFrame, key: str, k: int, query_type: str, chunk_type: str) -> DataFrame:
    """query_id, chunk_id, score: the k best of each tile for each query of the blocks with the same key.

    asked(key, asked_no, asked), tiles(key, corpus_no, corpus). Pairs are dealt by their numbers
    before vectors meet them, so that one key's pairs are not one task's.
    """
    width = max(1, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbers = asked.select(key, "asked_no").join(tiles.select(key, "corpus_no"), key).repartition(width, F.xxhash64(key, "asked_no", "corpus_no"))
    pairs = numbers.join(asked, [key, "asked_no"]).join(tiles, [key, "corpus_no"])
    return pairs.select("asked", "corpus").mapInPandas(_similar(k), f"query_id {query_type}, chunk_id {chunk_type}, score double")


#: A term that no text has: its postings are one a chunk.
EVERY = ""


def postings(corpus: DataFrame, only: DataFrame | None = None, every: bool = False, cut_by: Callable[[Column], Column] = terms) -> DataFrame:
    """term, chunk_id, tf, dl for corpus(chunk_id, content): an index to be written by term.

    only(term): other terms go before anything is shuffled or counted. every: EVERY is in each chunk,
    so that lengths come from the same reading of the texts. cut_by: terms of a text's column.
    """
    own = cut_by(F.col("content"))
    rows = corpus.where("chunk_id is not null and content is not null").select("chunk_id", own.alias("_t"))
    rows = rows.select("chunk_id", F.size("_t").alias("dl"), F.explode(F.concat(F.array(F.lit(EVERY)), "_t") if every else F.col("_t")).alias("term"))
    if only is not None:
        rows = rows.join(only, "term", "left_semi")
    return rows.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))


def counted(corpus: DataFrame) -> DataFrame:
    """``postings`` of each row of corpus by itself, without a shuffle: an id that repeats has rows of its own."""
    workers_import(corpus.sparkSession)
    own = corpus.where("chunk_id is not null and content is not null").select("chunk_id", terms(F.col("content")).alias("terms"))

    def run(batches):
        for b in batches:
            dl, n = pc.list_value_length(b.column(1)).to_numpy(), b.num_rows
            coded = b.column(1).flatten().dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.int64)
            cells, tf = np.unique(np.repeat(np.arange(n), dl) * len(coded.dictionary) + codes, return_counts=True)
            if len(cells):
                row, code = np.divmod(cells, len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code)), b.column(0).take(pa.array(row)), pa.array(tf.astype(np.int64)), pa.array(dl[row].astype(np.int32))], ["term", "chunk_id", "tf", "dl"])

    return own.mapInArrow(run, f"term string, chunk_id {own.schema['chunk_id'].dataType.simpleString()}, tf long, dl int")


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int = 20, fusion: Fusion = Fusion(), cut_by: Callable[[Column], Column] = terms) -> DataFrame:
    """query_id, chunk_id, score (to 6 decimals), rank for queries(query_id, text).

    Repeated query terms add up; blank queries match nothing. Texts are cut into terms once:
    postings are cut to the queries' terms before anything is aggregated over terms, with one row
    a chunk for its length. ``word_index`` searches a stored index by bounds instead. cut_by: how texts
    become terms, ``segment.cutter`` for words of unspaced text.
    """
    asked = cut(asked_terms(queries, cut_by))
    if asked.count() <= ASKED:
        found = _by_chunk(asked, corpus, k, fusion, cut_by)
        if found is not None:
            return found
    wanted = asked.select("term").union(queries.sparkSession.createDataFrame([(EVERY,)], "term string")).distinct()
    rows = cut(postings(corpus, wanted, True, cut_by))
    n, words = rows.where(F.col("term") == EVERY).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return scored(asked, rows.where(F.col("term") != EVERY), n, words, k, fusion)


#: Different (query, term) up to which every task gets them all; scores that a task holds at once, and hits before it drops some.
ASKED, SCORES, HITS = 100_000, 1 << 21, 1 << 18


def _by_chunk(asked: DataFrame, corpus: DataFrame, k: int, fusion: Fusion, cut_by: Callable[[Column], Column]) -> DataFrame | None:
    """bm25_topk where every task gets asked(query_id, term, qtf): a chunk's terms are in one row, so that
    its scores are summed where it is read, and only each task's k best of a query are shuffled. None where rows repeat an id."""
    spark = corpus.sparkSession
    numbers = {r["term"]: i for i, r in enumerate(asked.select("term").distinct().orderBy("term").collect())}  # ASKED at most
    wanted = spark.createDataFrame(list(numbers.items()), "term string, no int")
    own = corpus.where("chunk_id is not null and content is not null").select("chunk_id", cut_by(F.col("content")).alias("_t"))
    shared = spark.sparkContext.broadcast(numbers)

    def counted(batches):
        for b in batches:
            texts = b.column(1)
            terms_, ends = texts.flatten(), np.concatenate([[0], np.cumsum(texts.value_lengths().to_numpy(zero_copy_only=False))])
            known = shared.value
            own_no = np.array([known.get(t, -1) for t in terms_.to_pylist()], np.int64)
            row = np.repeat(np.arange(len(texts)), np.diff(ends))[own_no >= 0]
            cells, tf = np.unique(row * (len(known) + 1) + own_no[own_no >= 0], return_counts=True)
            at = np.searchsorted(cells, np.arange(len(texts) + 1) * (len(known) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (cells % (len(known) + 1), tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends).astype(np.int32)), *lists], ["chunk_id", "dl", "no", "tf"])

    kind = dict(corpus.dtypes)["chunk_id"]
    workers_import(spark)
    rows = cut(own.mapInArrow(counted, f"chunk_id {kind}, dl int, no array<int>, tf array<int>"))
    n, ids = rows.agg(F.count(F.lit(1)), F.count_distinct("chunk_id")).first()
    if ids < n:  # rows that repeat an id are one chunk, whose terms are not in one row
        return None
    words = rows.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
    df = rows.select(F.explode("no").alias("no")).groupBy("no").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    factors = asked.join(wanted, "term").join(df, "no").select("query_id", "no", (F.col("qtf") * idf).alias("w")).orderBy("no", "query_id").toArrow()
    return top(_best_chunks(rows, factors, words / n if n else 1.0, k, fusion, dict(asked.dtypes)["query_id"]), k, "score")


def id_values(ids: pa.Array) -> np.ndarray:
    return ids.to_numpy() if pa.types.is_integer(ids.type) else np.array(ids.to_pylist(), dtype=object)


class Best:
    """The k best (chunk, query's number, score) of each of width queries so far, of equal scores the lower ids; least: the k-th score."""

    def __init__(self, k: int, width: int):
        self.k, self.held, self.n, self.least = k, [], 0, np.full(width, -1.0)

    def _reduce(self) -> None:
        ids, of, score = (np.concatenate(x) for x in zip(*self.held))
        place = np.argsort(ids, kind="stable")
        order = place[np.lexsort((np.arange(len(ids)), -score[place], of[place]))]
        order = order[np.arange(len(order)) - np.searchsorted(of[order], of[order]) < self.k]
        ids, of, score = ids[order], of[order], score[order]
        last = np.flatnonzero(np.arange(len(of)) - np.searchsorted(of, of) == self.k - 1)
        self.least[of[last]] = score[last]
        self.held, self.n = [(ids, of, score)], len(ids)

    def add(self, ids: np.ndarray, of: np.ndarray, score: np.ndarray) -> None:
        self.held.append((ids, of, score))
        self.n += len(ids)
        if self.n > HITS or len(self.held) == 1:
            self._reduce()

    def batches(self, queries: pa.Array, kind: pa.DataType):
        if self.held:
            self._reduce()
            ids, of, score = self.held[0]
            for a in range(0, len(of), 10_000):
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(of[a : a + 10_000])), pa.array(ids[a : a + 10_000].tolist(), kind), pa.array(score[a : a + 10_000])], ["query_id", "chunk_id", "score"])


def _best_chunks(rows: DataFrame, factors: pa.Table, mean: float, k: int, fusion: Fusion, query_type: str) -> DataFrame:
    """query_id, chunk_id, score: each task's k best of every query among rows(chunk_id, dl, no, tf); dl is the
    chunk's length, or that of each of its postings.

    factors(query_id, no, w): a query's repeats of a term times the term's weight, in the order of no."""
    names = factors["query_id"].combine_chunks().dictionary_encode() if factors.num_rows else pa.array([], pa.int64()).dictionary_encode()
    query, no, w = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), factors["no"].to_numpy(), factors["w"].to_numpy()
    first = np.searchsorted(no, np.arange((no.max() if len(no) else 0) + 2))
    workers_import(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast((names.dictionary, query, w, first))

    def run(batches):
        queries, query, w, first = shared.value
        width = max(1, len(queries))
        best = Best(k, width)
        for b in batches:
            step = max(1, SCORES // width)
            for part in (b.slice(a, step) for a in range(0, b.num_rows, step)):
                sizes = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                tf, own = part.column(3).flatten().to_numpy().astype(np.float64), part.column(2).flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), sizes)
                dl = part.column(1)
                dl = dl.flatten().to_numpy() if pa.types.is_list(dl.type) else dl.to_numpy()[row]
                weight = tf / (tf + fusion.k1 * (1 - fusion.b + fusion.b * dl / (mean or 1.0)))
                asked = first[own + 1] - first[own]
                at = np.arange(asked.sum()) - np.repeat(np.cumsum(asked) - asked, asked) + np.repeat(first[own], asked)
                cell = np.repeat(row, asked) * width + query[at]
                # Summed as whole billionths: the order of additions cannot change the result.
                sums = np.bincount(cell, np.floor(w[at] * np.repeat(weight, asked) * 1e9 + 0.5), part.num_rows * width)
                score = np.floor(sums / 1e9 * 1e6 + 0.5) / 1e6
                there = np.zeros(len(score), bool)
                there[cell] = True
                score = np.where(there, score, -2.0).reshape(-1, width)
                i, j = np.nonzero((score >= best.least) & (score > -2))
                best.add(id_values(part.column(0))[i], j, score[i, j])
        yield from best.batches(queries, kind)

    kind = _arrow_type(rows.schema["chunk_id"].dataType)
    return rows.mapInArrow(run, f"query_id {query_type}, chunk_id {dict(rows.dtypes)['chunk_id']}, score double")


def asked_terms(queries: DataFrame, cut_by: Callable[[Column], Column] = terms) -> DataFrame:
    return queries.select("query_id", F.explode(cut_by(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def scored(asked: DataFrame, index: DataFrame, n: int, words: int, k: int, fusion: Fusion) -> DataFrame:
    mean = words / n if n else 1.0
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if asked.count() <= ASKED:  # postings meet by their chunk, and each task's k best follow
        numbers = {r["term"]: i for i, r in enumerate(asked.select("term").distinct().orderBy("term").collect())}
        wanted = F.broadcast(asked.sparkSession.createDataFrame(list(numbers.items()), "term string, no int"))
        rows = index.join(wanted, "term").groupBy("chunk_id").agg(F.collect_list(F.struct("no", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))).alias("c"))
        factors = asked.join(wanted, "term").join(df, "term").select("query_id", "no", (F.col("qtf") * idf).alias("w")).orderBy("no", "query_id").toArrow()
        return top(_best_chunks(rows.select("chunk_id", "c.dl", "c.no", "c.tf"), factors, mean, k, fusion, dict(asked.dtypes)["query_id"]), k, "score")
    weight = F.col("tf") / (F.col("tf") + fusion.k1 * (1 - fusion.b + fusion.b * F.col("dl") / F.lit(float(mean or 1.0))))
    part = index.join(df, "term").join(asked, "term").select("query_id", "chunk_id", (F.col("qtf") * idf * weight).alias("s"))
    # Summed as whole billionths: the order of additions cannot change the result.
    scores = part.groupBy("query_id", "chunk_id").agg((F.sum(F.floor(F.col("s") * 1e9 + 0.5)) / 1e9).alias("score"))
    return top(scores.withColumn("score", half_up(F.col("score"), 6)), k, "score")


#: Folders that an index is cut into by a hash of the term.
SHARDS = 64


def shard(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHARDS)).cast("int")


def index_search(queries: DataFrame, path: str, k: int = 20, fusion: Fusion = Fusion()) -> DataFrame:
    """The same as ``bm25_topk`` from an index that ``sinks.write_index`` has written.

    Reads the folders of the asked terms, and the number and length of all chunks from the table
    beside it. A chunk that was added again counts as it was added last.
    """
    spark, asked = queries.sparkSession, asked_terms(queries)
    folders = [r[0] for r in asked.select(shard(F.col("term"))).distinct().collect()]  # SHARDS at most
    chunks = spark.read.parquet(f"{path}-chunks")
    last = chunks.groupBy("chunk_id").agg(F.max("added").alias("added"), F.max_by("dl", "added").alias("dl"))
    n, words = last.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    index = spark.read.parquet(path).where(F.col("shard").isin(folders)).join(asked.select("term").distinct(), "term", "left_semi")
    if last.count() < chunks.count():
        index = index.join(last.select("chunk_id", "added"), ["chunk_id", "added"], "left_semi")
    return scored(asked, index.select("term", "chunk_id", "tf", "dl"), n, words, k, fusion)


def _weighted(hits: DataFrame, weight: float, name: str) -> DataFrame:
    """(total - place) / total * weight over each query's whole hit list."""
    total = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return hits.select("query_id", "chunk_id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"), ((total - F.col("rank") + 1) / total * weight).alias(f"{name}_weighted"))


def fuse(vector: DataFrame, bm25: DataFrame, fusion: Fusion = Fusion()) -> DataFrame:
    """All hits of either list with raw and weighted scores, ranks and flags, and final_score."""
    both = _weighted(vector, fusion.vector_weight, "vector").join(_weighted(bm25, fusion.bm25_weight, "bm25"), ["query_id", "chunk_id"], "full_outer")
    score = F.coalesce("vector_weighted", F.lit(0.0)) + F.coalesce("bm25_weighted", F.lit(0.0))
    return both.select("*", F.col("vector_rank").isNotNull().alias("hit_by_vector"), F.col("bm25_rank").isNotNull().alias("hit_by_bm25"), half_up(score, 9).alias("final_score"))


def hybrid(vector: DataFrame, bm25: DataFrame, fusion: Fusion = Fusion()) -> DataFrame:
    return top(fuse(vector, bm25, fusion), fusion.limit, "final_score", rank="final_rank")


def rerank(hits: DataFrame, scorer: Column | None = None, k: int = 5) -> DataFrame:
    """The k best by an external scorer's column; without a scorer the fused order stands."""
    by = hits if scorer is None else hits.withColumn("final_score", F.coalesce(scorer, F.col("final_score")))
    return top(by, k if k > 0 else 5, "final_score", rank="final_rank")


#: Answers of a service that does not have what is asked for, and never will.
GONE = (404, 501)


def rerank_with(hits: DataFrame, scorer: Callable[[str, list[str], int], list[tuple[int, float]]], k: int = 5) -> DataFrame:
    """query_id, chunk_id, final_score, final_rank of hits(query_id, query, chunk_id, content, final_score)
    by an external function: (query, texts, n) to (place, score) of the n best.

    Where it raises, names nothing, or the query is blank, the fused order stands. An error whose
    ``status`` is one of GONE switches it off: this task does not ask again.
    """
    n, off = (k if k > 0 else 5), []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["final_score", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        try:
            query = pdf["query"].iloc[0]
            found = scorer(query, pdf["content"].tolist(), n) if query and query.strip() and not off else []
            found = sorted(((p, s) for p, s in found if 0 <= p < len(pdf)), key=lambda x: -x[1])
        except Exception as e:  # whatever the function raises, its answer is missing
            found = []
            if getattr(e, "status", None) in GONE:
                off.append(True)
        if found:
            pdf = pdf.iloc[[p for p, _ in found]].assign(final_score=[float(s) for _, s in found])
        pdf = pdf.head(n)
        return pdf.assign(final_rank=np.arange(1, len(pdf) + 1, dtype=np.int32))[["query_id", "chunk_id", "final_score", "final_rank"]]

    own = hits.select("query_id", "query", "chunk_id", "content", F.col("final_score").cast("double").alias("final_score"))
    kind = dict(own.dtypes)
    return own.groupBy("query_id").applyInPandas(run, f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}, final_score double, final_rank int")


def retrieve(vector: DataFrame, bm25: DataFrame, entries: DataFrame, as_of: Column, code: str | None = None, target_code: str | None = None, target_name: str | None = None, fusion: Fusion = Fusion(), k: int = 30) -> DataFrame:
    """Knowledge search over entries(chunk_id, stock_code, stock_name, content, created_at).

    Hits without an entry stay, at the weight of unknown age and without a text to compare.
    Ranks and totals are those of the whole hit lists; the code filter comes after them, on a
    column that the windows do not partition by, so that it stays there. Then boosts, recency,
    the near-duplicate penalty, and the best k.
    """
    hits = fuse(vector, bm25, fusion).join(entries, "chunk_id", "left")
    if code is not None:
        hits = hits.where(F.col("stock_code") == code)
    score = F.col("final_score")
    if target_code or target_name:
        boost = F.when(F.col("stock_code") == target_code, fusion.code_boost) if target_code else F.when(F.lit(False), 0.0)
        boost = boost.when(F.col("stock_name") == target_name, fusion.name_boost) if target_name else boost
        score = score + F.coalesce(boost, F.lit(0.0))
    hits = hits.withColumn("score", half_up(score * recency(F.col("created_at"), as_of), 9))
    hits = hits.select("query_id", "chunk_id", "score", "content").withColumn("fp", text_prep.simhash("content"))
    penalty = fusion.duplicate_penalty

    def punish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        fp, score = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["score"].to_numpy().copy()
        for i in range(len(fp)):  # at most the two hit lists' lengths
            near = (np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= text_prep.NEAR) & (fp[i] != 0) & (fp[i + 1 :] != 0)
            for j in np.nonzero(near)[0] + i + 1:
                score[j if score[i] > score[j] else i] -= penalty
        pdf["score"] = np.floor(score * 1e9 + 0.5) / 1e9
        return pdf[["query_id", "chunk_id", "score"]]

    kind = dict(hits.dtypes)
    hits = hits.groupBy("query_id").applyInPandas(punish, f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}, score double")
    return top(hits, k, "score")


def context(hits: DataFrame, entries: DataFrame, label: str = "ref") -> DataFrame:
    """One text per query: its hits in rank order, a line each."""
    rows = hits.join(entries, "chunk_id")
    line = F.format_string(f"[{label} %d] %s(%s) | %s", F.col("rank"), F.col("stock_name"), F.col("stock_code"), F.col("content"))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return rows.groupBy("query_id").agg(lines.alias("l")).select("query_id", F.array_join(F.col("l.line"), "\n").alias("context"))


#: The code that general rules are filed under, and how a context names its parts.
GENERAL = "GENERAL"
GENERAL_HEAD, GENERAL_LINE = "【通用规则】", "[通用%d] %s"
KNOWN_HEAD, KNOWN_LINE = "【参考知识】", "[引用%d] %s(%s) | 类别:%s | 来源:%s | %s"


def _listed(hits: DataFrame, entries: DataFrame, head: str, line: Column) -> DataFrame:
    rows = hits.join(entries, "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"))
    return rows.select("query_id", F.concat(F.lit(head + "\n"), F.array_join(F.col("_l.line"), "\n"), F.lit("\n")).alias("part"))


def knowledge_context(rules: DataFrame, known: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, context: general rules first, a blank line, then entries of the instrument.

    rules and known are ranked hits(query_id, chunk_id, rank); entries(chunk_id, stock_code,
    stock_name, content, category, source). A part without hits is left out; a query with hits
    in neither list has no row.
    """
    c, blank = F.col, lambda k: F.coalesce(F.col(k), F.lit(""))
    first = _listed(rules, entries, GENERAL_HEAD, F.format_string(GENERAL_LINE, c("rank"), blank("content")))
    then = _listed(known, entries, KNOWN_HEAD, F.format_string(KNOWN_LINE, c("rank"), *map(blank, ("stock_name", "stock_code", "category", "source", "content"))))
    both = first.withColumnRenamed("part", "_a").join(then.withColumnRenamed("part", "_b"), "query_id", "full_outer")
    return both.select("query_id", F.concat(F.coalesce(F.concat("_a", F.lit("\n")), F.lit("")), F.coalesce("_b", F.lit(""))).alias("context"))


def retriever_rows(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, ref_id (REF-1 and on by rank), chunk_id, source, token_count, final_score, text for
    hits(query_id, chunk_id, final_score, final_rank); what an entry lacks is empty."""
    rows = hits.join(entries, "chunk_id", "left").withColumn("ref_id", F.concat(F.lit("REF-"), F.col("final_rank")))
    source, content = F.coalesce("source", F.lit("")), F.coalesce("content", F.lit(""))
    text = F.format_string("[%s]\nchunk_id: %s\nsource: %s\ntext: %s", F.col("ref_id"), F.col("chunk_id").cast("string"), source, content)
    return rows.select("query_id", "ref_id", "chunk_id", source.alias("source"), F.coalesce("token_count", F.lit(0)).alias("token_count"), "final_score", text.alias("text"))


def general_rules(entries: DataFrame, code: str = GENERAL) -> DataFrame:
    return entries.where(F.col("stock_code") == code)


def delete_entries(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """entries without those of ids(chunk_id), whatever they are filed under."""
    return entries.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "content") -> DataFrame:
    """chunks with vector: what embed makes of the texts of a batch; null for null texts."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        vectors = iter(embed(texts.dropna().tolist()))
        return pd.Series([None if t is None else next(vectors) for t in texts], dtype=object)

    return chunks.withColumn("vector", run(text))
