"""A stored BM25 index: segments of postings in blocks, searched by MaxScore, merged and deleted from.

A segment files its chunks in buckets by a hash of their id, and its texts are shuffled once, by their
bucket. The postings of a term in a bucket are one row, a block, and the block without a term has the
bucket's chunks. A block comes with the impacts of its postings: the pairs of term frequency and chunk length
that no other posting of the block beats in both. They bound the block's scores for whatever mean
length the whole index comes to have.

A search gives the rows of ``retrieval.bm25_topk`` over all chunks that the index holds:

1. The rarest terms of each query give partial scores, and the k-th best of these a threshold that
   k chunks reach.
2. Terms whose greatest scores together stay below it cannot bring a chunk in by themselves: chunks
   come from the others' blocks only, and of these from blocks that can reach the threshold.
3. Chunks that can still reach it with all the other terms meet those terms' blocks of their
   buckets; no other blocks of these terms are read.

``add`` writes a segment, ``delete`` a list of ids, and each a new manifest, which names what is
live: readers see the one or the other. Chunks that are added again replace themselves. Deleted
chunks count in nothing; until ``merge`` has written the live postings anew, searches read all
blocks of their terms to leave them out. Null ids and texts are left out; ids are of any type.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as _arrow_type

from tickloom.functions.numeric import half_up
from tickloom.functions.text import terms
from tickloom.operators.retrieval import ASKED, SCORES, Best, Fusion, asked_terms, id_values, scored, top
from tickloom.session import cut, workers_import
from tickloom.sources.sinks import exists, remove

#: Chunks of a bucket, on average, and so postings of a block. With 128, a block had 1.8 postings, and rows cost more than these.
BUCKET = 1024
#: Chunks that a task makes blocks of, on average, where there are many.
TOGETHER = 8192
#: Postings, as a multiple of k, up to which a query's threshold is taken from more terms than k chunks need.
START = 50
#: What sums and rounding to 6 decimals may differ by.
MARGIN = 1e-5


@dataclass(frozen=True)
class Manifest:
    """segments: (name, number, chunks, words, buckets); deleted: names of lists of ids."""

    version: int
    segments: tuple = ()
    deleted: tuple = ()


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The newest whole manifest; version -1 where there is none."""
    folder, fs = _fs(spark, f"{path}/manifests")
    if not fs.exists(folder):
        return Manifest(-1)
    versions = sorted((int(s.getPath().getName()) for s in fs.listStatus(folder)), reverse=True)
    for v in versions:
        if exists(spark, f"{path}/manifests/{v}/_SUCCESS"):
            found = json.loads(spark.read.text(f"{path}/manifests/{v}").first()[0])
            return Manifest(v, tuple(map(tuple, found["segments"])), tuple(found["deleted"]))
    return Manifest(-1)


def _publish(spark: SparkSession, path: str, version: int, segments: tuple, deleted: tuple) -> None:
    """The mode is an error where this version exists: of two writers one fails and may try again."""
    row = json.dumps({"segments": segments, "deleted": deleted})
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("error").text(f"{path}/manifests/{version}")


def impacts(postings: Column) -> Column:
    """Of array<struct<tf, dl>> the pairs that none beats: frequencies from the highest, each shorter than those before."""
    rising = F.array_sort(F.transform(postings, lambda p: F.struct((-p["tf"]).alias("t"), p["dl"].alias("dl"))))
    none = F.struct(F.lit(None).cast("int").alias("least"), F.array().cast("array<struct<tf: int, dl: int>>").alias("kept"))
    better = lambda s, p: s["least"].isNull() | (p["dl"] < s["least"])
    one = lambda p: F.array(F.struct((-p["t"]).cast("int").alias("tf"), p["dl"].cast("int").alias("dl")))
    return F.aggregate(rising, none, lambda s, p: F.when(better(s, p), F.struct(p["dl"].cast("int").alias("least"), F.concat(s["kept"], one(p)).alias("kept"))).otherwise(s))["kept"]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their bucket, the first column, with each bucket's in one batch."""
    held: list[pa.RecordBatch] = []
    for b in filter(lambda b: b.num_rows, batches):
        held.append(b)
        if b.column(0)[-1] != held[0].column(0)[0]:
            all_ = pa.concat_batches(held)
            last = int(np.searchsorted(all_.column(0).to_numpy(), all_.column(0)[-1].as_py()))
            yield all_.slice(0, last)
            held = [all_.slice(last)]
    if held:
        yield pa.concat_batches(held)


def _counted(b: pa.RecordBatch) -> tuple:
    """(bucket, chunk_id, terms) → buckets and ids of rows, the terms, and by posting the row, the term's number, tf
    and dl; a chunk itself is a posting of the number after the last."""
    lists = b.column(2)
    dl, n = pc.list_value_length(lists).to_numpy(), b.num_rows
    coded = lists.flatten().dictionary_encode()
    rows = np.arange(n)
    held = np.concatenate([coded.indices.to_numpy().astype(np.int64) * n + np.repeat(rows, dl), len(coded.dictionary) * n + rows])
    cells, tf = np.unique(held, return_counts=True)
    row, code = cells % n, cells // n
    return b.column(0).to_numpy(), b.column(1), coded.dictionary, row, code, np.where(code == len(coded.dictionary), 0, tf), dl[row]


def _posted(b: pa.RecordBatch) -> tuple:
    """(bucket, segment, dead, term, ids, tf, dl) of parts of blocks → as ``_counted``, a row a posting; rows with dead are
    of ids that are gone from that segment and below."""
    coded = b.column(3).dictionary_encode()
    code = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy().astype(np.int64)
    sizes = pc.list_value_length(b.column(4)).to_numpy()
    ids = b.column(4).flatten()
    rows = np.repeat(np.arange(b.num_rows), sizes)
    dead = b.column(2).to_numpy(zero_copy_only=False)[rows]
    left = ~dead
    if dead.any():
        segment, own = b.column(1).to_numpy()[rows], ids.dictionary_encode()
        chunk, upto = own.indices.to_numpy(), np.full(len(own.dictionary), -1)
        upto[chunk[dead]] = segment[dead]
        left &= segment > upto[chunk]
        ids = ids.filter(pa.array(left))
    rows = rows[left]
    return b.column(0).to_numpy()[rows], ids, coded.dictionary, np.arange(len(rows)), code[rows], b.column(5).flatten().to_numpy()[left], b.column(6).flatten().to_numpy()[left]


def _built(read: Callable[[pa.RecordBatch], tuple]):
    """Rows by bucket → the blocks of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole(batches):
            buckets, ids, names, row, code, tf, dl = read(b)
            if not len(row):
                continue
            order = np.lexsort((row, code, buckets[row]))
            row, code, tf, dl = row[order], code[order], tf[order].astype(np.int32), dl[order].astype(np.int32)
            first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (buckets[row[1:]] != buckets[row[:-1]])]))
            bounds = np.append(first, len(row)).astype(np.int32)
            of = np.repeat(np.arange(len(first)), np.diff(bounds))
            # From the highest frequency, each posting that is shorter than all before it in its block.
            fall = np.lexsort((dl, -tf, of))
            low = dl[fall].astype(np.int64) - (of[fall].astype(np.int64) << 32)
            best = fall[np.concatenate([[True], low[1:] < np.minimum.accumulate(low)[:-1]])]
            upto = np.searchsorted(of[best], np.arange(len(first) + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(tf[best]), pa.array(dl[best])], names=["tf", "dl"])
            cells = pa.StructArray.from_arrays([ids.take(pa.array(row)), pa.array(tf), pa.array(dl)], names=["chunk_id", "tf", "dl"])
            number = code[first]
            terms_ = names.take(pa.array(number, mask=number == len(names)))
            yield pa.RecordBatch.from_arrays(
                [terms_, pa.array(buckets[row[first]]), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(upto), pairs), pa.ListArray.from_arrays(pa.array(bounds), cells)],
                ["term", "bucket", "size", "impacts", "postings"],
            )

    return run


def _buckets(n: int, per: int) -> int:
    """A power of two, so that buckets of a larger segment lie in those of a smaller one."""
    return 1 << (max(1, -(-n // per)) - 1).bit_length()


def _bucket_of(ids: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(buckets)).cast("int").alias("bucket")


def _bucket(buckets: int) -> Column:
    return _bucket_of(F.col("chunk_id"), buckets)


def _together(rows: DataFrame, n: int) -> DataFrame:
    """rows(bucket, ..) of n chunks, each bucket's in one task."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TOGETHER), "bucket")


def _write_segment(rows: DataFrame, read, path: str, name: str, kind: str) -> None:
    """Blocks of rows(bucket, ..), each bucket's in one task, as ``read`` takes them; kind: the type of ids."""
    schema = f"term string, bucket int, size int, impacts array<struct<tf: int, dl: int>>, postings array<struct<chunk_id: {kind}, tf: int, dl: int>>"
    rows.sortWithinPartitions("bucket").mapInArrow(_built(read), schema).write.parquet(f"{path}/{name}/blocks")


def _size(spark: SparkSession, path: str, name: str) -> tuple[int, int]:
    """(chunks, words) of a segment."""
    return tuple(_chunks(spark, path, [(name, 0)]).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first())


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _blocks(spark: SparkSession, path: str, segments) -> DataFrame:
    return _union([spark.read.parquet(f"{path}/{name}/blocks").withColumn("segment", F.lit(number)) for name, number, *_ in segments])


def _chunks(spark: SparkSession, path: str, segments) -> DataFrame:
    rows = _blocks(spark, path, segments).where("term is null").select("bucket", "segment", F.explode("postings").alias("p"))
    return rows.select("p.chunk_id", "p.dl", "bucket", "segment")


def _deleted(spark: SparkSession, path: str, names) -> DataFrame:
    """(chunk_id, upto): ids that are gone from segments of that number and below."""
    return _union([spark.read.parquet(f"{path}/{name}") for name in names]).groupBy("chunk_id").agg(F.max("upto").alias("upto"))


def _live(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    """rows(chunk_id, segment, ..) without deleted ones."""
    if gone is None:
        return rows
    gone = gone.withColumnRenamed("chunk_id", "_gone")
    return rows.join(gone, (F.col("chunk_id") == F.col("_gone")) & (F.col("segment") <= F.col("upto")), "left_anti")


def add(corpus: DataFrame, path: str, bucket: int = BUCKET) -> None:
    """A new segment of corpus(chunk_id, content); of a chunk that is there already this one counts,
    and of rows that repeat an id the first by content. bucket: chunks of a bucket."""
    spark, now = corpus.sparkSession, manifest(corpus.sparkSession, path)
    workers_import(spark)
    own = corpus.where("chunk_id is not null and content is not null")
    buckets = _buckets(own.select("chunk_id").distinct().count(), bucket)
    number, name = now.version + 1, f"segment-{uuid.uuid4().hex}"
    rows = _together(own.select(_bucket(buckets), "chunk_id", "content"), buckets * bucket)
    rows = rows.groupBy("bucket", "chunk_id").agg(F.min("content").alias("content"))
    _write_segment(rows.select("bucket", "chunk_id", terms(F.col("content")).alias("terms")), _counted, path, name, rows.schema["chunk_id"].dataType.simpleString())
    n, words = _size(spark, path, name)
    deleted = now.deleted
    if now.segments:
        before = _chunks(spark, path, now.segments).select("chunk_id").join(_chunks(spark, path, [(name, number)]).select("chunk_id"), "chunk_id", "left_semi")
        deleted = _also_deleted(before, path, now.version, deleted)
    _publish(spark, path, number, (*now.segments, (name, number, n, words, buckets)), deleted)


def _also_deleted(ids: DataFrame, path: str, upto: int, deleted: tuple) -> tuple:
    name = f"deleted-{uuid.uuid4().hex}"
    rows = cut(ids.select("chunk_id").distinct())
    if rows.isEmpty():
        return deleted
    rows.withColumn("upto", F.lit(upto)).write.parquet(f"{path}/{name}")
    return (*deleted, name)


def delete(ids: DataFrame, path: str) -> None:
    """Chunks of ids(chunk_id) are gone from now on; ids that the index lacks do nothing."""
    spark, now = ids.sparkSession, manifest(ids.sparkSession, path)
    if now.segments:
        there = _chunks(spark, path, now.segments).select("chunk_id").join(ids.select("chunk_id"), "chunk_id", "left_semi")
        deleted = _also_deleted(there, path, now.version, now.deleted)
        if deleted != now.deleted:
            _publish(spark, path, now.version + 1, now.segments, deleted)


def merge(spark: SparkSession, path: str, bucket: int = BUCKET) -> None:
    """All segments as one, without what is deleted; then the old files go."""
    now = manifest(spark, path)
    if len(now.segments) + len(now.deleted) < 2:
        return
    workers_import(spark)
    gone = cut(_deleted(spark, path, now.deleted)) if now.deleted else None
    n = _live(_chunks(spark, path, now.segments), gone).count()
    buckets, name = _buckets(n, bucket), f"segment-{uuid.uuid4().hex}"
    if len(now.segments) == 1 and 2 * buckets > now.segments[0][4] >= buckets:
        _, number, *_, buckets = now.segments[0]
        _thinned(_blocks(spark, path, now.segments), gone.where(F.col("upto") >= number), buckets).write.parquet(f"{path}/{name}/blocks")
    else:
        # Buckets may be twice as large, where blocks of more chunks then go as they are.
        whole = lambda m: sum(s[2] for s in now.segments if s[4] % m == 0)
        if buckets > 1 and whole(buckets // 2) > whole(buckets):
            buckets //= 2
        frames, arrays = [], [F.col(f"p.{c}").alias(a) for c, a in (("chunk_id", "ids"), ("tf", "tf"), ("dl", "dl"))]
        for s in now.segments:
            own = _blocks(spark, path, [s])
            if s[4] % buckets == 0:
                own = own.select(F.pmod("bucket", F.lit(buckets)).alias("bucket"), "segment", "term", F.col("postings").alias("p"))
            else:
                own = own.select("segment", "term", F.explode("postings").alias("one")).select(_bucket_of(F.col("one.chunk_id"), buckets), "segment", "term", F.array("one").alias("p"))
            frames.append(own.select("bucket", "segment", F.lit(False).alias("dead"), "term", *arrays))
        if gone is not None:
            zero = F.array(F.lit(0))
            frames.append(gone.select(_bucket(buckets), F.col("upto").alias("segment"), F.lit(True).alias("dead"), F.lit(None).cast("string").alias("term"), F.array("chunk_id").alias("ids"), zero.alias("tf"), zero.alias("dl")))
        kind = _blocks(spark, path, now.segments[:1]).schema["postings"].dataType.elementType["chunk_id"].dataType.simpleString()
        _write_segment(_together(_union(frames), n), _posted, path, name, kind)
    n, words = _size(spark, path, name)
    _publish(spark, path, now.version + 1, ((name, now.version + 1, n, words, buckets),), ())
    for old in (*(s[0] for s in now.segments), *now.deleted):
        remove(spark, f"{path}/{old}")


def _thinned(blocks: DataFrame, dead: DataFrame, buckets: int) -> DataFrame:
    """blocks without chunks of dead(chunk_id), in the buckets that they have: no posting is shuffled."""
    rows = blocks.join(dead.groupBy(_bucket(buckets)).agg(F.collect_list("chunk_id").alias("dead")), "bucket", "left")
    left = F.when(F.col("dead").isNull(), F.col("postings")).otherwise(F.filter("postings", lambda p: ~F.array_contains("dead", p["chunk_id"])))
    rows = rows.select("term", "bucket", "size", "impacts", F.explode(F.array(left)).alias("left")).where(F.size("left") > 0)  # so that left is computed once
    kept = F.when(F.size("left") == F.col("size"), F.col("impacts")).otherwise(impacts(F.col("left")))
    return rows.select("term", "bucket", F.size("left").alias("size"), kept.alias("impacts"), F.col("left").alias("postings"))


def clear(spark: SparkSession, path: str) -> None:
    remove(spark, path)


@dataclass
class Plan:
    """What a search reads: weights(query_id, term, qtf, idf, ub, ..), the blocks of its terms, and by
    query the blocks for the threshold, those that chunks come from, and the others' of their buckets."""

    blocks: DataFrame
    first: DataFrame
    essential: DataFrame
    other: DataFrame
    scores: DataFrame

    def postings(self) -> tuple[int, int]:
        """(postings of all asked terms, postings of the blocks that are read), each block once."""
        key = ["term", "segment", "bucket"]
        read = _union([d.select(*key) for d in (self.first, self.essential, self.other)]).distinct()
        total = lambda d: d.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        return total(self.blocks.select(*key, "size")), total(self.blocks.select(*key, "size").join(read, key, "left_semi"))


def _weight(tf: Column, dl: Column, mean: float, f: Fusion) -> Column:
    return tf / (tf + f.k1 * (1 - f.b + f.b * dl / F.lit(float(mean or 1.0))))


def _summed(blocks: DataFrame, mean: float, f: Fusion) -> DataFrame:
    """(query_id, chunk_id, segment, bucket, s) of blocks with qtf and idf; sums are of whole billionths."""
    rows = blocks.select("query_id", "segment", "bucket", "qtf", "idf", F.explode("postings").alias("p"))
    part = F.col("qtf") * F.col("idf") * _weight(F.col("p.tf"), F.col("p.dl"), mean, f)
    rows = rows.select("query_id", F.col("p.chunk_id").alias("chunk_id"), "segment", "bucket", F.floor(part * 1e9 + 0.5).alias("s"))
    return rows.groupBy("query_id", "chunk_id", "segment", "bucket").agg(F.sum("s").alias("s"))


def _by_bucket(blocks: DataFrame, weights: DataFrame, mean: float, k: int, f: Fusion, n: int) -> DataFrame:
    """Steps 2 and 3 where every task gets all weights: the asked blocks of a bucket meet, scores are summed there, and
    each task's k best of a query are shuffled. What a task has found so far raises its thresholds."""
    told = weights.select("query_id", "term", "qtf", "idf", "ub", "most_all", "need", "rest", "essential").orderBy("term", "query_id").toArrow()
    col = lambda name: told[name].to_numpy()
    terms_ = told["term"].combine_chunks().dictionary_encode()  # in the order of terms
    names = told["query_id"].combine_chunks().dictionary_encode()
    query, no = names.indices.to_numpy().astype(np.int64), terms_.indices.to_numpy()
    needs, rests = np.zeros(max(1, len(names.dictionary))), np.zeros(max(1, len(names.dictionary)))
    needs[query], rests[query] = col("need"), col("rest")
    others = 1 + col("most_all") - (np.floor(col("ub") * 1e9) + 1)
    shared = blocks.sparkSession.sparkContext.broadcast((names.dictionary, query, col("qtf") * col("idf"), others, col("essential").astype(bool), needs, rests, np.searchsorted(no, np.arange(len(terms_.dictionary) + 1))))
    spark = blocks.sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(zip(terms_.dictionary.to_pylist(), range(len(terms_.dictionary)))), "term string, no int"))
    spot = F.shiftleft(F.col("segment").cast("long"), 32) + F.col("bucket")
    rows = blocks.join(wanted, "term").select(spot.alias("bucket"), "no", "w", F.col("postings.chunk_id").alias("id"), F.col("postings.tf").alias("tf"), F.col("postings.dl").alias("dl"))
    rows = _together(rows, n).sortWithinPartitions("bucket")
    ids_of = dict(rows.dtypes)["id"].removeprefix("array<")[:-1]
    kind = _arrow_type(rows.schema["id"].dataType.elementType)

    def spread(starts, sizes):
        return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)

    def run(batches):
        queries, query, factor, others, essential, needs, rests, first = shared.value
        best = Best(k, len(needs))
        for b in _whole(batches):
            own, w = b.column(1).to_numpy(), b.column(2).to_numpy()
            sizes = pc.list_value_length(b.column(3)).to_numpy().astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            ids = b.column(3).flatten().dictionary_encode()
            chunk, count = ids.indices.to_numpy().astype(np.int64), max(1, len(ids.dictionary))
            tf, dl = (b.column(c).flatten().to_numpy().astype(np.float64) for c in (4, 5))
            weight = tf / (tf + f.k1 * (1 - f.b + f.b * dl / float(mean or 1.0)))
            asked = first[own + 1] - first[own]
            pair, block = spread(first[own], asked), np.repeat(np.arange(b.num_rows), asked)
            order = np.argsort(query[pair], kind="stable")
            pair, block = pair[order], block[order]
            q = query[pair]
            need = np.maximum(needs, np.floor((best.least - MARGIN) * 1e9))
            comes = essential[pair] & (np.floor(factor[pair] * w[block] * 1e9) + others[pair] >= need[q])
            values, buckets = id_values(ids.dictionary), np.unique(b.column(0).to_numpy(), return_inverse=True)[1]
            of_chunk = np.zeros(count, np.int64)
            of_chunk[chunk] = np.repeat(buckets, sizes)

            def summed(some, a, width):
                at = spread(starts[block[some]], sizes[block[some]])
                cell = np.repeat((q[some] - a) * count, sizes[block[some]]) + chunk[at]
                return cell, np.bincount(cell, np.floor(np.repeat(factor[pair[some]], sizes[block[some]]) * weight[at] * 1e9 + 0.5), width * count)

            # Queries at once: as many as cells and postings allow.
            load = np.cumsum(np.bincount(q, sizes[block], len(needs))) // SCORES
            group = np.cumsum(np.concatenate([[0], np.diff(load) > 0])) + np.arange(len(needs)) // max(1, SCORES // count) * len(needs)
            edges = np.append(np.flatnonzero(np.concatenate([[True], np.diff(group) != 0])), len(needs))
            for a, z in zip(edges[:-1], edges[1:]):
                here = np.arange(*np.searchsorted(q, [a, z]))
                if not len(some := here[comes[here]]):
                    continue
                cell, s = summed(some, a, z - a)
                there = np.zeros(len(s), bool)
                there[cell] = True
                there &= (s.reshape(z - a, count) + rests[a:z, None] >= need[a:z, None]).ravel()
                i, j = np.nonzero(there.reshape(z - a, count))
                held = np.zeros((z - a, buckets.max() + 1), bool)
                held[i, of_chunk[j]] = True
                more = here[~essential[pair[here]]]
                if len(more := more[held[q[more] - a, buckets[block[more]]]]):
                    s += summed(more, a, z - a)[1]
                score = np.floor(s.reshape(z - a, count)[i, j] / 1e9 * 1e6 + 0.5) / 1e6
                some = score >= best.least[i + a]
                best.add(values[j[some]], i[some] + a, score[some])
        yield from best.batches(queries, kind)

    return rows.mapInArrow(run, f"query_id {dict(weights.dtypes)['query_id']}, chunk_id {ids_of}, score double")


def plan(queries: DataFrame, path: str, k: int = 20, fusion: Fusion = Fusion()) -> Plan:
    """The search of an index without deleted chunks."""
    spark, now = queries.sparkSession, manifest(queries.sparkSession, path)
    n, words = sum(s[2] for s in now.segments), sum(s[3] for s in now.segments)
    mean = words / n if n else 1.0
    asked = cut(asked_terms(queries))
    blocks = _blocks(spark, path, now.segments).join(asked.select("term").distinct(), "term", "left_semi")
    top_weight = F.array_max(F.transform("impacts", lambda i: _weight(i["tf"], i["dl"], mean, fusion)))
    blocks = blocks.withColumn("w", top_weight)
    heads = cut(blocks.select("term", "segment", "bucket", "size", "w"))  # without postings
    # Few asked terms go to the blocks, so that no posting is shuffled.
    near = F.broadcast if asked.count() <= ASKED else lambda d: d
    facts = heads.groupBy("term").agg(F.sum("size").alias("df"), F.max("w").alias("most"))
    idf = F.ln(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(facts, "term").withColumn("idf", idf).withColumn("ub", F.col("qtf") * F.col("idf") * F.col("most"))
    by = lambda *o: Window.partitionBy("query_id").orderBy(*o)  # noqa: E731  a query's terms
    before = by("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("query_id")
    weights = cut(weights.select("*", ((F.coalesce(F.sum("df").over(before), F.lit(0)) < k) | (F.sum("df").over(by("df", "term")) <= START * k)).alias("early"), F.sum(F.floor(F.col("ub") * 1e9) + 1).over(all_).alias("most_all"), F.sum(F.floor(F.col("ub") * 1e9) + 1).over(by("ub", "term")).alias("upto")))

    key = ["term", "segment", "bucket"]
    first = blocks.join(near(weights.where("early").select("query_id", "term", "qtf", "idf")), "term")
    partial = _summed(first, mean, fusion)
    kth = partial.withColumn("_r", F.row_number().over(by(F.desc("s")))).where(F.col("_r") == k).select("query_id", (F.col("s") - int(MARGIN * 1e9)).alias("floor"))
    weights = cut(weights.join(kth, "query_id", "left").select("*", F.coalesce("floor", F.lit(0)).alias("need"), (F.col("upto") > F.coalesce("floor", F.lit(0))).alias("essential")).drop("floor"))

    # A block of an essential term is read if a chunk in it can reach the threshold with all other terms.
    bound = F.floor(F.col("qtf") * F.col("idf") * F.col("w") * 1e9) + 1 + F.col("most_all") - (F.floor(F.col("ub") * 1e9) + 1)
    essential = blocks.join(near(weights.where("essential")), "term").where(bound >= F.col("need")).select("query_id", *key, "qtf", "idf", "postings")
    rest = weights.where("not essential").groupBy("query_id").agg(F.max("upto").alias("rest"))
    needs = weights.select("query_id", "need").distinct().join(rest, "query_id", "left").select("query_id", "need", F.coalesce("rest", F.lit(0)).alias("rest"))
    found = _summed(essential, mean, fusion)
    found = found.join(needs, "query_id").where(F.col("s") + F.col("rest") >= F.col("need")).select("query_id", "chunk_id", "segment", "bucket", "s")
    few = asked.count() <= ASKED
    if not few:
        found = cut(found)

    spots = found.select("query_id", "segment", "bucket").distinct()
    other = blocks.join(near(weights.where("not essential").select("query_id", "term", "qtf", "idf")), "term").join(spots, ["query_id", "segment", "bucket"]).select("query_id", *key, "qtf", "idf", "postings")
    if few:
        return Plan(blocks, first, essential, other, _by_bucket(_blocks(spark, path, now.segments).withColumn("w", top_weight), weights.join(needs.select("query_id", "rest"), "query_id"), mean, k, fusion, n))
    more = _summed(other, mean, fusion).join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    scores = found.select("query_id", "chunk_id", "s").unionByName(more.select("query_id", "chunk_id", "s")).groupBy("query_id", "chunk_id").agg((F.sum("s") / 1e9).alias("score"))
    return Plan(blocks, first, essential, other, scores)


def search(queries: DataFrame, path: str, k: int = 20, fusion: Fusion = Fusion()) -> DataFrame:
    """query_id, chunk_id, score (to 6 decimals), rank for queries(query_id, text), as ``bm25_topk``."""
    spark, now = queries.sparkSession, manifest(queries.sparkSession, path)
    if not now.segments:
        raise ValueError(f"no index at {path}")
    if not now.deleted:
        return top(plan(queries, path, k, fusion).scores.withColumn("score", half_up(F.col("score"), 6)), k, "score")
    gone = cut(_deleted(spark, path, now.deleted))
    n, words = _live(_chunks(spark, path, now.segments), gone).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    asked = asked_terms(queries)
    rows = _blocks(spark, path, now.segments).join(asked.select("term").distinct(), "term", "left_semi")
    rows = rows.select("term", "segment", F.explode("postings").alias("p")).select("term", "segment", "p.*")
    return scored(asked, cut(_live(rows, gone).select("term", "chunk_id", "tf", "dl")), n, words, k, fusion)
