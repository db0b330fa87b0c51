"""Token ids of documents as range-coded blocks in files, in ascending doc_id order.

Texts are range-partitioned by doc_id and sorted, tokenized in order, and gathered into blocks
of about BLOCK ids that end at document ends. Each block is coded on its own (see idcoder) and
written as one row of a Parquet data set in the shared folder: Spark's committer leaves no
half-written file when a task or an executor is lost. A row is (part, block, n_ids, doc_ids,
lengths, payload); part and block number the blocks in order. ``documents`` reads the files
back, decodes and checks every block, and places each document in the whole stream.

Null text is empty: the end id alone. Rows that repeat a doc_id are kept, ordered by a hash of their
text and then by it; where one id has many rows, ranges part them by that hash. Rows without a doc_id
come first. A long text is one document of a block, which then
ends with it. Other columns play no part, whatever their names. An empty table gives files without
blocks, and no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import idcoder, tokens
from .common import prepare, shared_dir

END = 2
BLOCK = 1 << 23
#: Rows of one doc_id, or a thousandth of all if that is more, beyond which ranges part them.
CROWDED = 1000
FILE = "part int, block int, n_ids long, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def _gathered(batches, size: int):
    """(doc_ids, texts) of batches, joined until they have so many bytes."""
    docs, texts, held = [], [], 0
    for b in batches:
        docs.append(b.column(0))
        texts.append(b.column(1))
        held += b.column(1).nbytes
        if held >= size:
            yield pa.concat_arrays(docs), pa.concat_arrays(texts)
            docs, texts, held = [], [], 0
    if docs:
        yield pa.concat_arrays(docs), pa.concat_arrays(texts)


def _blocks(path: str, end: int, vocabulary: int, most: int):
    tail = np.array([end], np.uint32)

    def run(batches):
        from pyspark import TaskContext

        coder, part, block = tokens.words(path), TaskContext.get().partitionId(), 0
        docs, sizes, held, n = [], [], [], 0

        def row():
            ids = np.concatenate(held)
            held.clear()
            cells = [[part], [block], [n], [docs], [sizes], [idcoder.encode(ids, vocabulary)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], ["part", "block", "n_ids", "doc_ids", "lengths", "payload"])

        for ids_of, texts in _gathered(batches, tokens.TOGETHER):
            for doc, ids in zip(ids_of.to_pylist(), coder.encode_all(texts)):
                docs.append(doc)
                held += [ids, tail]
                sizes.append(len(ids) + 1)
                n += sizes[-1]
                if n >= most:
                    yield row()
                    block += 1
                    docs, sizes, held, n = [], [], [], 0
        if docs:
            yield row()

    return run


def write(docs: DataFrame, path: str, folder: str, end: int = END, vocabulary: int = 49408, block: int = BLOCK) -> None:
    """Write the ids of docs(doc_id, text) into folder. vocabulary: ids are below it."""
    prepare(docs.sparkSession)
    most, rows = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    by = ["doc_id", F.xxhash64("text")] if (most or 0) > max(CROWDED, (rows or 0) // 1000) else ["doc_id"]
    rows = docs.select("doc_id", "text").repartitionByRange(*by).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    rows.mapInArrow(_blocks(path, end, vocabulary, block), FILE).write.mode("overwrite").parquet(folder)


def _decoded(batches):
    for b in batches:
        part, block, docs, place, sizes, sums = [], [], [], [], [], []
        for r in b.to_pylist():
            ids, at = idcoder.decode(r["payload"]), 0
            if len(ids) != sum(r["lengths"]) or len(ids) != r["n_ids"]:
                raise ValueError("lengths of a block differ from its ids")
            for k, (doc, n) in enumerate(zip(r["doc_ids"], r["lengths"])):
                part.append(r["part"])
                block.append(r["block"])
                docs.append(doc)
                place.append(at)
                sizes.append(n)
                sums.append(idcoder.checksum(ids[at : at + n]))
                at += n
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int32()), *[pa.array(x, pa.int64()) for x in (docs, place, sizes, sums)]], ["part", "block", "doc_id", "place", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FILE).parquet(folder)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files.

    Blocks are placed by sums over parts (one number each, at the driver) and, inside a part,
    over blocks.
    """
    prepare(spark)
    heads = read(spark, folder).select("part", "block", "n_ids")
    parts, run = [], 0
    for r in heads.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one row per part
        parts.append((r["part"], run))
        run += r["n"]
    ahead = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = heads.withColumn("ahead", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0))).join(F.broadcast(spark.createDataFrame(parts, "part int, first long")), "part")
    at = at.select("part", "block", (F.col("ahead") + F.col("first")).alias("first"))
    rows = read(spark, folder).mapInArrow(_decoded, "part int, block int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return rows.join(at, ["part", "block"]).select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, path: str) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    write(docs, path, folder)
    return documents(spark, folder)
