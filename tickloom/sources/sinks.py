"""Where results go: tables, indexes, upserts, traces and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.text import terms
from tickloom.operators import retrieval


def replace(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").format(kind).save(path)


def append(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("append").format(kind).save(path)


def write_index(corpus: DataFrame, path: str, add: bool = False) -> None:
    """Postings in files by a hash of the term, so that a search reads the folders of its terms, and
    the length of each chunk in a table beside them (path-chunks).

    add keeps the chunks that are there; of a chunk added again the last counts. Otherwise the
    index is made anew. Null ids or texts are left out.
    """
    spark, beside = corpus.sparkSession, f"{path}-chunks"
    added = spark.read.parquet(beside).agg(F.max("added")).first()[0] + 1 if add and exists(spark, beside) else 0
    mode = "append" if add else "overwrite"
    lengths = corpus.where("chunk_id is not null and content is not null").select("chunk_id", F.size(terms(F.col("content"))).alias("dl"), F.lit(added).alias("added"))
    # Counted where a chunk is, so that postings are shuffled once; rows that repeat an id meet there.
    key = ["term", "chunk_id", "added", "shard"]
    rows = retrieval.counted(corpus).select("term", "chunk_id", "tf", "dl", F.lit(added).alias("added"), retrieval.shard(F.col("term")).alias("shard"))
    rows = rows.repartition("shard")
    if not corpus.where("chunk_id is not null and content is not null").groupBy("chunk_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy(*key).agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
    rows.select("term", "chunk_id", "tf", "dl", "added", "shard").write.mode(mode).partitionBy("shard").parquet(path)
    lengths.write.mode(mode).parquet(beside)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is stored; nothing if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_index(spark: SparkSession, path: str) -> None:
    remove(spark, path)
    remove(spark, f"{path}-chunks")


def sync(table: DataFrame, desired: DataFrame, key: str, path: str) -> int:
    """Write the desired state to a new folder; the number of obsolete rows it leaves out."""
    gone = table.join(desired.select(key), key, "left_anti").count()
    replace(desired, path)
    return gone


def write_traces(events: DataFrame, path: str) -> None:
    """One JSON line an event."""
    events.select("line").write.mode("append").text(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def latest_alerts(batch: DataFrame, n: int = 20) -> list[dict]:
    """What a push channel sends on each trigger: the newest alerts, or a heartbeat."""
    rows = batch.orderBy(F.desc("ts"), F.desc("id")).limit(n).collect()
    return [r.asDict() for r in rows] or [{"heartbeat": True}]


def push_alerts(alerts: DataFrame, send: Callable[[list[dict]], None], n: int = 20, every: str = "5 seconds"):
    """A running query that sends the newest alerts of a stream, or a heartbeat, on each trigger."""
    return alerts.writeStream.trigger(processingTime=every).foreachBatch(lambda batch, _: send(latest_alerts(batch, n))).start()
