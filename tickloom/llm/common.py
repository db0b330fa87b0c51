"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.session import temporary

#: Runs of ASCII white space, as a Java pattern; the only word separators used here.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
REPO = str(Path(__file__).resolve().parents[2])


#: Rows of a table of keys that every task may get; measured by count before each broadcast.
SMALL = 100_000
#: A key is heavy with more than a share of 1 in so many of all rows, so that no more keys than this are.
HEAVY = 10_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and, unless the user set it, keep Arrow batches of long texts small."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if REPO not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, paths)])
    if spark.conf.get(_BATCH, "10000") == "10000":  # Spark's default
        spark.conf.set(_BATCH, "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where it is unset, a temporary one
    if driver and executors are one process; anything else is an error, for they share no local disk."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{temporary()}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of an intermediate table, wherever it is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: no lineage, stable partitions and rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns renamed, so that none clashes with a helper column, and the new names."""
    names = {c: f"_own{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with groups by key, where groups has one row a key and, in size, its number of rows.

    Heavy keys, HEAVY of them at most by their share of all rows, are sent to every task, so that
    their rows stay where they are; the others meet by a shuffle. Both tables are read twice: give
    checkpoints. Keys that are null match nothing.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    limit = max(1000, total // HEAVY)
    heavy = groups.where(F.col(size) > limit)
    if heavy.isEmpty():
        return rows.join(groups, key)
    fast = rows.join(F.broadcast(heavy), key)
    slow = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(groups.where(F.col(size) <= limit), key)
    return fast.unionByName(slow.select(*fast.columns))


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of text: runs of anything but ASCII white space; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS))


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add exclusive running sums over the whole table in the given order.

    sums maps a new column to the SQL expression that it sums; ``"1"`` numbers rows from 0.
    Rows are range-partitioned and written once, so that their partitions stay as they are; only
    one row per partition (never per record) reaches the driver. Ties keep the order of the file.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("_row", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_row", 33))
    totals = ranged.groupBy("_part").agg(*[F.sum(F.expr(e)).alias(n) for n, e in sums.items()]).orderBy("_part").collect()
    rows, run = [], [0] * len(sums)
    for r in totals:
        rows.append((r["_part"], *run))
        run = [a + (r[n] or 0) for a, n in zip(run, sums)]
    kinds = dict(ranged.select(*[F.sum(F.expr(e)).alias(n) for n, e in sums.items()]).dtypes)
    rows = [(p, *(float(x) if kinds[n] == "double" else x for n, x in zip(sums, xs))) for p, *xs in rows]
    schema = "_part long, " + ", ".join(f"`_o_{n}` {kinds[n]}" for n in sums)
    offsets = spark.createDataFrame(rows, schema)
    before = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(F.expr(e)).over(before), F.lit(0)).alias(f"_i_{n}") for n, e in sums.items()])
    out = out.join(F.broadcast(offsets), "_part")  # one row per partition
    return out.select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])
