"""Session settings that the engine expects, and table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf overrides."""
    builder = SparkSession.builder.appName("tickloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    return builder.config(map=conf).getOrCreate()


#: Bytes of an Arrow batch, whose texts and arrays a worker holds several times over as Python objects, and Spark's default.
BATCH_BYTES, _DEFAULT_BYTES = 1 << 22, 1 << 26
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it and, unless the user set it,
    keep Arrow batches to BATCH_BYTES, so that a worker's memory does not follow the rows of its task."""
    if spark.conf.get(_BYTES, str(_DEFAULT_BYTES)) in (str(_DEFAULT_BYTES), f"{_DEFAULT_BYTES}b", "64MB", "64m"):
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def scratch(spark: SparkSession) -> str:
    """A new folder for intermediate files, under spark.checkpoint.dir; a temporary one where that is
    unset and driver and executors are one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return f"{shared.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{temporary()}/files"


def temporary() -> str:
    """A folder of this process, on this machine, which goes when the process ends."""
    path = tempfile.mkdtemp(prefix="tickloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, where its files make a quarter as many partitions or fewer: work on
    long texts would wait for a few tasks, and so little data is soon shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * df.rdd.getNumPartitions() <= cores else df


#: Tables of long texts.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in TEXTS else found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the folder that the cluster shares and read it back: no lineage, computed once."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()
