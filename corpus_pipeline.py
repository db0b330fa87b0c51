"""A corpus pipeline of five stages over ``documents``; each works on all its predecessor kept.

Quality rules, exact dedup, SimHash near-dedup, mixing sources to target weights, packing. All
stages but the last return the columns of documents. Each is written as Parquet in the shared
folder and read again as the next one's docs.

Null and empty texts fail the quality rules and go with it; a null source is a source of its own.
Of rows that repeat a document one stays; rows that repeat an id with different texts are told
apart, and rows without an id are kept, except as exact copies. Empty tables give empty results.
Other columns are carried along as they are, whatever their names, up to packing, whose pieces
keep doc_id alone.
"""

from __future__ import annotations

import uuid

from tickloom.llm import exact_dedup, mixing, packing, quality, simhash
from tickloom.llm.common import remove, shared_dir
from tickloom.llm.queries import tokenizer
from tickloom.session import spread, table


def quality_rules(spark, docs, sf_dir):
    """Documents that pass, without lines above their host's limit."""
    return _counted(quality.clean(docs), docs)


def exact(spark, docs, sf_dir):
    return exact_dedup.dedup(docs)


def near(spark, docs, sf_dir):
    """One document of each component of near fingerprints."""
    return simhash.dedup(docs)


def mixed(spark, docs, sf_dir):
    """Documents as often as the mix takes them; the budget's last one of a source is cut there."""
    return _counted(mixing.mix(docs), docs)


def packed(spark, docs, sf_dir):
    found = packing.pack(docs, tokenizer("byte_bpe_50k.json"))
    return found.select("doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _counted(found, docs):
    """n_chars follows the text, where there is such a column."""
    from pyspark.sql import functions as F

    if "n_chars" not in docs.columns:
        return found
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mixed), ("packing", packed)]

#: SimHash, mixing after it and packing go by XXH64 and a tokenizer, which DuckDB lacks.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage. Each stage's files go when the next one's are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spread(spark.read.parquet(path))
            if before:
                remove(spark, before)
            before = path
    return docs
