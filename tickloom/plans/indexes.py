"""Queries over stored indexes of vectors and words, and over chunks with the ids that they have."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import tools
from tickloom.functions import labels
from tickloom.functions import text as X
from tickloom.operators import retrieval as R
from tickloom.operators import text_prep as P
from tickloom.operators import search, segment, vector_boxes, vector_index, word_index
from tickloom.plans import texts, timeseries
from tickloom.session import cut, scratch, table, workers_import

#: Letters whose shares in a text stand for a model's embedding.
LETTERS = "aeinrstu"


def letter_shares(batch: list[str]) -> list[list[float]]:
    """Times of each of LETTERS in every text."""
    return [[float(t.count(c)) for c in LETTERS] for t in batch]


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return asked, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def _vector_hits(spark, sf_dir, probes):
    folder = scratch(spark)
    asked, corpus = _vectors(spark, sf_dir)
    vector_index.write(corpus, folder)
    return vector_index.search(asked, folder, 20, probes)


def vector_index_topk(spark, sf_dir):
    """As many lists as calibration asks for: some hits of the exact search may be missed."""
    return _vector_hits(spark, sf_dir, None)


def vector_index_all(spark, sf_dir):
    """Every list probed: the exact search's rows, so that none is missing from the index."""
    return _vector_hits(spark, sf_dir, vector_index.LISTS)


def chunk_search(spark, sf_dir):
    """Documents cut into chunks with ids that are strings, embedded, and the nearest chunks of every
    20th document's first chunk."""
    workers_import(spark)
    chunks = P.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    own = cut(R.embedded(chunks.select("doc_id", "chunk_no", "chunk_id", "content"), letter_shares).drop("content"))
    asked = own.where("doc_id % 20 = 0 and chunk_no = 1").select(F.col("chunk_id").alias("query_id"), "vector")
    return vector_boxes.topk(asked, own.select("chunk_id", "vector"), 5)


def _halves(spark, sf_dir):
    """An index of two segments: documents of even ids and with a text of their own, then all others,
    some even ones again with the text they have in the table."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    folder = scratch(spark)
    again = F.col("chunk_id") % 10 == 0
    word_index.add(d.where("chunk_id % 2 = 0").withColumn("content", F.when(again, F.upper(F.substr("content", F.lit(1), F.lit(40)))).otherwise(F.col("content"))), folder)
    word_index.add(d.where((F.col("chunk_id") % 2 == 1) | again), folder)
    return folder


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_segments(spark, sf_dir):
    """Before a merge: chunks that were added again count once."""
    return word_index.search(_asked(spark, sf_dir), _halves(spark, sf_dir))


def bm25_pruned(spark, sf_dir):
    """After a merge: by blocks and their bounds."""
    folder = _halves(spark, sf_dir)
    word_index.merge(spark, folder)
    return word_index.search(_asked(spark, sf_dir), folder)


def bm25_deleted(spark, sf_dir):
    """Without the documents of every seventh id, deleted and merged away."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    folder = scratch(spark)
    word_index.add(d, folder)
    word_index.delete(d.where("chunk_id % 7 = 0"), folder)
    word_index.merge(spark, folder)
    return word_index.search(_asked(spark, sf_dir), folder)


def near_dup_sampled(spark, sf_dir):
    """Each document with its class of equal fingerprints and the near ones that the sampling index finds."""
    rows = P.sampled_links(texts.simhash(spark, sf_dir).select(F.col("doc_id").alias("id"), "fp"))
    return rows.select(F.col("id").alias("doc_id"), "fp", "class_id", "copies", "links")


def strings_by_grams(spark, sf_dir):
    """Which documents hold the first two words of which, by their rarest grams."""
    workers_import(spark)
    d = table(spark, sf_dir, "documents")
    first = F.regexp_extract("text", r"^(\S+ \S+)", 1)
    return search.joined(d.select(F.col("doc_id").alias("id"), "text"), d.select(first.alias("needle")))


def _ideographs(column):
    """Letters as ideographs, so that words are runs without a cut of their own."""
    small = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.lower(column), small, "".join(chr(0x4E00 + 37 * k) for k in range(len(small))))


def segmented_terms(spark, sf_dir):
    """Every document's letters as ideographs, cut into words by the cheapest path through a lattice of strings
    that the corpus holds often."""
    d = table(spark, sf_dir, "documents").select("doc_id", _ideographs(F.col("text")).alias("text"))
    own = d.select("doc_id", segment.cutter(d, segment.learn(d))("text").alias("terms"))
    return own.select("doc_id", F.size("terms").alias("n_terms"), F.md5(F.array_join("terms", " ").cast("binary")).alias("digest"))


def bm25_words(spark, sf_dir):
    """BM25 over the terms of a lexicon that was counted over the documents; spaced texts have the same as ever."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return R.bm25_topk(_asked(spark, sf_dir), d, cut_by=segment.cutter(d, segment.learn(d, "content")))


def file_tokens(name: str):
    """Counts by a public tokenizer's file; special tokens' spellings in texts are text."""

    def load():
        import os

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = Tokenizer.from_file(public_tokenizers.path(name))
        own.encode_special_tokens = True
        return lambda batch: [len(e.ids) for e in own.encode_batch_fast(batch, add_special_tokens=False)]

    return load


def token_count_model(spark, sf_dir):
    """Tokens of every document by a model's tokenizer in place of the rule."""
    workers_import(spark)
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.tokens_by(file_tokens("byte_bpe_50k.json"))("text").alias("tokens"))


def indicator_tool(spark, sf_dir):
    """The indicator tool over hourly bars: values and their wording."""
    found = tools.get_indicators(timeseries.hourly(spark, sf_dir))
    return found.select("symbol", "macd_dif", "rsi6", "kdj_k", "macd_text", "rsi_text")


QUERIES = {f.__name__: f for f in (vector_index_topk, vector_index_all, chunk_search, bm25_segments, bm25_pruned, bm25_deleted, near_dup_sampled, strings_by_grams, segmented_terms, bm25_words, token_count_model, indicator_tool)}

_COUNTS = ", ".join(f"(length(content) - length(replace(content, '{c}', '')))::DOUBLE" for c in LETTERS)
_MACD_TEXT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.MACD.items())
ORACLES = {
    "indicator_tool": f"""SELECT symbol, macd_dif, rsi6, kdj_k, CASE macd_signal {_MACD_TEXT} ELSE '无明确信号' END AS macd_text, CASE WHEN rsi6 IS NULL THEN '无数据' WHEN rsi6 > 70 THEN '超买区' WHEN rsi6 < 30 THEN '超卖区' ELSE '正常区间' END AS rsi_text
FROM ({timeseries.ORACLES["macd"]}) JOIN ({timeseries.ORACLES["macd_signal"]}) USING (symbol) JOIN ({timeseries.ORACLES["rsi"]}) USING (symbol) JOIN ({timeseries.ORACLES["kdj"]}) USING (symbol)""",
    "strings_by_grams": r"WITH n AS (SELECT DISTINCT regexp_extract(text, '^(\S+ \S+)', 1) AS needle FROM documents) SELECT doc_id AS id, needle FROM documents JOIN n ON needle <> '' AND contains(text, needle)",
    "bm25_words": texts.ORACLES["bm25_topk"],
    "bm25_segments": texts.ORACLES["bm25_topk"],
    "bm25_pruned": texts.ORACLES["bm25_topk"],
    "bm25_deleted": texts.ORACLES["bm25_topk"].replace("FROM documents WHERE text IS NOT NULL", "FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 0"),
    "vector_index_all": texts.ORACLES["vector_topk"],
    "chunk_search": f"""WITH ch AS ({texts.ORACLES["chunk_documents"]}), cv AS MATERIALIZED (SELECT doc_id, chunk_no, chunk_id, [{_COUNTS}] AS v FROM ch),
cn AS MATERIALIZED (SELECT *, sqrt(list_sum([x * x for x in v])) AS norm FROM cv),
cs AS (SELECT q.chunk_id AS query_id, c.chunk_id, floor((CASE WHEN q.norm = 0 OR c.norm = 0 THEN 0 ELSE list_inner_product(q.v, c.v) / q.norm / c.norm END + 1) / 2 * 1e6 + 0.5) / 1e6 AS score FROM cn q, cn c WHERE q.doc_id % 20 = 0 AND q.chunk_no = 1)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM cs QUALIFY rank <= 5""",
}
