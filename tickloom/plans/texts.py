"""Queries over documents, embeddings, benchmark and pages: text preparation and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import text as X
from tickloom.operators import retrieval as R
from tickloom.operators import text_prep as P
from tickloom.session import table, workers_import
from tickloom.sources import files, pages

AS_OF = "TIMESTAMP '2024-06-01 00:00:00'"


def text_clean(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    c = X.clean(F.col("text"), compatibility=False)
    return d.select("doc_id", F.length(c).alias("chars"), F.md5(c.cast("binary")).alias("digest"))


def sentence_split(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


def text_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate(F.col("text"), 240).alias("short"))


def contains_any(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.contains_any(F.col("text"), ("license", "%%%")).alias("plain"), X.contains_any(F.col("text"), ("LICENSE", "%%%"), True).alias("folded"))


def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_count(F.col("text")).alias("tokens"))


def ingest_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    blank = F.coalesce(F.trim("text") == "", F.lit(True))
    return d.groupBy("lang").agg(F.count_if(~blank).alias("documents"), F.count_if(blank).alias("refused"), F.sum(X.token_count(F.col("text"))).alias("tokens"))


def chunk_documents(spark, sf_dir):
    workers_import(spark)
    return P.chunk_documents(table(spark, sf_dir, "documents"))


def simhash(spark, sf_dir):
    workers_import(spark)
    return table(spark, sf_dir, "documents").select("doc_id", P.simhash("text").alias("fp"))


def near_dup_pairs(spark, sf_dir):
    """Each document with its class of equal fingerprints and how many others are within NEAR (22) of 64 bits."""
    rows = P.near_links(simhash(spark, sf_dir).select(F.col("doc_id").alias("id"), "fp"))
    return rows.select(F.col("id").alias("doc_id"), "fp", "class_id", "copies", "links")


def _vector_hits(spark, sf_dir, k):
    workers_import(spark)
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.vector_topk(queries, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), k)


def _entries(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("stock_code"), F.col("lang").alias("stock_name"), F.col("text").alias("content"), (F.expr(AS_OF) - F.make_dt_interval((F.col("doc_id") % 500).cast("int"))).alias("created_at"))


def _bm25_hits(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25_topk(queries, _entries(spark, sf_dir).select("chunk_id", "content"))


def vector_topk(spark, sf_dir):
    return _vector_hits(spark, sf_dir, 20)


def bm25_topk(spark, sf_dir):
    return _bm25_hits(spark, sf_dir)


def hybrid_fusion(spark, sf_dir):
    return R.hybrid(_vector_hits(spark, sf_dir, 20), _bm25_hits(spark, sf_dir)).select("query_id", "chunk_id", "vector_rank", "bm25_rank", "hit_by_vector", "hit_by_bm25", "final_score", "final_rank")


def rerank_topk(spark, sf_dir):
    """An external scorer that likes high chunk ids, over the fused hits."""
    fused = R.fuse(_vector_hits(spark, sf_dir, 20), _bm25_hits(spark, sf_dir))
    return R.rerank(fused, F.col("chunk_id") % 97 + F.lit(0.0), 5).select("query_id", "chunk_id", "final_score", "final_rank")


def kb_retrieve(spark, sf_dir):
    hits = R.retrieve(_vector_hits(spark, sf_dir, 30), _bm25_hits(spark, sf_dir), _entries(spark, sf_dir), F.expr(AS_OF), target_code="src1", target_name="en")
    return hits.select("query_id", "chunk_id", "score", "rank")


def recency_weight(spark, sf_dir):
    return _entries(spark, sf_dir).select("chunk_id", X.recency(F.col("created_at"), F.expr(AS_OF)).alias("weight"))


def context_render(spark, sf_dir):
    return R.context(_bm25_hits(spark, sf_dir).where("rank <= 5"), _entries(spark, sf_dir))


def kb_stats(spark, sf_dir):
    e = _entries(spark, sf_dir).where("trim(stock_code) <> ''")
    return e.groupBy("stock_code").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("stock_name").alias("names"), F.min("chunk_id").alias("first_seen"))


def page_links(spark, sf_dir):
    return pages.links(table(spark, sf_dir, "pages"), ("example.com", "example.org"))


def csv_import_stats(spark, sf_dir):
    """Documents written as CSV lines, some blank, commented, short or without a code, and read back."""
    workers_import(spark)
    k = F.col("doc_id") % 10
    body = F.concat(F.lit('"'), F.replace(F.regexp_replace("text", "\\s+", " "), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.when(k == 0, "  ").when(k == 1, "# note").when(k == 2, "a,b").when(k == 3, ",n,c,text").otherwise(F.concat_ws(",", "source", "lang", F.lit("c"), body))
    return files.csv_stats(files.csv_rows(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), line.alias("line"))))


QUERIES = {f.__name__: f for f in (text_clean, sentence_split, text_truncate, contains_any, token_count, ingest_stats, chunk_documents, simhash, near_dup_pairs, vector_topk, bm25_topk, hybrid_fusion, rerank_topk, kb_retrieve, recency_weight, context_render, kb_stats, page_links, csv_import_stats)}

_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '\r', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '(\n\s*){2,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"""
_VECTOR = """vq AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
vs AS (SELECT query_id, vec_id AS chunk_id, floor((list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) + 1) / 2 * 1e6 + 0.5) / 1e6 AS score FROM vq, embeddings),
vh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM vs QUALIFY rank <= 20)"""
_BM25 = r"""bq AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark), bqa AS (SELECT query_id, term, count(*) AS qtf FROM bq GROUP BY ALL),
bd AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ts FROM documents WHERE text IS NOT NULL), bn AS (SELECT count(*)::DOUBLE AS n, sum(len(ts)) / count(*) AS mean FROM bd),
bp AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM bd) GROUP BY chunk_id, term), bf AS (SELECT term, count(*) AS df FROM bp GROUP BY term),
bs AS (SELECT query_id, chunk_id, sum(floor(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / mean))) * 1e9 + 0.5)) / 1e9 AS s FROM bqa JOIN bp USING (term) JOIN bf USING (term), bn GROUP BY query_id, chunk_id),
bh AS (SELECT query_id, chunk_id, floor(s * 1e6 + 0.5) / 1e6 AS score, row_number() OVER (PARTITION BY query_id ORDER BY floor(s * 1e6 + 0.5) / 1e6 DESC, chunk_id)::INT AS rank FROM bs QUALIFY rank <= 20)"""
_FUSED = """w1 AS (SELECT query_id, chunk_id, rank, (count(*) OVER (PARTITION BY query_id) - rank + 1) / count(*) OVER (PARTITION BY query_id) * 0.7::DOUBLE AS w FROM vh),
w2 AS (SELECT query_id, chunk_id, rank, (count(*) OVER (PARTITION BY query_id) - rank + 1) / count(*) OVER (PARTITION BY query_id) * 0.3::DOUBLE AS w FROM bh),
fu AS (SELECT coalesce(w1.query_id, w2.query_id) AS query_id, coalesce(w1.chunk_id, w2.chunk_id) AS chunk_id, w1.rank AS vector_rank, w2.rank AS bm25_rank, floor((coalesce(w1.w, 0) + coalesce(w2.w, 0)) * 1e9 + 0.5) / 1e9 AS final_score FROM w1 FULL JOIN w2 ON w1.query_id = w2.query_id AND w1.chunk_id = w2.chunk_id)"""
_TITLE = r"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(body, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"

#: The bigram fingerprint: FNV-1a over two code units and the splitmix64 finaliser, in 128 bits, and a
#: majority of each bit. Code units are code points here: the texts have none beyond 16 bits.
_M = "18446744073709551615::UHUGEINT"
_MIXED = f"""fm AS (SELECT doc_id, unnest(string_split(text, '')[1:-2]) AS a, unnest(string_split(text, '')[2:]) AS b FROM documents WHERE trim(text) <> ''),
fg AS (SELECT doc_id, unicode(a)::UHUGEINT AS a, unicode(b)::UHUGEINT AS b, count(*) AS n FROM fm GROUP BY ALL), fd AS (SELECT DISTINCT a, b FROM fg),
f1 AS (SELECT a, b, (xor(((xor(14695981039346656037::UHUGEINT, a)) * 1099511628211::UHUGEINT) & {_M}, b) * 1099511628211::UHUGEINT) & {_M} AS h FROM fd),
f2 AS (SELECT a, b, (xor(h, h >> 30) * 13787848793156543929::UHUGEINT) & {_M} AS h FROM f1), f3 AS (SELECT a, b, (xor(h, h >> 27) * 10723151780598845931::UHUGEINT) & {_M} AS h FROM f2), f4 AS (SELECT a, b, xor(h, h >> 31) AS h FROM f3)"""
_BITS = " + ".join(f"CASE WHEN sum(CASE WHEN (h >> {k}) & 1 = 1 THEN n ELSE -n END) > 0 THEN {'-' if k == 63 else ''}{1 << k}::HUGEINT ELSE 0 END" for k in range(64))
_PRINTS = f"{_MIXED}, fs AS (SELECT doc_id, {_BITS} AS fp FROM fg JOIN f4 USING (a, b) GROUP BY doc_id), fp AS (SELECT doc_id, coalesce(fp, 0)::BIGINT AS fp FROM documents LEFT JOIN fs USING (doc_id))"

ORACLES = {
    "chunk_documents": r"""WITH RECURSIVE c0 AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?。；！？]*[.!?。；！？]|[^.!?。；！？]+$'), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL),
c1 AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k, unnest(list_transform(s, lambda x: greatest(1, length(x) // 2))) AS cost FROM c0 WHERE len(s) > 0),
c2 AS (SELECT doc_id, k, cost, sum(cost) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS upto, max(k) OVER (PARTITION BY doc_id) AS last FROM c1),
c3 AS (SELECT a.doc_id, a.k, a.upto - a.cost AS before, a.last, coalesce(e.k, a.last) AS until, coalesce(e.upto, (SELECT max(upto) FROM c2 z WHERE z.doc_id = a.doc_id)) AS reached FROM c2 a ASOF LEFT JOIN c2 e ON e.doc_id = a.doc_id AND e.upto >= a.upto - a.cost + 400),
c4 AS (SELECT c3.*, greatest(c3.k + 1, coalesce(b.k, 1)) AS next FROM c3 ASOF LEFT JOIN (SELECT doc_id, k, upto - cost AS before FROM c2) b ON b.doc_id = c3.doc_id AND b.before <= c3.reached - 80),
c5 AS (SELECT doc_id, 1 AS no, k, until, reached - before AS tokens, next, last FROM c4 WHERE k = 1 UNION ALL SELECT c4.doc_id, c5.no + 1, c4.k, c4.until, c4.reached - c4.before, c4.next, c4.last FROM c5 JOIN c4 ON c4.doc_id = c5.doc_id AND c4.k = c5.next WHERE c5.until < c5.last)
SELECT c5.doc_id, no::INT AS chunk_no, 'chunk-' || substr(sha256(c5.doc_id || '/' || no), 1, 16) AS chunk_id, array_to_string(s[c5.k:c5.until], '') AS content, tokens::INT AS tokens FROM c5 JOIN c0 ON c0.doc_id = c5.doc_id""",
    "kb_retrieve": f"""WITH RECURSIVE {_VECTOR.replace("rank <= 20", "rank <= 30")}, {_BM25}, {_FUSED}, {_PRINTS},
k0 AS (SELECT query_id, chunk_id, coalesce(fp, 0) AS fp, floor((final_score + CASE WHEN source = 'src1' THEN 0.30::DOUBLE WHEN lang = 'en' THEN 0.25::DOUBLE ELSE 0 END) * CASE WHEN d.doc_id IS NULL THEN 1.0 WHEN chunk_id % 500 <= 7 THEN 1.5 WHEN chunk_id % 500 <= 90 THEN 1.2 WHEN chunk_id % 500 <= 365 THEN 0.8 ELSE 0.3 END::DOUBLE * 1e9 + 0.5) / 1e9 AS score FROM fu LEFT JOIN documents d ON d.doc_id = chunk_id LEFT JOIN fp ON fp.doc_id = chunk_id),
k1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS i FROM k0),
k2 AS (SELECT a.query_id, a.i, b.i AS j, row_number() OVER (PARTITION BY a.query_id ORDER BY a.i, b.i) AS p FROM k1 a JOIN k1 b ON a.query_id = b.query_id AND a.i < b.i AND a.fp <> 0 AND b.fp <> 0 AND bit_count(xor(a.fp, b.fp)) <= 22),
k3 AS (SELECT query_id, 0::BIGINT AS p, array_agg(score ORDER BY i) AS s FROM k1 GROUP BY query_id UNION ALL SELECT k3.query_id, k2.p, list_transform(s, lambda x, n: CASE WHEN n = CASE WHEN s[k2.i] > s[k2.j] THEN k2.j ELSE k2.i END THEN x - 0.5::DOUBLE ELSE x END) FROM k3 JOIN k2 ON k2.query_id = k3.query_id AND k2.p = k3.p + 1),
k4 AS (SELECT query_id, arg_max(s, p) AS s FROM k3 GROUP BY query_id)
SELECT query_id, chunk_id, floor(s[i] * 1e9 + 0.5) / 1e9 AS score, row_number() OVER (PARTITION BY query_id ORDER BY floor(s[i] * 1e9 + 0.5) / 1e9 DESC, chunk_id)::INT AS rank FROM k1 JOIN k4 USING (query_id) QUALIFY rank <= 30""",
    "simhash": f"WITH {_PRINTS} SELECT doc_id, fp FROM fp",
    "near_dup_pairs": f"WITH {_PRINTS}, fc AS (SELECT fp, min(doc_id) AS class_id, count(*) AS copies FROM fp GROUP BY fp), fl AS (SELECT a.fp, count(*) FILTER (WHERE b.fp <> 0 AND b.fp <> a.fp AND bit_count(xor(a.fp, b.fp)) <= 22 AND a.fp <> 0) AS links FROM fc a, fc b GROUP BY a.fp) SELECT doc_id, fp, class_id, copies, links FROM fp JOIN fc USING (fp) JOIN fl USING (fp)",
    "text_clean": f"WITH c AS (SELECT doc_id, {_CLEAN} AS t FROM documents) SELECT doc_id, length(t)::INT AS chars, md5(t) AS digest FROM c",
    "sentence_split": r"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?。；！？]*[.!?。；！？]|[^.!?。；！？]+$'), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '') AS s FROM documents) SELECT doc_id, len(s)::INT AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::INT AS longest FROM s",
    "text_truncate": "SELECT doc_id, CASE WHEN length(trim(text)) <= 240 THEN trim(text) ELSE substr(trim(text), 1, 240) || '...' END AS short FROM documents",
    "contains_any": "SELECT doc_id, contains(text, 'license') OR contains(text, '%%%') AS plain, contains(lower(text), 'license') OR contains(lower(text), '%%%') AS folded FROM documents",
    "token_count": "SELECT doc_id, CASE WHEN text IS NULL OR length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 2) END::INT AS tokens FROM documents",
    "ingest_stats": "SELECT lang, count(*) FILTER (WHERE trim(text) <> '') AS documents, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS refused, sum(CASE WHEN text IS NULL OR length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 2) END)::BIGINT AS tokens FROM documents GROUP BY lang",
    "vector_topk": f"WITH {_VECTOR} SELECT query_id, chunk_id, score, rank FROM vh",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM bh",
    "hybrid_fusion": f"WITH {_VECTOR}, {_BM25}, {_FUSED} SELECT query_id, chunk_id, vector_rank, bm25_rank, vector_rank IS NOT NULL AS hit_by_vector, bm25_rank IS NOT NULL AS hit_by_bm25, final_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id)::INT AS final_rank FROM fu QUALIFY final_rank <= 30",
    "rerank_topk": f"WITH {_VECTOR}, {_BM25}, {_FUSED} SELECT query_id, chunk_id, (chunk_id % 97)::DOUBLE AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id % 97 DESC, chunk_id)::INT AS final_rank FROM fu QUALIFY final_rank <= 5",
    "recency_weight": "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 500 <= 7 THEN 1.5 WHEN doc_id % 500 <= 90 THEN 1.2 WHEN doc_id % 500 <= 365 THEN 0.8 ELSE 0.3 END::DOUBLE AS weight FROM documents",
    "context_render": f"WITH {_BM25} SELECT query_id, string_agg(printf('[ref %d] ', rank) || lang || '(' || source || ') | ' || text, chr(10) ORDER BY rank) AS context FROM bh JOIN documents ON doc_id = chunk_id WHERE rank <= 5 GROUP BY query_id",
    "kb_stats": "SELECT source AS stock_code, count(*) AS entries, count(DISTINCT lang) AS names, min(doc_id) AS first_seen FROM documents WHERE trim(source) <> '' GROUP BY source",
    "page_links": rf"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"[^>]*>.*?</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"[^"]*"[^>]*>(.*?)</a>', 1) AS b FROM pages),
l AS (SELECT page_id, url, unnest(range(len(h))) AS pos, unnest(h) AS href, unnest(b) AS body FROM a),
t AS (SELECT page_id, pos, {_TITLE} AS title, CASE WHEN regexp_matches(replace(href, '&amp;', '&'), '^[A-Za-z][A-Za-z0-9+.-]*:') THEN replace(href, '&amp;', '&') WHEN href LIKE '/%' THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || replace(href, '&amp;', '&') WHEN href = '' THEN '' ELSE regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || '/' || replace(href, '&amp;', '&') END AS url FROM l)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INT AS rank, title, url FROM t WHERE length(title) >= 6 AND (contains(url, 'example.com') OR contains(url, 'example.org')) QUALIFY rank <= 5""",
    "csv_import_stats": "SELECT count(*) FILTER (WHERE doc_id % 10 > 3 AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '') AS imported, count(*) AS total_rows, count(*) FILTER (WHERE NOT (doc_id % 10 > 3 AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '')) AS skipped, count(*) FILTER (WHERE doc_id % 10 IN (2, 3) OR doc_id % 10 > 3 AND trim(regexp_replace(text, '\\s+', ' ', 'g')) = '') AS errors FROM documents".replace("\\\\", "\\"),
}
