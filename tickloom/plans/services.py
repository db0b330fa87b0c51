"""Queries over what is written and read back: files, indexes, sinks, contexts, caches and retries.

Each writes its input from the test tables to a scratch folder in the form that a reader expects,
and reads it as a caller would.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import tools
from tickloom.functions import codes, labels
from tickloom.functions import text as X
from tickloom.operators import monitor, ops
from tickloom.operators import relational as J
from tickloom.operators import retrieval as R
from tickloom.plans import conversations, indexes, texts
from tickloom.session import scratch, table, workers_import
from tickloom.sources import files, market, pages, sinks


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# Readers ----------------------------------------------------------------------------------


def doc_scan(spark, sf_dir):
    """Documents written as text files, by source and remainder of the id, and scanned as files."""
    workers_import(spark)
    folder = scratch(spark)
    d = _documents(spark, sf_dir).select(F.concat_ws("-", "source", F.col("doc_id") % 8).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    d.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(folder)
    got = files.documents(spark, folder).where(F.col("path").endswith(".txt"))
    return got.groupBy(F.regexp_extract("path", "part=([^/]*)", 1).alias("part")).agg(F.sum(F.length("text")).alias("chars"), F.sum(F.size(F.split("text", "\n")) - 1).alias("lines"), F.sum("bytes").alias("bytes"))


def manifest_scan(spark, sf_dir):
    """Knowledge entries as JSON arrays of 500 documents, read as manifests."""
    folder = scratch(spark)
    d = _documents(spark, sf_dir)
    entry = F.struct(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit(" "), "source").alias("stockCode"), F.col("lang").alias("stockName"), F.col("text").alias("content"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("news").alias("category"), F.lit("2024-01-02T03:04:05Z").alias("createdAt"))
    part = F.floor(F.col("doc_id") / 500).alias("part")
    d.groupBy(part).agg(F.to_json(F.collect_list(entry)).alias("value")).write.partitionBy("part").text(folder)
    return files.manifest(spark, folder).select("id", "stock_code", "stock_name", F.length("content").alias("chars"), "category", F.unix_timestamp("created_at").alias("created"))


def vector_store_scan(spark, sf_dir):
    """Embeddings as stored vectors in JSON, a file for 500 of them."""
    folder = scratch(spark)
    e = table(spark, sf_dir, "embeddings")
    entry = F.struct(F.col("vec_id").cast("string").alias("id"), F.struct(F.col("embedding").alias("vector")).alias("embedding"), F.struct(F.concat(F.lit("t"), "vec_id").alias("text"), F.struct(F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata")).alias("metadata")).alias("embedded"))
    part = F.floor(F.col("vec_id") / 500).alias("part")
    e.groupBy(part).agg(F.to_json(F.struct(F.collect_list(entry).alias("entries"))).alias("value")).write.partitionBy("part").text(folder)
    r = files.vector_store(spark, folder)
    return r.select("chunk_id", F.size("vector").alias("dims"), F.floor(F.element_at("vector", 1) * 1000 + 0.5).cast("long").alias("first"), "content", F.col("metadata")["label"].alias("label"))


def cases_scan(spark, sf_dir):
    """Labelled documents as JSON lines, read as evaluation cases and counted."""
    folder = scratch(spark)
    own = table(spark, sf_dir, "labels").join(_documents(spark, sf_dir), "doc_id")
    own.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"), F.array("lang", "source").alias("toolObservations"), F.col("quality").cast("string").alias("expected"), F.col("lang").alias("category")).write.json(folder)
    c = files.cases(spark, folder)
    return c.groupBy("category", "expected").agg(F.count(F.lit(1)).alias("cases"), F.sum(F.size("toolObservations")).alias("observations"))


def csv_scan(spark, sf_dir):
    """Documents as CSV files with headers, one a source; read by lines, with each line's place in its file."""
    workers_import(spark)
    folder = scratch(spark)
    k = F.col("doc_id") % 10
    body = F.concat(F.lit('"'), F.replace(F.regexp_replace("text", "\\s+", " "), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.when(k == 0, "  ").when(k == 1, "# note").when(k == 2, "a,b").otherwise(F.concat_ws(",", "source", "lang", F.lit("c"), body))
    rows = _documents(spark, sf_dir).select(F.col("source").alias("part"), "doc_id", line.alias("value"))
    rows = rows.unionByName(rows.select("part").distinct().select("part", F.lit(-1).cast("long").alias("doc_id"), F.lit("code,name,category,content").alias("value")))
    rows.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(folder)
    got = files.read_csv(spark, folder).withColumn("part", F.regexp_extract("file", "part=([^/]*)", 1))
    return got.groupBy("part", "status").agg(F.count(F.lit(1)).alias("lines"), F.sum("line_no").alias("places"))


# Decoders ---------------------------------------------------------------------------------


def json_bar_decode(spark, sf_dir):
    """Orders as JSON bars, the second of two without a close, some responses broken."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("string")
    bar = lambda close: F.concat(F.lit('{"day":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('","open":"'), price, F.lit('"'), close, F.lit(',"volume":"'), (F.col("o_orderkey") % 100).cast("string"), F.lit('"}'))
    text = F.when(F.col("o_orderkey") % 13 == 0, "{broken").otherwise(F.concat(F.lit("["), bar(F.concat(F.lit(',"close":"'), price, F.lit('"'))), F.lit(","), bar(F.lit("")), F.lit("]")))
    return market.json_bars(o.select(F.col("o_orderkey").alias("symbol"), text.alias("response"))).select("symbol", "bar_idx", "date", "open", "close", "volume")


def statement_decode(spark, sf_dir):
    """Suppliers' balances as financial statements, the newest row first, some without one."""
    s = table(spark, sf_dir, "supplier")
    row = F.concat(F.lit('{"year":"2023","revenue":"'), F.col("s_acctbal").cast("string"), F.lit('","roe":null,"profit":"-"}'))
    text = F.when(F.col("s_suppkey") % 5 == 0, '{"result":{"data":[]}}').otherwise(F.concat(F.lit('{"result":{"data":['), row, F.lit(',{"year":"2022","revenue":"1"}]}}')))
    return tools.get_financials(s.select(F.col("s_suppkey").alias("code"), text.alias("response"))).select("code", "year", "revenue", "profit", "roe")


def sector_page(spark, sf_dir):
    """The second page of five of each region's nations as a sector list."""
    n = table(spark, sf_dir, "nation")
    item = F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("f12"), F.col("n_name").alias("f14"), (F.col("n_nationkey") * 1.5).alias("f2"), F.when(F.col("n_nationkey") % 2 == 0, "-").otherwise("0.5").alias("f3")))
    one = n.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("item")))).alias("a"))
    return market.sectors(one.select(F.concat(F.lit('{"data":{"diff":['), F.array_join(F.col("a.item"), ","), F.lit("]}}")).alias("response")), 2, 5)


def financial_tables(spark, sf_dir):
    """Pages with a table of parts' prices and sizes; every fourth table has nothing in its second column."""
    workers_import(spark)
    p = table(spark, sf_dir, "part")
    second = F.when(F.col("p_partkey") % 4 == 0, "--").otherwise(F.format_number("p_retailprice", 1))
    html = F.concat(F.lit("<html><table><tr><td>r</td><td>"), second, F.lit(" M</td></tr><tr><td>p</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr></table>"))
    return pages.financials(p.select(F.col("p_partkey").alias("page_id"), html.alias("html")))


def code_forms(spark, sf_dir):
    """Period codes, keyword codes, codes of what a user typed, address forms and bounded requests."""
    k = F.col("l_orderkey") % 4
    minutes = F.element_at(F.array(F.lit(240), F.lit(1200), F.lit(7200), F.lit(60)), (k + 1).cast("int"))
    six = F.lpad((F.col("l_partkey") % 900000).cast("string"), 6, "0")
    typed = F.when(k == 0, "茅台今天").when(k == 1, six).when(k == 2, F.concat(F.lit("0."), six)).otherwise("none")
    resolved = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("code 1."), six)).otherwise("unknown")
    own = table(spark, sf_dir, "lineitem")
    return own.select("l_orderkey", "l_linenumber", codes.period_code(minutes).alias("period"), codes.keyword_secid(typed).alias("keyword"), codes.input_to_secid(typed, resolved).alias("typed"), F.url_encode(F.concat("l_returnflag", F.lit(" &/"), "l_linestatus")).alias("encoded"), tools.rounds(F.col("l_quantity").cast("int") * 10 - 100).alias("rounds"), tools.kline_days((F.col("l_quantity") * 5).cast("int")).alias("days"), X.prefer_filled(F.when(k == 0, " "), F.when(k == 1, F.lit(None).cast("string")).otherwise(F.col("l_shipdate").cast("string").substr(1, 10)), F.col("l_returnflag")).alias("filled"))


def signal_wording(spark, sf_dir):
    """Wording of each signal that an event's remainder stands for."""
    k = F.col("event_id") % 5
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k + 1).cast("int"))
    e = table(spark, sf_dir, "events")
    return e.select("event_id", labels.macd(pick("golden_cross", "death_cross", "x", "", "y")).alias("macd"), labels.trend(pick("bullish", "bearish", "x", "", "y")).alias("trend"), labels.momentum(pick("overbought", "oversold", "overbought_trend_up", "oversold_trend_down", "x")).alias("momentum"), labels.rsi(F.when(k == 4, F.lit(None)).otherwise(pick(71.0, 70.0, 29.5, 30.0, 0.0))).alias("rsi"))


def text_nfkc(spark, sf_dir):
    """Texts with letters and digits in full width, which compatible composition turns back, cleaned."""
    workers_import(spark)
    narrow = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789"
    wide = F.translate("text", narrow, "".join(chr(ord(c) + 0xFEE0) for c in narrow))
    c = X.clean(wide)
    return _documents(spark, sf_dir).select("doc_id", F.length(c).alias("chars"), F.md5(c.cast("binary")).alias("digest"))


# Indexes, sinks and contexts --------------------------------------------------------------


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_indexed(spark, sf_dir):
    """BM25 over an index on disk, built in two steps, of which the second adds to the first."""
    folder = scratch(spark)
    own = texts._entries(spark, sf_dir).select("chunk_id", "content")
    sinks.write_index(own.where("chunk_id % 3 <> 0"), folder)
    sinks.write_index(own.where("chunk_id % 3 = 0"), folder, add=True)
    return R.index_search(_asked(spark, sf_dir), folder)


def sink_rounds(spark, sf_dir):
    """Customers written, some replaced, some appended, then synchronised with those in debt."""
    folder = scratch(spark)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    sinks.replace(c, f"{folder}/a")
    sinks.replace(c.where("c_custkey % 2 = 0"), f"{folder}/a")
    sinks.append(c.where("c_custkey % 4 = 1"), f"{folder}/a")
    now = spark.read.parquet(f"{folder}/a")
    gone = sinks.sync(now, now.where("c_acctbal < 0"), "c_custkey", f"{folder}/b")
    sinks.write_report(spark.read.parquet(f"{folder}/b"), f"{folder}/c")
    kept = spark.read.schema("c_custkey long, c_acctbal double").json(f"{folder}/c")
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.sum("c_custkey").alias("keys")).withColumn("gone", F.lit(gone).cast("long"))


def _knowledge(spark, sf_dir):
    d = _documents(spark, sf_dir)
    code = F.when(F.col("doc_id") % 4 == 0, R.GENERAL).otherwise(F.col("source"))
    return d.select(F.col("doc_id").alias("chunk_id"), code.alias("stock_code"), F.col("lang").alias("stock_name"), F.col("text").alias("content"), F.lit("k").alias("category"), F.col("source"), X.token_count(F.col("text")).alias("token_count"))


def _split_hits(spark, sf_dir):
    hits = texts._bm25_hits(spark, sf_dir)
    rules, known = hits.where("chunk_id % 4 = 0"), hits.where("chunk_id % 4 <> 0")
    return [R.top(h.drop("rank"), 5, "score") for h in (rules, known)]


def knowledge_context(spark, sf_dir):
    """General rules, then entries, of each question's hits."""
    rules, known = _split_hits(spark, sf_dir)
    return R.knowledge_context(rules, known, _knowledge(spark, sf_dir))


def retriever_rows(spark, sf_dir):
    hits = texts._bm25_hits(spark, sf_dir).where("rank <= 5").select("query_id", "chunk_id", F.col("score").alias("final_score"), F.col("rank").alias("final_rank"))
    return R.retriever_rows(hits, _knowledge(spark, sf_dir))


def rules_left(spark, sf_dir):
    """General rules after entries of some ids are deleted, whatever they were filed under."""
    entries = _knowledge(spark, sf_dir)
    left = R.delete_entries(entries, entries.where("chunk_id % 6 = 0").select("chunk_id"))
    return R.general_rules(left).select("chunk_id", "stock_name")


def advice_blocks(spark, sf_dir):
    """Texts that a model might have written from each question, cut into numbered suggestions."""
    b = table(spark, sf_dir, "benchmark")
    first = F.trim(F.regexp_replace("text", "\\s+", " "))
    text = F.concat(F.lit("前言\n建议1: "), first, F.lit("\n【规范依据】"), F.col("item_id").cast("string"), F.lit("\n【原文片段】"), first, F.lit("\n建议 2："), first, F.lit("\n【引用ID】REF-"), (F.col("item_id") % 7).cast("string"))
    return J.suggestions(b.select(F.col("item_id").alias("id"), text.alias("text"))).select("id", "no", "basis", "evidence", "ref_id")


def by_length(query: str, found: list[str], n: int) -> list[tuple[int, float]]:
    """Stands for a reranking model: scores by the texts' lengths, and names a place that is not there."""
    scores = sorted(((k, float(len(t or "") % 97)) for k, t in enumerate(found)), key=lambda x: (-x[1], x[0]))
    return [(len(found) + 3, 1e9), *scores[:n]]


def rerank_external(spark, sf_dir):
    """The fused hits in the order of an external function of query and texts."""
    workers_import(spark)
    hits = R.fuse(texts._vector_hits(spark, sf_dir, 20), texts._bm25_hits(spark, sf_dir)).select("query_id", "chunk_id", "final_score")
    asked = _asked(spark, sf_dir).withColumnRenamed("text", "query").unionByName(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.lit("any").alias("query")))
    asked = asked.groupBy("query_id").agg(F.max("query").alias("query"))
    content = _documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return R.rerank_with(hits.join(asked, "query_id").join(content, "chunk_id", "left"), by_length)


def quotes_tool(spark, sf_dir):
    """Quotes through the tool, parts of even keys from one provider and of odd ones from the other."""
    p = table(spark, sf_dir, "part")
    num = F.col("p_retailprice").cast("string")
    line = F.concat(F.lit('var q="'), F.concat_ws(",", "p_name", num, F.lit("800.0"), num, num, num, F.lit("0"), F.lit("0"), (F.col("p_size") * 1000).cast("string"), F.lit("1")), F.lit('";'))
    json = F.concat(F.lit('{"data":{"f57":"'), F.col("p_partkey"), F.lit('","f58":"'), F.col("p_name"), F.lit('","f43":'), num, F.lit(',"f47":'), F.col("p_size"), F.lit("}}"))
    return tools.get_quotes(p.select(F.col("p_partkey").alias("code"), F.when(F.col("p_partkey") % 2 == 0, line).otherwise(json).alias("response"))).select("code", "name", "price", "volume")


def ingest_manifest(spark, sf_dir):
    """Documents as files, some of a format that is refused, through ingest: cut, embedded, indexed; its manifest."""
    workers_import(spark)
    folder = scratch(spark)
    d = _documents(spark, sf_dir).select(F.concat_ws("-", "source", F.col("doc_id") % 8).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    d.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(f"{folder}/in")
    _documents(spark, sf_dir).select("source", "lang").distinct().repartition(1).write.csv(f"{folder}/in/part=other")
    found = tools.ingest_files(spark, f"{folder}/in", f"{folder}/kb", indexes.letter_shares)
    own = found.withColumn("part", F.regexp_extract("path", "part=([^/]*)", 1)).where(F.col("format").isin("txt", "csv"))
    return own.groupBy("part", "format", "status").agg(F.count_distinct("doc_id").alias("files"), F.sum("bytes").alias("bytes"), (F.min("chunks") > 0).alias("cut"))


# Caches, retries, polls -------------------------------------------------------------------


def _tiers(spark, sf_dir):
    workers_import(spark)
    e = table(spark, sf_dir, "events")
    own = e.select((F.col("user_id") % 4).alias("shard"), F.concat_ws("/", "event_type", F.col("user_id") % 3).alias("key"), "ts", F.col("event_id").alias("id"))
    return ops.tier_replay(own, F.when(F.col("key").startswith("error"), 86400).otherwise(20000), most=40000)


def tier_replay(spark, sf_dir):
    """Which tier of a cache, one a shard, serves each event."""
    return _tiers(spark, sf_dir).select("shard", "id", "tier")


def tier_stats(spark, sf_dir):
    return ops.tier_stats(_tiers(spark, sf_dir))


def context_cache(spark, sf_dir):
    """Retrieved context of a session by kind, each of its own life, one kind never kept."""
    workers_import(spark)
    kind = F.when(F.col("event_type") == "error", "other").when(F.col("event_type") == "view", "FINANCIAL").when(F.col("event_type") == "click", "STOCK_NEWS").otherwise("STOCK_QUOTE")
    e = table(spark, sf_dir, "events")
    return tools.context_cache(e.select((F.col("user_id") % 20).alias("session"), kind.alias("kind"), "ts", F.col("event_id").alias("id")))


def extract_targets(spark, sf_dir):
    """Which name each turn of a conversation states, asked again after half an hour at the earliest."""
    workers_import(spark)
    t = conversations._turns(spark, sf_dir).select("id", F.col("at").alias("ts"), F.concat(F.col("role"), F.lit(" "), "text").alias("text"))
    names = spark.createDataFrame([("assistant", "c1"), ("user", "c2"), ("sys", "c3"), ("system", "c4")], "name string, code string")
    return tools.extract(t, names)


def retry_summary(spark, sf_dir):
    """Each order's lines as attempts of a call, of which at most three count."""
    own = table(spark, sf_dir, "lineitem")
    return ops.retry_summary(own.select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("attempt_no"), (F.col("l_returnflag") == "R").alias("ok"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("long") * 100).alias("wait_ms")))


def checked_rounds(spark, sf_dir):
    """Turns as verdicts of a checker on a conversation's answer, two rounds at most."""
    t = table(spark, sf_dir, "conversations")
    raw = F.when(F.length("text") % 3 == 0, 'ok {"passed": true, "issues": []}').when(F.length("text") % 3 == 1, F.concat(F.lit('{"passed": false, "issues": ["'), "role", F.lit('", "b"]}'))).otherwise("no json")
    return ops.checked_rounds(t.select(F.col("conv_id").alias("answer_id"), (F.col("turn") + 1).alias("round"), raw.alias("raw")))


def watched_cycles(spark, sf_dir):
    """Polls of the first two symbols of a watch list only."""
    e = table(spark, sf_dir, "events")
    watch = e.groupBy(F.col("event_type").alias("symbol")).agg(F.min("event_id").alias("pos"))
    return monitor.cycles(e, watchlist=watch, most=2)


QUERIES = {f.__name__: f for f in (doc_scan, manifest_scan, vector_store_scan, cases_scan, csv_scan, json_bar_decode, statement_decode, sector_page, financial_tables, code_forms, signal_wording, text_nfkc, bm25_indexed, sink_rounds, knowledge_context, retriever_rows, rules_left, advice_blocks, rerank_external, quotes_tool, ingest_manifest, tier_replay, tier_stats, context_cache, extract_targets, retry_summary, checked_rounds, watched_cycles)}

_NFC = texts.ORACLES["text_clean"]
_SIX = "lpad((l_partkey % 900000)::VARCHAR, 6, '0')"
_KNOWN = "k AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'GENERAL' ELSE source END AS code, lang, text AS content, source, CASE WHEN text IS NULL OR length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 2) END AS tokens FROM documents)"
_PLACED = "row_number() OVER (PARTITION BY query_id, chunk_id % 4 = 0 ORDER BY score DESC, chunk_id)"
_TIERS = """a AS (SELECT user_id % 4 AS shard, event_type || '/' || (user_id % 3) AS key, event_id AS id, epoch_us(ts) AS t, CASE WHEN event_type = 'error' THEN 86400 ELSE 20000 END * 1000000::BIGINT AS ttl FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY shard, key ORDER BY t, id) AS k FROM a),
r AS (SELECT shard, key, id, k, t, t + least(ttl, 40000 * 1000000::BIGINT) AS l1, t + ttl AS l2, 'miss' AS tier FROM o WHERE k = 1
UNION ALL SELECT o.shard, o.key, o.id, o.k, o.t, CASE WHEN o.t < r.l1 THEN r.l1 ELSE o.t + least(o.ttl, 40000 * 1000000::BIGINT) END, CASE WHEN o.t < r.l1 OR o.t < r.l2 THEN r.l2 ELSE o.t + o.ttl END, CASE WHEN o.t < r.l1 THEN 'L1' WHEN o.t < r.l2 THEN 'L2' ELSE 'miss' END FROM r JOIN o ON o.shard = r.shard AND o.key = r.key AND o.k = r.k + 1)"""


def _replayed(rows: str) -> str:
    """rows: a(key, id, t, ttl) in microseconds; adds r(id, hit)."""
    return f"""{rows}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, id) AS k FROM a),
r AS (SELECT key, id, k, t AS born, false AS hit FROM o WHERE k = 1 UNION ALL SELECT o.key, o.id, o.k, CASE WHEN o.t < r.born + o.ttl THEN r.born ELSE o.t END, o.t < r.born + o.ttl FROM r JOIN o ON o.key = r.key AND o.k = r.k + 1)"""


def _worded(words: dict[str, str], picks: tuple[str, ...], other: str) -> str:
    return f"CASE event_id % 5 {' '.join(f'WHEN {k} THEN ' + repr(words.get(p, other)) for k, p in enumerate(picks))} END"


ORACLES = {
    "doc_scan": "SELECT source || '-' || (doc_id % 8) AS part, sum(length(coalesce(text, '')) + 1)::BIGINT AS chars, sum(len(string_split(coalesce(text, ''), chr(10))))::BIGINT AS lines, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes FROM documents GROUP BY 1",
    "manifest_scan": "SELECT doc_id::VARCHAR AS id, trim(source) AS stock_code, lang AS stock_name, length(trim(coalesce(text, ''), ' '))::INT AS chars, CASE WHEN doc_id % 3 = 0 THEN 'general' ELSE 'news' END AS category, epoch(TIMESTAMP '2024-01-02 03:04:05')::BIGINT AS created FROM documents",
    "vector_store_scan": "SELECT vec_id::VARCHAR AS chunk_id, len(embedding)::INT AS dims, floor(embedding[1]::DOUBLE * 1000 + 0.5)::BIGINT AS first, 't' || vec_id AS content, label::VARCHAR AS label FROM embeddings",
    "cases_scan": "SELECT lang AS category, quality::VARCHAR AS expected, count(*) AS cases, count(*) * 2 AS observations FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2",
    "csv_scan": r"""WITH l AS (SELECT source AS part, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) + 1 AS line_no, CASE WHEN doc_id % 10 < 2 THEN 'skipped' WHEN doc_id % 10 = 2 THEN 'short' WHEN trim(source) = '' OR trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 'missing' ELSE 'ok' END AS status FROM documents) SELECT part, status, count(*) AS lines, sum(line_no)::BIGINT AS places FROM l GROUP BY 1, 2""",
    "json_bar_decode": "SELECT o_orderkey AS symbol, k::INT AS bar_idx, strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice AS open, CASE WHEN k = 0 THEN o_totalprice ELSE 0.0 END AS close, o_orderkey % 100 AS volume FROM orders, (VALUES (0), (1)) v(k) WHERE o_orderkey % 13 <> 0",
    "statement_decode": "SELECT s_suppkey AS code, '2023' AS year, s_acctbal AS revenue, 0.0::DOUBLE AS profit, 0.0::DOUBLE AS roe FROM supplier WHERE s_suppkey % 5 <> 0",
    "sector_page": "SELECT n_nationkey::INT AS pos, n_nationkey::VARCHAR AS code, n_name AS name, n_nationkey * 1.5::DOUBLE AS price, CASE WHEN n_nationkey % 2 = 1 THEN 0.5 END::DOUBLE AS change FROM nation WHERE n_nationkey BETWEEN 5 AND 9",
    "financial_tables": "SELECT p_partkey AS page_id, round(p_retailprice, 1) * 10000 AS revenue, p_size * 10000.0::DOUBLE AS profit FROM part WHERE p_partkey % 4 <> 0",
    "code_forms": f"""WITH b AS (SELECT *, l_orderkey % 4 AS k, {_SIX} AS six, CASE WHEN {_SIX}[1] = '6' THEN '1.' ELSE '0.' END || {_SIX} AS full_code FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN 101 WHEN 1 THEN 102 WHEN 2 THEN 103 ELSE 101 END AS period, CASE k WHEN 0 THEN '1.600519' WHEN 1 THEN full_code WHEN 2 THEN '0.' || six END AS keyword,
CASE k WHEN 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN '1.' || six END WHEN 1 THEN full_code WHEN 2 THEN '0.' || six ELSE 'none' END AS typed, l_returnflag || '+%26%2F' || l_linestatus AS encoded,
least(200, greatest(1, l_quantity::INT * 10 - 100))::INT AS rounds, least(120, (l_quantity * 5)::INT)::INT AS days, CASE WHEN k = 1 THEN l_returnflag ELSE strftime(l_shipdate, '%Y-%m-%d') END AS filled FROM b""",
    "signal_wording": f"SELECT event_id, {_worded(labels.MACD, ('golden_cross', 'death_cross', 'x', '', 'y'), '无明确信号')} AS macd, {_worded(labels.TREND, ('bullish', 'bearish', 'x', '', 'y'), '震荡（中性）')} AS trend, {_worded(labels.MOMENTUM, ('overbought', 'oversold', 'overbought_trend_up', 'oversold_trend_down', 'x'), '中性')} AS momentum, CASE event_id % 5 WHEN 0 THEN '超买区' WHEN 2 THEN '超卖区' WHEN 4 THEN '无数据' ELSE '正常区间' END AS rsi FROM events",
    "text_nfkc": _NFC,
    "bm25_indexed": texts.ORACLES["bm25_topk"],
    "sink_rounds": "WITH n AS (SELECT * FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 4 = 1) SELECT count(*) FILTER (WHERE c_acctbal < 0) AS kept, sum(c_custkey) FILTER (WHERE c_acctbal < 0)::BIGINT AS keys, count(*) FILTER (WHERE c_acctbal >= 0) AS gone FROM n",
    "knowledge_context": f"""WITH {texts._BM25}, {_KNOWN}, h AS (SELECT *, {_PLACED} AS n FROM bh QUALIFY n <= 5),
r AS (SELECT query_id, '【通用规则】' || chr(10) || string_agg('[通用' || n || '] ' || content, chr(10) ORDER BY n) || chr(10) || chr(10) AS part FROM h JOIN k ON doc_id = chunk_id WHERE chunk_id % 4 = 0 GROUP BY query_id),
e AS (SELECT query_id, '【参考知识】' || chr(10) || string_agg('[引用' || n || '] ' || lang || '(' || code || ') | 类别:k | 来源:' || source || ' | ' || content, chr(10) ORDER BY n) || chr(10) AS part FROM h JOIN k ON doc_id = chunk_id WHERE chunk_id % 4 <> 0 GROUP BY query_id)
SELECT coalesce(r.query_id, e.query_id) AS query_id, coalesce(r.part, '') || coalesce(e.part, '') AS context FROM r FULL JOIN e ON r.query_id = e.query_id""",
    "retriever_rows": f"WITH {texts._BM25}, {_KNOWN} SELECT query_id, 'REF-' || rank AS ref_id, chunk_id, source, tokens::INT AS token_count, score AS final_score, '[REF-' || rank || ']' || chr(10) || 'chunk_id: ' || chunk_id || chr(10) || 'source: ' || source || chr(10) || 'text: ' || content AS text FROM bh JOIN k ON doc_id = chunk_id WHERE rank <= 5",
    "rules_left": "SELECT doc_id AS chunk_id, lang AS stock_name FROM documents WHERE doc_id % 4 = 0 AND doc_id % 6 <> 0",
    "advice_blocks": r"WITH f AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS w FROM benchmark) SELECT item_id AS id, 1::INT AS no, item_id::VARCHAR AS basis, w AS evidence, '' AS ref_id FROM f UNION ALL SELECT item_id, 2, '', '', 'REF-' || (item_id % 7) FROM f",
    "rerank_external": f"WITH {texts._VECTOR}, {texts._BM25}, {texts._FUSED}, rr AS (SELECT query_id, chunk_id, (length(coalesce(text, '')) % 97)::DOUBLE AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY length(coalesce(text, '')) % 97 DESC, final_score DESC, chunk_id)::INT AS final_rank FROM fu LEFT JOIN documents ON doc_id = chunk_id) SELECT query_id, chunk_id, final_score, final_rank FROM rr WHERE final_rank <= 5",
    "quotes_tool": "SELECT p_partkey AS code, p_name AS name, floor(p_retailprice * 100 + 0.5) / 100 AS price, CASE WHEN p_partkey % 2 = 0 THEN p_size * 10 ELSE p_size END::BIGINT AS volume FROM part",
    "ingest_manifest": "SELECT source || '-' || (doc_id % 8) AS part, 'txt' AS format, 'ok' AS status, 1::BIGINT AS files, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, true AS cut FROM documents GROUP BY 1 UNION ALL SELECT 'other', 'csv', 'unsupported', 1, sum(strlen(source) + strlen(lang) + 2)::BIGINT, false FROM (SELECT DISTINCT source, lang FROM documents)",
    "tier_replay": f"WITH RECURSIVE {_TIERS} SELECT shard, id, tier FROM r",
    "tier_stats": f"WITH RECURSIVE {_TIERS} SELECT shard, count(*) FILTER (WHERE tier = 'L1') AS hits, count(*) FILTER (WHERE tier <> 'L1') AS misses, floor(count(*) FILTER (WHERE tier = 'L1') / count(*) * 10000 + 0.5) / 10000 AS rate, 0::BIGINT AS evictions, count(DISTINCT key) AS size FROM r GROUP BY shard",
    "context_cache": "WITH RECURSIVE " + _replayed("a AS (SELECT (user_id % 20) || '/' || event_type AS key, event_id AS id, epoch_us(ts) AS t, CASE event_type WHEN 'view' THEN 72 WHEN 'click' THEN 24 ELSE 1 END * 3600000000 AS ttl FROM (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('view', 'click', 'error') THEN event_type ELSE 'quote' END AS event_type FROM events) WHERE event_type <> 'error')") + " SELECT id, hit FROM r UNION ALL SELECT event_id, false FROM events WHERE event_type = 'error'",
    "extract_targets": "WITH RECURSIVE " + _replayed("a AS (SELECT trim(role || ' ' || text) AS key, conv_id * 1000 + turn AS id, epoch_us(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 % 864000 + turn * 60)) AS t, 1800000000 AS ttl FROM conversations WHERE text IS NOT NULL)") + ", c AS (SELECT id, hit, CASE WHEN contains(key, 'assistant') THEN 'assistant' WHEN contains(key, 'system') THEN 'system' WHEN contains(key, 'user') THEN 'user' WHEN contains(key, 'sys') THEN 'sys' END AS name FROM r) SELECT id, name, CASE name WHEN 'assistant' THEN 'c1' WHEN 'system' THEN 'c4' WHEN 'user' THEN 'c2' WHEN 'sys' THEN 'c3' END AS code, NOT hit AS asked FROM c UNION ALL SELECT conv_id * 1000 + turn, NULL, NULL, false FROM conversations WHERE text IS NULL",
    "retry_summary": "WITH a AS (SELECT l_orderkey AS call_id, l_linenumber AS n, l_returnflag = 'R' AS ok, CASE WHEN l_linenumber > 1 THEN l_quantity::BIGINT * 100 ELSE 0 END AS w FROM lineitem WHERE l_linenumber <= 3), f AS (SELECT call_id, min(n) FILTER (WHERE ok) AS hit FROM a GROUP BY 1) SELECT call_id, count(*) AS tries, sum(w)::BIGINT AS waited_ms, bool_or(ok) AS succeeded, NOT bool_or(ok) AS gave_up FROM a JOIN f USING (call_id) WHERE hit IS NULL OR n <= hit GROUP BY call_id",
    "checked_rounds": "WITH r AS (SELECT conv_id, turn + 1 AS round, length(text) % 3 AS m, role FROM conversations WHERE turn + 1 <= 2), f AS (SELECT conv_id, min(round) FILTER (WHERE m = 0) AS hit, max(round) AS last, min_by(m, round) AS m, min_by(role, round) AS role FROM r GROUP BY 1) SELECT conv_id AS answer_id, coalesce(hit, last) AS rounds, hit IS NOT NULL AS passed, CASE m WHEN 1 THEN '请修正以下问题后重新回答：' || role || '；b' WHEN 2 THEN '请修正以下问题后重新回答：' END AS instructions FROM f",
    "watched_cycles": "WITH w AS (SELECT event_type FROM events GROUP BY 1 ORDER BY min(event_id) LIMIT 2) SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS cycle, event_type AS symbol, arg_max(value, struct_pack(t := ts, e := event_id)) AS price, count(*) AS ticks FROM events SEMI JOIN w USING (event_type) WHERE isodow(ts) < 6 AND (hour(ts) * 60 + minute(ts) BETWEEN 570 AND 690 OR hour(ts) * 60 + minute(ts) BETWEEN 780 AND 900) GROUP BY 1, 2",
}
