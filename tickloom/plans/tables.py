"""Queries over the star schema: codes, decoded responses, reports, upserts and name resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import codes
from tickloom.operators import relational as J
from tickloom.session import table
from tickloom.sources import market


def normalize_code(spark, sf_dir):
    k = F.col("p_partkey") % 6
    six = F.lpad((F.col("p_partkey") + 599000 * (F.col("p_partkey") % 2)).cast("string"), 6, "0")
    raw = F.when(k == 0, F.concat(F.lit("SH"), six)).when(k == 1, F.concat(F.lit(" sz"), six)).when(k == 2, F.concat(six, F.lit(".sh"))).when(k == 3, six).when(k == 4, F.concat(F.lit("1."), six)).otherwise(F.concat(F.lit("x"), six))
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).withColumn("code", codes.normalize_code(F.col("raw")))
    return rows.select("p_partkey", "code", codes.secid(F.col("raw")).alias("secid"), codes.exchange_symbol(F.col("code")).alias("symbol"))


def quote_decode(spark, sf_dir):
    """Parts written as quote responses, some malformed, and decoded again."""
    p = table(spark, sf_dir, "part")
    num = F.col("p_retailprice").cast("string")
    line = F.concat(F.lit('var q="'), F.concat_ws(",", "p_name", num, F.lit("800.0"), num, num, num, F.lit("0"), F.lit("0"), (F.col("p_size") * 1000).cast("string"), F.lit("1")), F.lit('";'))
    line = F.when(F.col("p_partkey") % 10 == 0, F.lit('var q="a,b";')).otherwise(line)
    json = F.when(F.col("p_partkey") % 7 == 0, "not-a-json").otherwise(F.concat(F.lit('{"data":{"f57":"'), F.col("p_partkey"), F.lit('","f43":'), num, F.lit(',"f162":"-","f47":'), F.col("p_size"), F.lit("}}")))
    q = p.select("p_partkey", market.quoted_csv_quote(line).alias("a"), market.json_quote(json).alias("b"))
    return q.select("p_partkey", "a.name", "a.price", "a.change", "a.volume", F.col("b.code").alias("json_code"), F.col("b.price").alias("json_price"), F.col("b.pe").alias("json_pe"), F.col("b.volume").alias("json_volume"))


def kline_decode(spark, sf_dir):
    """Orders written as bars in JSON, one response a row, some malformed or without a price."""
    o = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 11 == 0, "-").otherwise(F.col("o_totalprice").cast("string"))
    item = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), price, price, price, price, (F.col("o_orderkey") % 100).cast("string"))
    text = F.when(F.col("o_orderkey") % 13 == 0, "{broken").otherwise(F.concat(F.lit('{"data":{"klines":["2020-01-01,1","'), item, F.lit('"]}}')))
    return market.csv_bars(o.select(F.col("o_orderkey").alias("symbol"), text.alias("response"))).drop("bar_idx")


def resolve_name(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    word = lambda k, mark: p.select(F.split("p_name", " ")[k].alias("name")).distinct().withColumn("code", F.concat(F.lit(mark), F.length("name")))
    return J.resolve(p.select(F.col("p_name").alias("name")), word(0, "a").where(F.length("name") > 3), word(1, "b"))


def name_in_text_join(spark, sf_dir):
    names = table(spark, sf_dir, "benchmark").groupBy(F.regexp_extract("text", r"^\S+", 0).alias("name")).agg(F.min("item_id").alias("code"))
    return J.names_in_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), names)


def daily_report(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("price"), (F.col("c_acctbal") / 1000).alias("change"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"), F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("title"), F.col("o_orderkey").alias("pos"))
    return J.report(c, o).select("code", "name", "price", "alert", "headlines")


def report_totals(spark, sf_dir):
    r = daily_report(spark, sf_dir)
    return r.agg(F.count(F.lit(1)).alias("instruments"), F.count_if("alert").alias("alerts"), F.count_if(F.col("headlines").isNull()).alias("without_news"))


def watchlist_upsert(spark, sf_dir):
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    new = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select((F.col("c_nationkey") + 10).alias("key"), F.col("c_name").alias("name"))
    return J.upsert(own, new, "key", [F.desc("name")])


def watchlist_insert(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return J.insert_new(own, new, "key", [F.asc("name")])


def source_fallback(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    first = c.where("c_acctbal > 0").select("c_custkey", F.lit("primary").alias("origin"), "c_acctbal")
    return J.fallback(first, c.select("c_custkey", F.lit("secondary").alias("origin"), "c_acctbal"), "c_custkey")


def trace_evidence(spark, sf_dir):
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.when(F.col("item_id") % 3 == 0, F.col("item_id") % 5 + 1).alias("ref_no"), F.col("text").alias("fragment"))
    hits = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") + 1).alias("rank"), F.col("text").alias("content"))
    return J.evidence(claims, hits)


QUERIES = {f.__name__: f for f in (normalize_code, quote_decode, kline_decode, resolve_name, name_in_text_join, daily_report, report_totals, watchlist_upsert, watchlist_insert, source_fallback, trace_evidence)}

_SIX = "lpad((p_partkey + 599000 * (p_partkey % 2))::VARCHAR, 6, '0')"
_ORDERED = "CASE WHEN s[1] = '6' THEN '1.' ELSE '0.' END || s"
_REPORT = """n AS (SELECT o_custkey AS code, string_agg(o_orderpriority || ' ' || o_orderkey, ' | ' ORDER BY k) AS headlines FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 3 GROUP BY o_custkey),
r AS (SELECT c_custkey AS code, c_name AS name, c_acctbal AS price, abs(c_acctbal / 1000) > 3.0 AS alert, headlines FROM customer LEFT JOIN n ON code = c_custkey)"""

ORACLES = {
    "normalize_code": f"""WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, {_SIX} AS s FROM part),
c AS (SELECT p_partkey, k, s, CASE k WHEN 0 THEN '1.' || s WHEN 1 THEN '0.' || s WHEN 2 THEN '1.' || s WHEN 3 THEN {_ORDERED} WHEN 4 THEN '1.' || s ELSE 'X' || s END AS code FROM p)
SELECT p_partkey, code, CASE k WHEN 0 THEN 'SH' || s WHEN 1 THEN ' sz' || s WHEN 2 THEN s || '.sh' WHEN 3 THEN {_ORDERED} WHEN 4 THEN '1.' || s ELSE 'x' || s END AS secid, CASE WHEN starts_with(code, '1.') THEN 'sh' ELSE 'sz' END || substr(code, 3) AS symbol FROM c""",
    "quote_decode": """SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 10 <> 0 THEN floor(p_retailprice * 100 + 0.5) / 100 END AS price, CASE WHEN p_partkey % 10 <> 0 THEN floor((p_retailprice - 800.0::DOUBLE) / 800.0::DOUBLE * 100 * 100 + 0.5) / 100 END AS change, CASE WHEN p_partkey % 10 <> 0 THEN p_size * 10 END::BIGINT AS volume,
CASE WHEN p_partkey % 7 <> 0 THEN p_partkey::VARCHAR END AS json_code, CASE WHEN p_partkey % 7 <> 0 THEN floor(p_retailprice * 100 + 0.5) / 100 END AS json_price, NULL::DOUBLE AS json_pe, CASE WHEN p_partkey % 7 <> 0 THEN p_size END::BIGINT AS json_volume FROM part""",
    "kline_decode": "SELECT o_orderkey AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice AS open, o_totalprice AS close, o_totalprice AS high, o_totalprice AS low, o_orderkey % 100 * 100 AS volume FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0",
    "resolve_name": """WITH w AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_name AS name FROM part),
r AS (SELECT DISTINCT 1 AS step, a AS r_name, 'a' || length(a) AS code FROM w WHERE length(a) > 3 UNION SELECT DISTINCT 2, b, 'b' || length(b) FROM w),
h AS (SELECT w.name, r.* , (w.name <> r_name)::INT AS loose FROM w JOIN r ON contains(w.name, r_name) OR contains(r_name, w.name))
SELECT w.name, min_by(code, struct_pack(s := step, l := loose, r := r_name)) AS code, min_by(r_name, struct_pack(s := step, l := loose, r := r_name)) AS matched FROM (SELECT DISTINCT name FROM w) w LEFT JOIN h USING (name) GROUP BY w.name""",
    "name_in_text_join": r"WITH n AS (SELECT regexp_extract(text, '^\S+') AS name, min(item_id) AS code FROM benchmark GROUP BY 1) SELECT doc_id AS id, name, code FROM documents JOIN n ON contains(text, name)",
    "daily_report": f"WITH {_REPORT} SELECT code, name, price, alert, headlines FROM r",
    "report_totals": f"WITH {_REPORT} SELECT count(*) AS instruments, count(*) FILTER (WHERE alert) AS alerts, count(*) FILTER (WHERE headlines IS NULL) AS without_news FROM r",
    "watchlist_upsert": "WITH i AS (SELECT c_nationkey + 10 AS key, max(c_name) AS name FROM customer WHERE c_acctbal > 5000 GROUP BY 1) SELECT key, name FROM i UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT key FROM i)",
    "watchlist_insert": "SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "source_fallback": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'primary' ELSE 'secondary' END AS origin, c_acctbal FROM customer",
    "trace_evidence": "WITH c AS (SELECT item_id AS claim_id, CASE WHEN item_id % 3 = 0 THEN item_id % 5 + 1 END AS ref_no, text AS fragment FROM benchmark) SELECT claim_id, coalesce((SELECT doc_id FROM documents WHERE doc_id + 1 = ref_no), (SELECT min(doc_id) FROM documents WHERE contains(text, trim(fragment)))) AS chunk_id FROM c",
}
