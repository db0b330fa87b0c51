"""Queries over conversations and events: memory, conclusions, tool calls, traces and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import text as X
from tickloom.operators import memory as M
from tickloom.operators import monitor, ops
from tickloom.session import table, workers_import

#: The default markers are Chinese; the test texts are not, so these stand in for them.
MARKERS = M.Markers(intent=("tion", "que"), noise=("%%%",), transient=("***",), conclusion=("ing", "ment", "keit"), incomplete=("!!",), abort=("$$$",), price=("th",), advice="en ", score="([0-9]+)", direction="(the|que|der)", confidence="(on|eau|ung)")
BASE = "TIMESTAMP '2024-01-01 00:00:00'"
AS_OF = "TIMESTAMP '2024-01-05 00:00:00'"


def _turns(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(F.unix_timestamp(F.expr(BASE)) + F.col("conv_id") * 3600 % 864000 + F.col("turn") * 60)
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "role", "text", at.alias("at"))


def importance_score(spark, sf_dir):
    return _turns(spark, sf_dir).select("id", M.importance(F.col("role"), F.col("text"), MARKERS).alias("s")).select("id", "s.importance", "s.kind", "s.noise")


def bounded_history(spark, sf_dir):
    return monitor.newest(_turns(spark, sf_dir), ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn")


def token_window(spark, sf_dir):
    workers_import(spark)
    t = _turns(spark, sf_dir).select(F.col("conv_id").alias("session_id"), "id", F.col("at").alias("created_at"), M.importance(F.col("role"), F.col("text"), MARKERS).alias("s"), X.token_count(F.col("text")).cast("long").alias("tokens"))
    return M.token_window(t.select("session_id", "id", "s.kind", "s.importance", "tokens", "created_at"), 400, 4)


_ALLOWED = {"invest_style": ("tionment", "ment", "ing"), "risk_preference": ("keit", "ción"), "holding_horizon": ("eau", "ung")}


def _candidates(spark, sf_dir):
    t = _turns(spark, sf_dir).where("role = 'user'")
    return t.select("id", "conv_id", "turn", "at", "text", M.profile_candidates(F.col("text"), _ALLOWED, ("the", "que", "der"), "^[A-Z]", "(?:la|of) ([a-z]{2,24}?) (?:de|the)", "(?:and|und) (.{4,80})").alias("candidates"))


def profile_candidates(spark, sf_dir):
    rows = _candidates(spark, sf_dir).select("id", F.explode("candidates").alias("c"))
    return rows.select("id", "c.key", "c.value")


def profile_fold(spark, sf_dir):
    workers_import(spark)
    rows = _candidates(spark, sf_dir).select((F.col("conv_id") % 50).alias("user_id"), F.col("id").alias("turn"), F.unix_timestamp("at").cast("double").alias("at"), "text", "candidates")
    return M.profile_fold(rows, ("the ",), ("que ",))


def conclusion_admission(spark, sf_dir):
    t = _turns(spark, sf_dir).where("role = 'assistant'")
    return t.select("id", M.admission(F.col("text"), F.col("turn") % 4, MARKERS).alias("a")).select("id", "a.admitted", "a.reason")


def conclusion_extract(spark, sf_dir):
    t = _turns(spark, sf_dir).where("role = 'assistant'")
    return t.select("id", *M.conclusion_facts(F.col("text"), MARKERS))


def _cards(spark, sf_dir):
    t = _turns(spark, sf_dir).where("role = 'assistant'")
    life = M.ttl_hours(F.col("text"), MARKERS) * 3600
    return t.select(
        (F.col("conv_id") % 7).alias("user_id"),
        "id",
        F.when(F.col("turn") % 3 != 0, F.concat(F.lit("c"), F.col("conv_id") % 40)).alias("stock_code"),
        F.concat(F.lit("n"), F.col("turn") % 4).alias("stock_name"),
        F.col("at").alias("created_at"),
        F.timestamp_seconds(F.unix_timestamp("at") + life).alias("expires_at"),
    )


def conclusion_supersede(spark, sf_dir):
    return M.latest_per_instrument(_cards(spark, sf_dir)).select("user_id", "id", "current")


def conclusion_lifecycle(spark, sf_dir):
    return M.lifecycle(_cards(spark, sf_dir), F.expr(AS_OF)).select("user_id", "id", "status", "reason")


def conclusion_counts(spark, sf_dir):
    return conclusion_lifecycle(spark, sf_dir).groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("cards"))


def _calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("call_id"), F.col("event_type").alias("tool"), F.col("props").alias("param"), "ts", "value")


def duplicate_calls(spark, sf_dir):
    return ops.duplicate_calls(_calls(spark, sf_dir)).select("call_id", "duplicate")


def tool_round_guard(spark, sf_dir):
    return ops.round_guard(_calls(spark, sf_dir)).select("call_id", "round", "stopped")


def trace_summary(spark, sf_dir):
    return ops.trace_summary(_calls(spark, sf_dir))


def trace_events(spark, sf_dir):
    return ops.trace_events(_calls(spark, sf_dir))


def latency_stats(spark, sf_dir):
    return ops.latency(_calls(spark, sf_dir), "tool", "value")


def tool_error_class(spark, sf_dir):
    kind = F.when(F.col("tool") == "error", "secid").when(F.col("tool") == "click", "keyword").when(F.col("tool") == "view", "name").when(F.col("tool") == "purchase", "duplicate").otherwise("other")
    message = F.when(F.col("call_id") % 2 == 0, F.concat(F.lit("HTTP 404 "), F.col("tool"))).otherwise(F.concat(F.lit("timeout "), F.col("tool")))
    c = _calls(spark, sf_dir).withColumn("m", message).withColumn("e", ops.error_class(kind, F.col("m")))
    line = ops.render_error(F.col("tool"), F.lit("secid"), F.col("request_id").cast("string"), F.col("e"), F.col("m"), F.lit(0), F.lit(3))
    return c.select("call_id", F.col("e.code").alias("code"), F.col("e.retryable").alias("retryable"), line.alias("rendered"))


def cache_replay(spark, sf_dir):
    workers_import(spark)
    c = _calls(spark, sf_dir).select(F.col("tool").alias("key"), "ts", F.col("call_id").alias("id"))
    return ops.cache_replay(c, F.when(F.col("key") == "error", 1800).otherwise(600))


def cache_stats(spark, sf_dir):
    r = cache_replay(spark, sf_dir)
    return r.groupBy("key").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def json_extract(spark, sf_dir):
    raw = F.concat(F.lit("noise "), F.col("props"), F.lit(" tail"))
    e = table(spark, sf_dir, "events").select("event_id", X.extract_json(raw).alias("json"))
    return e.select("event_id", "json", F.get_json_object("json", "$.k").cast("int").alias("k"), X.strict_true(F.col("json"), "passed").alias("passed"))


def eval_accuracy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), (F.col("n_chars") > 1000).cast("int").alias("returned"))
    return ops.accuracy(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("expected")).join(d, "doc_id"))


QUERIES = {f.__name__: f for f in (importance_score, bounded_history, token_window, profile_candidates, profile_fold, conclusion_admission, conclusion_extract, conclusion_supersede, conclusion_lifecycle, conclusion_counts, duplicate_calls, tool_round_guard, trace_summary, trace_events, latency_stats, tool_error_class, cache_replay, cache_stats, json_extract, eval_accuracy)}

_T = "t AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 % 864000 + turn * 60) AS tm FROM conversations)"
_NOISY = "(text IS NULL OR trim(text) = '' OR contains(trim(text), '%%%') OR contains(trim(text), '***') OR role = 'user' AND length(trim(text)) < 2)"
_IMPORTANCE = f"""CASE WHEN {_NOISY} THEN 0 WHEN role = 'user' THEN least(10, 7 + CASE WHEN contains(text, 'tion') OR contains(text, 'que') THEN 2 ELSE 0 END + CASE WHEN length(trim(text)) >= 40 THEN 1 ELSE 0 END)
WHEN role = 'assistant' THEN CASE WHEN contains(text, '!!') THEN 3 ELSE least(10, 7 + CASE WHEN contains(text, 'ing') OR contains(text, 'ment') OR contains(text, 'keit') THEN 2 ELSE 0 END + CASE WHEN length(trim(text)) >= 400 THEN 1 ELSE 0 END) END WHEN role = 'tool' THEN 5 ELSE 4 END::INT"""
_KIND = f"CASE WHEN {_NOISY} THEN 'NOISE' WHEN role = 'user' THEN 'USER_QUERY' WHEN role = 'assistant' THEN 'ASSISTANT_ANSWER' ELSE 'TOOL_OBSERVATION' END"
_CARDS = f"""{_T}, c AS (SELECT conv_id % 7 AS user_id, id, CASE WHEN turn % 3 <> 0 THEN 'c' || (conv_id % 40) END AS stock_code, 'n' || (turn % 4) AS stock_name, tm AS created_at, tm + to_hours(CASE WHEN contains(text, 'th') THEN 24 ELSE 168 END) AS expires_at FROM t WHERE role = 'assistant')"""
_LIFE = f"""{_CARDS}, s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, coalesce('c:' || stock_code, 'n:' || stock_name) ORDER BY created_at DESC, id DESC) > 1 THEN 'superseded' WHEN expires_at <= {AS_OF} THEN 'expired' END AS why FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, why IS NULL ORDER BY created_at DESC, id DESC) AS k FROM s),
u AS (SELECT *, CASE WHEN why IS NOT NULL THEN 'STALE' WHEN k > 20 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status FROM n),
l AS (SELECT user_id, id, status, coalesce(why, CASE WHEN status = 'ARCHIVED' THEN 'overflow' END) AS reason FROM u QUALIFY status = 'ACTIVE' OR row_number() OVER (PARTITION BY user_id, status = 'ACTIVE' ORDER BY created_at DESC, id DESC) <= 100)"""
_SUMMARY = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_REPLAY = """a AS (SELECT event_type AS key, event_id AS id, ts, CASE WHEN event_type = 'error' THEN 1800 ELSE 600 END AS ttl, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT key, id, k, ts AS born, false AS hit FROM a WHERE k = 1 UNION ALL SELECT a.key, a.id, a.k, CASE WHEN a.ts < r.born + to_seconds(a.ttl) THEN r.born ELSE a.ts END, a.ts < r.born + to_seconds(a.ttl) FROM r JOIN a ON a.key = r.key AND a.k = r.k + 1)"""
_CUE = "(contains(clause, 'the') OR contains(clause, 'que') OR contains(clause, 'der') OR regexp_matches(clause, '^[A-Z]'))"


def _candidate_sql() -> str:
    parts = []
    for key, values in _ALLOWED.items():
        case = "CASE " + " ".join(f"WHEN contains(text, '{v}') THEN '{v}'" for v in values) + " END"
        parts.append(f"SELECT id, '{key}' AS key, value FROM (SELECT id, value, coalesce(list_filter(string_split_regex(text, '[。；;！!？?\\n]'), lambda x: contains(x, value))[1], text) AS clause FROM (SELECT id, text, {case} AS value FROM u)) WHERE value IS NOT NULL AND {_CUE}")
    parts.append("SELECT id, 'focus_sectors', replace(replace(v, '、', '/'), ',', '/') FROM (SELECT id, regexp_extract(text, '(?:la|of) ([a-z]{2,24}?) (?:de|the)', 1) AS v FROM u) WHERE v <> ''")
    parts.append("SELECT id, 'custom_rules', trim(v) FROM (SELECT id, regexp_extract(text, '(?:and|und) (.{4,80})', 1) AS v FROM u) WHERE v <> ''")
    return f"WITH {_T}, u AS (SELECT * FROM t WHERE role = 'user') " + " UNION ALL ".join(parts)


#: One event after the other: settling a waiting change, then each stated value. v is what is known of the
#: two open keys, w when it was written, p the waiting change; closed keys allow none of the texts' values.
_EVENTS = f"""q AS ({_candidate_sql()}),
e0 AS (SELECT conv_id % 50 AS user_id, id, epoch(tm) AS tm, text, 0 AS part, NULL::VARCHAR AS key, NULL::VARCHAR AS value FROM t WHERE role = 'user' UNION ALL SELECT conv_id % 50, t.id, epoch(tm), text, CASE key WHEN 'invest_style' THEN 1 WHEN 'risk_preference' THEN 2 WHEN 'holding_horizon' THEN 3 WHEN 'focus_sectors' THEN 4 ELSE 5 END, key, trim(value) FROM q JOIN t USING (id)),
e AS (SELECT *, contains(text, 'the ') AS yea, contains(text, 'que ') AS nay, row_number() OVER (PARTITION BY user_id ORDER BY tm, id, part) AS n FROM e0),
z AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::VARCHAR AS v4, NULL::VARCHAR AS v5, NULL::DOUBLE AS w, NULL::VARCHAR AS pk, NULL::VARCHAR AS pv, NULL::DOUBLE AS pa, NULL::BIGINT AS id, NULL::VARCHAR AS event, NULL::VARCHAR AS key, NULL::VARCHAR AS value FROM e
UNION ALL SELECT user_id, n, CASE WHEN pk = 'focus_sectors' AND event = 'confirmed' THEN pv WHEN event = 'set' AND key = 'focus_sectors' THEN value ELSE v4 END, CASE WHEN pk = 'custom_rules' AND event = 'confirmed' THEN pv WHEN event = 'set' AND key = 'custom_rules' THEN value ELSE v5 END,
CASE WHEN event IN ('set', 'confirmed') THEN tm ELSE w END, CASE event WHEN 'conflict' THEN key WHEN 'confirmed' THEN NULL WHEN 'rejected' THEN NULL ELSE pk END, CASE event WHEN 'conflict' THEN value WHEN 'confirmed' THEN NULL WHEN 'rejected' THEN NULL ELSE pv END, CASE event WHEN 'conflict' THEN tm WHEN 'confirmed' THEN NULL WHEN 'rejected' THEN NULL ELSE pa END, id, event, coalesce(key, pk), coalesce(value, pv)
FROM (SELECT *, CASE WHEN part = 0 THEN CASE WHEN pk IS NOT NULL AND yea THEN 'confirmed' WHEN pk IS NOT NULL AND nay THEN 'rejected' END WHEN part <= 3 OR length(value) > 200 OR value = '' THEN 'refused' WHEN CASE part WHEN 4 THEN v4 ELSE v5 END IS NULL THEN 'set' WHEN CASE part WHEN 4 THEN v4 ELSE v5 END = value THEN 'unchanged' ELSE 'conflict' END AS event
FROM (SELECT e.*, CASE WHEN part = 0 AND tm - w > 90 * 86400 THEN NULL ELSE v4 END AS v4, CASE WHEN part = 0 AND tm - w > 90 * 86400 THEN NULL ELSE v5 END AS v5, w, CASE WHEN part = 0 AND tm - pa > 7200 THEN NULL ELSE pk END AS pk, CASE WHEN part = 0 AND tm - pa > 7200 THEN NULL ELSE pv END AS pv, CASE WHEN part = 0 AND tm - pa > 7200 THEN NULL ELSE pa END AS pa FROM z JOIN e ON e.user_id = z.user_id AND e.n = z.n + 1)))"""
#: The ranking of a session's records, and the fold down it: taken if it fits what is left.
_WINDOW = f"""{_T}, w0 AS (SELECT conv_id AS s, id, tm, {_IMPORTANCE} AS imp, {_KIND} AS kind, CASE WHEN text IS NULL OR length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 2) END::BIGINT AS tokens FROM t),
w1 AS (SELECT *, coalesce(id = max(CASE WHEN kind = 'USER_QUERY' THEN id END) OVER (PARTITION BY s), false) AS must FROM w0 WHERE kind <> 'NOISE'),
w2 AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY must DESC, imp >= 8 DESC, tm DESC, id DESC) AS k FROM w1),
w3 AS (SELECT s, id, k, must AS taken, CASE WHEN must OR tokens <= 400 THEN 400 - tokens ELSE 400 END AS room, tokens <= 400 OR must AS t0 FROM w2 WHERE k = 1
UNION ALL SELECT w2.s, w2.id, w2.k, w2.must, CASE WHEN w3.room > 0 AND w3.room >= w2.tokens THEN w3.room - w2.tokens ELSE w3.room END, w3.room > 0 AND w3.room >= w2.tokens FROM w3 JOIN w2 ON w2.s = w3.s AND w2.k = w3.k + 1),
w4 AS (SELECT w3.s, w3.id, w2.must, min(room) OVER (PARTITION BY w3.s) AS room, row_number() OVER (PARTITION BY w3.s ORDER BY w2.tm DESC, w3.id DESC) AS n, count(*) OVER (PARTITION BY w3.s) AS kept FROM w3 JOIN w2 ON w2.s = w3.s AND w2.k = w3.k WHERE t0),
w5 AS (SELECT *, count(*) OVER (PARTITION BY s) AS stay, (SELECT min(room) FROM w3 x WHERE x.s = w4.s) AS least FROM w4 WHERE n <= 4 OR must)"""

ORACLES = {
    "profile_fold": f"WITH RECURSIVE {_T}, {_EVENTS} SELECT user_id, id AS turn, event, key, value FROM z WHERE event IS NOT NULL",
    "token_window": f"WITH RECURSIVE {_WINDOW} SELECT s AS session_id, id, 400 - least AS used_tokens, kept - stay AS dropped FROM w5",
    "importance_score": f"WITH {_T} SELECT id, {_IMPORTANCE} AS importance, {_KIND} AS kind, {_NOISY} AS noise FROM t",
    "bounded_history": "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "profile_candidates": _candidate_sql(),
    "conclusion_admission": f"WITH {_T}, r AS (SELECT id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(trim(text)) < 60 THEN 'short' WHEN contains(text, '$$$') THEN 'aborted' WHEN NOT (contains(text, 'ing') OR contains(text, 'ment') OR contains(text, 'keit')) THEN 'no conclusion' WHEN turn % 4 <= 0 THEN 'no observations' ELSE 'accepted' END AS reason FROM t WHERE role = 'assistant') SELECT id, reason = 'accepted' AS admitted, reason FROM r",
    "conclusion_extract": f"WITH {_T}, c AS (SELECT *, {_SUMMARY} AS s FROM t WHERE role = 'assistant'), d AS (SELECT *, trim(CASE WHEN instr(s, 'en ') > 1 THEN substr(s, instr(s, 'en ')) ELSE s END) AS x FROM c) SELECT id, nullif(regexp_extract(text, '([0-9]+)', 1), '') AS score, nullif(regexp_extract(text, '(the|que|der)', 1), '') AS direction, nullif(regexp_extract(text, '(on|eau|ung)', 1), '') AS confidence, CASE WHEN length(x) <= 240 THEN x ELSE substr(x, 1, 240) || '...' END AS summary FROM d",
    "conclusion_supersede": f"WITH {_CARDS} SELECT user_id, id, row_number() OVER (PARTITION BY user_id, coalesce(stock_code, stock_name) ORDER BY created_at DESC, id DESC) = 1 AS current FROM c",
    "conclusion_lifecycle": f"WITH {_LIFE} SELECT user_id, id, status, reason FROM l",
    "conclusion_counts": f"WITH {_LIFE} SELECT user_id, status, count(*) AS cards FROM l GROUP BY user_id, status",
    "duplicate_calls": "SELECT event_id AS call_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) > 1 AS duplicate FROM events",
    "tool_round_guard": "SELECT event_id AS call_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS round, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 8 AS stopped FROM events",
    "trace_summary": "SELECT user_id AS request_id, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS total_ms, count(*) AS tool_calls, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id",
    "trace_events": """SELECT event_id AS call_id, '{"stage":"TOOL_CALL","attrs":{"traceId":"' || user_id || '","tool":"' || event_type || '","args":"' || replace(props, '"', '\\"') || '"}}' AS line FROM events""",
    "latency_stats": "SELECT event_type AS tool, count(*) AS runs, floor(sum(floor(value * 1000 + 0.5))::BIGINT / count(*) / 1000 * 1000 + 0.5) / 1000 AS mean, floor(list_sort(list(value))[count(*) // 2 + 1] * 1000 + 0.5) / 1000 AS p50, floor(max(value) * 1000 + 0.5) / 1000 AS max FROM events GROUP BY event_type",
    "tool_error_class": """WITH k AS (SELECT event_id, event_type, user_id, CASE WHEN event_id % 2 = 0 THEN 'HTTP 404 ' ELSE 'timeout ' END || event_type AS m FROM events),
c AS (SELECT *, CASE event_type WHEN 'error' THEN CASE WHEN contains(m, '404') THEN 'INVALID_SECID' ELSE 'NETWORK_ERROR' END WHEN 'click' THEN CASE WHEN contains(m, '404') THEN 'PARAMETER_INVALID' ELSE 'NETWORK_ERROR' END WHEN 'view' THEN 'STOCK_NOT_FOUND' WHEN 'purchase' THEN 'DUPLICATE_CALL' ELSE 'UNKNOWN' END AS code FROM k),
d AS (SELECT *, code NOT IN ('STOCK_NOT_FOUND', 'DUPLICATE_CALL') AS retryable FROM c)
SELECT event_id AS call_id, code, retryable, '{"tool":"' || event_type || '","request":{"secid":"' || user_id || '"},"error":{"code":"' || code || '","message":"' || m || '","retryable":' || retryable || ',"attempts":0,"maxAttempts":3}}' AS rendered FROM d""",
    "cache_replay": f"WITH RECURSIVE {_REPLAY} SELECT key, id, hit FROM r",
    "cache_stats": f"WITH RECURSIVE {_REPLAY} SELECT key, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM r GROUP BY key",
    "json_extract": "SELECT event_id, regexp_extract('noise ' || props || ' tail', '(?s)(\\{.*\\})', 1) AS json, (props->>'k')::INT AS k, false AS passed FROM events",
    "eval_accuracy": "SELECT category, count(*) AS total, count(*) FILTER (WHERE ok) AS correct, floor(count(*) FILTER (WHERE ok) / count(*) * 10000 + 0.5) / 10000 AS accuracy FROM (SELECT lang AS category, quality = (n_chars > 1000)::INT AS ok FROM labels JOIN documents USING (doc_id)) GROUP BY ROLLUP (category)",
}
