"""DuckDB SQL for the operators that SQL can express."""

BLANKS = r"[\x20\x09-\x0D]+"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, 2.0 * source_size AS cap, row_number() OVER (ORDER BY 2.0 * source_size / w, source) AS k FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps, coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, 1.5 * sum(source_size) OVER () AS total, sum(w) OVER () AS ws FROM r),
l AS (SELECT min_by((total - caps) / (ws - spent), k) AS level FROM c WHERE (total - caps) / (ws - spent) <= cap / w),
t AS (SELECT source, source_size, least(cap, coalesce(level, 'infinity'::DOUBLE) * w)::DOUBLE AS target FROM c, l),
p AS (SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(budget - (budget // source_size) * source_size - before, size)) END::BIGINT AS taken FROM p
"""

OP2 = rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{BLANKS}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""

# Equal lines of two places, the later one second, make diagonals; their stretches without a gap are the
# maximal runs. In one document a run and its source may not overlap, so runs of at most d lines count there.
OP3 = r"""
WITH raw AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
norm AS (SELECT doc_id, pos, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM raw),
l AS (SELECT *, row_number() OVER o AS k, sum(n) OVER o AS total FROM norm WHERE n > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
p AS (SELECT a.doc_id AS d, a.pos AS src, b.doc_id, b.k, b.k - a.k AS shift, b.pos, b.n, b.total FROM l a JOIN l b ON a.line = b.line AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.k < b.k)),
i AS (SELECT *, k - row_number() OVER (PARTITION BY d, doc_id, shift ORDER BY k) AS island FROM p),
m AS (SELECT *, count(*) OVER w AS len, row_number() OVER (w ORDER BY k) AS nth FROM i WINDOW w AS (PARTITION BY d, doc_id, shift, island)),
s AS (SELECT a.doc_id, a.k, a.pos AS first, b.pos AS last FROM m a JOIN m b ON a.d = b.d AND a.doc_id = b.doc_id AND a.shift = b.shift AND a.island = b.island AND b.nth = a.nth + (CASE WHEN a.d = a.doc_id THEN least(a.len, a.shift) ELSE a.len END) - 1 WHERE b.total - a.total + a.n >= 50),
r AS (SELECT *, coalesce(first > 1 + max(last) OVER (PARTITION BY doc_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS run FROM r),
u AS (SELECT doc_id, min(first) AS first_line, max(last) AS last_line, min(k) AS k FROM g GROUP BY doc_id, run),
e AS (SELECT u.*, (SELECT min(b.k) FROM l b WHERE b.doc_id = u.doc_id AND b.k >= u.k AND b.total >= a.total - a.n + 50) AS until FROM u JOIN l a ON a.doc_id = u.doc_id AND a.k = u.k)
SELECT e.doc_id, first_line::BIGINT AS first_line, last_line::BIGINT AS last_line, min(m.d)::BIGINT AS source_doc_id, min_by(m.src, (m.d, m.src))::BIGINT AS source_line
FROM e JOIN m ON m.doc_id = e.doc_id AND m.k = e.k AND m.len - m.nth >= e.until - e.k GROUP BY e.doc_id, first_line, last_line
"""

def _node(url: str) -> str:
    """A url's node: without fragment, scheme and host in small letters, / for an empty path."""
    head = f"coalesce(regexp_extract(split_part({url}, '#', 1), '^(?s:.*?)://[^/?#]*'), '')"
    rest = f"substr(split_part({url}, '#', 1), length({head}) + 1)"
    return f"CASE WHEN {head} = '' THEN split_part({url}, '#', 1) ELSE translate({head}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || CASE WHEN {rest} = '' OR starts_with({rest}, '?') THEN '/' ELSE '' END || {rest} END"


_LINK = "CASE WHEN t LIKE '/%' THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*') || t ELSE t END"
OP4 = rf"""
WITH RECURSIVE u AS (SELECT page_id, url, html, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(h, p, verdict)),
link AS (SELECT url, regexp_extract(regexp_extract(html, '(?is)(<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>)', 1), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM u WHERE html ILIKE '%canonical%'
  UNION ALL SELECT url, regexp_extract(regexp_extract(html, '(?is)(<meta\b[^>]*http-equiv\s*=\s*["'']?refresh\b[^>]*>)', 1), '(?is)url\s*=\s*["'']?([^"''\s>]+)', 1) FROM u WHERE html ILIKE '%refresh%'),
e AS (SELECT {_node("url")} AS a, {_node(_LINK)} AS b FROM link WHERE t <> ''),
twoway AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS n, a AS r FROM twoway UNION SELECT twoway.b, reach.r FROM reach JOIN twoway ON twoway.a = reach.n),
bad AS (SELECT DISTINCT n FROM (SELECT n, r, translate(regexp_extract(r, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h, regexp_extract(r, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS p FROM reach) q
  WHERE 'block' = (SELECT max_by(verdict, length(rules.h) * 1000 + length(rules.p)) FROM rules WHERE (q.h = rules.h OR ends_with(q.h, '.' || rules.h)) AND starts_with(q.p, rules.p))),
m AS (SELECT u.page_id, u.url, u.host, u.path, max_by(rules.h || rules.p, length(rules.h) * 1000 + length(rules.p)) AS rule, max_by(rules.verdict, length(rules.h) * 1000 + length(rules.p)) AS v
  FROM u LEFT JOIN rules ON (u.host = rules.h OR ends_with(u.host, '.' || rules.h)) AND starts_with(u.path, rules.p) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN {_node("url")} IN (SELECT n FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM m
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d WHERE len(w) >= 3),
rep AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM rep GROUP BY doc_id),
b AS (SELECT d.doc_id, host, t, ls, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
l AS (SELECT doc_id, host, t, unnest(ls) AS raw FROM b),
n AS (SELECT *, lower(array_to_string(regexp_extract_all(raw, '[^\x20\x09-\x0D]+'), ' ')) AS line, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS k FROM l),
f AS (SELECT host, line, count(DISTINCT t) AS docs FROM n WHERE line <> '' GROUP BY host, line),
h AS (SELECT host, count(DISTINCT t) AS all_docs FROM d GROUP BY host),
o AS (SELECT host, line FROM f JOIN h USING (host) WHERE docs > 5 AND docs > 0.02 * all_docs),
x AS (SELECT doc_id, sum(k) AS removed FROM n JOIN o USING (host, line) GROUP BY doc_id),
z AS (SELECT b.*, coalesce(removed, 0) AS removed, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b LEFT JOIN x ON x.doc_id = b.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND removed <= 0.5 * n_words AS kept FROM z
"""


def _op13(rounds: int = 4) -> str:
    """Plain Lloyd: every round assigns all parts anew and sums whole groups, each a table of its own."""
    steps, lists = [], "[floor(1024 * x::DOUBLE)::BIGINT for x in embedding]"
    steps.append(f"v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, {lists} AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)")
    steps.append("p AS MATERIALIZED (SELECT r, part, x[part * len(x) // 4 + 1 : (part + 1) * len(x) // 4] AS y FROM v, range(4) t(part))")
    steps.append("b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, y AS c FROM p WHERE r <= 256)")
    far = "list_sum([(q[1] - q[2]) * (q[1] - q[2]) for q in list_zip(y, c)])::BIGINT"
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, part, any_value(y) AS y, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT r, p.part, y, entry, {far} AS d FROM p JOIN b{k} b ON b.part = p.part) GROUP BY r, part)")
        if k < rounds:
            steps.append(f"m{k} AS MATERIALIZED (SELECT part, entry, list(z ORDER BY j) AS c FROM (SELECT part, entry, j, floor(sum(z)::DOUBLE / count(*))::BIGINT AS z FROM (SELECT part, entry, unnest(y) AS z, generate_subscripts(y, 1) AS j FROM a{k}) GROUP BY part, entry, j) GROUP BY part, entry)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry)")
    steps.append(f"s AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS digest FROM b{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM v JOIN s USING (r), h"


_CRC = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
_MICRO = "floor(1000000 * ln({}))::BIGINT"
# Letters are 1 to 3 characters: in order of their tries, with both neighbours, with the one before, alone.
OP12 = rf"""
WITH crc AS MATERIALIZED (SELECT {_CRC} AS t),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295) % 5 = 0 AS held_out,
  regexp_extract_all(lower(coalesce(text, '')), '\pL[\pL\pM]*') AS ws FROM documents, crc),
w AS MATERIALIZED (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(ws) AS word FROM d) GROUP BY r, word),
ls AS MATERIALIZED (SELECT lang, {_MICRO.format("count(*) / (SELECT count(*) FROM d WHERE lang IS NOT NULL AND NOT held_out)")} AS prior, (SELECT count(DISTINCT lang) FROM d WHERE NOT held_out) AS langs FROM d WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang),
c AS MATERIALIZED (SELECT lang, word, sum(n)::BIGINT AS n FROM w JOIN d USING (r) WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, word),
l AS MATERIALIZED (SELECT word, i, ' ' || word || ' ' AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM (SELECT DISTINCT word FROM w))),
g AS MATERIALIZED (SELECT word, i, size, CASE size WHEN 3 THEN substr(s, i, 3) WHEN 2 THEN substr(s, i, 2) ELSE substr(s, i + 1, 1) END AS token FROM l, (VALUES (1), (2), (3)) z(size)),
k AS MATERIALIZED (SELECT lang, 0 AS size, word AS token, n FROM c UNION ALL SELECT lang, size, token, sum(n)::BIGINT FROM c JOIN g USING (word) GROUP BY lang, size, token),
tot AS MATERIALIZED (SELECT lang, size, sum(n)::BIGINT AS total FROM k GROUP BY lang, size),
known AS MATERIALIZED (SELECT lang, size, token, {_MICRO.format("2.0 * n")} AS gain FROM k JOIN tot USING (lang, size) JOIN ls USING (lang) WHERE n * 1048576 >= total * langs),
fl AS MATERIALIZED (SELECT ls.lang, z.size, {_MICRO.format("0.5 / greatest(1, coalesce(total, 0))")} AS floor FROM ls, (VALUES (0), (1), (2), (3)) z(size) LEFT JOIN tot ON tot.lang = ls.lang AND tot.size = z.size),
kw AS (SELECT DISTINCT size, token FROM known),
u AS MATERIALIZED (SELECT DISTINCT word FROM w WHERE word NOT IN (SELECT token FROM kw WHERE size = 0)),
b AS MATERIALIZED (SELECT word, i, arg_max(g.token, g.size) FILTER (WHERE kw.token IS NOT NULL) AS token, max(g.size) FILTER (WHERE kw.token IS NOT NULL) AS size FROM u JOIN g USING (word) LEFT JOIN kw ON kw.size = g.size AND kw.token = g.token GROUP BY word, i),
sc AS MATERIALIZED (SELECT word, fl.lang, fl.floor + coalesce(gain, 0) AS s FROM (SELECT token AS word FROM kw WHERE size = 0) JOIN fl ON fl.size = 0 LEFT JOIN known ON known.size = 0 AND known.token = word AND known.lang = fl.lang
  UNION ALL SELECT b.word, ls.lang, floor(sum(coalesce(fl.floor, 0) + coalesce(gain, 0))::DOUBLE / count(*))::BIGINT FROM b CROSS JOIN ls LEFT JOIN fl ON fl.size = b.size AND fl.lang = ls.lang LEFT JOIN known ON known.size = b.size AND known.token = b.token AND known.lang = ls.lang GROUP BY b.word, ls.lang),
ds AS (SELECT r, lang, prior + sum(n * s)::BIGINT AS s FROM w JOIN sc USING (word) JOIN ls USING (lang) GROUP BY r, lang, prior),
p AS (SELECT r, arg_min(lang, (-s, lang)) AS lang_pred, max(s) AS top FROM ds GROUP BY r),
f AS (SELECT r, any_value(lang_pred) AS lang_pred, round(1.0 / sum(exp((s - top) / 1000000.0)), 6) AS score FROM ds JOIN p USING (r) GROUP BY r)
SELECT doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN f USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1, "op2_exact_dedup": OP2, "op3_line_dedup": OP3, "op4_url_filter": OP4, "op8_quality": OP8, "op12_language": OP12, "op13_vector_codes": _op13()}
