"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import audit, quality, secrets, urlfilter

_WS = r"[\x20\x09-\x0D]"
_BOTH = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{_WS}+'), lambda x: x <> '') AS words, string_split(t, chr(10)) AS lines FROM d),
win AS (SELECT rid, i, words[i:i + 7] AS k FROM w, LATERAL (SELECT unnest(range(1, len(words) - 6)) AS i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c >= 2),
rep AS (SELECT rid, sum(x)::BIGINT AS n FROM (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS x FROM dup) GROUP BY rid),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(lines, lambda x: trim(x, {_BOTH}) <> '')) - len(list_distinct(list_filter(lines, lambda x: trim(x, {_BOTH}) <> ''))))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    list_sum(list_transform(list_filter(lines, lambda x: NOT (
        (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 100 > length(x) * {quality.RULES.symbol_percent}
        OR (length(x) - length(regexp_replace(x, '{quality.PUNCTUATION}', '', 'g'))) * 100 > length(x) * {quality.RULES.punctuation_percent}
        OR length(x) >= {quality.RULES.long_line} AND NOT regexp_matches(x, '{quality.SENTENCE_END}')
        OR length(x) <= {quality.RULES.short_line} AND (regexp_matches(lower(x), '{quality.NAVIGATION_LINE}') OR regexp_matches(lower(x), '{quality.BOILERPLATE}')))), lambda x: length(regexp_replace(x, '{_WS}', '', 'g')))) AS left_chars
  FROM w LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(left_chars, 0) * 100 >= word_chars * {quality.RULES.least_left_percent} AS kept
FROM m
"""

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_BOTH}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, last IS NOT NULL AND k.doc_id <> last AS gone FROM k LEFT JOIN common USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> ''))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 9))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS lim FROM r),
v AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(lim) OVER (ORDER BY lim / weight, rank) - lim)) / sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(lim, greatest(max(level) OVER (), 0) * weight) AS target FROM v),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
c AS (SELECT d.*, u.source_size, u.target, u.times, target - times * source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, (size * (times + CASE WHEN upto + (upto - own) < 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""


def _op4() -> str:
    q = lambda s: s.replace("'", "''")
    union = []
    for i, (kind, pattern) in enumerate((("assign", secrets.ASSIGN), ("access", secrets.ACCESS), ("hex", secrets.HEX), *((k, secrets._class_pattern(c)) for k, c, _ in secrets.CLASSES))):
        union.append(f"SELECT rid, {i} AS rank, '{kind}' AS kind, unnest(string_split_regex(t, '{q(pattern)}')) AS gap, unnest(regexp_extract_all(t, '{q(pattern)}', 0)) AS match, generate_subscripts(string_split_regex(t, '{q(pattern)}'), 1) AS i FROM d WHERE regexp_matches(t, '{q(pattern)}')")
    logs = f"[{', '.join(map(str, secrets.LOGS))}]"
    limits = " ".join(f"WHEN '{k}' THEN {secrets.most(b)}" for k, _, b in secrets.CLASSES)
    chars = " ".join(f"WHEN '{k}' THEN '{c}'" for k, c, _ in secrets.CLASSES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(union)}),
p AS (SELECT *, sum(length(gap) + coalesce(length(match), 0)) OVER (PARTITION BY rid, rank ORDER BY i)::BIGINT AS stop FROM m),
s AS (SELECT rid, rank, kind, match, stop - length(match) AS start, stop FROM p WHERE match IS NOT NULL),
base AS (SELECT rid, rank, kind, start, stop FROM s WHERE rank > 0 AND rank < 3 OR rank = 0 AND length(regexp_extract(match, '{q(secrets.ASSIGN)}', 1)) >= 6),
cand AS (SELECT row_number() OVER () AS cid, *, CASE kind {chars} END AS chars FROM s WHERE rank >= 3 AND regexp_matches(match, '[0-9]') AND NOT regexp_matches(match, '{q(secrets.IDENTIFIER)}')),
win AS (SELECT cid, i, unnest(string_split(substr(match, i + 1, {secrets.WINDOW}), '')) AS ch FROM cand, LATERAL (SELECT unnest(range(0, length(match) - {secrets.WINDOW - 1})) AS i)),
cnt AS (SELECT cid, i, ch, count(*) AS c FROM win GROUP BY ALL),
ent AS (SELECT cid, i, sum({logs}[c + 1]) AS total FROM cnt GROUP BY ALL),
hot AS (SELECT cid, i, i - lag(i) OVER (PARTITION BY cid ORDER BY i) AS step FROM ent JOIN cand USING (cid) WHERE total <= CASE kind {limits} END AND NOT regexp_matches(substr(match, i + 1, {secrets.WINDOW}), '{q(secrets.ALLOWED)}')),
run AS (SELECT cid, i, count(*) FILTER (step > {secrets.WINDOW}) OVER (PARTITION BY cid ORDER BY i) AS run FROM hot),
part AS (SELECT cid, min(i) AS a, max(i) + {secrets.WINDOW} AS b FROM run GROUP BY cid, run),
extra AS (SELECT rid, rank, kind, start + a AS start, start + b AS stop, substr(match, a + 1, b - a) AS part FROM part JOIN cand USING (cid)),
more AS (SELECT rid, rank, kind, start, stop FROM extra e WHERE regexp_matches(part, '[0-9]') AND (rank = 3 OR regexp_matches(part, '[g-zG-Z]')) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = e.rid AND b.start <= e.start AND b.stop >= e.stop)),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS b FROM base GROUP BY rid),
z AS (SELECT rid, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid) LEFT JOIN z USING (rid)
"""


OP4 = _op4()

OP2 = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11 = f"""
WITH r(host, path, verdict) AS (VALUES {", ".join(map(repr, urlfilter.RULES))}),
p AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), {_LOWER}) AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM p)
SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, coalesce(r.verdict, '{urlfilter.DEFAULT}') AS verdict
FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC, r.verdict DESC) = 1
"""

OP12 = rf"""
WITH c AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
m AS (SELECT list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT rid, unnest(w) AS w FROM d),
mw AS (SELECT unnest(w) AS w FROM m),
words AS (SELECT DISTINCT w FROM dw UNION SELECT w FROM mw),
b AS (SELECT w, xor(list_reduce([4294967295] || list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM words, c),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM dw JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM mw JOIN b USING (w) GROUP BY bucket),
g AS (SELECT s.bucket, floor(1000 * ln(((coalesce(t.t, 0) + 1) * ((SELECT count(*) FROM dw)::DOUBLE + 10000)) / ((s.s + 1) * ((SELECT count(*) FROM mw)::DOUBLE + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
x AS (SELECT rid, count(*)::BIGINT AS n, sum(gain)::BIGINT AS weight FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY rid),
y AS (SELECT rid, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE AS h FROM d LEFT JOIN x USING (rid)),
z AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM y),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (rid)
"""

OP13 = f"""
WITH f(filter_order, step, own, earlier) AS (VALUES {", ".join(map(str, audit.steps()))}),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & own = 0 AND mask & earlier = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM c, f GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
