"""SQL that gives the same rows as a registered query over the same tables, where SQL can and is quick enough.

The statements join texts by brute force; they are meant for small tables.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = r"[\x20\x09-\x0D]+"

_NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text,''),'{_UPPER}','{_LOWER}'),'{_WHITE}'), lambda w: w <> '') ws FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws,' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3],' ')) END)) s FROM d),
n AS (SELECT doc_id, count(*) n FROM g GROUP BY 1),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT doc_id, doc_id c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) n_shingles, min(r.c) component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""

_BITS = "array_to_string(list_transform(string_split(sha1(h),''), lambda c: right('000' || bin(cast(strpos('0123456789abcdef', c) - 1 AS int)), 4)), '')"
_FIVE = " + ".join(f"CASE WHEN substr(b, cast(5 * k + {i + 1} AS int), 1) = '1' THEN {16 >> i} ELSE 0 END" for i in range(5))
_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html,'') h FROM pages), b AS (SELECT *, {_BITS} b FROM p),
l AS (SELECT *, max(page_id) OVER (PARTITION BY h) last FROM b)
SELECT page_id, octet_length(encode(h)) payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('{_UPPER}234567', cast(1 + {_FIVE} AS int), 1)), '') payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id <> last THEN last END refers_to FROM l"""

_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * cast(x AS double))) e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id query_id, r.vec_id, cast(list_dot_product(q.e, r.e) AS bigint) score FROM v q JOIN v r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id)
SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS int) AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""

_words = lambda t: f"regexp_extract_all(translate(coalesce({t},''),'{_UPPER}','{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
_DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_words("text")} ws FROM documents), i AS (SELECT cast(item_id AS varchar) item, {_words("text")} ws FROM benchmark),
w AS (SELECT DISTINCT item, least(len(ws), 10) size, array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') s FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) k FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM w), places AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) k FROM d),
hits AS (SELECT doc_id, k, w.size, item FROM places JOIN sizes ON k + sizes.size - 1 <= len(ws) JOIN w ON w.size = sizes.size AND w.s = array_to_string(ws[k:k + sizes.size - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) p FROM hits) GROUP BY 1),
t AS (SELECT doc_id, list_sort(list(DISTINCT item)) items FROM hits GROUP BY 1)
SELECT d.doc_id, len(ws) n_words, coalesce(n_hit, 0) n_hit, coalesce(len(items), 0) n_items, sha256(coalesce(array_to_string(items, ','), '')) items_sha256, n_hit IS NOT NULL contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

_AUDIT = f"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) toxic FROM labels GROUP BY 1),
d AS (SELECT doc_id, coalesce(lang,'') part, coalesce(text,'') t, list_filter(string_split_regex(coalesce(text,''),'{_WHITE}'), lambda w: w <> '') ws FROM documents),
m AS (SELECT part, coalesce(good, 0) good, coalesce(toxic, 0) toxic, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
 + CASE WHEN 100 * (length(t) - length(translate(t,'{_UPPER}',''))) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t,'[#$%&*|]') THEN 8 ELSE 0 END
 + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END mask FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) n, sum(good) good, sum(toxic) toxic FROM m GROUP BY ALL),
parts AS (SELECT DISTINCT part FROM c), sets AS (SELECT unnest(range(32)) s),
st AS (SELECT p.part, s, coalesce(sum(n) FILTER ((mask & s) = 0), 0) n, coalesce(sum(good) FILTER ((mask & s) = 0), 0) good, coalesce(sum(toxic) FILTER ((mask & s) = 0), 0) toxic FROM parts p CROSS JOIN sets JOIN c ON c.part = p.part GROUP BY ALL),
k AS (SELECT unnest(range(5)) k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT o, step, cast(o[step] AS int) f, cast(list_sum(list_transform(o[1:step], lambda x: cast(pow(2, x) AS bigint))) AS bigint) s FROM (SELECT o, unnest(range(1, 6)) step FROM o)),
fails AS (SELECT part, f, sum(n) FILTER ((mask & cast(pow(2, f) AS bigint)) > 0) fails, sum(n) FILTER (mask = cast(pow(2, f) AS bigint)) alone FROM c, (SELECT DISTINCT f FROM steps) GROUP BY ALL),
r AS (SELECT a.part, array_to_string(list_transform(o, lambda x: substr('ABCDE', cast(x + 1 AS int), 1)), '') filter_order, step, f, a.n kept, b.n - a.n removed, b.good - a.good good_lost, b.toxic - a.toxic toxic_lost
 FROM steps JOIN st a ON a.s = steps.s JOIN st b ON b.part = a.part AND b.s = steps.s - cast(pow(2, f) AS bigint))
SELECT r.part, filter_order, cast(step AS int) step, cast(kept AS bigint) kept, cast(removed AS bigint) removed, cast(coalesce(fails, 0) - removed AS bigint) redundant, cast(coalesce(alone, 0) AS bigint) unique_fails,
 cast(good_lost AS bigint) good_lost, cast(toxic_lost AS bigint) toxic_lost, cast(sum(removed) OVER (PARTITION BY r.part, r.f) AS bigint) shapley FROM r JOIN fails x ON x.part = r.part AND x.f = r.f"""

ORACLE_SQL = {
    "op1_ngram_join": _NGRAM_JOIN,
    "op2_warc": _WARC,
    "op5_top_k": _TOP_K,
    "op8_decontamination": _DECONTAMINATE,
    "op12_filter_audit": _AUDIT,
}
