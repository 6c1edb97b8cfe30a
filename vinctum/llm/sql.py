"""DuckDB SQL of the numbered operators' queries, written from their definitions and not from the Spark plans."""

from __future__ import annotations

from .quality_rules import STOP_WORDS

_A2Z = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH raw AS (SELECT doc_id, string_split({_A2Z}, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS line, list_sort(list_distinct(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+'))) AS w FROM raw, range(1, len(ls) + 1) t(i)),
c AS (SELECT w, min((doc_id, line)) AS first, len(w) AS n FROM l WHERE len(w) >= 1 GROUP BY w),
t AS (SELECT first, n, unnest(w) AS tok FROM c),
df AS (SELECT tok, count(*) AS df FROM t GROUP BY tok),
p AS (SELECT first, n, tok FROM t JOIN df USING (tok) QUALIFY row_number() OVER (PARTITION BY first ORDER BY df, tok) <= n - ceil(0.8 * n - 1e-9) + 1),
cand AS (SELECT DISTINCT a.first AS x, b.first AS y FROM p a JOIN p b ON a.tok = b.tok AND b.first < a.first AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
v AS (SELECT DISTINCT x FROM (SELECT x, len(list_intersect(a.w, b.w)) AS m, a.n + b.n AS s FROM cand JOIN c a ON a.first = x JOIN c b ON b.first = y) WHERE 100 * m >= 80 * (s - m)),
gone AS (SELECT l.doc_id, l.line FROM l JOIN c USING (w) LEFT JOIN v ON v.x = c.first WHERE v.x IS NOT NULL OR (l.doc_id, l.line) > c.first),
g AS (SELECT doc_id, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS s FROM gone GROUP BY doc_id)
SELECT doc_id, CASE WHEN ls = [''] THEN 0 ELSE len(ls) END::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(g.s, '') AS removed_lines FROM raw LEFT JOIN g USING (doc_id)
"""

OP3 = """
WITH bits AS (SELECT i, i AS c0 FROM range(256) t(i)),
tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM bits)),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT doc_id, strlen(text)::BIGINT + 1 AS size, hex(encode(text)) AS h, strlen(text) AS n FROM d),
s AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM x, tab),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS far, sum(size) OVER () AS total FROM s),
q AS (SELECT doc_id, size, text_crc32, ((2 * far - size) * 8 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard FROM q
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_A2Z}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_A2Z}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM b, range(1, len(w) - least(13, len(w)) + 2) t(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, ns, range(1, len(w) - n + 2) t(i)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(n) t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_MEASURED = rf"""
d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {{docs}}),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, range(1, len(w) - 3) t(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) t(k) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS stops FROM d),
m2 AS (SELECT doc_id, n_words, word_chars, n_symbols, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, stops FROM m LEFT JOIN rep USING (doc_id)),
m3 AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m2),
judged AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_symbols / n_words <= 0.3 AND word_chars / n_words BETWEEN 1.5 AND 30 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND (n_words < 60 OR stops / n_words >= 0.01) AS kept FROM m3)"""
OP10 = f"WITH {_MEASURED.format(docs='documents')} SELECT * FROM judged"

#: The rounds are written out one by one; sums of squares stay far below 2**53, so dot products in doubles are exact.
_ROUNDS, _K = 10, 8
_ASSIGN = "a{r} AS MATERIALIZED (SELECT vec_id, n, v, min({{'d': list_dot_product(v, v) - 2 * list_dot_product(v, m) + list_dot_product(m, m), 'c': c}}) AS best FROM k, c{r} GROUP BY vec_id, n, v)"
_MOVE = """s{r} AS (SELECT c, i, sum(x::HUGEINT) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(v)::BIGINT AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i),
c{n} AS MATERIALIZED (SELECT c, coalesce(new.m, old.m) AS m FROM c{r} old LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS m FROM s{r} GROUP BY c) new USING (c))"""
OP11 = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
k AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, list_transform(x, lambda y: floor(1024 * y)) AS v FROM e),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v AS m FROM k QUALIFY c < {_K}),
{", ".join(_ASSIGN.format(r=r) + ", " + _MOVE.format(r=r, n=r + 1) for r in range(_ROUNDS))},
{_ASSIGN.format(r=_ROUNDS)}
SELECT vec_id, best.c::INT AS cluster, best.d::BIGINT AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(m, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{_ROUNDS} JOIN c{_ROUNDS} ON best.c = c
"""

OP12 = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM d, range(1, len(w) - 33) t(i)),
again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY g) > 1),
gone AS (SELECT r, list_distinct(list(i + k)) AS places FROM again, range(35) t(k) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(source::VARCHAR, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS own, list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END)) AS before FROM o, range(1, 6) t(step)),
b AS (SELECT filter_order, step, own::INT AS own, coalesce(before, 0)::INT AS before FROM s)
SELECT part, filter_order, step,
  sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & own <> 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & own <> 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost,
  sum(sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END)) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM c, b GROUP BY part, filter_order, step, own
"""

ORACLE_SQL = {"op11_centroids": OP11, "op12_substring_dedup": OP12, "op13_filter_audit": OP13, "op1_line_dedup": OP1, "op3_sharding": OP3, "op7_decontaminate": OP7, "op10_quality_rules": OP10}
