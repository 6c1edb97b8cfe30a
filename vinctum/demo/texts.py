"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinctum.functions import text as T
from vinctum.functions import vocab as V
from vinctum.operators import matching

from .linkage import case_sql, mark_sql, tokens_sql
from .views import Registry

Q = Registry()

_LOC = r"""coalesce(nullif(trim(regexp_extract(text, '(?:en|por|desde|cerca de)\s+([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s*,\s*[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)?)', 1)), ''), nullif(trim(regexp_extract(text, '(?i)(?:colonia|fracc|fraccionamiento|barrio)\s+([A-ZÁÉÍÓÚÑ][a-zA-Z0-9_\sáéíóúñ.-]{2,60})', 1)), ''), nullif(trim(regexp_extract(text, '(?i)(?:estado|municipio|ciudad)\s+[de\s]*([A-ZÁÉÍÓÚÑ][a-zA-Z0-9_\sáéíóúñ.-]{2,40})', 1)), ''))"""
Q("tokens_ascii", "documents", sql=f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM documents")(lambda d: d.select("doc_id", F.array_join(T.tokens_ascii("text"), " ").alias("tokens")))
_M = "list_filter(list_transform(string_split(coalesce(sana_particular, ''), '<br>'), lambda x: trim(x)), lambda x: x <> '' AND upper(x) <> 'NINGUNA')"


@Q("mark_struct", "v_personas", sql=f"SELECT id, m.raw AS raw, m.lado AS lado, array_to_string(list_sort(m.tokens), ' ') AS tokens FROM (SELECT id, {mark_sql('x')} AS m FROM (SELECT id_victimadirecta AS id, unnest({_M}) AS x FROM v_personas))")
def mark_struct(p):
    """T2."""
    from vinctum.functions.clean import parse_marks

    m = p.select(F.col("id_victimadirecta").alias("id"), F.explode(parse_marks("sana_particular")).alias("x")).select("id", T.mark_struct("x").alias("m"))
    return m.select("id", "m.raw", "m.lado", F.array_join(F.array_sort("m.tokens"), " ").alias("tokens"))


Q("split_marks", "v_records", sql="SELECT id, array_to_string(list_filter(list_transform(string_split_regex(raw_description, '[;,\\n]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS marks FROM v_records")(lambda r: r.select("id", F.array_join(T.split_marks("raw_description"), "|").alias("marks")))
Q("classify_mark", "v_records", sql=f"SELECT id, {case_sql('raw_description', V.TYPES, 'otra_sena')} AS feature_type, {case_sql('raw_description', V.REGIONS, 'generico')} AS body_region, {case_sql('raw_description', V.SIDES, 'na')} AS laterality, {case_sql('raw_description', V.MOTIFS)} AS motif_category FROM v_records")(
    lambda r: r.select("id", T.classify_mark("raw_description").alias("c")).select("id", "c.*"))
_PH, _EM = r"(\+\d{1,3}[\s.-]?)?\b\d{10}\b", r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
Q("redact_pii", "v_posts", sql=f"SELECT doc_id, regexp_replace(x, '{_EM}', '[email_redactado]', 'g') AS redacted_text, len(regexp_extract_all(text, '{_PH}'))::INT AS phone_count, len(regexp_extract_all(x, '{_EM}'))::INT AS email_count FROM (SELECT *, regexp_replace(text, '{_PH}', '[telefono_redactado]', 'g') AS x FROM v_posts)")(
    lambda p: p.select("doc_id", T.redact_pii("text").alias("r")).select("doc_id", "r.*"))
_F = "list_filter([" + ", ".join(f"'{x}'" for x in V.FORBIDDEN) + "], lambda p: contains(low, p))"
_R = " OR ".join(f"contains(low, '{x}')" for x in V.RECOMMENDED)


@Q("copy_safety", "conversations", sql=f"SELECT conv_id, turn, len({_F}) = 0 AS ok, array_to_string({_F}, '|') AS forbidden, {_R} AS uses_recommended FROM (SELECT conv_id, turn, lower(text || CASE WHEN conv_id % 3 = 0 THEN ' Este caso está conectado y CONFIRMADO POR IA.' ELSE ' Señal contextual pendiente de revisión.' END) AS low FROM conversations)")
def copy_safety(c):
    """T7."""
    text = F.concat("text", F.when(F.col("conv_id") % 3 == 0, " Este caso está conectado y CONFIRMADO POR IA.").otherwise(" Señal contextual pendiente de revisión."))
    return c.select("conv_id", "turn", T.copy_safety(text).alias("s")).select("conv_id", "turn", "s.ok", F.array_join("s.forbidden_hits", "|").alias("forbidden"), "s.uses_recommended")


_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
Q("strip_tags", "pages", sql=f"SELECT page_id, md5({_STRIP}) AS digest, length({_STRIP}) AS n FROM pages")(lambda p: p.select("page_id", F.md5(T.strip_tags("html").cast("binary")).alias("digest"), F.length(T.strip_tags("html")).alias("n")))


@Q("artifact_text", "pages", sql=f"SELECT page_id, md5(CASE WHEN page_id % 3 = 0 THEN trim(url || chr(10) || 'md ' || page_id) WHEN page_id % 3 = 1 THEN trim(url || chr(10) || {_STRIP}) ELSE '{{}}' END) AS digest FROM pages")
def artifact_text(p):
    """T9."""
    title = F.when(F.col("page_id") % 3 != 2, F.col("url"))
    markdown = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("md "), "page_id"))
    html = F.when(F.col("page_id") % 3 != 2, F.col("html"))
    return p.select("page_id", F.md5(T.artifact_text(title, markdown, html, F.lit("{}")).cast("binary")).alias("digest"))


_RT = lambda x: f"nullif(trim(replace({x}, '<br>', ', ')), '')"
Q("record_text", "v_personas", sql=f"SELECT id_victimadirecta AS id, coalesce(nullif(concat_ws(' | ', {_RT('sana_particular')}, {_RT('media_filiacion')}, {_RT('sexo')}, {_RT('estado')}), ''), 'sin datos') AS text FROM v_personas")(
    lambda p: p.select(F.col("id_victimadirecta").alias("id"), T.record_text("sana_particular", "media_filiacion", "sexo", "estado").alias("text")))
Q("location_phrase", "v_posts", sql=f"SELECT doc_id, {_LOC} AS place FROM v_posts")(lambda p: p.select("doc_id", T.location_phrase("text").alias("place")))
_TONE = lambda table: "concat_ws(',', " + ", ".join("CASE WHEN regexp_matches(lower(text), '(?i){}') THEN '{}' END".format(p, k) for k, p in table) + ")"
Q("tone_keywords", "v_posts", sql=f"SELECT doc_id, {_TONE(V.TONES)} AS tones, {_TONE(V.SHORT_TONES)} AS tags FROM v_posts")(lambda p: p.select("doc_id", F.array_join(T.tone_keywords("text"), ",").alias("tones"), F.array_join(T.tone_keywords("text", "short"), ",").alias("tags")))
# a space between a unit and a digit lets each mark have its next character for itself
_MARKED = """l AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '([hdwmy])([0-9])', '\\1 \\2', 'g'), '([0-9]{1,2}[hdwmy])(?:[a-z0-9\\s]|$)', 1)) AS m FROM v_posts),
k AS (SELECT doc_id, list_position(['h', 'd', 'w', 'm', 'y'], right(m, 1)) AS r, left(m, length(m) - 1)::INT AS n FROM l), best AS (SELECT doc_id, max((r, n)) AS x FROM k WHERE n <= [23, 30, 52, 12, 10][r] GROUP BY doc_id)"""
Q("relative_date", "v_posts", sql=f"WITH {_MARKED} SELECT doc_id, strftime(TIMESTAMP '2024-06-30 12:00:00' - CASE x[1] WHEN 1 THEN to_hours(x[2]) WHEN 2 THEN to_days(x[2]) WHEN 3 THEN to_days(7 * x[2]) WHEN 4 THEN to_months(x[2]) ELSE to_years(x[2]) END, '%Y-%m-%d %H:%M:%S') AS posted FROM v_posts LEFT JOIN best USING (doc_id)")(
    lambda p: p.select("doc_id", F.date_format(T.relative_date("text", F.lit("2024-06-30 12:00:00").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("posted")))
_UI = "(?i)^(Like|Comment|Share|All reactions.*|Reply|View (more|all).*|[0-9]+[dhw])$"


@Q("split_posts", "conversations", sql=f"""
WITH t AS (SELECT conv_id, string_agg(CASE WHEN turn % 3 = 1 THEN text || chr(10) || ' Like ' || chr(10) || 'first answer' || chr(10) || '3d' || chr(10) || 'Reply' ELSE text END, chr(10) || 'Comment as ' ORDER BY turn, text) AS page FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, trim(unnest(s)) AS chunk, (generate_subscripts(s, 1) - 1)::INT AS idx FROM (SELECT conv_id, string_split_regex(page, '(?i)\nComment as |\nAnswer as ') AS s FROM t)),
l AS (SELECT conv_id, idx, list_filter(list_transform(string_split(chunk, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM c WHERE length(chunk) > 20),
k AS (SELECT *, coalesce(list_position(list_transform(ls, lambda x: regexp_matches(x, '(?i)^(Like|Comment|Share|All reactions.*)$')), true), 0) AS cut FROM l),
b AS (SELECT conv_id, idx, list_filter(CASE WHEN cut > 0 THEN ls[1:cut - 1] ELSE ls END, lambda x: NOT regexp_matches(x, '{_UI}')) AS body, list_filter(CASE WHEN cut > 0 THEN ls[cut:] ELSE [] END, lambda x: NOT regexp_matches(x, '{_UI}')) AS more FROM k)
SELECT conv_id, idx, substr(array_to_string(body, ' ') || CASE WHEN len(more) > 0 THEN chr(10) || chr(10) || '[Comments: ' || array_to_string(more, ' | ') || ']' ELSE '' END, 1, 5000) AS content FROM b WHERE length(array_to_string(body, ' ')) >= 10""")  # fmt: skip
def split_posts(c):
    """T14, over conversations joined to one text each; some turns carry reactions and a comment."""
    text = F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit("\n Like \nfirst answer\n3d\nReply"))).otherwise(F.col("text"))
    turns = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", text.alias("full")))), lambda x: x["full"]), "\nComment as ").alias("page"))  # a conversation's turns
    return T.split_posts(turns, "page", ["conv_id"])


Q("content_hashes", "pages", sql=r"SELECT page_id, sha256(concat('web', chr(31), 'scrape', chr(31), chr(31), lower(trim(url)))) AS run_key, substr(sha256(html), 1, 16) AS short FROM pages")(
    lambda p: p.select("page_id", T.idempotency_key(F.lit(" Web "), F.lit("scrape"), F.lit(None), "url").alias("run_key"), F.substring(F.sha2("html", 256), 1, 16).alias("short")))


@Q("flatten_search", "pages", sql="""
SELECT page_id, kind, url, title FROM (SELECT page_id, 'web' AS kind, url, 'w' || page_id AS title FROM pages UNION ALL SELECT page_id, 'news', 'l' || url, NULL FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'images', NULL, 'x' FROM pages) WHERE url IS NOT NULL""")  # fmt: skip
def flatten_search(p):
    """T16."""
    one = lambda url, link, title: F.struct(url.alias("url"), link.alias("link"), title.alias("title"))
    none = F.lit(None).cast("string")
    results = p.select("page_id", F.array(one(F.col("url"), none, F.concat(F.lit("w"), "page_id"))).alias("web"), F.when(F.col("page_id") % 2 == 0, F.array(one(F.lit(""), F.concat(F.lit("l"), "url"), none))).otherwise(F.array().cast("array<struct<url:string,link:string,title:string>>")).alias("news"), F.array(one(none, F.lit(""), F.lit("x"))).alias("images"))
    return T.flatten_search(results, ["page_id"])


@Q("match_patterns", "v_posts", sql=f"""
WITH t AS (SELECT doc_id, list_filter(string_split({_TONE(V.TONES)}, ','), lambda x: x <> '') AS k, regexp_matches(text, '(?i){V.TRIGGERS}') AS trig FROM v_posts),
pat AS (SELECT * FROM t ORDER BY (doc_id * 7919) % 1000 DESC, doc_id LIMIT 500),
s AS (SELECT c.doc_id AS case_id, p.doc_id AS pattern_id, len(list_intersect(c.k, p.k))::DOUBLE / greatest(len(c.k), len(p.k)) * 0.6::DOUBLE + CASE WHEN c.trig THEN 0.15::DOUBLE ELSE 0 END AS score FROM t c, pat p WHERE len(list_intersect(c.k, p.k)) > 0)
SELECT case_id, pattern_id, round(score, 6) AS score FROM s WHERE round(score, 9) >= 0.3 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, (pattern_id * 7919) % 1000 DESC, pattern_id) <= 5""")  # fmt: skip
def match_patterns(p):
    """The newest 500 patterns are the feature's own limit."""
    tones = matching.case_tones(p.select(F.col("doc_id").alias("case_id"), "text"))
    patterns = tones.select(F.col("case_id").alias("pattern_id"), "keywords", (F.col("case_id") * 7919 % 1000).alias("scraped_at"))
    out = matching.match_patterns(tones, patterns)
    return out.select("case_id", "pattern_id", F.round("score", 6).alias("score"))
