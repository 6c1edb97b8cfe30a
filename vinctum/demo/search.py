"""Queries of searches and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinctum.functions.clean import parse_marks
from vinctum.operators import matching
from vinctum.operators import search as S

from .views import Registry

Q = Registry()


@Q("search_people", "v_personas", sql="""WITH hit AS (SELECT id_victimadirecta AS id FROM v_personas WHERE contains(lower(estado), 'tion_1') AND sexo = 'Mujer' AND (contains(lower(nombre), '1') OR contains(lower(apellido), '1')))
SELECT id, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY id LIMIT 24 OFFSET 3""")  # fmt: skip
def search_people(p):
    """F1."""
    page, total = S.search_people(p, ["nombre", "apellido"], "id_victimadirecta", state="Tion_1", sex="Mujer", q="1", offset=3)
    return page.select(F.col("id_victimadirecta").alias("id")).join(F.broadcast(total))


Q("search_records", "v_records", sql="SELECT id FROM (SELECT *, 'MUN' || substr(id, length(id), 1) AS municipio FROM v_records) WHERE record_type = 'missing' AND (contains(lower(raw_description), 'n7') OR contains(lower(municipio), 'n7')) ORDER BY id LIMIT 20")(
    lambda r: S.search_records(r.withColumn("municipio", F.concat(F.lit("MUN"), F.substring("id", -1, 1))), q="N7", record_type="missing").select("id"))
Q("search_pages", "pages", sql="SELECT page_id, row_number() OVER (ORDER BY page_id)::INT AS rank, substr(html, 1, 160) AS description FROM (SELECT * FROM pages WHERE contains(lower(url), '/fr') OR contains(lower(html), 'est le') ORDER BY page_id LIMIT 10)")(
    lambda p: S.search_pages(p.withColumn("both", F.concat_ws("|", F.when(F.lower("url").contains("/fr"), "est le"), "html")), "both", "html", "EST LE").select("page_id", "rank", "description"))
Q("having_mark", "v_personas", sql="SELECT id_victimadirecta AS id FROM v_personas WHERE list_contains(list_transform(string_split(sana_particular, '<br>'), lambda x: trim(x)), 'LUNAR EN CUELLO')")(
    lambda p: S.having_mark(p.withColumn("marks", parse_marks("sana_particular")), "marks", "LUNAR EN CUELLO").select(F.col("id_victimadirecta").alias("id")))
Q("fetchable", "v_personas", sql="SELECT id_victimadirecta AS id FROM v_personas WHERE fecha_hechos IS NOT NULL AND extranjero <> 'SIN DATO'")(
    lambda p: S.fetchable(p.withColumn("x", F.when(F.col("extranjero") == "SIN DATO", " Confidencial").otherwise(F.col("extranjero"))), "fecha_hechos", "x").select(F.col("id_victimadirecta").alias("id")))
_TG = "list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))"
_SIMILAR = f"WITH r AS (SELECT c_custkey AS id, {_TG} AS g FROM (SELECT c_custkey, '  ' || lower(c_name) || ' ' AS t FROM customer)), s AS (SELECT a.id AS query_id, b.id, len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))) AS s FROM r a, r b WHERE a.id % 100 = 0) SELECT query_id, id, round(s, 6) AS similarity FROM s WHERE s >= 0.75"
_similar = lambda c: S.similar_pairs(c, "c_custkey", "c_name", "c_custkey % 100 = 0", 0.75).select("query_id", "id", F.round("similarity", 6).alias("similarity"))
# every name of a key divisible by 100 against all names
Q("similar_names", "customer", sql=_SIMILAR)(_similar)


@Q("gazetteer", "v_records", "nation", sql="""
WITH x AS (SELECT id, lower(CASE WHEN length(id) % 2 = 0 THEN coalesce(estado, '') || '.' ELSE 'cerca de ' || coalesce(estado, '') || ' sur' END) AS raw FROM v_records), y AS (SELECT id, trim(regexp_replace(trim(raw), '[.,;]$', '')) AS p FROM x),
g AS (SELECT lower(n_name) AS name, n_nationkey AS ord, n_nationkey + 0.5 AS lat FROM nation)
SELECT id, round(coalesce(e.lat, (SELECT min_by(lat, ord) FROM g WHERE contains(p, name)))::DOUBLE, 6) AS lat FROM y LEFT JOIN g e ON e.name = p""")  # fmt: skip
def gazetteer(r, n):
    """J7."""
    table = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"), (F.col("n_nationkey") + F.lit(0.5)).alias("lat"), F.col("n_nationkey").cast("double").alias("lng"))
    state = F.coalesce("estado", F.lit(""))
    places = r.select("id", F.when(F.length("id") % 2 == 0, F.concat(state, F.lit("."))).otherwise(F.concat(F.lit("cerca de "), state, F.lit(" sur"))).alias("place"))
    return matching.gazetteer(places, "place", table).select("id", F.round(F.col("lat").cast("double"), 6).alias("lat"))


@Q("coords_fallback", "v_registry", "nation", sql="""
WITH m AS (SELECT DISTINCT entidad AS estado, municipio, CASE WHEN length(municipio) % 2 = 0 THEN 0 ELSE 1 + length(entidad) END AS lat FROM v_registry WHERE k % 3 = 0), s AS (SELECT n_name AS estado, 10 + n_nationkey AS lat FROM nation WHERE n_nationkey % 4 <> 0)
SELECT id, coalesce(nullif(m.lat, 0), s.lat)::DOUBLE AS lat FROM v_registry r LEFT JOIN m ON m.estado = r.entidad AND m.municipio = r.municipio LEFT JOIN s ON s.estado = r.entidad""")  # fmt: skip
def coords_fallback(r, n):
    """J8."""
    lat = F.when(F.length("municipio") % 2 == 0, 0).otherwise(1 + F.length("estado"))
    muni = r.where("k % 3 = 0").select(F.col("entidad").alias("estado"), "municipio").distinct().select("estado", "municipio", lat.alias("lat"), lat.alias("lng"))
    state = n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("estado"), (F.col("n_nationkey") + 10).alias("lat"), F.col("n_nationkey").alias("lng"))
    return matching.coords_fallback(r.withColumnRenamed("entidad", "estado"), muni, state).select("id", F.col("lat").cast("double").alias("lat"))


@Q("place_lookup", "v_registry", sql="""
WITH k AS (SELECT DISTINCT municipio || ', ' || entidad AS key FROM v_registry), c AS (SELECT key FROM k WHERE length(key) % 2 = 0) SELECT count(*) FILTER (key IN (SELECT key FROM c)) AS n_found, count(*) FILTER (key NOT IN (SELECT key FROM c)) AS n_missing FROM k""")  # fmt: skip
def place_lookup(r):
    """J14."""
    cache = r.select(F.concat_ws(", ", "municipio", "entidad").alias("place_key")).distinct().where("length(place_key) % 2 = 0").select("place_key", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"))
    return matching.place_lookup(r, ["municipio", "entidad"], cache)[1]


@Q("case_unlocked", "events", sql="""
WITH l AS (SELECT DISTINCT event_id % 400 AS case_id, user_id FROM events WHERE event_type = 'click'), e AS (SELECT event_id % 400 AS case_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS user_id FROM events WHERE event_type = 'error')
SELECT case_id, user_id, EXISTS (SELECT 1 FROM l o WHERE o.case_id = l.case_id AND o.user_id <> l.user_id) OR EXISTS (SELECT 1 FROM e WHERE e.case_id = l.case_id AND e.user_id IS DISTINCT FROM l.user_id) AS unlocked FROM l""")  # fmt: skip
def case_unlocked(e):
    """J6."""
    case = (F.col("event_id") % 400).alias("case_id")
    links = e.where("event_type = 'click'").select(case, "user_id").distinct()
    evidence = e.where("event_type = 'error'").select(case, F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("user_id"))
    return matching.case_unlocked(links, evidence)
