"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinctum.functions import clean as C
from vinctum.functions.vocab import STATE_REPAIRS
from vinctum.operators import aggregate as A
from vinctum.operators import matching, ranking

from .views import Registry

Q = Registry()
_AGE = "CASE WHEN a BETWEEN 0 AND 100 THEN a END"
AGED = f"aged AS (SELECT *, {_AGE} AS age FROM (SELECT *, (year(fecha) - year(nacimiento) - CASE WHEN strftime(fecha, '%m%d') < strftime(nacimiento, '%m%d') THEN 1 ELSE 0 END)::INT AS a FROM v_registry))"


def aged(r):
    return r.withColumn("age", C.age_at("nacimiento", "fecha"))


Q("counts_by_status", "v_registry", sql="SELECT estatus, origen, count(*) AS n FROM v_registry GROUP BY ALL")(lambda r: A.counts(r, "estatus", "origen"))
Q("registry_totals", "v_registry", sql="SELECT count(*) AS n, count(*) FILTER (estatus IN ('O', 'P')) AS n_open, count(DISTINCT origen) AS n_sources FROM v_registry")(lambda r: A.totals(r, "estatus", ["O", "P"], "origen"))
Q("counts_by_year", "v_registry", sql="SELECT entidad, sexo, CASE WHEN year(fecha) BETWEEN 1960 AND 2026 THEN year(fecha) END::INT AS year, count(*) AS n FROM v_registry WHERE sexo IN ('HOMBRE', 'MUJER') GROUP BY ALL")(
    lambda r: A.counts(r.where("sexo IN ('HOMBRE', 'MUJER')").withColumn("year", C.year_of(F.col("fecha").cast("string"), 1960, 2026)), "entidad", "sexo", "year"))
_YR = "CASE WHEN year(fecha) BETWEEN 1960 AND 2026 THEN year(fecha) END::INT"


@Q("counts_by_level", "v_registry", sql=f"""WITH x AS (SELECT CASE WHEN sexo IN ('HOMBRE', 'MUJER') THEN sexo END AS sexo, {_YR} AS year, entidad FROM v_registry)
SELECT CASE WHEN g = 3 THEN 0 WHEN g = 5 THEN 1 WHEN g = 6 THEN 2 ELSE 3 END::INT AS level, sexo, year, entidad, n FROM (
SELECT grouping(sexo) * 4 + grouping(year) * 2 + grouping(entidad) AS g, sexo, year, entidad, count(*) AS n FROM x GROUP BY GROUPING SETS ((sexo), (year), (entidad), (entidad, year)))
WHERE (grouping_has(g, 4) OR sexo IS NOT NULL) AND (grouping_has(g, 2) OR year IS NOT NULL) AND (grouping_has(g, 1) OR entidad IS NOT NULL)""".replace("grouping_has(g, 4)", "(g & 4) > 0").replace("grouping_has(g, 2)", "(g & 2) > 0").replace("grouping_has(g, 1)", "(g & 1) > 0"))  # fmt: skip
def counts_by_level(r):
    """A2: by sex, by year, by state, and by state and year, in one pass."""
    x = r.select(F.when(F.col("sexo").isin("HOMBRE", "MUJER"), F.col("sexo")).alias("sexo"), C.year_of(F.col("fecha").cast("string"), 1960, 2026).alias("year"), "entidad")
    return A.grouped_counts(x, [("sexo",), ("year",), ("entidad",), ("entidad", "year")])


Q("peak_year", "v_registry", sql="SELECT year(fecha)::INT AS year, count(*) AS n FROM v_registry GROUP BY ALL ORDER BY n DESC, year LIMIT 1")(lambda r: A.argmax(r.withColumn("year", F.year("fecha")), "year"))
Q("top_sources", "v_registry", sql="SELECT entidad, count(*) AS n FROM v_registry GROUP BY ALL ORDER BY n DESC, entidad LIMIT 8")(lambda r: A.top_counts(r, "entidad", 8))
Q("age_sex_matrix", "v_registry", sql=f"WITH {AGED} SELECT CASE WHEN age < 18 THEN '0-17' WHEN age < 30 THEN '18-29' WHEN age < 45 THEN '30-44' WHEN age < 60 THEN '45-59' ELSE '60+' END AS bucket, count(*) FILTER (sexo = 'HOMBRE') AS hombre, count(*) FILTER (sexo = 'MUJER') AS mujer, count(*) FILTER (sexo NOT IN ('HOMBRE', 'MUJER')) AS noinfo FROM aged WHERE age IS NOT NULL GROUP BY ALL")(
    lambda r: A.age_sex(aged(r).withColumn("b", C.age_bucket("age")), "b", "sexo"))
Q("age_stats", "v_registry", sql=f"WITH {AGED}, o AS (SELECT age, row_number() OVER (ORDER BY age) AS i, count(*) OVER () AS n FROM aged WHERE age IS NOT NULL) SELECT floor(avg(age) * 10 + 0.5) / 10 AS mean, min(age) FILTER (i = n // 2 + 1) AS median, floor(stddev_pop(age) * 10 + 0.5) / 10 AS std FROM o")(lambda r: A.age_stats(aged(r), "age"))
Q("state_shares", "v_registry", sql="SELECT entidad, floor(n / sum(n) OVER () * 10000 + 0.5) / 10000 AS share FROM (SELECT entidad, count(*) AS n FROM v_registry GROUP BY ALL ORDER BY n DESC, entidad LIMIT 6)")(lambda r: A.shares(r, "entidad", 6))
Q("site_totals", "v_sites", sql="SELECT count(*) AS n_sites, sum(CASE WHEN regexp_matches(trim(fosas), '^[0-9]+$') THEN trim(fosas)::INT ELSE 0 END)::BIGINT AS fosas, sum(CASE WHEN regexp_matches(trim(cuerpos), '^[0-9]+$') THEN trim(cuerpos)::INT ELSE 0 END)::BIGINT AS cuerpos FROM v_sites")(lambda s: A.site_totals(s, "fosas", "cuerpos"))
_REP = "upper(trim(n_name))"
for _a, _b in STATE_REPAIRS:
    _REP = f"replace({_REP}, '{_a}', '{_b}')"
Q("population_by_state", "customer", "nation", sql=f"SELECT {_REP} AS estado, sum(c_custkey) AS population FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")(
    lambda c, n: A.population_by_state(c.join(n, c["c_nationkey"] == n["n_nationkey"]), "n_name", "c_custkey"))


@Q("per_capita", "v_registry", "customer", "nation", sql="""
SELECT entidad, n, population, CASE WHEN population > 0 THEN floor(n * 100000::DOUBLE / population * 10 + 0.5) / 10 END AS rate FROM (SELECT entidad, count(*) AS n FROM v_registry GROUP BY ALL)
LEFT JOIN (SELECT n_name AS entidad, sum(CASE WHEN n_nationkey % 6 = 0 THEN 0 ELSE c_custkey END)::BIGINT AS population FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 5 <> 0 GROUP BY ALL) USING (entidad)""")  # fmt: skip
def per_capita(r, c, n):
    """States without people, and without an entry, have no rate."""
    pop = c.join(n, c["c_nationkey"] == n["n_nationkey"]).where("n_nationkey % 5 <> 0").groupBy(F.col("n_name").alias("entidad")).agg(F.sum(F.when(F.col("n_nationkey") % 6 == 0, 0).otherwise(F.col("c_custkey"))).alias("population"))
    return matching.per_capita(A.counts(r, "entidad"), pop, "entidad")


Q("recency_buckets", "events", sql="""SELECT event_id, least(floor(ratio * 20), 19)::INT AS bucket FROM (SELECT event_id, ln((epoch(ts)::BIGINT - epoch(lo)::BIGINT) / 86400.0::DOUBLE + 1) / ln((epoch(hi)::BIGINT - epoch(lo)::BIGINT) / 86400.0::DOUBLE + 1) AS ratio FROM (SELECT event_id, date_trunc('second', ts) AS ts, date_trunc('second', min(ts) OVER ()) AS lo, date_trunc('second', max(ts) OVER ()) AS hi FROM events))""")(
    lambda e: A.recency_bucket(e.select("event_id", F.date_trunc("second", "ts").alias("ts")), "ts").select("event_id", "bucket"))
Q("site_grid", "v_sites", sql="SELECT floor(lat / 2.5::DOUBLE)::BIGINT AS cell_y, floor(lng / 2.5::DOUBLE)::BIGINT AS cell_x, count(*) AS n, round(avg(k), 6) AS mean FROM v_sites WHERE lat IS NOT NULL GROUP BY ALL")(
    lambda s: A.grid(s.withColumns({"lat": F.col("lat").cast("double"), "lng": F.col("lng").cast("double")}), 2.5, "k").withColumn("mean", F.round("mean", 6)))
Q("run_summary", "v_personas", sql="SELECT sexo, count(*) AS n, count(*) FILTER (edad IS NOT NULL) AS n_edad, count(*) FILTER (estado <> '') AS n_estado, count(*) FILTER (sana_particular <> '') AS n_sana_particular FROM v_personas GROUP BY sexo")(lambda p: A.run_summary(p, "sexo", ["edad", "estado", "sana_particular"]))
Q("k_anonymity", "v_registry", sql="SELECT entidad, municipio, sexo, count(*) AS n FROM v_registry GROUP BY ALL HAVING count(*) >= 12")(lambda r: A.k_anonymous(A.counts(r, "entidad", "municipio", "sexo"), "n", 12))
Q("coordinates", "v_sites", sql="SELECT (SELECT count(*) FROM v_sites WHERE lat IS NOT NULL) AS n_sites, (SELECT count(*) FROM v_sites WHERE lat BETWEEN 15 AND 25 AND lng BETWEEN -110 AND -90) AS n_box")(
    lambda s: A.with_coords(s).agg(F.count(F.lit(1)).alias("n_sites")).join(F.broadcast(A.count_in_box(s, 15, -110, 25, -90).withColumnRenamed("n", "n_box"))))
Q("last_points", "v_registry", sql="SELECT entidad, year, n FROM (SELECT entidad, year(fecha)::INT AS year, count(*) AS n FROM v_registry GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY entidad ORDER BY year DESC) <= 10")(
    lambda r: ranking.last_n_per(A.counts(r.withColumn("year", F.year("fecha")), "entidad", "year"), "entidad", "year", 10))
Q("latest_event", "events", sql="SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")(lambda e: ranking.latest_per(e, "user_id", "ts", "event_id").select("user_id", "event_id"))
Q("newest_events", "events", sql="SELECT event_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS unread FROM events ORDER BY ts DESC, event_id LIMIT 50")(
    lambda e: ranking.newest(e, "ts", 50, "event_id").select("event_id").join(F.broadcast(e.agg(F.count_if(F.col("event_type") == "error").alias("unread")))))
Q("legend", "v_registry", sql="SELECT estatus, count(*) AS n FROM v_registry GROUP BY ALL")(lambda r: A.counts(r, "estatus"))
