"""Queries of the cleaning functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinctum.functions import clean as C
from vinctum.functions.vocab import STATE_REPAIRS

from .views import Registry

Q = Registry()
_P = "CASE WHEN regexp_matches({t}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(substr({t}, 1, 10) AS DATE) WHEN regexp_matches({t}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN CASE WHEN regexp_extract({t}, '^(\\d{{1,2}})/(\\d{{1,2}})/(\\d{{4}})', 1)::INT > 12 THEN try_strptime(regexp_extract({t}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}'), '%d/%m/%Y')::DATE ELSE try_strptime(regexp_extract({t}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}'), '%m/%d/%Y')::DATE END END"


def flex_date_sql(t: str) -> str:
    return _P.format(t=f"trim({t})")


@Q("clean_fields", "v_personas", sql=r"""
SELECT id_victimadirecta, CASE WHEN trim(extranjero) NOT IN ('', 'SIN DATO') THEN trim(extranjero) END AS cleaned,
  CASE upper(trim(extranjero)) WHEN 'SI' THEN true WHEN 'NO' THEN false END AS flag,
  CASE WHEN regexp_matches(trim(edad_texto), '^[+-]?[0-9]+$') THEN trim(edad_texto)::INT END AS as_int,
  try_cast(nullif(regexp_replace(edad_texto, '[^0-9]', '', 'g'), '') AS INT) AS digits,
  CASE WHEN regexp_matches(fecha_percato, '^\s*\d{1,2}/\d{1,2}/\d{4}\s*$') THEN split_part(trim(fecha_percato), '/', 3) || '-' || lpad(split_part(trim(fecha_percato), '/', 2), 2, '0') || '-' || lpad(split_part(trim(fecha_percato), '/', 1), 2, '0') END AS dmy
FROM v_personas""")  # fmt: skip
def clean_fields(p):
    """C1-C5."""
    return p.select("id_victimadirecta", C.clean("extranjero").alias("cleaned"), C.to_bool("extranjero").alias("flag"), C.to_int("edad_texto").alias("as_int"), C.digits_int("edad_texto").alias("digits"), C.parse_dmy("fecha_percato").alias("dmy"))


@Q("clean_dates", "v_personas", sql=f"""
SELECT id_victimadirecta, {flex_date_sql('fecha_percato')} AS flex, CASE WHEN try_cast(nullif(regexp_extract(fecha_hechos, '^(\\d{{4}})', 1), '') AS INT) BETWEEN 1994 AND 1996 THEN regexp_extract(fecha_hechos, '^(\\d{{4}})', 1)::INT END AS year FROM v_personas""")  # fmt: skip
def clean_dates(p):
    """C6, C7."""
    return p.select("id_victimadirecta", C.parse_flex_date("fecha_percato").alias("flex"), C.year_of("fecha_hechos", 1994, 1996).alias("year"))


@Q("age_at_event", "v_registry", sql="""
SELECT id, age, CASE WHEN age < 18 THEN '0-17' WHEN age < 30 THEN '18-29' WHEN age < 45 THEN '30-44' WHEN age < 60 THEN '45-59' WHEN age IS NOT NULL THEN '60+' END AS bucket
FROM (SELECT id, CASE WHEN a BETWEEN 0 AND 100 THEN a END AS age FROM (SELECT id, (year(fecha) - year(nacimiento) - CASE WHEN strftime(fecha, '%m%d') < strftime(nacimiento, '%m%d') THEN 1 ELSE 0 END)::INT AS a FROM v_registry))""")  # fmt: skip
def age_at_event(r):
    """C8, C9."""
    age = C.age_at("nacimiento", "fecha")
    return r.select("id", age.alias("age"), C.age_bucket(age).alias("bucket"))


_REPAIRED = "upper(trim(translate(n_name, 'e', 'E')))"
for _a, _b in STATE_REPAIRS:
    _REPAIRED = f"replace({_REPAIRED}, '{_a}', '{_b}')"


@Q("map_sex_state", "v_personas", "nation", sql=f"""
SELECT id_victimadirecta AS id, CASE WHEN regexp_matches(sexo, '(?i)hombre|masculino') THEN 'M' WHEN regexp_matches(sexo, '(?i)mujer|femenino') THEN 'F' WHEN sexo <> '' THEN 'X' END AS sex,
  CASE WHEN lower(trim(sexo)) IN ('hombre', 'masculino', 'm') THEN 'M' WHEN lower(trim(sexo)) IN ('mujer', 'femenino', 'f') THEN 'F' END AS strict, estado_r AS repaired
FROM v_personas LEFT JOIN (SELECT n_name, {_REPAIRED} AS estado_r FROM nation) ON n_name = estado""")  # fmt: skip
def map_sex_state(p, n):
    """C10, C11."""
    repaired = n.select(F.col("n_name").alias("estado"), C.repair_state("n_name").alias("repaired"))
    return p.join(repaired, "estado", "left").select(F.col("id_victimadirecta").alias("id"), C.map_sex("sexo").alias("sex"), C.map_sex("sexo", strict=True).alias("strict"), "repaired")


_MARKS = "list_filter(list_transform(string_split(coalesce(sana_particular, ''), '<br>'), lambda x: trim(x)), lambda x: x <> '' AND upper(x) <> 'NINGUNA')"


@Q("parse_marks_and_heights", "v_personas", sql=f"""
SELECT id_victimadirecta, array_to_string({_MARKS}, '|') AS marks, CASE WHEN h BETWEEN 50 AND 230 THEN h END AS height_b,
  try_cast(nullif(regexp_extract(media_filiacion, '[Ee]statura[:\\s]*(\\d{{3}})\\s*cm', 1), '') AS INT) AS height_a
FROM (SELECT *, try_cast(nullif(regexp_extract(regexp_extract(media_filiacion, 'ESTATURA:\\s*([\\d.,]+)', 1), '(\\d{{2,3}})', 1), '') AS INT) AS h FROM v_personas)""")  # fmt: skip
def parse_marks_and_heights(p):
    """C12, C14."""
    return p.select("id_victimadirecta", F.array_join(C.parse_marks("sana_particular"), "|").alias("marks"), C.height_cm("media_filiacion", "b").alias("height_b"), C.height_cm("media_filiacion", "a").alias("height_a"))


@Q("parse_attributes", "v_personas", sql="""
WITH parts AS (SELECT id_victimadirecta AS id, unnest(string_split(media_filiacion, '<br>')) AS p, generate_subscripts(string_split(media_filiacion, '<br>'), 1) AS i FROM v_personas),
kv AS (SELECT id, i, trim(split_part(p, ':', 1)) AS k, trim(substr(p, strpos(p, ':') + 1)) AS v FROM parts WHERE contains(p, ':') AND trim(split_part(p, ':', 1)) <> '')
SELECT id, string_agg(k || '=' || v, '|' ORDER BY k) AS attributes, count(*) FILTER (v <> '') AS n_filled FROM (SELECT * FROM kv QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY i DESC) = 1) GROUP BY id""")  # fmt: skip
def parse_attributes(p):
    """C13."""
    kept = F.array_sort(F.transform(F.map_entries(C.parse_kv("media_filiacion")), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return p.select(F.col("id_victimadirecta").alias("id"), F.array_join(kept, "|").alias("attributes"), F.size(C.parse_kv("media_filiacion", drop_empty=True)).cast("long").alias("n_filled"))


@Q("to_record", "v_personas", sql=f"""
SELECT 'persona-' || id_victimadirecta AS id, 'missing' AS record_type, CASE WHEN regexp_matches(sexo, '(?i)hombre|masculino') THEN 'M' WHEN regexp_matches(sexo, '(?i)mujer|femenino') THEN 'F' WHEN sexo <> '' THEN 'X' END AS sex,
  edad AS age_min, edad AS age_max, CASE WHEN h BETWEEN 50 AND 230 THEN h END AS height_cm, nullif(estado, '') AS estado, coalesce(nullif(fecha_hechos, ''), nullif(fecha_percato, '')) AS event_date, array_to_string({_MARKS}, '; ') AS raw_description
FROM (SELECT *, try_cast(nullif(regexp_extract(regexp_extract(media_filiacion, 'ESTATURA:\\s*([\\d.,]+)', 1), '(\\d{{2,3}})', 1), '') AS INT) AS h FROM v_personas)""")  # fmt: skip
def to_record(p):
    """C15."""
    return C.to_record(p)


@Q("flatten_notice", "v_personas", sql="""
SELECT 'img' || k AS image, CASE WHEN k % 4 = 0 THEN 'otro' ELSE 'ficha' END AS kind, CASE WHEN k % 8 = 0 THEN '' ELSE nombre END AS nombre, 'mexicana' AS nacionalidad,
  CASE WHEN k % 3 = 0 THEN 0.0 ELSE (k % 10) / 10.0 END::DOUBLE AS confianza, CASE WHEN k % 5 = 0 THEN false ELSE true END AS requiere_revision, CASE WHEN k % 2 = 0 THEN 'https://p.example.org/' || k END AS permalink, CASE WHEN k % 2 = 0 THEN estado END AS author
FROM v_personas WHERE NOT (k % 4 = 0 AND k % 8 = 0)""")  # fmt: skip
def flatten_notice(p):
    """C16."""
    notice = F.struct(F.when(F.col("k") % 4 == 0, "otro").otherwise("ficha").alias("kind"), F.when(F.col("k") % 8 == 0, "").otherwise(F.col("nombre")).alias("name"), F.lit(None).cast("string").alias("nationality"), F.when(F.col("k") % 3 != 0, (F.col("k") % 10) / 10.0).alias("confidence"), F.when(F.col("k") % 5 == 0, False).alias("review"))
    image = F.concat(F.lit("img"), "k").alias("image")
    posts = p.where("k % 2 = 0").select(image, F.concat(F.lit("https://p.example.org/"), "k").alias("permalink"), F.col("estado").alias("author"))
    return C.flatten_notice(p.select(image, notice.alias("notice")), posts)


@Q("display_detail", "v_personas", sql=f"""
SELECT id_victimadirecta, coalesce(nullif(concat_ws(' ', nullif(trim(nombre), ''), nullif(trim(apellido), '')), ''), 'Sin nombre') AS name, len({_MARKS})::BIGINT AS n_marks, id_victimadirecta || '|' || coalesce(edad::VARCHAR, '') AS key FROM v_personas""")  # fmt: skip
def display_detail(p):
    """C17, C18, K9."""
    named = p.select("id_victimadirecta", C.display_name("nombre", "apellido").alias("name"), C.record_key("id_victimadirecta", "edad").alias("key"))
    return named.join(C.detail(p).select("id_victimadirecta", F.size("marks").cast("long").alias("n_marks")), "id_victimadirecta")
