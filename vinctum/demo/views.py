"""Domain views over the given tables, in SQL that Spark and DuckDB both run, and the decorator that registers queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")

V_RECORDS = """
with m as (select c_custkey k, n_name estado, min(o_orderdate) d
           from customer join nation on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by c_custkey, n_name),
r as (select concat('M', cast(k as varchar(20))) id, 'missing' record_type, k, estado, cast(d as date) event_date from m
      union all
      select concat('U', cast(s_suppkey as varchar(20))), 'unidentified', s_suppkey, n_name, date '1996-01-01' + cast((s_suppkey * 17) % 2000 as integer)
      from supplier join nation on s_nationkey = n_nationkey)
select id, record_type, case when k % 10 < 6 then 'M' when k % 10 < 9 then 'F' else null end sex,
  cast(16 + k % 50 as integer) age_min, cast(20 + k % 50 as integer) age_max, cast(155 + (k * 7) % 31 as integer) height_cm,
  case when k % 17 = 0 then null else estado end estado, case when k % 13 = 0 then null else event_date end event_date,
  concat(case k % 2 when 0 then 'tatuaje de ' else 'cicatriz de ' end,
    case k % 4 when 0 then 'ancla' when 1 then 'rosa' when 2 then 'cruz' else 'calavera' end, ' en ',
    case k % 3 when 0 then 'antebrazo ' when 1 then 'espalda ' else 'mano ' end,
    case k % 5 when 0 then '' when 1 then 'izquierdo' when 2 then 'izq' when 3 then 'derecho' else 'der' end,
    case when k % 6 = 0 then '; lunar en cuello' else '' end) raw_description
from r
"""

V_ADJACENT = "select a.n_name a, b.n_name b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey"

_MARK = """concat(case {k} % 2 when 0 then 'TATUAJE ' else 'CICATRIZ ' end, case {k} % 4 when 0 then 'ANCLA' when 1 then 'ROSA ROJA' when 2 then 'CRUZ' else 'CALAVERA' end,
  ' EN ', case {k} % 3 when 0 then 'ANTEBRAZO ' when 1 then 'ESPALDA ' else 'MANO ' end, case {k} % 5 when 0 then '' when 1 then 'IZQUIERDO' when 2 then 'LADO IZQ' when 3 then 'DERECHO' else 'LADO DER' end)"""

V_PERSONAS = f"""
select concat('P', cast(c_custkey as varchar(20))) id_victimadirecta, c_custkey k,
  case when c_custkey % 10 < 5 then 'HOMBRE' when c_custkey % 10 < 9 then 'Mujer' else '' end sexo,
  case when c_custkey % 19 = 0 then null else cast(16 + c_custkey % 50 as integer) end edad,
  case when c_custkey % 7 = 0 then 'NINGUNA' when c_custkey % 11 = 0 then ' ' when c_custkey % 23 = 0 then null
    else concat({_MARK.format(k='c_custkey')}, case when c_custkey % 6 = 0 then '<br>LUNAR EN CUELLO' else '' end) end sana_particular,
  concat('ESTATURA: ', case c_custkey % 5 when 0 then '165 CM' when 1 then '1.72' when 2 then '178' when 3 then '350' else '' end,
    '<br>COMPLEXIÓN: DELGADA<br>: SUELTO<br>OJOS:<br>SIN CLAVE<br>CABELLO: NEGRO: LACIO') media_filiacion,
  case when c_custkey % 29 = 0 then '' else n_name end estado,
  case c_custkey % 4 when 0 then concat(cast(1993 + c_custkey % 6 as varchar(4)), '-0', cast(1 + c_custkey % 9 as varchar(2)), '-1', cast(c_custkey % 10 as varchar(1)), 'T00:00:00')
    when 1 then concat(cast(1 + c_custkey % 28 as varchar(2)), '/', cast(1 + c_custkey % 12 as varchar(2)), '/', cast(1993 + c_custkey % 6 as varchar(4)))
    when 2 then '' else '2/30/1995' end fecha_percato,
  case when c_custkey % 3 = 0 then null else concat(cast(1992 + c_custkey % 7 as varchar(4)), '-05-', cast(10 + c_custkey % 19 as varchar(2))) end fecha_hechos,
  case c_custkey % 4 when 0 then 'SIN DATO' when 1 then ' SI ' when 2 then 'no' else '' end extranjero,
  concat(' ', cast(c_custkey % 60 as varchar(4)), case c_custkey % 3 when 0 then ' AÑOS' when 1 then '' else ' ' end) edad_texto,
  c_name nombre, case when c_custkey % 3 = 0 then '' else c_mktsegment end apellido, c_acctbal saldo
from customer join nation on c_nationkey = n_nationkey
"""

V_CUERPOS = f"""
select concat('C', cast(s_suppkey as varchar(20))) codigo, s_suppkey k,
  case when s_suppkey % 8 < 4 then 'HOMBRE' when s_suppkey % 8 < 7 then 'MUJER' else null end sexo,
  case when s_suppkey % 17 = 0 then null else cast(20 + s_suppkey % 40 as integer) end edad_min, cast(26 + s_suppkey % 40 as integer) edad_max,
  cast(case when s_suppkey % 9 = 0 then 20 else 155 + (s_suppkey * 7) % 31 end as integer) estatura_cm,
  case when s_suppkey % 10 = 0 then null else concat({_MARK.format(k='s_suppkey')}, case when s_suppkey % 4 = 0 then '<br>LUNAR EN CUELLO' else '' end) end sana_particular,
  n_name estado, concat(cast(1996 + s_suppkey % 4 as varchar(4)), '-07-', cast(10 + s_suppkey % 19 as varchar(2))) fecha_hallazgo,
  concat('ESTATURA: ', cast(155 + (s_suppkey * 7) % 31 as varchar(4))) media_filiacion
from supplier join nation on s_nationkey = n_nationkey
"""

V_REGISTRY = """
select concat('R', cast(o_orderkey as varchar(20))) id, o_orderkey k, o_orderstatus estatus, o_orderpriority origen,
  case o_custkey % 5 when 0 then 'HOMBRE' when 1 then 'HOMBRE' when 2 then 'MUJER' when 3 then 'MUJER' else 'INDETERMINADO' end sexo,
  n_name entidad, concat('MUN', cast(o_custkey % 40 as varchar(4))) municipio, cast(c_nationkey as varchar(4)) cve_ent,
  cast(o_orderdate as date) fecha, cast(o_orderdate as date) - cast((o_orderkey * 37) % 38000 as integer) nacimiento
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
"""

V_SITES = """
select n_nationkey k, n_name entidad, case when n_nationkey % 7 = 3 then null else 14.0 + n_nationkey * 0.71 end lat, case when n_nationkey % 7 = 3 then null else -117.0 + n_nationkey * 1.31 end lng,
  case n_nationkey % 4 when 0 then '3' when 1 then 'S/D' when 2 then '12' else ' 7' end fosas, case n_nationkey % 3 when 0 then '10' when 1 then '' else '4.5' end cuerpos, n_regionkey region
from nation
"""

V_POSTS = """
select doc_id, source author, text base, concat('https://posts.example.org/', cast(doc_id as varchar(20))) url,
  concat(text, chr(10), case doc_id % 8
    when 0 then 'Vacante de guardia de seguridad. Contratación inmediata sin experiencia. Sueldo $18000 semanal. Te mandamos Uber para entrevista en central de autobuses. Contacto por WhatsApp 5512345678.'
    when 1 then 'Buscamos ingeniero con experiencia, sueldo $22,000 mensual, en Guadalajara, Jalisco. Envía tu INE y paga cuota.'
    when 2 then 'Se busca gente para trabajar en el norte buen sueldo sin experiencia. Gana lo que quieras. Escribe a jefe@correo.example.com 3d'
    when 3 then 'Prestaciones, seguro social, Infonavit, vales y aguinaldo. Hotel Riu. TRÉBOL de la suerte, inicia hoy, 2w'
    when 4 then 'Casting de modelos, urgente, bitcoin y rendimiento. Uniforme incluido. Desde Monterrey 11h'
    when 5 then 'Trabajo de electricista en Colonia Roma Norte. Pago 70 mil. Telegram.'
    when 6 then 'Sin novedad.' else '' end) text,
  case when doc_id % 5 = 0 then '33' when doc_id % 5 = 1 then '55' else null end contact_area, case when doc_id % 3 = 0 then '33' else null end offer_state,
  case when doc_id % 9 = 0 then 'casa particular' else null end interview, doc_id % 6 = 0 has_image
from documents
"""

V_PAYLOADS = """
select doc_id, concat('{"event_type":', case doc_id % 4 when 0 then '"otro"' when 1 then '"robo"' when 2 then '["otro"]' else '"trata_enganche"' end, ',"estado":', case doc_id % 5 when 0 then '7' when 1 then 'null' else concat('"', source, '"') end,
  case when doc_id % 3 = 0 then '' else ',"municipio":"M"' end, ',"confidence":', case when doc_id % 13 = 0 then '"0.5"' else concat('0.', cast(doc_id % 90 as varchar(4)), case when doc_id % 6 = 1 then 'e1' else '' end) end,
  ',"privacy_level":"', case when doc_id % 8 = 0 then 'public' else 'internal' end, '"', case when doc_id % 7 = 0 then ',"extra":{"a":[1]},"z":1' else '' end, case when doc_id % 9 = 0 then ',"needs_human_review":"yes"' else '' end, case when doc_id % 11 = 0 then '' else '}' end) payload
from documents
"""

V_ARTIFACTS = """
select page_id id, concat('run', cast(page_id % 5 as varchar(4))) run_id, concat('c', cast(page_id % 20 as varchar(4))) consent_id, url, html,
  date '2024-01-01' + cast(page_id % 90 as integer) fetched, cast(10 + page_id % 40 as integer) retention_days, case when page_id % 7 = 0 then date '2024-03-01' else null end purged
from pages
"""
V_JOBS = "select page_id id, page_id artifact, case page_id % 3 when 0 then 'done' when 1 then 'queued' else 'failed' end status, (page_id % 100) / 100.0 confidence from pages"
V_EVENTS = """
select page_id id, page_id artifact, case page_id % 4 when 0 then 'oferta' when 1 then 'otro' when 2 then 'trata' else 'balacera' end kind, concat('E', cast(page_id % 6 as varchar(4))) estado,
  concat('MUN', cast(page_id % 11 as varchar(4))) municipio, (page_id % 100) / 100.0 confidence, case when page_id % 9 = 0 then 'hidden' when page_id % 2 = 0 then 'approved' else 'pending' end review, case when page_id % 5 = 0 then 'restricted' else 'public' end privacy
from pages where page_id % 3 = 0
"""
V_LINEAGE = "select page_id - page_id % 3 event, page_id artifact, case when page_id % 2 = 0 then 'primary' else 'support' end role from pages where page_id % 7 = 0"
V_CONSENTS = """
select distinct concat('c', cast(page_id % 20 as varchar(4))) id, concat('run', cast(page_id % 5 as varchar(4))) source, date '2023-06-01' + cast(page_id % 20 as integer) granted,
  case when page_id % 4 = 0 then null else date '2024-01-15' + cast(page_id % 20 as integer) end expires, cast(null as date) revoked from pages
"""
V_REQUESTS = """
select event_id id, case event_id % 5 when 0 then 'public' when 1 then 'unknown' when 2 then 'authorized_group' when 3 then 'private_denied' else 'submitted_by_family' end access_type,
  case event_id % 3 when 0 then 'scrape' when 1 then 'discovery_search' else 'monitor' end mode, case when event_id % 4 = 0 then 'scrape' else 'scrape,discovery_search' end actions,
  event_id % 2 = 0 pii_requested, event_id % 7 <> 0 pii_allowed, event_id % 3 = 0 has_consent, case event_id % 6 when 0 then null when 1 then 'not_assessed' else 'interest' end legal_basis,
  case when event_id % 8 = 0 then cast(90 as integer) else null end retention_days
from events
"""

VIEWS = {k.lower(): v for k, v in list(globals().items()) if k.startswith("V_")}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over the given tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\b(?:from|join)\s+{t}\b", sql)]
    sql = sql.replace("{", "{{").replace("}", "}}")
    text = re.sub(rf"\b(from|join)\s+({'|'.join(used)})\b", r"\1 {\2}", sql)
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in used})


def with_views(body: str) -> str:
    """DuckDB SQL: the views that the body names, then the body, which starts with SELECT or with further named queries and a comma-free head."""
    names = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    heads = [f"{v} AS ({VIEWS[v]})" for v in names]
    if not heads:
        return body
    if m := re.match(r"\s*WITH(\s+RECURSIVE)?\b", body, re.I):
        return re.sub(r"^\s*WITH(\s+RECURSIVE)?\b", f"WITH{m[1] or ''} " + ",\n".join(heads).replace("\\", "\\\\") + ",", body, count=1, flags=re.I)
    return "WITH " + ",\n".join(heads) + "\n" + body


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, *inputs: str, sql: str | None = None):
        """Register fn(*input DataFrames) -> DataFrame under a name, with the SQL that gives the same rows."""

        def add(fn):
            self.queries[name] = lambda spark, sf_dir: fn(*[load(spark, sf_dir, i) for i in inputs])
            if sql:
                self.oracles[name] = with_views(sql)
            return fn

        return add
