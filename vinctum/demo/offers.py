"""Queries of the rule detectors and of extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinctum.functions import json_schema
from vinctum.functions.json_schema import SOCIAL_RISK_EVENT
from vinctum.functions import detect as D
from vinctum.functions import vocab as V

from .views import Registry

Q = Registry()


def _re(p: str) -> str:
    return p.replace("'", "''")  # \b is ASCII there


def _found(x: str, ps: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '(?i){_re(p)}', 0), '')" for p in ps) + ", NULL)"


_SAL = r"(?i)(\$|mxn|pesos)?\s*(\d[\d.,]*)\s*(mil)?\s*(semanal|quincenal|mensual|al mes|por semana)?"
_S = lambda i: f"regexp_extract(text, '{_SAL}', {i})"
_NUM = f"(try_cast(regexp_replace({_S(2)}, '[,.]', '', 'g') AS DOUBLE) * CASE WHEN {_S(3)} <> '' THEN 1000 ELSE 1 END)"
_COMPUTED = {
    "salario_inusual": f"CASE WHEN NOT regexp_matches(text, '\\d') THEN NULL WHEN regexp_matches(text, '(?i)gana\\s+(lo\\s+que|cuanto|lo q)') THEN 'gana lo que quieras (vago)' WHEN regexp_matches(text, '(?i)semanal') AND {_NUM} >= 15000 THEN {_S(0)} || ' (semanal muy alto)' WHEN {_NUM} >= 60000 THEN {_S(0)} || ' (inusual)' END",
    "prestaciones_excesivas": f"CASE WHEN len(regexp_extract_all(text, '(?i){V.BENEFITS}')) >= 4 THEN len(regexp_extract_all(text, '(?i){V.BENEFITS}')) || ' prestaciones listadas' END",
    "contacto_otra_ciudad": "CASE WHEN contact_area <> offer_state THEN 'contacto ' || contact_area || ' vs oferta ' || offer_state END",
    "diseno_generico": "CASE WHEN has_image THEN '(imagen presente — requiere revisión)' END",
}
_EVID = {i: _COMPUTED[i] if ps is None else _found("concat_ws(' ', interview, text)" if i == "ubicacion_sospechosa" else "text", ps) for i, _, _, ps in V.SIGNALS}
_SIG = "sig AS (SELECT *, " + ", ".join(f"{e} AS s_{i}" for i, e in _EVID.items()) + " FROM v_posts)"
_SCORE = "least(100, " + " + ".join(f"CASE WHEN s_{i} IS NOT NULL THEN {V.SEVERITY[s]} ELSE 0 END" for i, _, s, _ in V.SIGNALS) + ")"
_N = " + ".join(f"CASE WHEN s_{i} IS NOT NULL THEN 1 ELSE 0 END" for i, _, _, _ in V.SIGNALS)
_IDS = "concat_ws(',', " + ", ".join(f"CASE WHEN s_{i} IS NOT NULL THEN '{i}' END" for i, _, _, _ in V.SIGNALS) + ")"
DET = f"{_SIG}, det AS (SELECT *, {_SCORE} AS score, {_N} AS n_hits, {_IDS} AS ids FROM sig), lev AS (SELECT *, CASE WHEN s_pide_dinero_documentos IS NOT NULL OR score >= 70 THEN 'CRÍTICO' WHEN score >= 45 THEN 'ALTO' WHEN score >= 20 THEN 'MEDIO' ELSE 'BAJO' END AS level FROM det)"
_LOC = r"trim(regexp_extract(text, '(?i)(?:en|ubicaci[oó]n|zona)\s+([A-ZÁÉÍÓÚÑ][A-Z0-9_áéíóúñ\s.,-]{2,80})', 1))"
_RECOMMENDED = "CASE level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (("CRÍTICO", "ALTO riesgo de reclutamiento forzado/fraude. No acudas sin verificar a la empresa en fuentes oficiales ni entregues documentos/dinero. Reporta a autoridades de búsqueda."), ("ALTO", "Múltiples señales de alerta. Verifica la empresa (Google Maps, RFC), desconfía de entrevistas en terminales/hoteles, ve acompañado y comparte tu ubicación."), ("MEDIO", "Algunas señales presentes. Confirma los datos de la empresa antes de aceptar."), ("BAJO", "Pocas o ninguna señal. Aplica las precauciones habituales al buscar empleo."))) + " END"


def detected(p):
    return D.offer_score(D.offer_signals(p, "text", "contact_area", "offer_state", "interview", "has_image"))


Q("offer_signals", "v_posts", sql=f"WITH {_SIG} SELECT doc_id, concat_ws('|', " + ", ".join(f"'{i}=' || s_{i}" for i, _, _, _ in V.SIGNALS) + ") AS hits FROM sig")(
    lambda p: detected(p).select("doc_id", F.array_join(F.transform("hits", lambda h: F.concat(h["id"], F.lit("="), h["evidence"])), "|").alias("hits")))
Q("offer_score", "v_posts", sql=f"WITH {DET} SELECT doc_id, score, level FROM lev")(lambda p: detected(p).select("doc_id", "score", "level"))
Q("extract_offer", "v_posts", sql=rf"""WITH {DET} SELECT doc_id, n_hits > 0 OR regexp_matches(text, '(?i)trabajo|empleo|vacante|contrataci[oó]n|sueldo') AS is_job_offer, substr(trim(regexp_extract(text, '(?i)(?:vacante|trabajo|empleo)\s+(?:de|para|como)?\s*([^\n.,;]+)', 1)), 1, 80) AS job_title,
  ids AS risk_signals, CASE WHEN score >= 45 THEN 'reclutamiento_forzado_o_fraude' ELSE 'sin_mecanismo_claro' END AS possible_mechanism, score / 100.0::DOUBLE AS confidence, CASE WHEN score >= 20 THEN 'restricted' ELSE 'internal' END AS privacy_level, score >= 20 AS needs_review, coalesce({_LOC}, '') AS location_text, {_RECOMMENDED} AS notes, trim({_S(0)}) AS salary_text,
  concat_ws(',', CASE WHEN regexp_matches(text, '(?i)whats?app|wa\.me') THEN 'whatsapp' END, CASE WHEN regexp_matches(text, '\b\d{{10}}\b') THEN 'telefono' END, CASE WHEN regexp_matches(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}') THEN 'email' END, CASE WHEN regexp_matches(text, '(?i)inbox|dm|mensaje directo') THEN 'dm' END) AS contacts FROM lev""")(
    lambda p: D.extract_offer(detected(p)).select("doc_id", "is_job_offer", "job_title", F.array_join("risk_signals", ",").alias("risk_signals"), "possible_mechanism", "confidence", "privacy_level", "needs_review", "location_text", "notes", "salary_text", F.array_join("contact_methods", ",").alias("contacts")))
Q("extract_risk_event", "v_posts", sql=f"WITH {DET} SELECT doc_id, CASE WHEN score >= 20 THEN 'oferta_laboral_sospechosa' ELSE 'otro' END AS event_type, CASE WHEN score = 0 THEN 0.3 ELSE score / 100.0 END::DOUBLE AS confidence, CASE WHEN n_hits > 0 THEN 'Oferta o reporte con ' || n_hits || ' senales de riesgo detectadas.' ELSE 'Reporte contextual sin senales suficientes.' END AS summary, coalesce({_LOC}, '') AS locality_approx FROM lev")(
    lambda p: D.extract_risk_event(detected(p)).select("doc_id", "event_type", "confidence", "summary", "locality_approx"))


@Q("merge_validation", "v_posts", sql=f"WITH {DET} SELECT doc_id, concat_ws(',', 'dado', nullif(ids, '')) AS risk_signals, greatest((doc_id % 10) / 10.0, score / 100.0)::DOUBLE AS confidence, CASE WHEN score >= 20 THEN 'restricted' ELSE 'public' END AS privacy_level, doc_id % 2 = 0 OR score >= 20 AS needs_review, CASE WHEN doc_id % 3 = 0 THEN 'nota propia' ELSE {_RECOMMENDED} END AS notes FROM lev")
def merge_validation(p):
    """R5."""
    given = detected(p).withColumns({"g_signals": F.array(F.lit("dado")), "g_confidence": F.col("doc_id") % 10 / F.lit(10.0), "g_privacy": F.lit("public"), "g_review": F.col("doc_id") % 2 == 0, "g_notes": F.when(F.col("doc_id") % 3 == 0, "nota propia").when(F.col("doc_id") % 3 == 1, "")})
    return D.merge_validation(given).select("doc_id", F.array_join("risk_signals", ",").alias("risk_signals"), "confidence", "privacy_level", "needs_review", "notes")


Q("keyword_event", "v_posts", sql=f"SELECT doc_id, n AS n_hits, CASE WHEN n >= 2 THEN 'oferta_laboral_sospechosa' ELSE 'otro' END AS event_type, round(least(0.3::DOUBLE + n * 0.1::DOUBLE, 0.8), 6) AS confidence, 2 AS severity FROM (SELECT doc_id, len(regexp_extract_all(text, '(?i){V.RISK_WORDS}'))::INT AS n FROM v_posts)")(
    lambda p: D.keyword_event(p, "text").select("doc_id", "n_hits", "event_type", F.round("confidence", 6).alias("confidence"), "severity"))


@Q("extraction_confidence", "v_personas", sql="""
SELECT id_victimadirecta AS id, c AS confidence, c < 0.4 OR k % 4 = 0 AS needs_review FROM (SELECT id_victimadirecta, k, floor(least(((nullif(sexo, '') IS NOT NULL)::INT + (edad IS NOT NULL)::INT + (nullif(sana_particular, '') IS NOT NULL)::INT + (nullif(estado, '') IS NOT NULL)::INT + (nullif(fecha_percato, '') IS NOT NULL)::INT + (fecha_hechos IS NOT NULL)::INT + (nullif(apellido, '') IS NOT NULL)::INT + (nullif(extranjero, '') IS NOT NULL)::INT) / 7.0::DOUBLE, 1) * 100 + 0.5) / 100 AS c FROM v_personas)""")  # fmt: skip
def extraction_confidence(p):
    """R7, with a kind derived from the key."""
    fields = ["sexo", "edad", "sana_particular", "estado", "fecha_percato", "fecha_hechos", "apellido", "extranjero"]
    out = D.extraction_confidence(p.withColumn("kind", F.when(F.col("k") % 4 == 0, "otro").otherwise("ficha")), fields, "kind")
    return out.select(F.col("id_victimadirecta").alias("id"), "confidence", "needs_review")


@Q("validate_offers", "v_posts", sql=f"WITH {DET} SELECT doc_id, concat_ws(',', CASE WHEN level NOT IN ('CRÍTICO', 'ALTO', 'MEDIO') THEN 'level: not allowed' END, CASE WHEN score < 10 THEN 'score: too small' END, CASE WHEN score > 90 THEN 'score: too large' END, CASE WHEN interview IS NULL THEN 'interview: required' END, 'author: unknown') AS violations FROM lev")
def validate_offers(p):
    """R8."""
    spec = {"doc_id": {"required": True}, "level": {"enum": ["CRÍTICO", "ALTO", "MEDIO"]}, "score": {"min": 10, "max": 90}, "interview": {"required": True}}
    out = D.validate(detected(p).select("doc_id", "level", "score", "interview", "author"), spec)
    return out.select("doc_id", F.array_join("violations", ",").alias("violations"))


def _json_rules(schema: dict) -> str:
    """The same rules in DuckDB's JSON functions, for flat schemas."""
    kinds = {"string": "'VARCHAR'", "boolean": "'BOOLEAN'", "number": "'DOUBLE', 'UBIGINT', 'BIGINT'"}
    out = []
    for name, rule in schema["properties"].items():
        x, kind = f"json_type(j, '$.{name}')", rule["type"]
        out += [f"CASE WHEN {x} IS NULL THEN '$.{name}: missing' END"] if name in schema["required"] else []
        out.append(f"CASE WHEN {x} NOT IN ({kinds.get(kind, repr(kind.upper()))}) THEN '$.{name}: not {kind}' END")
        if "enum" in rule:
            out.append(f"CASE WHEN {x} = 'VARCHAR' AND json_extract_string(j, '$.{name}') NOT IN ({', '.join(map(repr, rule['enum']))}) THEN '$.{name}: not allowed' END")
        if "maximum" in rule:
            out.append(f"CASE WHEN {x} IN ({kinds['number']}) AND try_cast(json_extract_string(j, '$.{name}') AS DOUBLE) > {rule['maximum']} THEN '$.{name}: too large' END")
    names = ", ".join(map(repr, schema["properties"]))
    return f"list_concat(list_filter([{', '.join(out)}], lambda v: v IS NOT NULL), list_transform(list_filter(json_keys(j), lambda k: k NOT IN ({names})), lambda k: '$.' || k || ': unknown'))"


@Q("validate_payloads", "v_payloads", sql=f"SELECT doc_id, array_to_string(list_sort(CASE WHEN json_valid(payload) THEN {_json_rules(SOCIAL_RISK_EVENT)} ELSE ['$: not JSON'] END), ',') AS violations FROM (SELECT doc_id, payload, CASE WHEN json_valid(payload) THEN payload END AS j FROM v_payloads)")
def validate_payloads(p):
    """R8 over JSON documents."""
    return p.select("doc_id", F.array_join(F.array_sort(json_schema.violations("payload", SOCIAL_RISK_EVENT)), ",").alias("violations"))


@Q("policy_gate", "v_requests", sql="""
SELECT id, reason IS NULL AS allowed, coalesce(reason, 'allowed by source policy') AS reason, CASE WHEN reason IS NULL AND NOT pii_requested THEN 'internal' ELSE 'restricted' END AS privacy_level, coalesce(retention_days, 30) AS retention_days FROM (SELECT *, CASE
 WHEN access_type = 'private_denied' THEN 'source is private or explicitly denied' WHEN access_type = 'unknown' AND mode <> 'discovery_search' THEN 'unknown sources require discovery review before acquisition'
 WHEN NOT list_contains(string_split(actions, ','), mode) THEN 'mode ''' || mode || ''' is not allowed for this source' WHEN pii_requested AND NOT pii_allowed THEN 'PII requested but source policy does not allow PII processing'
 WHEN pii_requested AND access_type IN ('authorized_group', 'submitted_by_family', 'submitted_by_partner') AND NOT has_consent THEN 'PII processing requires active consent for this source type'
 WHEN pii_requested AND coalesce(legal_basis, 'not_assessed') = 'not_assessed' THEN 'PII processing requires documented legal basis' END AS reason FROM v_requests)""")  # fmt: skip
def policy_gate(r):
    """R9."""
    return D.policy_gate(r.withColumn("allowed_actions", F.split("actions", ","))).select("id", "allowed", "reason", "privacy_level", "retention_days")
