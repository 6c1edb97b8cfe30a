"""Queries of both matchers and of ranking and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinctum.functions import text as T
from vinctum.functions import vocab as V
from vinctum.operators import evaluation, kinds
from vinctum.operators import personas as B
from vinctum.operators import ranking
from vinctum.operators import records as A
from vinctum.plans import link
from vinctum.plans.config import MatchConfig

from .cleaning import flex_date_sql
from .views import Registry

Q = Registry()


def case_sql(x: str, table, default: str | None = None) -> str:
    arms = " ".join("WHEN regexp_matches({}, '(?i){}') THEN '{}'".format(x, p.replace("'", "''"), v) for p, v in table)
    return f"CASE {arms} ELSE {repr(default) if default else 'NULL'} END"


def tokens_sql(x: str) -> str:
    stops = ", ".join(f"'{w}'" for w in V.STOP_A)
    return f"list_filter(string_split_regex(regexp_replace(strip_accents(lower({x})), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: length(w) > 1 AND w NOT IN ({stops}))"


FEATS = f"""seg AS (SELECT id AS record_id, unnest(list_filter(list_transform(string_split_regex(raw_description, '[;,\\n]'), lambda x: trim(x)), lambda x: x <> '')) AS description_raw, generate_subscripts(list_filter(list_transform(string_split_regex(raw_description, '[;,\\n]'), lambda x: trim(x)), lambda x: x <> ''), 1) - 1 AS place FROM v_records),
cls AS (SELECT *, {case_sql('description_raw', V.TYPES, 'otra_sena')} AS feature_type, {case_sql('description_raw', V.REGIONS, 'generico')} AS body_region, {case_sql('description_raw', V.SIDES, 'na')} AS laterality, {case_sql('description_raw', V.MOTIFS)} AS motif_category FROM seg),
feats AS (SELECT *, {tokens_sql("concat_ws(' ', description_raw, body_region, laterality, motif_category)")} AS tokens FROM cls)"""

ADJ = "adj AS (SELECT a, b FROM v_adjacent UNION SELECT b, a FROM v_adjacent UNION SELECT a, a FROM v_adjacent UNION SELECT b, b FROM v_adjacent)"
PAIRS = """m AS (SELECT id, sex, age_min, age_max, nullif(height_cm, 0) AS height_cm, estado, event_date FROM v_records WHERE record_type = 'missing'),
u AS (SELECT id, sex, age_min, age_max, nullif(height_cm, 0) AS height_cm, estado, event_date FROM v_records WHERE record_type = 'unidentified'),
pairs AS (SELECT m.id AS m_id, u.id AS u_id, m.sex AS m_sex, u.sex AS u_sex, m.age_min AS m_lo, m.age_max AS m_hi, u.age_min AS u_lo, u.age_max AS u_hi, m.height_cm AS m_h, u.height_cm AS u_h, m.estado AS m_e, u.estado AS u_e, m.event_date AS m_d, u.event_date AS u_d
 FROM m, u WHERE (m.estado IS NULL OR u.estado IS NULL OR m.estado = u.estado OR (m.estado, u.estado) IN (SELECT (a, b) FROM adj)) AND (m.sex IS NULL OR u.sex IS NULL OR m.sex = u.sex)
 AND (m.age_max >= u.age_min - 3 AND m.age_min <= u.age_max + 3) AND (m.event_date IS NULL OR u.event_date IS NULL OR m.event_date <= u.event_date))"""

_CL = "CASE " + " ".join(f"WHEN {{x}} IN ({', '.join(repr(r) for r in rs)}) THEN '{k}'" for k, rs in V.CLUSTERS.items()) + " END"
_R2 = "floor(({x}) * 100 + 0.5) / 100"
SCORED = f"""fp AS (SELECT m_id, u_id, a.place AS place, a.laterality AS la, b.laterality AS lb, a.body_region AS ra, b.body_region AS rb, a.motif_category AS ma, b.motif_category AS mb, list_distinct(a.tokens) AS ta, list_distinct(b.tokens) AS tb FROM pairs JOIN feats a ON a.record_id = m_id JOIN feats b ON b.record_id = u_id AND a.feature_type = b.feature_type),
fs AS (SELECT m_id, u_id, place, (la = 'izquierda' AND lb = 'derecha') OR (la = 'derecha' AND lb = 'izquierda') AS conflict,
  CASE WHEN ra = 'generico' OR rb = 'generico' OR ra = rb OR ({_CL.format(x='ra')}) = ({_CL.format(x='rb')}) THEN least(0.4::DOUBLE + CASE WHEN ra = rb THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN ma = mb THEN 0.25::DOUBLE ELSE 0 END + 0.2::DOUBLE * CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(list_concat(ta, tb))) ELSE 0 END, 0.99::DOUBLE) END AS s FROM fp),
per AS (SELECT m_id, u_id, place, coalesce(max(CASE WHEN NOT conflict THEN s END), 0) AS best, bool_or(conflict) AS conflict FROM fs GROUP BY ALL),
mk AS (SELECT m_id, u_id, max(best) AS best, bool_or(conflict AND best = 0) AS opposite FROM per GROUP BY ALL),
fld AS (SELECT pairs.*, coalesce(best, 0) AS best, coalesce(opposite, false) AS opposite, CASE WHEN opposite THEN 0.05::DOUBLE ELSE {_R2.format(x='coalesce(best, 0)')} END AS s_marks,
  abs(m_h - u_h) AS dh, abs((m_lo + m_hi) / 2.0 - (u_lo + u_hi) / 2.0)::DOUBLE AS da FROM pairs LEFT JOIN mk USING (m_id, u_id)),
f2 AS (SELECT *, CASE WHEN dh <= 2 THEN 1.0 WHEN dh <= 5 THEN 0.7 WHEN dh <= 8 THEN 0.4 WHEN dh IS NOT NULL THEN 0.1 END::DOUBLE AS s_height, CASE WHEN da <= 3 THEN 1.0 WHEN da <= 8 THEN 0.7 WHEN da <= 15 THEN 0.35 ELSE 0.05 END::DOUBLE AS s_age,
  CASE WHEN m_d <= u_d THEN 1.0 WHEN m_d > u_d THEN 0.0 END::DOUBLE AS s_temporal, CASE WHEN m_e = u_e THEN 1.0 WHEN m_e IS NOT NULL AND u_e IS NOT NULL THEN 0.5 ELSE 0.3 END::DOUBLE AS s_geo FROM fld),
f3 AS (SELECT *, opposite OR coalesce(s_temporal, 1) = 0 OR da > 12 AS hard,
  (0.0::DOUBLE + s_marks * 0.45::DOUBLE + coalesce(s_height, 0) * 0.12::DOUBLE + s_age * 0.13::DOUBLE + coalesce(s_temporal, 0) * 0.15::DOUBLE + s_geo * 0.15::DOUBLE) / (0.0::DOUBLE + 0.45::DOUBLE + CASE WHEN s_height IS NOT NULL THEN 0.12::DOUBLE ELSE 0 END + 0.13::DOUBLE + CASE WHEN s_temporal IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + 0.15::DOUBLE) AS raw FROM f2),
scored AS (SELECT *, CASE WHEN hard THEN least({_R2.format(x='raw')}, 0.2) ELSE {_R2.format(x='raw')} END AS overall_score FROM f3),
tiered AS (SELECT *, CASE WHEN hard THEN 'baja' WHEN overall_score >= 0.75 THEN 'alta' WHEN overall_score >= 0.5 THEN 'media' ELSE 'baja' END AS tier FROM scored)"""
ALL_A = f"WITH {ADJ}, {FEATS}, {PAIRS}, {SCORED}"
CANDS = f"{ALL_A}, cands AS (SELECT m_id || '-' || u_id AS id, m_id AS persona, u_id AS cuerpo, overall_score AS score, tier, m_e AS estado, (CASE WHEN opposite THEN 1 ELSE 0 END + CASE WHEN da > 12 THEN 1 ELSE 0 END + CASE WHEN s_temporal = 0 THEN 1 ELSE 0 END) AS n_con FROM tiered)"

Q("block_pairs", "v_records", "v_adjacent", sql=f"WITH {ADJ}, {PAIRS} SELECT m_id, u_id FROM pairs")(lambda r, a: A.block_pairs(r.where("record_type = 'missing'"), r.where("record_type = 'unidentified'"), A.adjacency_closure(a)).select("m_id", "u_id"))
Q("adjacency_closure", "v_adjacent", sql=f"WITH {ADJ} SELECT a, b FROM adj")(lambda a: A.adjacency_closure(a))
Q("build_features", "v_records", sql=f"WITH {FEATS} SELECT record_id, place::INT AS place, feature_type, body_region, laterality, motif_category, description_raw, array_to_string(tokens, ' ') AS tokens FROM feats")(lambda r: T.build_features(r).withColumn("tokens", F.array_join("tokens", " ")))
Q("score_features", "v_records", "v_adjacent", sql=f"{ALL_A} SELECT m_id, u_id, round(coalesce(best, 0), 6) AS best, coalesce(opposite, false) AS opposite FROM mk")(
    lambda r, a: link.marks_of_pairs(r, a).select("m_id", "u_id", F.round("best", 6).alias("best"), "opposite"))
Q("score_fields", "v_records", "v_adjacent", sql=f"{ALL_A} SELECT m_id, u_id, s_marks, s_height, s_age, s_temporal, s_geo, overall_score, hard, tier FROM tiered")(
    lambda r, a: link.score_records(r, a).select("m_id", "u_id", "s_marks", "s_height", "s_age", "s_temporal", "s_geo", "overall_score", "hard", "tier"))
_NUM = "regexp_replace({x}::VARCHAR, '\\.0$', '')"
EVID = f"""concat_ws('. ', CASE WHEN NOT opposite AND best > 0.5 THEN 'Señas coinciden (score ' || {_NUM.format(x='s_marks')} || '): tipo + región + motivo léxico' END, CASE WHEN dh IS NOT NULL THEN 'Estatura: ficha ' || m_h || 'cm vs cuerpo ' || u_h || 'cm (Δ ' || dh || 'cm)' END,
  CASE WHEN s_temporal = 1 THEN 'Temporal coherente: desaparición ' || m_d || ' ≤ hallazgo ' || u_d END, CASE WHEN m_e = u_e THEN 'Mismo estado: ' || m_e END)"""
CONTRA = "concat_ws('. ', CASE WHEN opposite THEN 'CONTRADICCIÓN: lateralidad opuesta en seña (izquierda vs derecha) — incompatible' END, CASE WHEN da > 12 THEN 'CONTRADICCIÓN: edad incompatible (Δ ' || floor(da + 0.5)::INT || ' años)' END, CASE WHEN s_temporal = 0 THEN 'CONTRADICCIÓN temporal: cuerpo hallado ANTES de la desaparición' END)"
Q("verify_records", "v_records", "v_adjacent", sql=f"{ALL_A} SELECT m_id, u_id, coalesce(nullif({EVID}, ''), 'Coincidencia parcial de señas y datos contextuales.') AS evidence, coalesce(nullif({CONTRA}, ''), 'Sin contradicciones duras detectadas.') AS contradiction, tier FROM tiered")(
    lambda r, a: link.score_records(r, a).select("m_id", "u_id", "evidence", "contradiction", "tier"))
Q("link_records", "v_records", "v_adjacent", sql=f"{ALL_A} SELECT m_id, u_id, overall_score, tier FROM tiered ORDER BY overall_score DESC, m_id, u_id LIMIT 12")(lambda r, a: link.link_records(r, a).select("m_id", "u_id", "overall_score", "tier"))
Q("bridge_tiers", "v_records", "v_adjacent", sql=f"{ALL_A} SELECT m_id, u_id, CASE WHEN overall_score >= 0.8 THEN 'alta' WHEN overall_score >= 0.6 THEN 'media' ELSE 'baja' END AS bridge_tier FROM tiered")(lambda r, a: A.bridge_tier(link.score_records(r, a)).select("m_id", "u_id", "bridge_tier"))


# --- matcher B


def mark_sql(x: str) -> str:
    """(raw, lado, tokens) of a mark."""
    t = f"list_filter(string_split_regex(upper({x}), '[^A-ZÁÉÍÓÚÑ0-9]+'), lambda w: w <> '')"
    left, right, stop = (", ".join(f"'{w}'" for w in ws) for ws in (V.SIDES_B["IZQ"], V.SIDES_B["DER"], V.STOP_B))
    side = f"list_filter({t}, lambda w: w IN ({left}, {right}))[1]"
    return f"{{'raw': {x}, 'lado': CASE WHEN {side} IN ({left}) THEN 'IZQ' WHEN {side} IN ({right}) THEN 'DER' END, 'tokens': list_distinct(list_filter({t}, lambda w: w NOT IN ({left}, {right}, {stop})))}}"


_MARKS = "list_filter(list_transform(string_split(coalesce(sana_particular, ''), '<br>'), lambda x: trim(x)), lambda x: x <> '' AND upper(x) <> 'NINGUNA')"
_H = "try_cast(nullif(regexp_extract(regexp_extract(media_filiacion, 'ESTATURA:\\s*([\\d.,]+)', 1), '(\\d{2,3})', 1), '') AS INT)"
TIDY = f"""p AS (SELECT id_victimadirecta AS p_id, sexo AS p_raw, upper(nullif(sexo, '')) AS p_sex, edad AS p_age, nullif(estado, '') AS p_state, {flex_date_sql("coalesce(nullif(fecha_percato, ''), nullif(fecha_hechos, ''))")} AS p_date, CASE WHEN {_H} BETWEEN 50 AND 230 THEN {_H} END AS p_h, {_MARKS} AS p_marks FROM v_personas),
b AS (SELECT codigo AS b_id, upper(sexo) AS b_sex, edad_min AS b_lo, edad_max AS b_hi, estado AS b_state, fecha_hallazgo::DATE AS b_date, CASE WHEN estatura_cm BETWEEN 50 AND 230 THEN estatura_cm END AS b_h, {_MARKS} AS b_marks FROM v_cuerpos)"""
_REASON = "CASE WHEN p_sex <> b_sex THEN 'sexo incompatible' WHEN p_date > b_date THEN 'desaparición posterior al hallazgo' WHEN b_lo IS NOT NULL AND b_hi IS NOT NULL AND (p_age < b_lo - 12 OR p_age > b_hi + 12) THEN 'edad fuera de rango' END"
_R4 = "floor(({x}) * 10000 + 0.5) / 10000"
_R3 = "floor(({x}) * 1000 + 0.5) / 1000"

def all_b(ok: str | None = None, tidy: str = TIDY) -> str:
    """Scores of all pairs that nothing blocks, or of those of the table `ok`; marks are compared once per pair of distinct texts."""
    pairs = ok or f"SELECT p.*, b.* FROM p, b WHERE ({_REASON}) IS NULL"
    return f"""WITH {tidy.replace(" AS (SELECT id_victim", " AS MATERIALIZED (SELECT id_victim").replace("b AS (SELECT", "b AS MATERIALIZED (SELECT")}, ok AS MATERIALIZED ({pairs}),
pm AS MATERIALIZED (SELECT p_id, unnest(p_marks) AS pt, generate_subscripts(p_marks, 1) AS i FROM p), bm AS MATERIALIZED (SELECT b_id, unnest(b_marks) AS bt, generate_subscripts(b_marks, 1) AS j FROM b),
dp AS MATERIALIZED (SELECT pt, {mark_sql('pt')} AS pm FROM (SELECT DISTINCT pt FROM pm)), db AS MATERIALIZED (SELECT bt, {mark_sql('bt')} AS bm FROM (SELECT DISTINCT bt FROM bm)),
ds AS MATERIALIZED (SELECT bt, pt, CASE WHEN len(bm.tokens) = 0 OR len(pm.tokens) = 0 THEN 0 ELSE len(list_intersect(bm.tokens, pm.tokens))::DOUBLE / len(list_distinct(list_concat(bm.tokens, pm.tokens))) END AS s, (bm.lado IS NULL OR pm.lado IS NULL OR bm.lado = pm.lado) AS sides FROM db, dp),
sim AS (SELECT b_id, p_id, j, i, bt, pt, s, sides FROM ok JOIN bm USING (b_id) JOIN pm USING (p_id) JOIN ds USING (bt, pt)),
per AS MATERIALIZED (SELECT b_id, p_id, j, max(s) AS best, bool_or(s >= 0.4 AND sides) AS fits, any_value(bt) AS bt, arg_min(pt, (-s, i)) AS top, arg_min(pt, (-s, i)) FILTER (s >= 0.4 AND sides) AS fit FROM sim GROUP BY b_id, p_id, j),
mk AS (SELECT b_id, p_id, sum(best ORDER BY j) / count(*) AS s, count(*) FILTER (best >= 0.4 AND NOT fits) AS n_con, string_agg('seña coincide: «' || bt || '» ~ «' || fit || '»', '; ' ORDER BY j) FILTER (best >= 0.4 AND fits) AS ev, string_agg('lateralidad opuesta: «' || bt || '» vs «' || top || '»', '; ' ORDER BY j) FILTER (best >= 0.4 AND NOT fits) AS con FROM per GROUP BY b_id, p_id),
sub AS (SELECT ok.*, coalesce(s, 0.5)::DOUBLE AS r_marks, coalesce(n_con, 0) AS n_con, ev, con, coalesce(greatest(0, 1 - abs(b_h - p_h) / 25.0::DOUBLE), 0.5)::DOUBLE AS r_height,
  CASE WHEN p_age IS NULL OR b_lo IS NULL OR b_hi IS NULL THEN 0.5 WHEN p_age BETWEEN b_lo AND b_hi THEN 1 ELSE greatest(0, 1 - least(abs(p_age - b_lo), abs(p_age - b_hi)) / 12.0::DOUBLE) END::DOUBLE AS r_age,
  CASE WHEN p_state IS NULL OR b_state IS NULL THEN 0.5 WHEN upper(p_state) = upper(b_state) THEN 1 ELSE 0.4 END::DOUBLE AS s_geo, CASE WHEN p_date IS NULL OR b_date IS NULL THEN 0.5 WHEN p_date <= b_date THEN 1 ELSE 0 END::DOUBLE AS s_temporal FROM ok LEFT JOIN mk USING (b_id, p_id)),
tot AS (SELECT *, CASE WHEN n_con > 0 THEN least(t, 0.2::DOUBLE) ELSE t END AS total FROM (SELECT *, 0.45::DOUBLE * r_marks + 0.20::DOUBLE * r_height + 0.10::DOUBLE * r_age + 0.15::DOUBLE * s_geo + 0.10::DOUBLE * s_temporal AS t FROM sub)),
res AS MATERIALIZED (SELECT *, {_R4.format(x='total')} AS score, CASE WHEN total >= 0.65 THEN 'alta' WHEN total >= 0.35 THEN 'media' ELSE 'baja' END AS tier, {_R3.format(x='r_marks')} AS s_marks, {_R3.format(x='r_height')} AS s_height, {_R3.format(x='r_age')} AS s_age FROM tot),
ranked AS (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY score DESC, p_id)::INT AS rank FROM res)"""


ALL_B = all_b()
#: Bodies of other tables in the place of v_cuerpos.
OTHER_BODIES = "b AS (SELECT codigo AS b_id, upper(sexo) AS b_sex, edad_min AS b_lo, edad_max AS b_hi, estado AS b_state, fecha_hallazgo::DATE AS b_date, CASE WHEN estatura_cm BETWEEN 50 AND 230 THEN estatura_cm END AS b_h, " + _MARKS + " AS b_marks FROM ({bodies}))"


def with_bodies(bodies: str) -> str:
    return all_b(tidy=TIDY[: TIDY.index("b AS (SELECT codigo")] + OTHER_BODIES.replace("{bodies}", bodies))


_EVIDENCE = """concat_ws('; ', ev, CASE WHEN p_sex = b_sex THEN 'sexo coincide: ' || p_raw END, CASE WHEN p_h IS NOT NULL AND b_h IS NOT NULL THEN 'estatura ' || CASE WHEN r_height > 0.6 THEN 'compatible' ELSE 'difiere' END || ': ' || p_h || 'cm vs ' || b_h || 'cm' END,
  CASE WHEN p_age IS NOT NULL AND b_lo IS NOT NULL AND b_hi IS NOT NULL THEN 'edad ' || CASE WHEN r_age >= 0.8 THEN 'compatible' ELSE 'parcial' END || ': ficha ' || p_age || ', cuerpo ' || b_lo || '-' || b_hi END, CASE WHEN upper(p_state) = upper(b_state) THEN 'mismo estado: ' || p_state END,
  CASE WHEN p_date <= b_date THEN 'temporal coherente: desaparición ' || p_date || ', hallazgo ' || b_date || ' (' || date_diff('day', p_date, b_date) || ' días)' END)"""
_NARRATIVE = "CASE WHEN n_con > 0 THEN 'Descartado a prioridad baja por contradicción: ' || con || '. Requiere revisión humana; el sistema no concluye.' ELSE 'Candidato priorizado (tier ' || tier || ', ' || round_even(score * 100, 0)::INT || '%). El sistema no concluye; se prioriza para revisión humana.' END"


_REASONS = f"WITH {TIDY} SELECT reason, count(*)::BIGINT AS n FROM (SELECT coalesce({_REASON}, 'ok') AS reason FROM p, b) GROUP BY reason"
# J3 over all pairs, from grouped keys of both sides
Q("block_reason", "v_personas", "v_cuerpos", sql=_REASONS)(lambda p, b: B.reason_counts(p, b))
Q("candidate_pairs_b", "v_personas", "v_cuerpos", sql=f"{ALL_B} SELECT p_id, b_id FROM ok")(lambda p, b: kinds.all_ids(p, b))
Q("score_pair_b", "v_personas", "v_cuerpos", sql=f"{ALL_B} SELECT b_id, p_id, score, tier, s_marks, s_height, s_age, s_geo, s_temporal, n_con::BIGINT AS n_con FROM res")(
    lambda p, b: kinds.all_scores(p, b).select("b_id", "p_id", "score", "tier", *[A.half_up(F.col(x), 3).alias(x) for x in ("s_marks", "s_height", "s_age")], "s_geo", "s_temporal", F.col("n_contradictions").cast("long").alias("n_con")))
Q("rank_with_rejected", "v_personas", "v_cuerpos", sql=f"{ALL_B} SELECT b_id, p_id, score, rank FROM ranked WHERE rank <= 8 OR n_con > 0")(
    lambda p, b: kinds.reviewed(p, b, 8).select("b_id", "p_id", "score", "rank"))
Q("to_verify", "v_personas", "v_cuerpos", sql=f"{ALL_B} SELECT b_id, p_id, score, n_con > 0 AS rejected FROM ranked WHERE rank = 1 OR n_con > 0")(
    lambda p, b: kinds.reviewed(p, b, 1, rank_all=False).select("b_id", "p_id", "score", "rejected"))
Q("narrative_b", "v_personas", "v_cuerpos", sql=f"{ALL_B} SELECT b_id, p_id, {_NARRATIVE} AS narrative FROM res WHERE n_con = 0")(
    lambda p, b: kinds.all_scores(p, b, keep="n_contradictions = 0", told=("narrative",), texts=lambda df: B.narrative(df.withColumn("contradictions", F.array().cast("array<string>")))).select("b_id", "p_id", "narrative"))
Q("evidence_b", "v_personas", "v_cuerpos", sql=f"{ALL_B} SELECT b_id, p_id, {_EVIDENCE} AS evidence, coalesce(con, '') AS contradiction, {_NARRATIVE} AS narrative FROM ranked WHERE rank <= 8 OR n_con > 0")(
    lambda p, b: link.link_personas(p, b, rank_all=False).select("b_id", "p_id", F.array_join("evidences", "; ").alias("evidence"), F.array_join("contradictions", "; ").alias("contradiction"), "narrative"))

_COS = "list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v)) / sqrt(list_dot_product(y.v, y.v))"
_FUNNEL = f"""SELECT p.*, b.* FROM (SELECT b_id, p_id FROM (SELECT 'C' || s_suppkey AS b_id, 'P' || c_custkey AS p_id, row_number() OVER (PARTITION BY s_suppkey ORDER BY round({_COS}, 12) DESC, 'P' || c_custkey) AS n
  FROM (SELECT s_suppkey, embedding::DOUBLE[] AS v FROM supplier JOIN embeddings ON vec_id = s_suppkey * 7 % 150 WHERE s_suppkey % 5 <> 0) x, (SELECT c_custkey, embedding::DOUBLE[] AS v FROM customer JOIN embeddings ON vec_id = c_custkey % 150) y) WHERE n <= 50
  UNION ALL SELECT b_id, p_id FROM b, p WHERE substr(b_id, 2)::INT % 5 = 0) JOIN p USING (p_id) JOIN b USING (b_id) WHERE ({_REASON}) IS NULL"""


@Q("personas_funnel", "v_personas", "v_cuerpos", "embeddings", sql=f"{all_b(_FUNNEL)} SELECT b_id, p_id, score, rank, rank <= 3 AS narrated, {_NARRATIVE} AS narrative FROM ranked WHERE rank <= 8 OR n_con > 0")
def personas_funnel(p, b, e):
    """J5 in matcher B: vectors retrieve 50 personas a body, bodies without a vector meet all; ranked, then given texts."""
    vec = lambda df, id_col, place: df.select(F.col(id_col).alias("id"), place.alias("vec_id")).join(e, "vec_id").select("id", F.col("embedding").alias("vec"))
    out = link.link_personas_by_vector(p, b, vec(p, "id_victimadirecta", F.col("k") % 150), vec(b.where("k % 5 <> 0"), "codigo", F.col("k") * 7 % 150))
    return out.select("b_id", "p_id", "score", "rank", "narrated", "narrative")


# --- ranking, review


def _cands(r, a):
    return link.candidates(link.score_records(r, a))


Q("top_candidates", "v_records", "v_adjacent", sql=f"{CANDS} SELECT id, score FROM cands ORDER BY score DESC, id LIMIT 6")(lambda r, a: link.best_candidates(r, a, 6).orderBy(F.desc("score"), "id").select("id", "score"))
Q("alerts", "v_records", "v_adjacent", sql=f"{CANDS} SELECT id, score FROM cands WHERE score >= 0.5 AND (persona = 'M10' OR cuerpo = 'U10')")(
    lambda r, a: link.candidates_of(r, a, "M10", "U10").where("status = 'in_review' AND score >= 0.5").orderBy(F.desc("score"), "id").select("id", "score"))


@Q("priority_staleness", "v_records", "v_adjacent", sql=f"""{CANDS}, x AS (SELECT id, CASE tier WHEN 'alta' THEN 3.0 WHEN 'media' THEN 1.5 ELSE 0.5 END::DOUBLE * score + 0.2::DOUBLE * least((hash_s % 7200) / 1800.0::DOUBLE, 2.0) AS urgency FROM (SELECT *, length(id) * 700 AS hash_s FROM cands))
SELECT id, round(urgency, 6) AS urgency, row_number() OVER (ORDER BY urgency, id DESC) AS queue_priority FROM x""")  # fmt: skip
def priority_staleness(r, a):
    """P1; ages are derived from the ids."""
    created = F.expr("timestamp '2024-01-01 12:00:00' - make_interval(0, 0, 0, 0, 0, 0, (length(id) * 700) % 7200)")
    out = ranking.priority_staleness(_cands(r, a).withColumn("created_at", created), "2024-01-01 12:00:00", keep=("id",))
    return out.select("id", F.round("urgency", 6).alias("urgency"), "queue_priority")


@Q("priority_context", "v_records", "v_adjacent", "nation", sql=f"""{CANDS}, ev AS (SELECT lower(substr(n_name, 1, 4)) AS e FROM nation WHERE n_nationkey % 5 = 0),
x AS (SELECT id, score, tier, CASE WHEN EXISTS (SELECT 1 FROM ev WHERE contains(lower(coalesce(estado, '')), e)) THEN 0.2::DOUBLE ELSE 0 END AS boost, (length(id) % 10) / 10.0::DOUBLE AS confidence FROM cands)
SELECT id, floor(least(1, score * 0.6::DOUBLE + boost + confidence * 0.2::DOUBLE) * 1000 + 0.5) / 1000 AS priority, boost FROM x""")  # fmt: skip
def priority_context(r, a, n):
    """J13, P2."""
    events = n.where("n_nationkey % 5 = 0").select(F.substring("n_name", 1, 4).alias("estado"))
    return ranking.priority_context(_cands(r, a).withColumn("confidence", F.length("id") % 10 / F.lit(10.0)), events, r).select("id", "priority", "boost")


@Q("review_view", "v_records", "v_adjacent", sql=f"""{CANDS}, nf AS (SELECT record_id, count(*) AS n, string_agg(feature_type, ',' ORDER BY place) AS kinds FROM feats GROUP BY record_id)
SELECT id, score, a.n AS n_a, b.n AS n_b, a.kinds AS kinds_a FROM cands LEFT JOIN nf a ON a.record_id = persona LEFT JOIN nf b ON b.record_id = cuerpo""")  # fmt: skip
def review_view(r, a):
    """Candidates with the features of both sides."""
    f = T.build_features(r).groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("place", "feature_type"))).alias("fs"))  # a record's marks
    # the records take their features' counts with them, so that no pair is joined again
    known = r.join(f.select(F.col("record_id").alias("id"), "n", F.array_join(F.transform("fs", lambda x: x["feature_type"]), ",").alias("kinds")), "id", "left")
    c = link.candidates(link.score_records(known, a, extra=("n", "kinds")), "m_n", "u_n", "m_kinds")
    return c.select("id", "score", F.col("m_n").alias("n_a"), F.col("u_n").alias("n_b"), F.col("m_kinds").alias("kinds_a"))


@Q("evaluation_set", "v_personas", sql="""
SELECT 'TM-' || id_victimadirecta AS codigo, sana_particular FROM (SELECT *, row_number() OVER (ORDER BY id_victimadirecta) AS n FROM v_personas WHERE regexp_matches(upper(sana_particular), 'IZQ|DER')) WHERE n <= 10
UNION ALL SELECT 'NM-' || id_victimadirecta, replace(replace(replace(replace(replace(replace(sana_particular, 'IZQUIERDO', '§1'), 'DERECHO', 'IZQUIERDO'), '§1', 'DERECHO'), 'LADO IZQ', '§2'), 'LADO DER', 'LADO IZQ'), '§2', 'LADO DER')
FROM (SELECT *, row_number() OVER (ORDER BY id_victimadirecta) AS n FROM v_personas WHERE regexp_matches(upper(sana_particular), 'IZQ|DER')) WHERE n BETWEEN 11 AND 13""")  # fmt: skip
def evaluation_set(p):
    """Copies as true matches, swapped sides as near misses."""
    return evaluation.build_eval_set(p).select("codigo", "sana_particular")


_EVAL = """SELECT CASE WHEN n > 10 THEN 'NM-' ELSE 'TM-' END || id_victimadirecta AS codigo, sexo, edad - 2 AS edad_min, edad + 2 AS edad_max, NULL::INT AS estatura_cm, estado, '2005-01-01' AS fecha_hallazgo,
  CASE WHEN n > 10 THEN replace(replace(replace(replace(replace(replace(sana_particular, 'IZQUIERDO', '§1'), 'DERECHO', 'IZQUIERDO'), '§1', 'DERECHO'), 'LADO IZQ', '§2'), 'LADO DER', 'LADO IZQ'), '§2', 'LADO DER') ELSE sana_particular END AS sana_particular
  FROM (SELECT *, row_number() OVER (ORDER BY id_victimadirecta) AS n FROM v_personas WHERE regexp_matches(upper(sana_particular), 'IZQ|DER')) WHERE n <= 13"""


@Q("evaluate_matcher", "v_personas", sql=f"""{with_bodies(_EVAL)}, j AS (SELECT b.b_id, starts_with(b.b_id, 'TM-') AS m, score FROM b LEFT JOIN res ON res.b_id = b.b_id AND res.p_id = substr(b.b_id, 4))
SELECT count(*) FILTER (m) AS n_true, count(*) FILTER (m AND score >= 0.5) AS n_found, count(*) FILTER (NOT m) AS n_near, count(*) FILTER (NOT m AND coalesce(score, 0) < 0.3) AS n_rejected FROM j""")
def evaluate_matcher(p):
    """Planted pairs found and near misses rejected."""
    bodies = evaluation.build_eval_set(p)
    return evaluation.evaluate(B.score_numbers(B.candidate_pairs(p, bodies), p, bodies), evaluation.labelled_pairs(bodies))


Q("labelled_pairs", "v_personas", sql=f"SELECT codigo AS b_id, substr(codigo, 4) AS p_id, starts_with(codigo, 'TM-') AS is_match FROM ({_EVAL})")(lambda p: evaluation.labelled_pairs(evaluation.build_eval_set(p)))
Q("candidates_for", "v_records", "v_adjacent", "v_cuerpos", sql=f"""{CANDS} SELECT cands.id, persona, cuerpo, score, b.sexo AS cuerpo_sexo, b.estado AS cuerpo_estado, b.sana_particular AS cuerpo_senas FROM cands JOIN v_cuerpos b ON b.codigo = 'C' || substr(cuerpo, 2) WHERE persona = 'M10'""")(
    lambda r, a, b: link.candidates_for(link.candidates_of(r, a, "M10"), b.withColumn("codigo", F.concat(F.lit("U"), F.substring("codigo", 2, 20))), "M10").select("id", "persona", "cuerpo", "score", "cuerpo_sexo", "cuerpo_estado", "cuerpo_senas"))
