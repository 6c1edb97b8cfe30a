"""Cases and properties of both matchers, reviews, governance and clusters."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vinctum.functions import detect, text
from vinctum.operators import evaluation, govern, matching, ranking, vector_index, vectors
from vinctum.operators import personas as B
from vinctum.operators import records as A
from vinctum.plans import link

D = dt.date
REC = "id string, record_type string, sex string, age_min int, age_max int, height_cm int, estado string, event_date date, raw_description string"


def records(spark, *rows):
    return spark.createDataFrame(rows, REC)


@pytest.fixture(scope="module")
def nowhere(spark):
    return spark.createDataFrame([("A", "B")], "a string, b string")


def test_blocking_of_the_sample_pair(spark, nowhere):
    r = records(
        spark,
        ("persona-1", "missing", "M", 30, 30, 170, "JALISCO", D(2023, 1, 1), "ancla brazo der."),
        ("cuerpo-A", "unidentified", "M", 29, 31, 170, "JALISCO", D(2023, 3, 15), "tatuaje de ancora en antebrazo derecho"),
        ("cuerpo-B", "unidentified", "F", 60, 65, 150, "JALISCO", D(2023, 3, 15), ""),
        ("cuerpo-C", "unidentified", None, None, None, None, None, None, None),
    )
    got = {x.u_id: x for x in link.score_records(r, nowhere).collect()}
    assert set(got) == {"cuerpo-A", "cuerpo-C"}
    assert got["cuerpo-A"].overall_score > got["cuerpo-C"].overall_score and got["cuerpo-A"].tier in ("alta", "media")


def test_no_bodies_give_no_pairs(spark, nowhere):
    r = records(spark, ("p", "missing", "M", 30, 30, 170, "A", D(2023, 1, 1), "lunar"))
    assert link.score_records(r, nowhere).count() == 0


places, sexes = st.sampled_from(["A", "B", "C", "", None]), st.sampled_from(["M", "F", "", None])
ages = st.one_of(st.none(), st.integers(10, 60))
days = st.one_of(st.none(), st.dates(D(2020, 1, 1), D(2020, 2, 1)))
row = st.tuples(sexes, ages, ages, places, days)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=6), st.lists(row, min_size=1, max_size=6))
def test_keyed_blocking_loses_nothing(spark, missing, found):
    rows = [(f"m{i}", "missing", s, a, b, 0, p, d, "x") for i, (s, a, b, p, d) in enumerate(missing)]
    rows += [(f"u{i}", "unidentified", s, a, b, 0, p, d, "x") for i, (s, a, b, p, d) in enumerate(found)]
    adj = {("A", "B"), ("B", "A")}

    def ok(m, u):
        if m[6] and u[6] and m[6] != u[6] and (m[6], u[6]) not in adj:
            return False
        if m[2] and u[2] and m[2] != u[2]:
            return False
        if None not in (m[3], m[4], u[3], u[4]) and not (m[4] >= u[3] - 3 and m[3] <= u[4] + 3):
            return False
        return not (m[7] and u[7] and m[7] > u[7])

    r = records(spark, *rows)
    near = A.adjacency_closure(spark.createDataFrame([("A", "B")], "a string, b string"))
    got = [(x.m_id, x.u_id) for x in A.block_pairs(r.where("record_type = 'missing'"), r.where("record_type = 'unidentified'"), near).select("m_id", "u_id").collect()]
    want = [(m[0], u[0]) for m in rows for u in rows if m[1] == "missing" and u[1] == "unidentified" and ok(m, u)]
    assert sorted(got) == sorted(want)


P = "id_victimadirecta string, sexo string, edad int, sana_particular string, media_filiacion string, estado string, fecha_percato string, fecha_hechos string"
C = "codigo string, sexo string, edad_min int, edad_max int, estatura_cm int, sana_particular string, estado string, fecha_hallazgo string"


def test_opposite_side_is_capped_and_stays_listed(spark):
    p = spark.createDataFrame([("P1", "HOMBRE", 18, "TATUAJE LADO IZQUIERDO", "ESTATURA: 165", "TAMAULIPAS", "2026-01-01", None)], P)
    b = spark.createDataFrame([("A", "HOMBRE", 16, 20, 165, "TATUAJE LADO IZQUIERDO", "TAMAULIPAS", "2026-06-30"), ("B", "HOMBRE", 16, 20, 165, "TATUAJE LADO DERECHO", "TAMAULIPAS", "2026-06-30")], C)
    got = {x.b_id: x for x in link.link_personas(p, b).collect()}
    assert got["A"].score > 0.9 and got["A"].tier == "alta" and not got["A"].contradictions
    assert got["B"].score == 0.2 and len(got["B"].contradictions) == 1 and got["B"].tier == "baja"


def test_no_contradicted_pair_exceeds_the_cap(spark):
    from vinctum.demo.views import load

    sf = "/root/testdata/sf0.001"
    p, b = load(spark, sf, "v_personas"), load(spark, sf, "v_cuerpos")
    s = B.score_pair_b(B.candidate_pairs(p, b), p, b)
    assert s.where("size(contradictions) > 0 AND score > 0.2").count() == 0
    a = link.score_records(load(spark, sf, "v_records"), load(spark, sf, "v_adjacent"))
    assert a.where("hard AND overall_score > 0.2").count() == 0


def test_planted_matches_are_found(spark):
    from vinctum.demo.views import load

    people = load(spark, "/root/testdata/sf0.01", "v_personas")
    bodies = evaluation.build_eval_set(people)
    r = evaluation.evaluate(B.score_pair_b(B.candidate_pairs(people, bodies), people, bodies), evaluation.labelled_pairs(bodies)).first()
    assert (r.n_true, r.n_near) == (10, 3) and r.n_found == 10 and r.n_rejected == 3


def test_missing_persona_height_and_sex(spark):
    from vinctum.functions.clean import height_cm, map_sex

    r = spark.createDataFrame([("Mujer", "Estatura: 160cm<br>Complexión: Delgada", "ESTATURA: 1.65")], "s string, a string, b string").select(map_sex("s"), height_cm("a", "a"), height_cm("b", "b")).first()
    assert tuple(r) == ("F", 160, 65)


def test_suspicious_offer(spark):
    t = "Vacante de guardia de seguridad. Contratacion inmediata sin experiencia. Sueldo $18000 semanal. Te mandamos Uber para entrevista en central de autobuses. Contacto por WhatsApp."
    df = spark.createDataFrame([(1, t), (2, "Ingeniero con experiencia, sueldo de mercado."), (3, None)], "id int, text string")
    out = {r.id: r for r in detect.extract_offer(detect.offer_score(detect.offer_signals(df, "text"))).collect()}
    assert out[1].is_job_offer and out[1].privacy_level == "restricted" and out[1].level == "CRÍTICO"
    assert out[2].score < 20 and out[3].score == 0


def test_copy_safety_and_redaction(spark):
    df = spark.createDataFrame([("Este caso está conectado y confirmado por IA.",), ("Posible patrón. Señal contextual pendiente de revisión.",), ("Llamar al 5551234567 o escribir a reclutador@demo.test",)], "t string")
    r = df.select(text.copy_safety("t").alias("c"), text.redact_pii("t").alias("p")).collect()
    assert not r[0].c.ok and len(r[0].c.forbidden_hits) >= 2 and r[1].c.ok and r[1].c.uses_recommended
    assert (r[2].p.phone_count, r[2].p.email_count) == (1, 1) and "5551234567" not in r[2].p.redacted_text


def test_staleness_orders_reviews(spark):
    now = "2024-01-01 12:00:00"
    rows = [("a", 0.9, "alta", now), ("b", 0.9, "baja", now), ("c", 0.7, "media", "2024-01-01 11:00:00"), ("d", 0.7, "media", "2024-01-01 11:59:00")]
    df = spark.createDataFrame(rows, "id string, score double, tier string, t string").withColumn("created_at", F.col("t").cast("timestamp"))
    got = {r.id: r for r in ranking.priority_staleness(df, now).collect()}
    assert got["a"].urgency > got["b"].urgency and got["c"].urgency > got["d"].urgency
    assert sorted(r.queue_priority for r in got.values()) == [1, 2, 3, 4] and got["a"].queue_priority == 4


def test_a_countdown_moves_what_is_asked_for_only(spark, monkeypatch):
    from vinctum import registry

    asked, whole = [], ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, name: asked.append(set(df.columns)) or whole(df, name))
    registry.QUERIES["priority_staleness"](spark, "/root/testdata/sf0.001").count()
    assert asked == [{"id", "urgency", "_range", "_r"}]


def test_revoking_twice_changes_nothing_more(spark):
    d = D(2024, 1, 1)
    con = spark.createDataFrame([("c1", None)], "id string, revoked date")
    art = spark.createDataFrame([(1, "c1", None), (2, "c1", None), (3, "c2", None)], "id long, consent_id string, purged date")
    jobs = spark.createDataFrame([(1, 1, "done")], "id long, artifact long, status string")
    ev = spark.createDataFrame([(10, 1, "pending"), (11, 3, "pending")], "id long, artifact long, review string")
    lin = spark.createDataFrame([(10, 2, "x")], "event long, artifact long, role string")
    out = govern.revoke(con, art, jobs, ev, lin, "c1", "2024-02-01", "asked")
    assert tuple(out["counts"].first())[:3] == (2, 1, 1)
    again = govern.revoke(out["consents"], out["artifacts"], out["jobs"], out["events"], lin, "c1", "2024-03-01", "asked")
    assert tuple(again["counts"].first())[:3] == (0, 0, 0)
    assert out["consents"].first().revoked == again["consents"].first().revoked == D(2024, 2, 1) and d


def test_secure_read_refuses_and_audits(spark):
    df = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(govern.AccessDenied) as e:
        govern.secure_read(df, "public", "sites", "2024-01-01")
    assert e.value.audit.first().action == "secure_read_denied"
    assert govern.secure_read(df, "admin", "sites", "2024-01-01").count() == 1


def test_window_clusters_against_a_loop(spark):
    xs = [0, 1, 2, 3, 9, 10, 20, 21, 21, 22, 40]
    df = spark.createDataFrame([("k", x) for x in xs], "k string, x int")
    want, i = [], 0
    while i < len(xs):
        run = [x for x in xs[i:] if x - xs[i] <= 2]
        if len(run) >= 3:
            want.append((run[0], run[-1], len(run)))
            i += len(run)
        else:
            i += 1
    assert sorted((r.first, r.last, r.size) for r in vectors.window_clusters(df, ["k"], "x", 2).collect()) == want


@pytest.mark.parametrize("options", [{}, {"local_rows": 3, "seed_rows": 4, "part_rows": 9}])
@pytest.mark.parametrize("least", [2, 3])
def test_greedy_duplicates_against_a_loop(spark, least, options):
    rng = np.random.default_rng(4)
    few = rng.integers(0, 4, (30, 3)) + 0.5
    rows = [("ab"[int(rng.integers(2))], i, [float(x) for x in few[rng.integers(30)]]) for i in range(160)]
    want, seen = set(), set()
    cos = lambda x, y: np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
    for block in "ab":
        mine = [(i, v) for b, i, v in rows if b == block]
        for i, v in mine:
            if i not in seen:
                members = [i] + [j for j, w in mine if j != i and j not in seen and cos(v, w) >= 0.97]
                if len(members) >= least:
                    seen |= set(members)
                    want |= {(block, i, j, len(members)) for j in members}
    got = vectors.greedy_duplicates(spark.createDataFrame(rows, "block string, id long, vec array<double>"), "block", min_size=least, **options).collect()
    assert {(r.block, r.seed, r.id, r["size"]) for r in got} == want and len(got) == len(want) and all(0.97 <= r.similarity <= 1 for r in got)


def test_retrieval_in_blocks_is_the_whole_search(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 3, (90, 4)).astype(float)  # many ties, some null vectors
    df = spark.createDataFrame([(f"x{i:02d}", [float(x) for x in row]) for i, row in enumerate(v)] + [(None, [1.0] * 4), ("none", None)], "id string, vec array<double>")
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    want = {(f"x{q:02d}", f"x{i:02d}", k + 1) for q in range(90) for k, i in enumerate(np.lexsort((np.arange(90), -np.round(u @ u[q], 12)))[:5])}
    for options in ({}, {"query_bytes": 900}, {"threshold": -1.0}):
        assert {(r.query_id, r.id, r["rank"]) for r in vectors.retrieve(df, df.repartition(5), 5, **options).collect()} == want
    for cells, probes in ((1, 1), (7, 7), (9, 99)):
        index = vector_index.build_index(df.repartition(3), cells=cells, block_rows=8)
        assert {(r.query_id, r.id, r["rank"]) for r in vector_index.search(index, df, 5, probes=probes).collect()} == want
    assert vector_index.search(vector_index.build_index(df.limit(0)), df, 5).count() == 0 and vectors.retrieve(df, df.limit(0), 5).count() == vectors.retrieve(df.limit(0), df, 5).count() == 0


def test_a_task_of_the_search_holds_pieces_of_the_product_only():
    """4,000 queries and batches of 10,000 rows: their product alone is 320 MB."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(9)
    q, v = (vectors.unit_rows(rng.integers(-2, 3, (n, 4)).astype(float)) for n in (4_000, 20_000))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(at, at + 10_000)), pa.array(v[at : at + 10_000].tolist())], names=["id", "vec"]) for at in (10_000, 0)]
    tracemalloc.start()
    got = list(vectors.nearest_rows(iter(batches), pa.array(range(4_000)), q, 3))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 160 << 20
    rows = [r for b in got for r in b.to_pylist()]
    assert len(rows) == 12_000
    for i in range(0, 4_000, 397):
        assert [r["id"] for r in rows if r["query_id"] == i] == np.lexsort((np.arange(20_000), -np.round(v @ q[i], 12)))[:3].tolist()


def test_queries_of_equal_vectors_have_equal_neighbours(spark):
    q = spark.createDataFrame([(f"q{i:02d}", [1.0, float(i % 2)]) for i in range(20)], "id string, vec array<double>")
    rows = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(12)], "id int, vec array<double>")
    got = {}
    for r in vectors.retrieve(q, rows, 2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    assert len(got) == 20 and all(sorted(x) == ([(1, 0), (2, 1)] if int(i[1:]) % 2 == 0 else [(1, 10), (2, 11)]) for i, x in got.items())


def test_zero_vectors_are_in_no_cluster(spark):
    rows = [("a", i, [0.0, 0.0]) for i in range(3)] + [("a", 7, [1.0, 0.0]), ("a", 8, [1.0, 0.01])]
    got = vectors.greedy_duplicates(spark.createDataFrame(rows, "block string, id long, vec array<double>"), "block").collect()
    assert {(r.seed, r.id, r["size"]) for r in got} == {(7, 7, 2), (7, 8, 2)}


def test_index_holds_every_row_once_and_finds_most_neighbours(spark, tmp_path):
    rng = np.random.default_rng(6)
    v = rng.normal(0, 1, (40, 16))[rng.integers(0, 40, 3000)] + rng.normal(0, 0.5, (3000, 16))
    v[1000:2000] = v[1000]  # a third of all rows are one vector
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>").repartition(4)
    index = vector_index.build_index(df, cells=40, block_rows=100, path=f"file://{tmp_path}/index")
    held = [i for r in index.blocks.select("ids").collect() for i in r["ids"]]
    assert sorted(held) == list(range(3000)) and max(len(r["ids"]) for r in index.blocks.select("ids").collect()) < 160
    queries = df.where("id % 50 = 0")
    exact = vectors.retrieve(queries, df, 10)
    found = vector_index.search(vector_index.load_index(spark, f"file://{tmp_path}/index"), queries, 10, probes=8)
    assert vector_index.recall(found, exact) >= 0.95 and vector_index.recall(exact, exact) == 1.0
    same = {(r.query_id, r.id): r.similarity for r in exact.collect()}
    assert all(abs(same[r.query_id, r.id] - r.similarity) < 1e-9 for r in found.collect() if (r.query_id, r.id) in same)
    joined = found.count()
    assert joined == 600


def test_countdown_of_many_ties(spark):
    rows = [(i, float(i % 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, s double").repartition(7)
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], -r[0])))}
    assert {r.id: r.queue_priority for r in ranking.global_countdown(df, "s", "id").collect()} == want


def test_parts_are_found_by_their_first_characters(spark):
    texts, parts = ["ciudad juarez", "ab", "a", "xx", "", None, "norte de la baja"], ["ciudad", "b", "ab", "baja", "zzz", "a", "", "rte de"]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    p = spark.createDataFrame([(x,) for x in parts], "p string")
    got = sorted((r.t, r.p) for r in matching.contains_join(t, "t", p, "p").collect())
    assert got == sorted((x, y) for x in texts if x for y in parts if y and y in x)


def test_the_funnel_retrieves_before_it_scores(spark):
    personas = spark.createDataFrame([(f"P{i}", "HOMBRE", 30, "TATUAJE ROSA ROJA EN MANO DERECHO", "", "X", "1999-01-01", None) for i in range(12)], "id_victimadirecta string, sexo string, edad int, sana_particular string, media_filiacion string, estado string, fecha_percato string, fecha_hechos string")
    bodies = spark.createDataFrame([(c, "HOMBRE", 25, 35, 170, m, "X", "1999-07-10") for c, m in (("C1", "TATUAJE ROSA ROJA EN MANO DERECHO"), ("C2", "TATUAJE ROSA ROJA EN MANO IZQUIERDO"))], "codigo string, sexo string, edad_min int, edad_max int, estatura_cm int, sana_particular string, estado string, fecha_hallazgo string")
    vec = lambda rows: spark.createDataFrame(rows, "id string, vec array<double>")
    pv = vec([(f"P{i}", [1.0, float(i)]) for i in range(12)])
    cfg = link.MatchConfig(retrieve_k=3, top_k=2, verify_top_n=1)
    out = link.link_personas_by_vector(personas, bodies, pv, vec([("C1", [1.0, 0.0])]), cfg).collect()
    first = sorted((r["rank"], r.p_id, r.narrated) for r in out if r.b_id == "C1")
    assert first == [(1, "P0", True), (2, "P1", False)]
    other = [r for r in out if r.b_id == "C2"]  # no vector: all personas, each contradicted one stays
    assert len(other) == 12 and all(r.score <= 0.2 and r.narrative.startswith("Descartado") for r in other)
    stored = spark.createDataFrame([("P1", "C1", 0.5), ("P1", "C2", 0.9), ("P2", "C1", 1.0)], "persona string, cuerpo string, score double")
    got = link.candidates_for(stored, bodies, "P1").collect()
    assert [(r.cuerpo, r.cuerpo_sexo, r.cuerpo_estado) for r in got] == [("C2", "HOMBRE", "X"), ("C1", "HOMBRE", "X")] and got[0].cuerpo_senas.endswith("IZQUIERDO")


SUSPICIOUS = "Vacante de guardia de seguridad. Contratacion inmediata sin experiencia. Sueldo $18000 semanal. Te mandamos Uber para entrevista en central de autobuses. Contacto por WhatsApp."


def test_offer_cases_typed_by_hand(spark):
    texts = [SUSPICIOUS, "Ingeniero con experiencia, sueldo de mercado", "Entra x  q pagan bien", "Ven x\nq hay", "ax q no", "vacante zona Centro Norte de la ciudad", "Promo CASA PARTICULAR hoy", "la casas particulares", "NINJA y ninjas", "MÉDICO titulado", "BÚHO", "gana lo que quieras", "trabajo en 3 dias", "Ubicación: x", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = {r.i: r for r in detect.extract_offer(detect.offer_score(detect.offer_signals(df, "text"))).collect()}
    hits = {i: {h.id: h.evidence for h in r.hits} for i, r in out.items()}
    assert hits[0] == {"no_experiencia": "sin experiencia", "contratacion_inmediata": "Contratacion inmediata", "salario_inusual": "$18000 semanal (semanal muy alto)", "ubicacion_sospechosa": "central de autobuses", "transporte_entrevista": "Te mandamos Uber", "perfiles_lure": "guardia de seguridad"}
    a = out[0]
    assert a.is_job_offer and a.privacy_level == "restricted" and a.level == "CRÍTICO" and a.notes == a.recommendation and a.contact_methods == ["whatsapp"] and a.salary_text == "$18000 semanal"
    assert a.job_title == "guardia de seguridad" and a.location_text.startswith("central de autobuses. Contacto por WhatsApp")
    assert hits[1] == {} and out[1].privacy_level == "internal"
    assert hits[2] == {"errores_ortograficos": "x  q"} and hits[3] == {"errores_ortograficos": "x\nq"} and hits[4] == {}
    assert out[5].location_text == "Centro Norte de la ciudad"
    assert hits[6] == {"ubicacion_sospechosa": "CASA PARTICULAR"} and hits[7] == {} and hits[8] == {"codigos_visuales_crimen": "NINJA"}
    assert hits[9] == {"perfiles_tecnicos_crimen": "MÉDICO"} and hits[10] == {"codigos_visuales_crimen": "BÚHO"}
    assert hits[11] == {} and out[12].location_text == "" and out[13].location_text == "" and hits[14] == hits[15] == {}
    event = {r.i: r for r in detect.extract_risk_event(detect.offer_score(detect.offer_signals(df, "text"))).collect()}
    assert event[0].event_type == "oferta_laboral_sospechosa" and event[5].locality_approx == "Centro Norte de la ciudad" and event[14].locality_approx == ""


def test_every_signal_pattern_holds_its_literal(spark):
    from vinctum.functions import vocab

    assert detect.required_literal(r"sin\s+experiencia") == "experiencia" and detect.required_literal("a|b") == "" and detect.required_literal(r"modelos?\s+(femeninas?|buscamos)") == "modelo"
    assert detect.required_literal("tr[eé]bol") == "bol" and detect.required_literal(r"\bninja\b") == "ninja" and detect.required_literal("(m[eé]dico|enfermer[oa])") == ""
    assert detect.required_literal(r"call\s*center") == "center" and detect.required_literal(r"x{2}y") != "x"
    assert all(detect.required_literal(p) in p for _, _, _, ps in vocab.SIGNALS for p in ps or [])


def test_upsert_takes_one_of_the_incoming_rows_of_a_key(spark):
    from vinctum.operators import tables

    t = spark.createDataFrame([(1, "old", "x"), (2, "old", "x")], "id int, a string, b string")
    i = spark.createDataFrame([(1, "n1", "y"), (1, "n2", "y"), (3, "n3", "y"), (3, "n3", "y")], "id int, a string, b string")
    assert sorted(map(tuple, tables.upsert(t, i, ["id"], ["a"]).collect())) == [(1, "n2", "x"), (2, "old", "x"), (3, "n3", "y")]
    assert sorted(map(tuple, tables.upsert_coalesce(t, i, ["id"], ["a", "b"]).collect())) == [(1, "n2", "y"), (2, "old", "x"), (3, "n3", "y")]


def test_records_are_searched_by_municipality_too(spark):
    from vinctum.operators import search

    r = spark.createDataFrame([("1", "rosa", "Centro"), ("2", "ancla", "La ROSA"), ("3", "ancla", None)], "id string, raw_description string, municipio string")
    assert [x.id for x in search.search_records(r, q="rosa").collect()] == ["1", "2"]


def test_a_feature_collection_is_one_document(spark, tmp_path):
    import glob
    import json

    from vinctum.sources import files

    rows = [(i, None if i % 4 == 0 else float(i), 1.5, f"s{i}", str(i) if i % 3 else "S/D") for i in range(20)]
    df = spark.createDataFrame(rows, "k int, lng double, lat double, name string, fosas string").repartition(3)
    for n, part in ((1, df), (2, df.where("k = 0")), (3, df.where("k < 0"))):
        files.write_feature_collection(part, f"{tmp_path}/{n}", "lng", "lat", ["k", "name"], ["fosas"], "k")
        doc = json.loads("".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/{n}/part-*"))))
        mine = [r for r in rows if n == 1 or n == 2 and r[0] == 0]
        sited = [r for r in mine if r[1] is not None]
        assert doc["type"] == "FeatureCollection" and doc["num_sitios"] == len(sited) and doc["total_fosas"] == sum(int(r[4]) for r in mine if r[4].isdigit())
        assert [f["properties"]["k"] for f in doc["features"]] == [r[0] for r in sited] and all(f["geometry"]["coordinates"][1] == 1.5 for f in doc["features"])
    files.write_ordered_json(df, f"{tmp_path}/rows", "k")
    lines = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/rows/part-*"))).splitlines()
    assert [json.loads(x)["k"] for x in lines] == list(range(20))


def test_blocked_pairs_against_every_pair(spark):
    """Ages in steps: unknown, wide, turned and far ranges; each pair once."""
    rng = np.random.default_rng(8)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    row = lambda i: (f"r{i}", pick(["M", "F", None, ""]), pick([None, -5, 3, 17, 29, 30, 88, 160]), pick([None, 2, 20, 31, 95, 170]), 170, pick(["A", "A", "A", "B", "C", None]), pick([None, "2020-01-01", "2021-06-05"]))
    schema = "id string, sex string, age_min int, age_max int, height_cm int, estado string, event_date string"
    left, right = [row(i) for i in range(90)], [row(i) for i in range(90, 170)]
    near = {("A", "B"), ("B", "A"), *((x, x) for x in "ABC")}
    df = spark.createDataFrame([("A", "B")], "a string, b string")
    c = spark.createDataFrame([("C", "C")], "a string, b string")
    got = A.block_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), A.adjacency_closure(df.unionByName(c))).select("m_id", "u_id").collect()
    want = {
        (m[0], u[0])
        for m in left
        for u in right
        if (m[5] is None or u[5] is None or (m[5], u[5]) in near) and (not m[1] or not u[1] or m[1] == u[1]) and (None in (m[2], m[3], u[2], u[3]) or (m[3] >= u[2] - 3 and m[2] <= u[3] + 3)) and (None in (m[6], u[6]) or m[6] <= u[6])
    }
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_only_records_of_fitting_ages_meet(spark, monkeypatch):
    """What the join makes is what is returned, where no dates are; a key of many pairs is dealt, and each of its missing records is in one part."""
    rng = np.random.default_rng(9)
    row = lambda i, kind, age: (f"{kind[0]}{i}", kind, "M", age, age + 4, 170, "A", None, "x")
    rows = [row(i, "missing", int(rng.integers(20, 60)) if i % 3 else 33) for i in range(120)] + [row(i, "unidentified", int(rng.integers(20, 60)) if i % 3 else 33) for i in range(60)]
    df, near = records(spark, *rows), A.adjacency_closure(spark.createDataFrame([("A", "B")], "a string, b string"))
    sides, made, whole = [], [], A.meet
    monkeypatch.setattr(A, "_PAIRS", 100)
    monkeypatch.setattr(A, "meet", lambda m, u, on: sides.append((m, u)) or made.append(whole(m, u, on)) or made[0])
    got = A.block_pairs(df.where("record_type = 'missing'"), df.where("record_type = 'unidentified'"), near).select("m_id", "u_id").collect()
    want = {(m[0], u[0]) for m in rows for u in rows if m[1] == "missing" and u[1] == "unidentified" and m[4] >= u[3] - 3 and m[3] <= u[4] + 3}
    assert len(got) == len(want) == made[0].count() and {tuple(r) for r in got} == want
    hot = sides[0][0].where("k_age = 33").groupBy("k_part").agg(F.count("*").alias("n"), F.countDistinct("m_id").alias("ids")).collect()
    assert len(hot) > 3 and all(r.n == r.ids for r in hot)


def test_sets_of_marks_are_joined_by_one_number(spark, monkeypatch):
    """The scores are those of the join by the sets' names, which stays for sets too many to number; records without marks have no number."""
    rng = np.random.default_rng(10)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    marks = ["tatuaje de ancla en mano izquierda", "tatuaje de ancla en mano derecha", "cicatriz en espalda", "lunar en cuello", "tatuaje de rosa en mano; lunar en cuello", ""]
    rows = [(f"{'MU'[i % 2]}{i}", ("missing", "unidentified")[i % 2], "M", 30, 34, pick([170, 175, None]), pick(["A", "B", None]), pick([D(2020, 1, 1), None]), pick(marks)) for i in range(80)]
    df, near = records(spark, *rows), spark.createDataFrame([("A", "B")], "a string, b string")
    asked, whole = [], A.score_fields
    monkeypatch.setattr(A, "score_fields", lambda pairs, marks, on: asked.append(on) or whole(pairs, marks, on))
    columns = ["m_id", "u_id", "s_marks", "best", "opposite", "overall_score", "tier"]
    one = sorted(map(tuple, link.score_records(df, near).select(*columns).collect()))
    short = sorted(map(tuple, link.marks_of_pairs(df, near).collect()))
    monkeypatch.setattr(A, "coded_sets", lambda *a, **k: None)
    assert one == sorted(map(tuple, link.score_records(df, near).select(*columns).collect())) and len(one) > 1000
    assert short == sorted(map(tuple, link.marks_of_pairs(df, near).collect())) and 0 < len(short) < len(one)
    assert asked == [("sets",), ("m_marks_of", "u_marks_of")]


def test_pairs_of_one_record_are_made_from_it_alone(spark, tmp_path, monkeypatch):
    from vinctum import registry
    from vinctum.operators import records as A

    asked = []
    whole = A.block_pairs
    monkeypatch.setattr(A, "block_pairs", lambda m, u, *a, **k: asked.append((m.count(), u.count())) or whole(m, u, *a, **k))
    registry.QUERIES["alerts"](spark, "/root/testdata/sf0.001").collect()
    registry.QUERIES["candidates_for"](spark, "/root/testdata/sf0.001").collect()
    assert all(min(n) <= 1 for n in asked) and len(asked) == 3


@pytest.mark.parametrize("spread", [1, 2, 3])
def test_the_best_pairs_are_found_without_all_pairs(spark, monkeypatch, spread):
    """spread 1: many equal records; 2: few of the best; 3: none alike, so that all pairs are made."""
    rng = np.random.default_rng(spread)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    marks = ["tatuaje de ancla en mano izquierda", "cicatriz en espalda", "lunar en cuello", "tatuaje de rosa en mano; lunar en cuello", ""]
    rows = []
    for i in range(120):
        age, kind = pick([20, 24, 30]), "missing" if i % 2 else "unidentified"
        text = pick(marks) if spread < 3 else ("cicatriz en espalda" if i % 2 else "tatuaje de ancla en mano")
        rows.append((f"{'MU'[i % 2 == 0]}{i}", kind, pick(["M", "F", None]), age, age + 2, pick([170, 173, 190, None, 0]), pick(["A", "B", None]) if spread < 2 else "AB"[i % 2], D(2020, 1, 1) if i % 2 else pick([D(2019, 1, 1), D(2021, 1, 1), None]), text))
    df, near = records(spark, *rows), spark.createDataFrame([("A", "B")], "a string, b string")
    want = [(r.m_id, r.u_id, r.overall_score) for r in link.rate_records(df, near).orderBy(F.desc("overall_score"), "m_id", "u_id").limit(12).collect()]
    asked, whole = [], A.score_fields
    monkeypatch.setattr(A, "score_fields", lambda pairs, *a, **k: asked.append(pairs) or whole(pairs, *a, **k))
    got = [(r.m_id, r.u_id, r.overall_score) for r in link.link_records(df, near, top=12).collect()]
    assert got == want
    n = A.block_pairs(df.where("record_type = 'missing'"), df.where("record_type = 'unidentified'"), A.adjacency_closure(near)).count()
    assert len(asked) == 3 if spread == 3 else asked[0].count() < n
    cands = link.candidates(link.score_records(df, near)).orderBy(F.desc("score"), "id").limit(6).collect()
    assert [(r.id, r.score) for r in link.best_candidates(df, near, 6).collect()] == [(r.id, r.score) for r in cands]


def test_features_are_made_of_the_chosen_records_only(spark, nowhere, monkeypatch):
    """The pairs of one missing record need no marks of the others."""
    row = lambda i, kind: (i, kind, "M", 20, 24, 170, "A", D(2020, 1, 1), "lunar en cuello")
    df = records(spark, *[row(f"M{i}", "missing") for i in range(9)], row("U1", "unidentified"))
    seen, whole = [], link.build_features
    monkeypatch.setattr(link, "build_features", lambda r: seen.append(r.count()) or whole(r))
    assert [r.id for r in link.candidates_of(df, nowhere, "M3").collect()] == ["M3-U1"] and seen == [2]


def test_pairs_are_joined_again_with_small_tables_only(spark):
    """What scores or shows pairs moves the records, never the pairs."""
    from vinctum import registry

    for name in ("score_features", "review_view", "priority_context"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in plan.splitlines() if "Join LeftOuter" in x and ("persona" in x or "cuerpo" in x)]
        assert not joins, name


def test_dealt_joins_lose_and_repeat_nothing(spark):
    from vinctum.operators.dealt import dealt_join

    a = spark.range(300).selectExpr("id AS i", "id % 3 AS k")
    b = spark.range(70).selectExpr("id AS j", "CASE WHEN id % 7 > 0 THEN id % 4 END AS k")
    got = sorted((r.i, r.j) for r in dealt_join(a, b, ["k"], "i").collect())
    assert got == sorted((r.i, r.j) for r in a.join(b, "k").collect())


@pytest.mark.parametrize("rank_all", [True, False])
def test_ranks_from_counts_against_a_sort_of_each_group(spark, rank_all):
    from vinctum.operators.ranking import rank_with_rejected

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None]), f"p{i}", rng.choice([0.2, 0.2, 0.1, 0.5, 0.9, None]), int(rng.random() < 0.2)) for i in range(300)] + [("d", "p1", 0.2, 1)]
    df = spark.createDataFrame(rows, "b_id string, p_id string, score double, n_contradictions int")
    out = rank_with_rejected(df, 8, rank_all=rank_all)
    assert "Window [row_number" not in "".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "windowspecdefinition(b_id" in x and "_s" not in x)
    want = set()
    for g in ("a", "b", "c", "d", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[2] if r[2] is not None else -9), r[1]))
        want |= {(g, r[1], n if rank_all or n <= 8 else None) for n, r in enumerate(mine, 1) if n <= 8 or r[3]}
    got = [(r.b_id, r.p_id, r["rank"]) for r in out.collect()]
    # of the scores that hold the eighth, all contradicted rows are numbered
    assert len(got) == len(want) and {(g, p, n if rank_all or (n or 9) <= 8 else None) for g, p, n in got} == want


def test_an_event_gets_the_newest_of_many_equal_spans(spark):
    import datetime as dt

    from vinctum.operators import intervals

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    v = spark.createDataFrame([("s", i, day(i % 3), day(9) if i % 2 else None) for i in range(500)], "source string, policy int, a date, b date")
    e = spark.createDataFrame([(i, "s" if i % 5 else None, day(i % 12) if i % 7 else None) for i in range(100)], "id int, source string, day date")
    spans = []
    whole = intervals.in_force_at
    try:
        intervals.in_force_at = lambda events, at, versions, *a, **k: spans.append((events.count(), versions.count())) or whole(events, at, versions, *a, **k)
        got = {r.id: r.policy for r in intervals.policy_at(e, "day", v, ["source"], "a", "b").collect()}
    finally:
        intervals.in_force_at = whole
    assert spans == [(12, 6)] and len(got) == 100
    for i in range(100):
        held = [(k % 3, k) for k in range(500) if i % 5 and i % 7 and k % 3 <= i % 12 and (k % 2 == 0 or i % 12 < 9)]
        assert got[i] == (max(held)[1] if held else None)


def test_similar_names_compare_classes_of_names(spark):
    from vinctum.operators import search

    names = [None, "Ana Luna", "ANA luna", "Ana Lunas", "Berta", "", "Ana Luna"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {(r.query_id, r.id): round(r.similarity, 6) for r in search.similar_pairs(df, "id", "name", "id in (1, 4)", 0.7).collect()}
    assert {k for k, s in got.items() if s == 1} == {(1, 1), (1, 2), (1, 6), (4, 4)} and set(got) == {(1, 1), (1, 2), (1, 3), (1, 6), (4, 4)}
