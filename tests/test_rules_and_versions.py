"""Versions in force, counts without pairs, nested schemas, marks of letters, roles and sources, against plain Python."""

import datetime as dt
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from vinctum.functions import json_schema, text
from vinctum.operators import aggregate, govern, intervals, matching
from vinctum.operators import personas as B


def _day(n):
    return None if n is None else dt.date(2024, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("step", [1, 7, 400])
def test_versions_in_force_against_every_pair(spark, step):
    rng = random.Random(step)
    events = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, *range(-5, 90)])) for i in range(200)]
    versions = [(rng.choice("abd"), k, rng.choice([None, *range(-50, 80)]), rng.choice([None, *range(-40, 120)])) for k in range(60)]
    e = spark.createDataFrame([(i, k, _day(d), "x") for i, k, d in events], "id long, source string, day date, _slot string").withColumnRenamed("_slot", "note")
    v = spark.createDataFrame([(s, k, _day(a), _day(b)) for s, k, a, b in versions], "source string, version int, since date, until date")
    got = {r.id: [x.version for x in r.held] for r in intervals.in_force_at(e, "day", v, ["source"], "since", "until", step_days=step, name="held").collect()}
    assert len(got) == 200
    for i, k, d in events:
        want = [(a, n) for s, n, a, b in versions if d is not None and s == k and a is not None and a <= d and (b is None or b > d)]
        assert got[i] == [n for a, n in sorted(want, key=lambda x: (-x[0], -x[1]))]
    newest = {r.id: r.version for r in intervals.policy_at(e, "day", v, ["source"], "since", "until", step_days=step).collect()}
    assert newest == {i: (x[0] if x else None) for i, x in got.items()}
    assert intervals.in_force_at(e.limit(0), "day", v, ["source"], "since", "until").count() == 0 and all(not r.in_force for r in intervals.in_force_at(e, "day", v.limit(0), ["source"], "since", "until").collect())


def test_no_range_join_and_no_product_in_the_plans(spark):
    e = spark.createDataFrame([(1, "a", _day(1))], "id long, source string, day date")
    v = spark.createDataFrame([("a", 1, _day(0), None)], "source string, version int, since date, until date")
    p, b = _people(spark, random.Random(1), 5), _bodies(spark, random.Random(1), 5)
    # the joins without a key are those with a table of one row: the events' span, the distinct sexes (twice in the counts, which are read once more for both rules) and ages
    for df, most in ((intervals.in_force_at(e, "day", v, ["source"], "since", "until"), 1), (B.reason_counts(p, b), 7)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        loops = [x for x in plan.split("\n") if "BroadcastNestedLoopJoin" in x]
        assert "Cartesian" not in plan and len(loops) <= most


def _people(spark, rng, n):
    date = lambda: rng.choice([None, "", "2020-01-05", "2020-02-01", "2021-03-09", "2/30/1995"])
    rows = [(f"p{i}", rng.choice(["HOMBRE", "Mujer", "", None, "X"]), rng.choice([None, *range(0, 100, 7)]), "", "", "E", date(), date()) for i in range(n)]
    return spark.createDataFrame(rows, "id_victimadirecta string, sexo string, edad int, sana_particular string, media_filiacion string, estado string, fecha_percato string, fecha_hechos string")


def _bodies(spark, rng, n):
    rows = [(f"b{i}", rng.choice(["HOMBRE", "MUJER", None]), rng.choice([None, 10, 40, 60]), rng.choice([None, 20, 45, 61]), 170, "", "E", rng.choice(["", "2020-01-05", "2020-06-01", "2022-01-01"])) for i in range(n)]
    return spark.createDataFrame(rows, "codigo string, sexo string, edad_min int, edad_max int, estatura_cm int, sana_particular string, estado string, fecha_hallazgo string")


@pytest.mark.parametrize("flags", [{}, {"block_on_sex": False}, {"block_on_time": False}, {"age_margin": 0}])
def test_reason_counts_against_all_pairs(spark, flags):
    cfg = B.MatchConfig(**flags)
    p, b = _people(spark, random.Random(2), 60), _bodies(spark, random.Random(3), 40)
    pairs = B.block_reason(B.tidy_personas(p).crossJoin(B.tidy_bodies(b)), cfg)
    want = {r.reason: r["count"] for r in pairs.groupBy(F.coalesce("block_reason", F.lit("ok")).alias("reason")).count().collect()}
    assert {r.reason: r.n for r in B.reason_counts(p, b, cfg).collect()} == want
    assert B.reason_counts(p.limit(0), b, cfg).count() == 0


def test_ordered_pairs_of_ties(spark):
    left = spark.createDataFrame([("k", x, n) for x, n in ((1, 2), (3, 5), (3, 1), (None, 9))], "k string, x int, n long")
    right = spark.createDataFrame([("k", 3, 4), ("k", 2, 10), ("other", 0, 7)], "k string, x int, n long")
    assert intervals.ordered_pairs(left, right, ["k"], "x", "n").first().n == 6 * 10 and intervals.paired(left, right, ["k"], "n").first().n == 17 * 14


def test_counts_of_several_groupings(spark):
    rows = [("a", 1), ("a", None), (None, 1), ("b", 2), ("a", 1)]
    got = {tuple(r) for r in aggregate.grouped_counts(spark.createDataFrame(rows, "s string, y int"), [("s",), ("y",), ("s", "y"), ()]).collect()}
    assert got == {(0, "a", None, 3), (0, "b", None, 1), (1, None, 1, 3), (1, None, 2, 1), (2, "a", 1, 2), (2, "b", 2, 1), (3, None, None, 5)}


OFFER = {"is_job_offer": True, "risk_signals": ["x"], "confidence": 0.5, "privacy_level": "internal"}
EVENT = {"event_type": "otro", "estado": "E", "municipio": "M", "confidence": 1, "privacy_level": "restricted"}


def test_every_rule_of_both_documents(spark):
    without = lambda d, k: {x: v for x, v in d.items() if x != k}
    cases = [("offer", OFFER, []), ("event", EVENT, []), ("offer", '{"is', ["$: not JSON"]), ("event", None, ["$: not JSON"]), ("offer", [1], ["$: not object"]), ("event", "7", ["$: not object"])]
    for name, doc, schema in (("offer", OFFER, json_schema.FAKE_JOB_OFFER), ("event", EVENT, json_schema.SOCIAL_RISK_EVENT)):
        cases += [(name, without(doc, k), [f"$.{k}: missing"]) for k in schema["required"]]
        wrong = {"string": 7, "boolean": "yes", "number": "1", "array": "x"}
        cases += [(name, doc | {k: wrong[r["type"]]}, [f"$.{k}: not {r['type']}"] + ([f"$.{k}: not allowed"] if False else [])) for k, r in schema["properties"].items()]
        cases += [(name, doc | {k: None}, [f"$.{k}: not {r['type']}"]) for k, r in schema["properties"].items()]
        cases += [(name, doc | {k: ["a", 1, None]}, [f"$.{k}[1]: not string", f"$.{k}[2]: not string"]) for k, r in schema["properties"].items() if r["type"] == "array"]
        cases += [(name, doc | {k: "other"}, [f"$.{k}: not allowed"]) for k, r in schema["properties"].items() if "enum" in r]
        cases += [(name, doc | {"confidence": x}, [f"$.confidence: {y}"]) for x, y in ((-0.1, "too small"), (1.5, "too large"), (12, "too large"))]
        cases += [(name, doc | {"z": 1, "b": {}}, ["$.b: unknown", "$.z: unknown"])]
    df = spark.createDataFrame([(i, n, d if isinstance(d, str) or d is None else json.dumps(d)) for i, (n, d, _) in enumerate(cases)], "i int, name string, doc string")
    out = df.withColumn("v", F.when(F.col("name") == "offer", json_schema.violations("doc", json_schema.FAKE_JOB_OFFER)).otherwise(json_schema.violations("doc", json_schema.SOCIAL_RISK_EVENT)))
    got = {r.i: r.v for r in out.collect()}
    for i, (_, doc, want) in enumerate(cases):
        assert got[i] == want, doc


def test_nested_objects_and_arrays_of_objects(spark):
    schema = {"type": "object", "properties": {"who": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 2, "pattern": "^[A-Z]"}, "age": {"type": ["integer", "null"], "minimum": 0}}, "additionalProperties": False}, "marks": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["side"], "properties": {"side": {"enum": ["l", "r"]}}}}}}
    docs = [{"who": {"name": "Ana", "age": None}, "marks": [{"side": "l"}]}, {"who": {"age": 1.5, "x": 1}}, {"who": {"name": "a"}, "marks": [{"side": "z"}, 3, {}]}, {"marks": []}, {"who": {"name": "Bo", "age": -1}}]
    got = [r.v for r in spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, d string").withColumn("v", json_schema.violations("d", schema)).orderBy("i").collect()]
    assert got == [[], ["$.who.name: missing", "$.who.age: not integer or null", "$.who.x: unknown"], ["$.who.name: too short", "$.who.name: no match", "$.marks[0].side: not allowed", "$.marks[1]: not object", "$.marks[2].side: missing"], ["$.marks: too few"], ["$.who.age: too small"]]


def test_marks_go_as_in_decomposition(spark):
    chars = [chr(x) for x in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), 0x212A, 0x212B)] + ["ő", "ř", "ş", "ş", "ő", "ñ", "ẹ́", "ß", "я", "й", "Ω"]
    plain = lambda t: "".join(x for x in unicodedata.normalize("NFD", t) if not "̀" <= x <= "ͯ")
    df = spark.createDataFrame([(x,) for x in chars], "t string")
    for r in df.withColumn("u", text.without_marks("t")).collect():
        want = plain(r.t)
        assert r.u == (want if want.isascii() else "".join(x for x in r.t if not "̀" <= x <= "ͯ"))
    got = spark.createDataFrame([("Dvořák Erdős Şişli niño Ǻb",)], "t string").select(text.tokens_ascii("t").alias("w")).first().w
    assert got == ["dvorak", "erdos", "sisli", "nino", "ab"]


def test_roles_see_their_columns_and_rows(spark):
    df = spark.createDataFrame([(1, "a", 19.43, "555"), (2, "b", 20.68, "556")], "k int, region string, lat double, phone string")
    policies = {"liaison": govern.RolePolicy(("k", "lat"), "region = 'a'", (("lat", "round(lat, 0)"),)), "admin": govern.RolePolicy(("k", "region", "lat", "phone"))}
    view, audit = govern.role_view(df, "liaison", policies, "sites", "2024-01-01")
    assert [tuple(r) for r in view.collect()] == [(1, 19.0)] and audit.first().action == "accessed" and "phone" not in view._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
    assert govern.role_view(df, "admin", policies, "sites", "2024-01-01")[0].count() == 2
    with pytest.raises(govern.AccessDenied) as e:
        govern.role_view(df, "public", policies, "sites", "2024-01-01")
    assert e.value.audit.first().action == "access_denied"


def test_only_allowed_sources_are_published(spark):
    events = spark.createDataFrame([("s1", "E", "M", "k", 0.9, "approved", "public")] * 3 + [("s2", "E", "M", "k", 0.9, "approved", "public")] * 3 + [(None, "E", "M", "k", 0.9, "approved", "public")], "source string, estado string, municipio string, kind string, confidence double, review string, privacy string")
    sources = spark.createDataFrame([("s1", True, _day(0), None), ("s1", True, _day(0), _day(90)), ("s2", False, _day(0), None), ("s2", True, _day(50), None)], "source string, allowed boolean, valid_from date, valid_to date")
    at = lambda d: [r.n for r in govern.publishable(events, k=1, sources=sources, at=d).collect()]
    assert at("2024-01-10") == [3] and at("2024-03-10") == [6] and at("2023-01-01") == [] and govern.publishable(events, k=1).first().n == 7


def test_only_the_newest_patterns_are_known(spark):
    patterns = [(i, ["urgency", "payment_request"], i % 5) for i in range(30)] + [(90, ["urgency", "payment_request"], None)]
    p = spark.createDataFrame(patterns, "pattern_id long, keywords array<string>, scraped_at long")
    cases = spark.createDataFrame([(1, "urgente: pago de cuota"), (2, "nada"), (3, None)], "case_id long, text string")
    got = [(r.case_id, r.pattern_id) for r in matching.match_patterns(cases, p, limit=8, newest=8).collect()]
    assert sorted(got) == [(1, x) for x in sorted([4, 9, 14, 19, 24, 29, 3, 8])]
    first = [r.pattern_id for r in matching.match_patterns(cases, p, limit=2, newest=500).collect()]
    assert sorted(first) == [4, 9]


def test_location_phrase_folds_case_as_its_sql_does(spark):
    import duckdb

    from vinctum.demo.texts import _LOC
    from vinctum.functions.text import location_phrase

    texts = ["vive en la ciudad última de todas", "COLONIA ÁLAMOS DEL ÑANDÚ, sur", "el eſtado de Puebla", "barrio ſan Karl ÉXITO.", "fracc\x0bLomas verdes", "en\x0bToledo", "colonia Roma\x0bNorte", "en París , Lyon", "municipio de élite", "colonia  ab", "estado dede E", None, ""]
    want = [duckdb.execute(f"SELECT {_LOC} FROM (SELECT ?::VARCHAR AS text)", [t]).fetchone()[0] for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", location_phrase("text").alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == want
