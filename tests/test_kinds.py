"""Matcher B by kinds against the same by rows."""

import random

import pytest
from pyspark.sql import functions as F

from vinctum.operators import kinds
from vinctum.operators import personas as B
from vinctum.plans.config import MatchConfig

P = "id_victimadirecta string, sexo string, edad int, sana_particular string, media_filiacion string, estado string, fecha_percato string, fecha_hechos string"
C = "codigo string, sexo string, edad_min int, edad_max int, estatura_cm int, sana_particular string, estado string, fecha_hallazgo string"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    pick = rng.choice
    marks = ["TATUAJE LADO IZQUIERDO", "TATUAJE LADO DERECHO", "LUNAR EN CUELLO<br>TATUAJE LADO IZQUIERDO", "NINGUNA", None]
    ps = [(f"P{i}", pick(["HOMBRE", "MUJER", "", None]), pick([20, 30, 70, None]), pick(marks), pick(["ESTATURA: 165", ""]), pick(["X", "x", "Y", None]), pick(["2020-01-01", "2021-01-01", "2022-01-01", None]), None) for i in range(90)]
    bs = [(f"C{i if i < 17 else 3}", pick(["HOMBRE", "MUJER", None]), pick([18, 25, None]), pick([30, 40]), pick([165, 180, None]), pick(marks), pick(["X", "Y", None]), pick(["2020-06-01", "2021-06-01", None])) for i in range(19)]
    return spark.createDataFrame(ps, P).cache(), spark.createDataFrame(bs, C).cache()


def rows(df):
    return sorted(repr([x if not isinstance(x, float) else round(x, 9) for x in r]) for r in df.select(*sorted(df.columns)).collect())


def numbers(p, b, cfg):
    return B.score_numbers(B.candidate_pairs(p, b, cfg), p, b, cfg).select("p_id", "b_id", "score", "tier", "s_marks", "s_height", "s_age", "s_geo", "s_temporal", "n_contradictions")


@pytest.mark.parametrize("cfg", [MatchConfig(), MatchConfig(block_on_time=False, block_on_sex=False)])
@pytest.mark.parametrize("rank_all, texts", [(True, False), (False, True)])
def test_reviewed_by_kinds_and_by_rows(spark, tables, monkeypatch, cfg, rank_all, texts):
    monkeypatch.setattr(kinds, "_MEMBERS", 2)
    p, b = B.tidy_personas(tables[0]), B.tidy_bodies(tables[1])
    want = kinds.by_rows(B.candidate_pairs(p, b, cfg), p, b, 3, cfg, rank_all, texts)
    got = kinds.reviewed(*tables, 3, cfg, rank_all, texts)
    # beyond the third score without rank_all: numbered or not
    plain = lambda df: df.withColumn("rank", F.when(F.lit(rank_all) | (F.col("rank") <= 3), F.col("rank")))
    assert rows(plain(got)) == rows(plain(want))


def test_all_pairs_by_kinds_and_by_rows(spark, tables, monkeypatch):
    monkeypatch.setattr(kinds, "_MEMBERS", 2)
    cfg = MatchConfig()
    assert rows(kinds.all_scores(*tables)) == rows(numbers(*tables, cfg))
    assert rows(kinds.all_ids(*tables)) == rows(B.candidate_pairs(*tables).select("p_id", "b_id"))


def test_rows_that_are_alike_are_scored_once(spark, monkeypatch):
    p = spark.createDataFrame([(f"P{i}", "HOMBRE", 30, "TATUAJE LADO IZQUIERDO", "ESTATURA: 165", "X", f"2020-01-0{1 + i % 9}", None) for i in range(60)], P)
    b = spark.createDataFrame([(f"C{i}", "HOMBRE", 25, 35, 165, "TATUAJE LADO DERECHO", "X", "2020-01-05") for i in range(7)], C)
    met, score = [], B.score_numbers
    monkeypatch.setattr(B, "score_numbers", lambda pairs, *a: met.append(pairs.count()) or score(pairs, *a))
    out = kinds.reviewed(p, b, 8).collect()
    assert len(out) == 7 * 35 and sorted(r["rank"] for r in out if r.b_id == "C1") == list(range(1, 36))
    assert met and max(met) == 1
