"""Patterns over long texts: what is looked up as plain text finds what the pattern finds, and each text is read once."""

import random
import re

from pyspark.sql import functions as F

from vinctum.functions import detect, vocab
from vinctum.functions.text import tone_keywords
from vinctum.operators import matching

PATTERNS = [p for _, _, _, ps in vocab.SIGNALS for p in ps or []] + [p for _, p in vocab.TONES + vocab.SHORT_TONES] + [vocab.TRIGGERS, vocab.BENEFITS, vocab.RISK_WORDS, "(ab|c)", "(ab)?", "(ab|cd)x", "a|(b|c)d", "ab?c", r"a\.b", r"(\$|peso)?\d"]


def test_matches_are_those_of_the_pattern(spark):
    rng = random.Random(5)
    words = sorted({w for p in PATTERNS for w in re.findall(r"[a-záéíóúñ]+|\$", re.sub(r"\[(.)(.)\]", lambda m: rng.choice(m.groups()), p.replace(r"\s", " ").replace(r"\b", " ")))})
    texts = ["", "abx", "abc", "ac", "a.b", "axb", "cdx", "cx", "medico", "enfermería", "trébol", "un búho", "búhos", "_ninja", "x q", "ax q", "x  q", "$ 12345", "pesos1234", "pesos 123"]
    texts += ["".join(rng.choice([w, w, w[:-1], w + "s"]) + rng.choice([" ", " ", "  ", "\n", "", "9"]) for w in rng.choices(words, k=rng.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, low string")
    got = df.select("i", *[detect.matches(F.col("low"), p).alias(f"p{k}") for k, p in enumerate(PATTERNS)]).orderBy("i").collect()
    for row in got:
        assert [row[f"p{k}"] for k in range(len(PATTERNS))] == [bool(re.search(p, texts[row["i"]], re.A if r"\b" in p else 0)) for p in PATTERNS], texts[row["i"]]


def test_plain_alternatives_need_no_pattern(spark):
    df = spark.createDataFrame([("a", "x")], "text string, low string")
    plan = lambda col: df.select(col.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    for p in (vocab.BENEFITS, "(m[eé]dico|enfermer[oa]|enfermer[ií]a)", vocab.TONES[0][1]):
        assert "RLIKE" not in plan(detect.matches(F.col("low"), p))
    assert detect.needed(r"\bb[uú]ho\b") == (["buho", "búho"], False) and detect.needed(r"(\$|pesos)\s*\d{4,}") == (["$", "pesos"], False)


def test_salaries_begin_where_the_whole_pattern_finds_them(spark):
    texts = ["sueldo $ 70000 mensual", "pesos\n\n80 mil", "m p $$ 90000", "x1 y 90000", "MXN70,000.", "70 MIL por semana", "gana cuanto 5", "16000 semanal", "nada", "$", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    hits = {r["i"]: [h.evidence for h in r.hits if h.id == "salario_inusual"] for r in detect.offer_signals(df, "text").collect()}
    assert hits == {0: ["$ 70000 mensual (inusual)"], 1: ["pesos\n\n80 mil (inusual)"], 2: ["$ 90000 (inusual)"], 3: [], 4: ["MXN70,000. (inusual)"], 5: ["70 MIL por semana (inusual)"], 6: ["gana lo que quieras (vago)"], 7: ["16000 semanal (semanal muy alto)"], 8: [], 9: [], 10: []}


def test_texts_of_cases_are_searched_once(spark):
    cases = spark.createDataFrame([(i, "urgente pago" if i % 2 else "nada") for i in range(20)], "case_id long, text string")
    patterns = spark.createDataFrame([(1, ["urgency", "payment_request"], 3)], "pattern_id long, keywords array<string>, scraped_at long")
    out = matching.match_patterns(cases, patterns)
    assert "urgente" not in out._jdf.queryExecution().optimizedPlan().toString()  # the texts' patterns are in no plan that reads their keywords
    assert sorted(r.case_id for r in out.collect()) == list(range(1, 20, 2))
    again = matching.match_patterns(matching.case_tones(cases), patterns)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    assert cases.select(tone_keywords("text").alias("k")).distinct().count() == 2
