"""Names that are alike."""

import random


def test_similar_names_meet_once_and_are_compared_there(spark, monkeypatch):
    from vinctum.operators import search

    rng = random.Random(4)
    names = ["Customer#" + "".join(rng.choices("012", k=6)) for _ in range(150)] + [None, "", "customer#000000"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    out = search.similar_pairs(df, "id", "name", "id % 10 = 0", 0.6)
    got = {(r.query_id, r.id): round(r.similarity, 9) for r in out.collect()}
    grams = lambda x: {t[i : i + 3] for t in ["  " + x.lower() + " "] for i in range(len(t) - 2)}
    sets = [None if x is None else grams(x) for x in names]
    want = {(i, j): round(len(a & b) / len(a | b), 9) for i, a in enumerate(sets) for j, b in enumerate(sets) if i % 10 == 0 and a and b and len(a & b) >= 0.6 * len(a | b)}
    assert got == want and out.count() == len(want)
    written, write = {}, search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: written.setdefault(name, df) and write(df, name))
    search.similar_pairs(df, "id", "name", "id % 10 = 0", 0.6)
    plan = written["similar-classes"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join ") == 1  # pairs are neither made distinct nor joined again
