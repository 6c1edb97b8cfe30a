"""Centroid clustering, substring dedup and the filter audit against plain Python on small tables."""

import math
import random
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest

from vinctum.llm import filter_audit, shallot, substring_dedup

# --- 11 centroids


def _lloyd(rows, k=8, rounds=10, seed=3, dims=64):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(1024 * x) if abs(x) < 2.0**52 else int(x) * 1024 for x in v]))
    cents = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, sha256(f"{seed}:{r[0]}".encode()).hexdigest(), ",".join(map(str, r[1]))))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        cents = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if groups[j] else c for j, c in enumerate(cents)]
    found = [(i, *near(v)) for i, v in kept]
    sums = Counter()
    for _, d, j in found:
        sums[j] += d
    top = (1 << 63) - 1
    return sorted((i is None, i or 0, j, min(d, top), min(sums[j], top), min(sum(sums.values()), top), sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in found)


def _clusters(spark, rows, parts=3, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string").repartition(parts)
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in shallot.report(df, **options).collect())


def test_clusters_against_lloyd(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 0.3, (12, 64))
    rows = [(i, (centers[i % 12] + rng.normal(0, 0.1, 64)).tolist(), "x") for i in range(300)]
    rows += [(300 + i, rows[i % 3][1], "x") for i in range(60)]  # equal vectors
    rows += [(5, rows[5][1], "x"), (5, rows[6][1], "x"), (None, rows[7][1], "x"), (None, rows[7][1], "x")]
    bad = [(900, None, "x"), (901, [], "x"), (902, [0.5] * 63, "x"), (903, [0.5] * 65, "x"), (904, [float("nan"), *[0.5] * 63], "x"), (905, [float("inf"), *[0.5] * 63], "x"), (906, [None, *[0.5] * 63], "x")]
    assert _clusters(spark, rows + bad) == _lloyd([r[:2] for r in rows + bad])


@pytest.mark.parametrize("n", [0, 1, 5])
def test_clusters_of_few_vectors(spark, n):
    rows = [(i, [i / 7.0] * 64, "x") for i in range(n)]
    assert _clusters(spark, rows) == _lloyd([r[:2] for r in rows])


def test_clusters_with_ties_and_huge_components(spark):
    rng = random.Random(2)
    grid = [(i, [float(rng.randint(-1, 1)) if j < 3 else 0.0 for j in range(64)], "x") for i in range(120)]
    assert _clusters(spark, grid) == _lloyd([r[:2] for r in grid])
    huge = grid[:20] + [(200 + i, [rng.choice([1e300, -3.5e18, 2.0**53 + 2, 1e5]), *[rng.random()] * 63], "x") for i in range(12)]
    assert _clusters(spark, huge) == _lloyd([r[:2] for r in huge])


def test_bounds_spare_distances_but_not_results():
    rng = np.random.default_rng(3)
    centers = rng.integers(-900, 900, (16, 8))
    x = centers[rng.integers(0, 16, 3000)] + rng.integers(-120, 120, (3000, 8))
    cents = [c.tolist() for c in x[:16]]
    state, now, counted = None, shallot.Round(cents), []
    for _ in range(8):
        calls = []
        plain = now.squared
        now.squared = lambda a, to, plain=plain, calls=calls: (calls.append(len(a)), plain(a, to))[1]
        state = now.assign(x, state)
        counted.append(sum(calls))
        d = ((x[:, None, :] - np.array(cents)[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        two = np.sort(d, axis=1)[:, :2]
        assert (state[2] ** 2 >= two[:, 0] * (1 - 1e-9)).all() and (state[3] ** 2 <= two[:, 1] * (1 + 1e-9)).all()
        means = [(x[state[0] == j].sum(0) // (state[0] == j).sum()).tolist() if (state[0] == j).any() else c for j, c in enumerate(cents)]
        moves = [math.dist(a, b) for a, b in zip(cents, means)]
        cents, now = means, shallot.Round(means, moves)
    assert counted[0] == 16 * 3000 and counted[-1] < 0.25 * counted[0]


# --- 12 substring dedup


def _passages(rows, n):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {i + k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(n)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d is None, d or 0, len(w), len(gone), sha256(kept).hexdigest()))
    return sorted(out)


def _texts(rng, n=40):
    vocab = [f"w{i}" for i in range(400)] + ["Ab", "ab", "é", " x"]
    say = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared = [say(rng.randint(30, 60)) for _ in range(4)]
    out = []
    for _ in range(n):
        w = say(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            at = rng.randint(0, 8)
            w += p[at : at + rng.randint(30, 60)] + say(rng.randint(0, 12))
        out.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(w))
    return out


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 300}, {"chunk_bytes": 900}])
def test_passages_against_brute_force(spark, options):
    rows = list(enumerate(_texts(random.Random(4))))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (None, rows[4][1]), (102, None), (103, ""), (104, " \n "), (105, "a b " * 60), (106, "one " * 34), (107, " ".join(rows[5][1].split()).upper())]
    got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **options).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == _passages(rows, 35)
    assert all(sum(s.end - s.first for s in r.spans) == r.n_removed for r in got)


def test_passages_of_other_lengths_and_an_empty_table(spark):
    rows = [(1, "a b c d e f g"), (2, "x c d e f y"), (3, "c d e z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 2, 3, 4, 5):
        got = substring_dedup.repeats(df, window=n, chunk_bytes=8).collect()
        assert sorted((False, r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == _passages(rows, n)
    assert substring_dedup.repeats(df.limit(0)).count() == 0


def test_a_long_text_is_hashed_in_pieces(monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE_BYTES", 64)
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 50)}" for _ in range(n)).encode() for n in (300, 0, 7, 120)] + [b"x" * 500]
    hasher = substring_dedup.Words(fold=False)
    parted = substring_dedup.Runs(texts, hasher)
    assert list(list(b for _, b in g) for g in substring_dedup._pieces(texts, 1 << 20)) == [texts]
    whole, owner, _ = hasher.of(texts)
    assert (parted.hash == whole).all() and (parted.cuts == np.searchsorted(owner, np.arange(6))).all()


def test_cut_keeps_columns_and_clashing_names(spark):
    passage = " ".join(f"p{i}" for i in range(35))
    rows = [(1, f"alpha  {passage}\nomega", 7, "k", "s"), (2, passage, 8, "k", "s"), (3, "un  touched\n", 9, "k", "s"), (4, None, None, "k", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, _k0 string, spans string")
    out = {r.doc_id: tuple(r) for r in substring_dedup.cut(df).collect()}
    assert out == {1: (1, "alpha omega", 11, "k", "s"), 2: (2, "", 0, "k", "s"), 3: rows[2], 4: rows[3]}


# --- 13 filter audit


def _audit(docs, labels):
    first, marks = {}, defaultdict(lambda: [False, False])
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, q, x in labels:
        if d is not None:
            marks[d] = [marks[d][0] or q == 1, marks[d][1] or x == 1]
    rows = []
    for d, t, s in docs:
        t = t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > first[t]}
        rows.append((s or "", fails, *(marks[d] if d is not None else (False, False))))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed = {(o, i): [r for r in mine if r[1][f] and not any(r[1][g] for g in o[:i])] for o in permutations("ABCDE") for i, f in enumerate(o)}
        shares = Counter()
        for (o, i), gone in removed.items():
            shares[o[i]] += len(gone)
        for (o, i), gone in removed.items():
            f = o[i]
            failing = [r for r in mine if r[1][f]]
            kept = sum(not any(r[1][g] for g in o[: i + 1]) for r in mine)
            out.append((part, "".join(o), i + 1, kept, len(gone), len(failing) - len(gone), sum(sum(r[1].values()) == 1 for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone), shares[f]))
    return sorted(out)


def _documents(rng, n=120):
    base = [" ".join(rng.choice(["Word", "word", "other", f"t{i}"]) + (rng.choice(["", "#", "$", "é"]) if rng.random() < 0.02 else "") for i in range(rng.choice([0, 3, 49, 50, 80]))) for _ in range(50)]
    return [(rng.choice([None, i, i, i, i]), rng.choice([None, *base]), rng.choice([None, "", "web", "books"])) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"max_bits": 4}, {"broadcast_bytes": 0}])
def test_audit_against_every_order(spark, options):
    rng = random.Random(6)
    docs = _documents(rng)
    docs += [docs[0], docs[5], (7, docs[5][1], "web"), (7, "same", "a"), (7, "same", "b"), (8, "same", "a")]
    labels = [(rng.choice([None, i]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(60)] + [(7, 1, 0), (7, 0, 1)]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, source string, mask string").repartition(4)
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **options)
    assert sorted(tuple(r) for r in got.collect()) == _audit(docs, labels)


def test_audit_of_empty_tables_and_clashing_hashes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, "a", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    want = _audit([(1, "a", "s"), (2, "b", "s"), (3, "a", "s")], [])
    assert sorted(tuple(r) for r in filter_audit.audit(docs, labels).collect()) == want
    # all texts share their hashes: full texts still tell them apart
    monkeypatch.setattr(filter_audit, "text_hashes", lambda text: (filter_audit.F.lit(1).cast("long"), filter_audit.F.lit(2).cast("long")))
    assert sorted(tuple(r) for r in filter_audit.audit(docs, labels).collect()) == want


def test_sketch_clears_unique_texts_and_no_repeats(spark):
    rows = filter_audit.flags(spark.createDataFrame([(i, f"text {i % 900}", "s") for i in range(1000)], "doc_id long, text string, source string").repartition(6))
    maybe = {r.doc_id for r in filter_audit.possible_repeats(rows, 16).collect()}
    assert {*range(100), *range(900, 1000)} <= maybe and len(maybe) < 230
