"""Whole plans: record linkage (matcher A) and persona linkage (matcher B), from tidy tables to ranked, verified candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinctum.functions.text import build_features
from vinctum.operators import kinds
from vinctum.operators import personas as B
from vinctum.operators import ranking
from vinctum.operators import records as A
from vinctum.operators.vectors import retrieve
from vinctum.sources.scratch import materialize

from .config import MatchConfig, RecordConfig


def rate_records(records: DataFrame, adjacency: DataFrame, cfg: RecordConfig = RecordConfig(), missing_id: str | None = None, found_id: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """All blocked pairs with field scores and overall score; no texts are made. Sets of marks are scored once for each pair of different sets that meets.

    missing_id, found_id: only pairs of this record on a side, chosen before any pair is made. extra: further columns of the records to keep.
    """
    return _rated(*_marked_pairs(records, adjacency, cfg, missing_id, found_id, extra), cfg)


def _rated(pairs: DataFrame, marks: DataFrame, on: tuple[str, ...], cfg: RecordConfig) -> DataFrame:
    return A.overall(A.score_fields(pairs, marks, on), cfg).drop(*on)


def _marked_records(records: DataFrame, missing_id: str | None = None, found_id: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Missing and found records with codes of their sets of marks, and the features of these sets. A record that is asked for is chosen before features are made."""
    mine = lambda kind, i: F.col("record_type").eqNullSafe(kind) & (F.lit(True) if i is None else F.col("id") == i)
    # written: the records may come from joins, and are read by several steps
    chosen = materialize(records.where(mine("missing", missing_id) | mine("unidentified", found_id)), "records")
    features = materialize(build_features(chosen), "features")
    sets = materialize(A.mark_sets(features).withColumnRenamed("record_id", "id"), "mark-sets")
    known = materialize(chosen.join(sets, "id", "left"), "marked-records")
    return known.where("record_type = 'missing'"), known.where("record_type = 'unidentified'"), features.join(sets.select(F.col("marks_of").alias("record_id")).distinct(), "record_id", "left_semi")


def _marked_pairs(records: DataFrame, adjacency: DataFrame, cfg: RecordConfig, missing_id: str | None = None, found_id: str | None = None, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """Blocked pairs with codes of their sets of marks, the scores of the sets, written, and the columns that both have. Where the sets are few enough to score all pairs of them, that is one number."""
    missing, found, features = _marked_records(records, missing_id, found_id)
    near = A.adjacency_closure(adjacency)
    codes = A.coded_sets(missing, found)
    if codes is None:
        pairs = A.block_pairs(missing, found, near, cfg, extra=("marks_of", *extra))
        return pairs, materialize(A.score_marks(pairs, features, missing, found), "mark-scores"), ("m_marks_of", "u_marks_of")
    codes = materialize(codes, "mark-codes")
    coded = lambda df, p: df.join(codes.select(F.col(f"{p}_marks_of").alias("marks_of"), F.col(f"{p}_code").alias("code")).distinct(), "marks_of", "left")
    missing, found = coded(missing, "m"), coded(found, "u")
    marks = materialize(A.score_marks(None, features, missing, found).join(codes, ["m_marks_of", "u_marks_of"]).select((F.col("m_code") + F.col("u_code")).alias("sets"), "s_marks", "best", "opposite"), "mark-scores")
    pairs = A.block_pairs(missing, found, near, cfg, extra=("code", *extra)).withColumn("sets", F.col("m_code") + F.col("u_code")).drop("m_code", "u_code")
    return pairs, F.broadcast(marks), ("sets",)


#: Losses by marks and place (of a whole score of 1) within which the best pairs are looked for, before all pairs are made.
LOSSES = (0.02, 0.07)


def best_rated(records: DataFrame, adjacency: DataFrame, n: int, *ids: Column, cfg: RecordConfig = RecordConfig(), losses: tuple[float, ...] = LOSSES) -> DataFrame:
    """The n pairs of rate_records with the greatest overall score, ties by ids; pairs that can't be among them are not made.

    Marks and place count in every pair, and what they lose of their weights is the least that the score loses. So pairs that lose up to some share by them are made first: where n of
    these have a score that no other pair can reach, they are the result. A loss below that of another place keeps pairs to equal places. Else more, and at last all pairs are made.
    """
    missing, found, features = _marked_records(records)
    near = A.adjacency_closure(adjacency)
    pairs = A.block_pairs(missing, found, near, cfg, extra=("marks_of",))
    marks = materialize(A.score_marks(pairs, features, missing, found), "mark-scores")
    weights = dict(cfg.weights)
    whole = sum(weights.values())
    for loss in losses:
        least = 1 - loss * whole / weights["marks"]
        if least <= 0:  # also sets that have no score, or none at all, would be within the loss
            break
        close = marks.where(F.col("s_marks") >= least - 1e-9)
        same = loss * whole < weights["geo"] * (1 - 0.5) - 1e-9
        some = A.block_pairs(missing, found, near, cfg, extra=("marks_of",), marks=close.select("m_marks_of", "u_marks_of"), same_place=same)
        best = materialize(ranking.top_n(_rated(some, close, ("m_marks_of", "u_marks_of"), cfg), n, "overall_score", *ids), "best")
        # rounded half up: what another pair can reach at most
        if best.where(F.col("overall_score") > A.half_up(F.lit(1 - loss + 1e-9))).count() == n:
            return best.orderBy(F.desc("overall_score"), *ids)
    return ranking.top_n(_rated(pairs, marks, ("m_marks_of", "u_marks_of"), cfg), n, "overall_score", *ids)


def marks_of_pairs(records: DataFrame, adjacency: DataFrame, cfg: RecordConfig = RecordConfig()) -> DataFrame:
    """(m_id, u_id, s_marks, best, opposite) of all blocked pairs with marks of one type; sets of marks are scored once."""
    pairs, marks, on = _marked_pairs(records, adjacency, cfg)
    return pairs.join(marks, list(on)).select("m_id", "u_id", "s_marks", "best", "opposite")


def score_records(records: DataFrame, adjacency: DataFrame, cfg: RecordConfig = RecordConfig(), **options) -> DataFrame:
    """All blocked pairs with field scores, overall score, evidence and tier; options as in rate_records."""
    return A.verify(A.evidence(rate_records(records, adjacency, cfg, **options), cfg), cfg)


def candidates_of(records: DataFrame, adjacency: DataFrame, missing_id: str, found_id: str | None = None, cfg: RecordConfig = RecordConfig()) -> DataFrame:
    """Candidate rows of one missing record, or of it and one found record; no other pair is made."""
    mine = candidates(score_records(records, adjacency, cfg, missing_id=missing_id))
    if found_id is None:
        return mine
    return mine.unionByName(candidates(score_records(records, adjacency, cfg, found_id=found_id)).where(F.col("persona") != missing_id))


def link_records(records: DataFrame, adjacency: DataFrame, top: int = 12, cfg: RecordConfig = RecordConfig()) -> DataFrame:
    """The best candidates overall, for review; only these get evidence."""
    best = best_rated(records, adjacency, top, F.col("m_id"), F.col("u_id"), cfg=cfg)
    return A.verify(A.evidence(best, cfg), cfg)


def best_candidates(records: DataFrame, adjacency: DataFrame, n: int, cfg: RecordConfig = RecordConfig()) -> DataFrame:
    """The n best candidate rows, ties by id; only these get evidence."""
    best = best_rated(records, adjacency, n, F.concat_ws("-", "m_id", "u_id"), cfg=cfg)
    return candidates(A.verify(A.evidence(best, cfg), cfg))


def _told(ranked: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Ranked pairs with texts, given a narrative; `narrated` marks those whose narrative a model may write."""
    return B.narrative(ranked.withColumn("narrated", F.coalesce(F.col("rank") <= cfg.verify_top_n, F.lit(False))).drop("rejected"))


def link_personas(personas: DataFrame, bodies: DataFrame, cfg: MatchConfig = MatchConfig(), rank_all: bool = True) -> DataFrame:
    """Per body the top candidates and every contradicted pair, with a narrative; all personas are compared. rank_all as in rank_with_rejected."""
    return _told(kinds.reviewed(personas, bodies, cfg.top_k, cfg, rank_all, texts=True), cfg)


def link_personas_by_vector(personas: DataFrame, bodies: DataFrame, persona_vectors: DataFrame, body_vectors: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """The same over the retrieve_k personas nearest to a body's vector; vectors are (id, vec). A body without a vector meets all personas."""
    near = materialize(retrieve(body_vectors, persona_vectors, cfg.retrieve_k).select(F.col("query_id").alias("b_id"), F.col("id").alias("p_id")), "retrieved")
    p, b = B.tidy_personas(personas), B.tidy_bodies(bodies)
    rest = bodies.join(near.select(F.col("b_id").alias("codigo")).distinct(), "codigo", "left_anti")
    found = kinds.by_rows(B.retrieved_pairs(p, b, near, cfg), p, b, cfg.top_k, cfg, texts=True)
    return _told(found.unionByName(kinds.reviewed(personas, rest, cfg.top_k, cfg, texts=True)), cfg)


def candidates_for(candidates: DataFrame, bodies: DataFrame, persona_id: str) -> DataFrame:
    """A persona's stored candidates (persona, cuerpo, score, ...) with the body's columns, best first."""
    b = bodies.select(F.col("codigo").alias("cuerpo"), F.col("sexo").alias("cuerpo_sexo"), F.col("estado").alias("cuerpo_estado"), F.col("sana_particular").alias("cuerpo_senas"))
    return candidates.where(F.col("persona") == persona_id).join(b, "cuerpo").orderBy(F.desc("score"), "cuerpo")


def candidates(scored: DataFrame, *extra: str) -> DataFrame:
    """Scored record pairs as candidate rows of the review tables. extra: further columns to keep."""
    return scored.select(F.concat_ws("-", "m_id", "u_id").alias("id"), F.col("m_id").alias("persona"), F.col("u_id").alias("cuerpo"), F.col("overall_score").alias("score"), "tier", F.col("m_estado").alias("estado"), F.col("contradictions"), F.lit("in_review").alias("status"), *extra)
