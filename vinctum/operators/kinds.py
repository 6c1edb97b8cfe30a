"""Matcher B by kinds: rows that scoring can't tell apart are one kind, pairs of kinds are scored once, and only what a result asks for becomes pairs of rows.

Personas of a kind may differ in their date and id only. Dates decide nothing but how many of a kind come before a body, so members are kept by date and a pair of kinds has the
first so many of them. A body kind meets all persona kinds in one task; so its scores are counted, and its result numbered, without moving a pair. Where all rows differ a kind is a row.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vinctum.operators import personas as B
from vinctum.operators.dealt import meet
from vinctum.operators.ranking import global_countdown, rank_with_rejected
from vinctum.plans.config import MatchConfig
from vinctum.sources.scratch import materialize

#: About how many members a row of a kind has; a larger kind is dealt into up to _SLOTS such rows.
_MEMBERS = 1024
_SLOTS = 1024
#: About how many pairs of rows a task makes at least, where there are tasks for all, and how many pairs of kinds at most.
_FEW, _MANY = 2_000_000, 16_000_000
#: Up to how many ids of a table are sent to all tasks.
_ROWS = 1_000_000
#: What blocking, scores and texts read.
BLOCKED = (("p_sex", "p_age"), ("b_sex", "b_lo", "b_hi", "b_date"))
SCORED = (BLOCKED[0] + ("p_place", "p_height", "p_set"), BLOCKED[1] + ("b_place", "b_height", "b_set"))
TOLD = (SCORED[0] + ("p_sex_raw", "p_state", "p_marks"), SCORED[1] + ("b_state", "b_marks"))


def _kinds(tidy: DataFrame, same: tuple[str, ...], *members: str) -> DataFrame:
    """Rows that are alike in `same` as one row (a very large kind as several), with their members in order."""
    slot = F.pmod(F.xxhash64(members[-1]), F.lit(_SLOTS)).alias("_slot")
    slots = tidy.groupBy(F.struct(*same).alias("kind"), slot).agg(F.collect_list(F.struct(*members)).alias("_some"))
    rows = F.ceil(F.sum(F.size("_some")).over(Window.partitionBy("kind")) / _MEMBERS)  # over up to _SLOTS rows
    piece = F.pmod("_slot", F.least(rows, F.lit(_SLOTS))).alias("_piece")
    return slots.select("kind", "_some", piece).groupBy("kind", "_piece").agg(F.array_sort(F.flatten(F.collect_list("_some"))).alias("members")).select("kind.*", "members")


def persona_kinds(tidy: DataFrame, same: tuple[str, ...], cfg: MatchConfig) -> DataFrame:
    """Kinds of tidy personas, written: p_date is the first of their dates, p_days has these and p_upto the members up to each; ids and dates of the members are in order of date."""
    rows = tidy.withColumn("p_when", F.col("p_date").isNotNull() if cfg.block_on_time else F.col("p_date"))
    numbers = [x for x in ("p_number",) if x in tidy.columns]
    k = _kinds(rows, (*same, "p_when"), "p_date", *numbers, "p_id").withColumns({"p_date": F.expr("members[0].p_date"), "p_dates": F.expr("members.p_date"), "p_ids": F.expr("members.p_id"), "p_n": F.size("members")})
    k = k.withColumns({f"{x}s": F.expr(f"members.{x}") for x in numbers})
    k = k.withColumn("p_days", F.when(F.col("p_date").isNull(), F.array().cast("array<date>")).otherwise(F.array_distinct("p_dates")))
    return materialize(k.withColumn("p_upto", F.expr("transform(p_days, d -> size(filter(p_dates, x -> x <= d)))")).drop("members", "p_when"), "persona-kinds")


def body_kinds(tidy: DataFrame, same: tuple[str, ...]) -> DataFrame:
    """Kinds of tidy bodies, written, with a number and the ids of their members."""
    k = _kinds(tidy, same, "b_id").select(*same, F.expr("members.b_id").alias("b_ids"), F.size("members").alias("b_n"))
    return materialize(k.withColumn("b_kind", F.monotonically_increasing_id()), "body-kinds")


def kind_pairs(p: DataFrame, b: DataFrame, cfg: MatchConfig, together: bool = True) -> DataFrame:
    """Pairs of kinds that nothing blocks, with n: how many of the personas' members, from the first, the bodies meet.

    together: all pairs of a body kind are in one task, told by k_place. Else the personas are dealt over tasks, so that each writes few ids of them.
    """
    (n, bodies), (m, personas) = b.agg(F.count("*"), F.sum("b_n")).first(), p.agg(F.count("*"), F.sum("p_n")).first()
    tasks = 2 * int(b.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as few keys fill tasks unevenly
    parts = max(1, min(n if together else m, max(ceil(m * n / _MANY), min(tasks, ceil((personas or 0) * (bodies or 0) / _FEW)))))
    sexes = F.broadcast(b.agg(F.array_sort(F.collect_set(F.coalesce("b_sex", F.lit(B._ANY)))).alias("all_sex")))  # the distinct sexes: one row
    place = lambda sex, part: ((F.array_position("all_sex", sex) - 1) * parts + part).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    b = b.join(sexes).withColumn("_part", F.pmod(F.xxhash64("b_kind"), F.lit(parts)) if together else each)
    fit = F.when(F.col("p_sex").isNull() | F.lit(not cfg.block_on_sex), F.col("all_sex")).otherwise(F.array_intersect("all_sex", F.array("p_sex", F.lit(B._ANY))))
    p = p.join(sexes).withColumn("_sex", F.explode(fit)).withColumn("_part", each if together else F.pmod(F.xxhash64("p_ids"), F.lit(parts)))
    b = b.withColumn("k_place", place(F.coalesce("b_sex", F.lit(B._ANY)), F.col("_part"))).drop("all_sex", "_part")
    p = p.withColumn("k_place", place(F.col("_sex"), F.col("_part"))).drop("all_sex", "_sex", "_part")
    met = meet(p, b, ["k_place"], least=3 * parts).where(F.expr(f"({B.reason_sql(cfg)}) IS NULL"))
    first = "CASE WHEN p_date IS NULL OR b_date IS NULL THEN p_n ELSE get(p_upto, size(filter(p_days, d -> d <= b_date)) - 1) END" if cfg.block_on_time else "p_n"
    return met.withColumn("n", F.expr(first))


def all_ids(personas: DataFrame, bodies: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """(p_id, b_id) of all pairs that nothing blocks. Rows of the same kinds lie together, so that a file of them is small."""
    p, b = B.tidy_personas(personas), B.tidy_bodies(bodies)
    pairs = kind_pairs(persona_kinds(p, BLOCKED[0], cfg), body_kinds(b, BLOCKED[1]), cfg, together=False)
    return _expanded(pairs)


def _expanded(pairs: DataFrame, *keep) -> DataFrame:
    """(p_id, b_id, *keep) of the members of pairs of kinds; each body's first personas follow one another, again and again."""
    # outer: else Spark asks for filled arrays before it blocks a pair
    return pairs.select(F.expr("slice(p_ids, 1, n)").alias("p_ids"), F.explode_outer("b_ids").alias("b_id"), *keep).select(F.explode_outer("p_ids").alias("p_id"), "b_id", *keep)


def all_scores(personas: DataFrame, bodies: DataFrame, cfg: MatchConfig = MatchConfig(), keep: str = "true", told: tuple[str, ...] = ("score", "tier", "s_marks", "s_height", "s_age", "s_geo", "s_temporal", "n_contradictions"), texts=lambda df: df) -> DataFrame:
    """p_id, b_id of all pairs that nothing blocks, with what score_numbers gives; keep: a condition on that. texts: a function that adds further columns to scored pairs of kinds; told: the columns to keep."""
    p, b = _tidied(personas, bodies)
    pairs = kind_pairs(persona_kinds(p, SCORED[0], cfg), body_kinds(b, SCORED[1]), cfg, together=False)
    return _expanded(texts(B.score_numbers(pairs, p, b, cfg).where(keep)), *told)


def _tidied(personas: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    return materialize(B.tidy_personas(personas), "tidy-personas"), materialize(B.tidy_bodies(bodies), "tidy-bodies")


def reviewed(personas: DataFrame, bodies: DataFrame, k: int, cfg: MatchConfig = MatchConfig(), rank_all: bool = True, texts: bool = False) -> DataFrame:
    """The rows of rank_with_rejected over all pairs that nothing blocks: b_id, p_id, score, rejected (contradicted), rank; with texts also what pair_texts adds.

    Pairs of kinds are counted by body kind and score first; only those whose score is asked for become rows, which are numbered in the task that makes them. Texts are made of
    pairs of kinds, but for the dates. Bodies that share an id are ranked together, by rows.
    """
    p, b = _tidied(personas, bodies)
    times = materialize(b.groupBy("b_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "repeated-bodies")
    if not times.count():
        return _by_kinds(p, b, k, cfg, rank_all, texts)
    same = b["b_id"].eqNullSafe(times["b_id"])
    again, once = b.join(times.select("b_id"), same, "left_semi"), b.join(times.select("b_id"), same, "left_anti")
    return _by_kinds(p, once, k, cfg, rank_all, texts).unionByName(by_rows(B.candidate_pairs(p, again, cfg), p, again, k, cfg, rank_all, texts))


def by_rows(pairs: DataFrame, p: DataFrame, b: DataFrame, k: int, cfg: MatchConfig, rank_all: bool = True, texts: bool = False) -> DataFrame:
    """What reviewed gives, of tidy pairs."""
    ranked = rank_with_rejected(B.score_numbers(pairs, p, b, cfg), k, rank_all=rank_all).withColumn("rejected", F.col("n_contradictions") > 0)
    return (B.pair_texts(ranked, cfg, "rejected") if texts else ranked).select(*_columns(texts))


def _columns(texts: bool) -> list[str]:
    return ["b_id", "p_id", "score", "rejected", "rank"] + texts * ["tier", "s_marks", "s_height", "s_age", "s_geo", "s_temporal", "evidences", "contradictions"]


def _by_kinds(p: DataFrame, b: DataFrame, k: int, cfg: MatchConfig, rank_all: bool, texts: bool) -> DataFrame:
    numbered = materialize(global_countdown(p, "p_id", "p_id").withColumnRenamed("queue_priority", "p_number"), "numbered-personas")  # by id, from 1
    p_kinds, b_kinds = persona_kinds(numbered, TOLD[0] if texts else SCORED[0], cfg), body_kinds(b, TOLD[1] if texts else SCORED[1])
    sets = materialize(B.score_mark_sets(kind_pairs(p_kinds, b_kinds, cfg), p, b, cfg), "mark-sets")
    scored = lambda q, c: B.score_numbers(kind_pairs(q, c, cfg), p, b, cfg, sets)
    place, against = ["k_place", "b_kind"], F.col("n_contradictions") > 0
    cells = scored(p_kinds.drop("p_ids", "p_dates", "p_numbers", "p_marks"), b_kinds.drop("b_ids", "b_marks")).groupBy(*place, "score").agg(F.sum("n").alias("_n"), F.bool_or(against).alias("_against"))
    above = F.coalesce(F.sum("_n").over(Window.partitionBy(*place).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = cells.withColumn("above", above).where((F.col("above") < k) | (F.col("_against") if rank_all else F.lit(False)))
    asked = asked.groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct("score", F.struct("above", "_against")))).alias("asked")).select("b_kind", "asked")  # a body kind's scores
    known = materialize(b_kinds.drop("b_ids").join(asked, "b_kind"), "asked-kinds")
    chosen = scored(p_kinds, known).withColumn("cell", F.col("asked")[F.col("score")]).withColumns({"above": F.col("cell.above"), "rejected": against}).where(F.col("above").isNotNull() | (F.lit(not rank_all) & against))
    if texts:
        chosen = B.kind_texts(chosen, cfg)
    ids = b_kinds.select("b_kind", F.explode("b_ids").alias("b_id"))
    ids = F.broadcast(ids) if b.count() <= _ROWS else ids
    more = [x for x in _columns(texts) if x not in ("b_id", "p_id", "rank")] + (["b_date"] if texts else [])
    member = F.explode_outer(F.expr("slice(arrays_zip(p_ids, p_dates), 1, n)" if texts else "slice(p_ids, 1, n)"))
    rows = lambda df: df.select(*place, "above", *more, member.alias("m")).withColumn("p_id", F.col("m.p_ids") if texts else F.col("m"))
    first = chosen.where(F.col("above").isNotNull())
    if texts:  # sorted in the task: no row is moved
        ranked = rows(first).withColumn("rank", (F.col("above") + F.row_number().over(Window.partitionBy("b_kind", "score", "k_place").orderBy("p_id"))).cast("int")).where((F.col("rank") <= k) | F.col("rejected"))
    else:
        ranked = _numbered(first, numbered, k)
    if not rank_all:
        ranked = ranked.unionByName(rows(chosen.where(F.col("above").isNull())).withColumn("rank", F.lit(None).cast("int")), allowMissingColumns=True)
    if texts:
        ranked = ranked.withColumn("evidences", F.concat("evidences", F.array_compact(F.array(B.temporal_text(F.col("m.p_dates"))))))
    return ranked.join(ids, "b_kind").select(*_columns(texts))


def _numbered(chosen: DataFrame, personas: DataFrame, k: int) -> DataFrame:
    """Rows of pairs of kinds (b_kind, p_id, score, rejected, rank): the members of a body kind with one score are numbered in one array of their personas' numbers, doubled, and one more if contradicted.

    Where no pair of that score is contradicted, the first k members of each kind are enough.
    """
    mine = F.sort_array(F.expr("slice(p_numbers, 1, n)"))
    some = F.when(F.col("cell._against"), mine).otherwise(F.slice(mine, 1, k))
    coded = F.transform(some, lambda x: x * 2 + F.col("rejected").cast("long")).alias("_some")
    cells = chosen.select("k_place", "b_kind", "score", "above", coded).groupBy("k_place", "b_kind", "score", "above").agg(F.sort_array(F.flatten(F.collect_list("_some"))).alias("_all"))
    rows = cells.select("b_kind", "score", "above", F.posexplode("_all").alias("_at", "_code"))
    rows = rows.select("b_kind", "score", F.shiftright("_code", 1).alias("p_number"), (F.col("_code") % 2 == 1).alias("rejected"), (F.col("above") + F.col("_at") + 1).cast("int").alias("rank")).where((F.col("rank") <= k) | F.col("rejected"))
    names = personas.select("p_number", "p_id")
    return rows.join(F.broadcast(names) if names.count() <= _ROWS else names, "p_number").drop("p_number")
