"""Matcher B: block reasons, mark scores with sides, neutral scores for what can't be compared, narrative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinctum.functions.clean import blank_to_null, height_cm, parse_flex_date, parse_marks, plausible_height
from vinctum.functions.text import mark_struct
from vinctum.operators import intervals as I
from vinctum.operators.dealt import dealt_join
from vinctum.operators.records import half_up
from vinctum.plans.config import MatchConfig
from vinctum.sources.scratch import materialize

_ANY = "∅"
_STEP = 10


def _marks(side: str, marks) -> list:
    """The marks of a row, and a code of what scoring needs of them (null without marks)."""
    what = F.transform(marks, lambda m: F.struct(m["lado"], F.array_sort(m["tokens"])))
    return [marks.alias(f"{side}_marks"), F.when(F.size(marks) > 0, F.struct(F.xxhash64(what).alias("h0"), F.xxhash64(F.lit(1), what).alias("h1"))).alias(f"{side}_set")]


def tidy_personas(p: DataFrame) -> DataFrame:
    """The columns that matching needs; a table that has them already is returned as it is."""
    if "p_id" in p.columns:
        return p
    date = parse_flex_date(F.coalesce(blank_to_null("fecha_percato"), blank_to_null("fecha_hechos")))
    return p.select(F.col("id_victimadirecta").alias("p_id"), F.upper(blank_to_null("sexo")).alias("p_sex"), F.col("sexo").alias("p_sex_raw"), F.col("edad").alias("p_age"), blank_to_null("estado").alias("p_state"), F.upper(blank_to_null("estado")).alias("p_place"), date.alias("p_date"), height_cm("media_filiacion", "b").alias("p_height"), *_marks("p", F.transform(parse_marks("sana_particular"), lambda m: mark_struct(m))))


def tidy_bodies(b: DataFrame) -> DataFrame:
    """The columns that matching needs; a table that has them already is returned as it is."""
    if "b_id" in b.columns:
        return b
    return b.select(F.col("codigo").alias("b_id"), F.upper(blank_to_null("sexo")).alias("b_sex"), F.col("edad_min").alias("b_lo"), F.col("edad_max").alias("b_hi"), blank_to_null("estado").alias("b_state"), F.upper(blank_to_null("estado")).alias("b_place"), parse_flex_date("fecha_hallazgo").alias("b_date"), plausible_height("estatura_cm").alias("b_height"), *_marks("b", F.transform(parse_marks("sana_particular"), lambda m: mark_struct(m))))


def reason_sql(cfg: MatchConfig = MatchConfig()) -> str:
    """The first reason that blocks a pair, or null."""
    m, parts = cfg.age_margin, []
    if cfg.block_on_sex:
        parts.append("WHEN p_sex <> b_sex THEN 'sexo incompatible'")
    if cfg.block_on_time:
        parts.append("WHEN p_date > b_date THEN 'desaparición posterior al hallazgo'")
    return f"CASE {' '.join(parts)} WHEN b_lo IS NOT NULL AND b_hi IS NOT NULL AND (p_age < b_lo - {m} OR p_age > b_hi + {m}) THEN 'edad fuera de rango' END"


def block_reason(pairs: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    return pairs.withColumn("block_reason", F.expr(reason_sql(cfg)))


def _sex_keys(p: DataFrame, b: DataFrame, cfg: MatchConfig) -> DataFrame:
    """p once for each k_sex of the bodies that it is compatible with."""
    sexes = b.agg(F.collect_set(F.coalesce("b_sex", F.lit(_ANY))).alias("all_sex"))  # the distinct sexes: one row
    keys = F.when(F.col("p_sex").isNull() | F.lit(not cfg.block_on_sex), F.col("all_sex")).otherwise(F.array("p_sex", F.lit(_ANY)))
    return p.join(F.broadcast(sexes)).withColumn("k_sex", F.explode(keys)).drop("all_sex")


def reason_counts(personas: DataFrame, bodies: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """(reason, n) over all pairs of both tables, 'ok' where nothing blocks; no pair is made, not even of keys.

    Both sides are counted by sex, date and age; what a reason blocks is a number of ordered pairs: of dates within a sex, and, for both rules at once, of dates within a sex and
    an age. A body counts at each of the personas' distinct ages that it excludes (whole years), so all counts are bounded by the sexes, days and ages, not by the rows.
    """
    p = materialize(tidy_personas(personas).groupBy("p_sex", "p_date", "p_age").agg(F.count(F.lit(1)).alias("n")), "persona-counts")
    b = materialize(tidy_bodies(bodies).groupBy("b_sex", "b_date", "b_lo", "b_hi").agg(F.count(F.lit(1)).alias("n")), "body-counts")
    b = b.withColumn("k_sex", F.coalesce("b_sex", F.lit(_ANY)))
    keyed = _sex_keys(p, b, cfg)
    m = cfg.age_margin
    ages = p.where("p_age IS NOT NULL").agg(F.collect_set("p_age").alias("ages"))  # distinct ages: one row
    excluded = b.where("b_lo IS NOT NULL AND b_hi IS NOT NULL").join(F.broadcast(ages)).withColumn("p_age", F.explode(F.expr(f"filter(ages, a -> a < b_lo - {m} OR a > b_hi + {m})")))
    excluded = excluded.groupBy("k_sex", "b_date", "p_age").agg(F.sum("n").alias("n"))
    rows = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(38,0)").alias("n"))
    none = p.sparkSession.range(1).select(F.lit(0).cast("decimal(38,0)").alias("n"))
    by_date = lambda right, keys: I.ordered_pairs(keyed.withColumnRenamed("p_date", "x"), right.withColumnRenamed("b_date", "x"), keys, "x", "n") if cfg.block_on_time else none
    one = I.one_row(p=rows(p), b=rows(b), met=I.paired(keyed, b, ["k_sex"], "n"), late=by_date(b, ["k_sex"]), old=I.paired(keyed.where("p_age IS NOT NULL"), excluded, ["k_sex", "p_age"], "n"), both=by_date(excluded, ["k_sex", "p_age"]))
    counts = {"sexo incompatible": "p * b - met", "desaparición posterior al hallazgo": "late", "edad fuera de rango": "old - both", "ok": "met - late - old + both"}
    each = F.array(*[F.struct(F.lit(k).alias("reason"), F.expr(f"cast({v} as bigint)").alias("n")) for k, v in counts.items()])
    return one.select(F.inline(each)).where("n <> 0")


def candidate_pairs(personas: DataFrame, bodies: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Tidy pairs that nothing blocks, by a hash join on sex and a ten-year age step, with the rest as a residual."""
    p, b = tidy_personas(personas), tidy_bodies(bodies)
    p = _sex_keys(p, b, cfg).withColumn("k_age", F.when(F.col("p_age").isNull(), -1).otherwise(F.floor(F.least(F.greatest("p_age", F.lit(0)), F.lit(149)) / _STEP).cast("int")))
    m = cfg.age_margin
    steps = f"CASE WHEN b_lo IS NULL OR b_hi IS NULL THEN sequence(0, {150 // _STEP - 1}) ELSE sequence(cast(floor(least(greatest(b_lo - {m}, 0), 149) / {_STEP}) as int), cast(floor(least(greatest(b_hi + {m}, b_lo - {m}, 0), 149) / {_STEP}) as int)) END"
    b = b.withColumn("k_sex", F.coalesce("b_sex", F.lit(_ANY))).withColumn("k_age", F.explode(F.expr(f"concat(array(-1), {steps})")))
    return dealt_join(p, b, ["k_sex", "k_age"], "p_id").where(F.expr(f"({reason_sql(cfg)}) IS NULL")).drop("k_sex", "k_age")


_SIM = "CASE WHEN size(c.tokens) = 0 OR size(p.tokens) = 0 THEN 0D ELSE size(array_intersect(c.tokens, p.tokens)) / size(array_union(c.tokens, p.tokens)) END"
_SIDES = "(c.lado IS NULL OR p.lado IS NULL OR c.lado = p.lado)"


def score_mark_sets(pairs: DataFrame, personas: DataFrame, bodies: DataFrame, cfg: MatchConfig = MatchConfig(), most: int | None = None) -> DataFrame:
    """(b_set, p_set, set_score, set_contradictions) of the different sets of marks that meet in tidy pairs, each scored once; personas and bodies hold them.

    A body mark's similarity to the persona's marks is their token overlap at best; it contradicts where some mark is alike but none of these has
    a side that fits. Where the different sets of both sides make up to `most` (MOST_SETS) pairs, all of these are scored, and the pairs needn't be made for it.
    """
    sets = lambda tidy, s: tidy.where(f"{s}_set IS NOT NULL").select(f"{s}_set", F.transform(f"{s}_marks", lambda m: F.struct(m["lado"].alias("lado"), F.array_sort(m["tokens"]).alias("tokens"))).alias(f"{s}_marks")).distinct()
    b, p = materialize(sets(tidy_bodies(bodies), "b"), "body-sets"), materialize(sets(tidy_personas(personas), "p"), "persona-sets")
    if b.count() * p.count() <= (MOST_SETS if most is None else most):
        met = p.crossJoin(F.broadcast(b))
    else:
        met = pairs.where("b_set IS NOT NULL AND p_set IS NOT NULL").select("b_set", "p_set").distinct().join(b, "b_set").join(p, "p_set")
    per = f"transform(b_marks, c -> transform(p_marks, p -> named_struct('s', {_SIM}, 'fits', {_SIDES})))"
    t = cfg.mark_threshold
    score = "aggregate(sims, 0D, (a, r) -> a + array_max(transform(r, x -> x.s))) / size(sims)"
    against = f"size(filter(sims, r -> exists(r, x -> x.s >= {t}) AND NOT exists(r, x -> x.s >= {t} AND x.fits)))"
    return met.withColumn("sims", F.expr(per)).select("b_set", "p_set", F.expr(score).alias("set_score"), F.expr(against).alias("set_contradictions"))


#: Up to how many scores of sets are sent to the pairs.
MOST_SETS = 1_000_000


def score_numbers(pairs: DataFrame, personas: DataFrame, bodies: DataFrame, cfg: MatchConfig = MatchConfig(), sets: DataFrame | None = None) -> DataFrame:
    """Tidy pairs of personas and bodies with sub-scores, total, score, tier and the number of contradictions; no texts are made. sets: what score_mark_sets gives, written."""
    n = cfg.neutral
    sets = materialize(score_mark_sets(pairs, personas, bodies, cfg), "mark-sets") if sets is None else sets
    sets = F.broadcast(sets) if sets.count() <= MOST_SETS else sets
    df = pairs.join(sets, ["b_set", "p_set"], "left").withColumns({
        "s_marks": F.expr(f"coalesce(set_score, {n}D)"),
        "n_contradictions": F.expr("coalesce(set_contradictions, 0)"),
        "s_height": F.expr(f"coalesce(greatest(0D, 1 - abs(b_height - p_height) / {cfg.height_tolerance}D), {n}D)"),
        "s_age": F.expr(f"CASE WHEN p_age IS NULL OR b_lo IS NULL OR b_hi IS NULL THEN {n}D WHEN p_age BETWEEN b_lo AND b_hi THEN 1D ELSE greatest(0D, 1 - least(abs(p_age - b_lo), abs(p_age - b_hi)) / {cfg.age_decay}D) END"),
        "s_geo": F.expr(f"CASE WHEN p_place IS NULL OR b_place IS NULL THEN {n}D WHEN p_place = b_place THEN 1D ELSE {cfg.other_state}D END"),
        "s_temporal": F.expr(f"CASE WHEN p_date IS NULL OR b_date IS NULL THEN {n}D WHEN p_date <= b_date THEN 1D ELSE 0D END"),
    }).drop("b_set", "p_set", "set_score", "set_contradictions")
    total = cfg.w_marks * F.col("s_marks") + cfg.w_height * F.col("s_height") + cfg.w_age * F.col("s_age") + cfg.w_geo * F.col("s_geo") + cfg.w_temporal * F.col("s_temporal")
    df = df.withColumn("total", F.when(F.col("n_contradictions") > 0, F.least(total, F.lit(cfg.cap))).otherwise(total))
    tier = F.when(F.col("total") >= cfg.tier_high, "alta").when(F.col("total") >= cfg.tier_medium, "media").otherwise("baja")
    return df.withColumns({"tier": tier, "score": half_up(F.col("total"), 4)})


def temporal_text(p_date) -> Column:
    """The sentence on the order of a persona's date and b_date, null where these don't say anything."""
    days = F.datediff("b_date", p_date).cast("string")
    return F.when(p_date <= F.col("b_date"), F.concat(F.lit("temporal coherente: desaparición "), p_date.cast("string"), F.lit(", hallazgo "), F.col("b_date").cast("string"), F.lit(" ("), days, F.lit(" días)")))


def kind_texts(df: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Adds evidences, but the last sentence on dates, and contradictions to pairs of score_numbers, and rounds the sub-scores."""
    # per body mark: the persona's marks by similarity, ties in their own order
    ranked = f"transform(b_marks, c -> named_struct('c', c, 'ps', array_sort(transform(p_marks, (p, i) -> named_struct('neg', -({_SIM}), 'i', i, 'p', p)))))"
    t = cfg.mark_threshold
    hits = f"transform(filter(ranked, r -> -r.ps[0].neg >= {t}), r -> named_struct('c', r.c, 'top', r.ps[0].p, 'ok', get(filter(r.ps, x -> -x.neg >= {t} AND (r.c.lado IS NULL OR x.p.lado IS NULL OR r.c.lado = x.p.lado)), 0).p))"
    df = df.withColumn("ranked", F.expr(f"CASE WHEN size(b_marks) > 0 AND size(p_marks) > 0 THEN {ranked} END")).withColumn("hits", F.expr(hits))
    texts = {
        "contradictions": F.expr("coalesce(transform(filter(hits, h -> h.ok IS NULL), h -> concat('lateralidad opuesta: «', h.c.raw, '» vs «', h.top.raw, '»')), cast(array() as array<string>))"),
        "mark_evidence": F.expr("coalesce(transform(filter(hits, h -> h.ok IS NOT NULL), h -> concat('seña coincide: «', h.c.raw, '» ~ «', h.ok.raw, '»')), cast(array() as array<string>))"),
    }
    rest = F.array_compact(F.array(
        F.expr("CASE WHEN p_sex = b_sex THEN concat('sexo coincide: ', p_sex_raw) END"),
        F.expr("CASE WHEN p_height IS NOT NULL AND b_height IS NOT NULL THEN concat('estatura ', CASE WHEN s_height > 0.6 THEN 'compatible' ELSE 'difiere' END, ': ', p_height, 'cm vs ', b_height, 'cm') END"),
        F.expr("CASE WHEN p_age IS NOT NULL AND b_lo IS NOT NULL AND b_hi IS NOT NULL THEN concat('edad ', CASE WHEN s_age >= 0.8 THEN 'compatible' ELSE 'parcial' END, ': ficha ', p_age, ', cuerpo ', b_lo, '-', b_hi) END"),
        F.expr("CASE WHEN s_geo = 1 AND upper(p_state) = upper(b_state) THEN concat('mismo estado: ', p_state) END"),
    ))
    df = df.withColumns(texts).withColumn("evidences", F.concat("mark_evidence", rest))
    subs = {x: half_up(F.col(x), 3) for x in ("s_marks", "s_height", "s_age", "s_geo", "s_temporal")}
    return df.withColumns(subs)


def pair_texts(df: DataFrame, cfg: MatchConfig = MatchConfig(), *extra: str) -> DataFrame:
    """Adds evidences and contradictions to pairs of score_numbers, rounds the sub-scores and drops what they are made from. extra: further columns to keep."""
    df = kind_texts(df, cfg).withColumn("evidences", F.concat("evidences", F.array_compact(F.array(temporal_text(F.col("p_date"))))))
    more = [x for x in ("rank", "narrated") if x in df.columns]
    return df.select("b_id", "p_id", "score", "tier", "s_marks", "s_height", "s_age", "s_geo", "s_temporal", "evidences", "contradictions", *extra, *more)


def retrieved_pairs(p: DataFrame, b: DataFrame, near: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Tidy pairs of near (b_id, p_id) that nothing blocks; p, b: tidy rows."""
    return near.select("b_id", "p_id").join(b, "b_id").join(p, "p_id").where(F.expr(f"({reason_sql(cfg)}) IS NULL"))


def score_pair_b(pairs: DataFrame, personas: DataFrame, bodies: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Scores, sub-scores, tier, evidence and contradictions of tidy pairs of personas and bodies."""
    return pair_texts(score_numbers(pairs, personas, bodies, cfg), cfg)


def narrative(df: DataFrame) -> DataFrame:
    against = F.concat(F.lit("Descartado a prioridad baja por contradicción: "), F.array_join("contradictions", "; "), F.lit(". Requiere revisión humana; el sistema no concluye."))
    fine = F.concat(F.lit("Candidato priorizado (tier "), F.col("tier"), F.lit(", "), F.bround(F.col("score") * 100).cast("int").cast("string"), F.lit("%). El sistema no concluye; se prioriza para revisión humana."))
    return df.withColumn("narrative", F.when(F.size("contradictions") > 0, against).otherwise(fine))
