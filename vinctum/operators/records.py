"""Matcher A: null-tolerant blocking by hash join, feature and field scores, evidence, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinctum.functions import vocab as V
from vinctum.functions.clean import blank_to_null
from vinctum.operators.dealt import meet
from vinctum.plans.config import RecordConfig
from vinctum.sources.scratch import materialize

_ANY = "∅"
_STEP = 10
_YEARS = 150
#: About how many pairs a key makes in one task.
_PAIRS = 4_000_000
FIELDS = ("id", "sex", "age_min", "age_max", "height_cm", "estado", "event_date")


def adjacency_closure(pairs: DataFrame) -> DataFrame:
    """(a, b) in both directions and of every place with itself."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.unionByName(both.select("a", F.col("a").alias("b"))).distinct()


def half_up(x: Column, digits: int = 2) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def block_pairs(missing: DataFrame, found: DataFrame, adjacency: DataFrame, cfg: RecordConfig = RecordConfig(), extra: tuple[str, ...] = (), marks: DataFrame | None = None, same_place: bool = False) -> DataFrame:
    """Pairs with compatible place, sex, age range and order of dates; a missing value is compatible with all. extra: further columns to keep.
    marks: only pairs of these sets (m_marks_of, u_marks_of; extra has marks_of). same_place: only pairs of equal, known places.

    Age ranges meet at one year: the missing record's first one, if the found record's range (with slack) holds it, else the found record's first one. Both sides have a row for each year that
    they may meet at, so a pair comes once and none of far ages is made; unknown ranges of found records meet by steps of ten years. Which places and sexes go together is settled for the keys
    (place, sex, year) that occur, in a small table that is written, with the pairs that a key will make: found records go to the keys that they fit, and keys of many pairs are dealt over tasks.
    """
    tidy = lambda df, p: df.select(*[(blank_to_null(x) if x in ("sex", "estado") else F.nullif(F.col(x), F.lit(0)) if x == "height_cm" else F.col(x)).alias(f"{p}_{x}") for x in (*FIELDS, *extra)])
    s = cfg.age_slack
    year = lambda x: f"cast(floor(least(greatest({x}, 0), {_YEARS - 1})) as int)"
    low = lambda p, d: year(f"least({p}_age_min, {p}_age_max) - {d}")
    high = lambda p, d: year(f"greatest({p}_age_min, {p}_age_max) + {d}")
    open_ = lambda p: f"({p}_age_min IS NULL OR {p}_age_max IS NULL)"
    # -1: unknown range of the missing record; then its first year, that of the found record, and steps for an unknown range of the found one
    later = f"CASE WHEN {low('m', 0)} < {high('m', 0)} THEN sequence({_YEARS} + {low('m', 0)} + 1, {_YEARS} + {high('m', 0)}) ELSE array() END"
    m_years = f"CASE WHEN {open_('m')} THEN array(-1) ELSE concat(array({low('m', 0)}, {2 * _YEARS} + cast(floor({low('m', 0)} / {_STEP}) as int)), {later}) END"
    u_years = f"concat(array(-1), CASE WHEN {open_('u')} THEN sequence({2 * _YEARS}, {2 * _YEARS + (_YEARS - 1) // _STEP}) ELSE concat(sequence({low('u', s)}, {high('u', s)}), array({_YEARS} + {low('u', s)})) END)"
    keyed = lambda df, p, years: tidy(df, p).withColumns({f"{p}_geo": F.coalesce(f"{p}_estado", F.lit(_ANY)), f"{p}_sexo": F.coalesce(f"{p}_sex", F.lit(_ANY)), "k_age": F.explode(F.expr(years))})
    m, u = keyed(missing, "m", m_years), keyed(found, "u", u_years)
    m_key, u_key = ["m_geo", "m_sexo", "k_age"], ["u_geo", "u_sexo", "k_age"]
    fits = materialize(_fitting(m.groupBy(*m_key).agg(F.count("*").alias("m_n")), u.groupBy(*u_key).agg(F.count("*").alias("u_n")), adjacency, same_place), "fitting-keys")
    left = m.join(fits.select(*m_key, "k_parts").distinct(), m_key).withColumn("k_part", F.expr("pmod(xxhash64(m_id), k_parts)")).drop("k_parts")
    right = u.join(fits, u_key).withColumn("k_part", F.explode(F.expr("sequence(0L, k_parts - 1)"))).drop("u_geo", "u_sexo", "k_parts")
    keys = [*m_key, "k_part"]
    if marks is not None:  # each missing record under the sets that its own may meet
        left = left.join(marks.select("m_marks_of", F.col("u_marks_of").alias("k_marks")).distinct(), "m_marks_of")
        right, keys = right.withColumn("k_marks", F.col("u_marks_of")), [*keys, "k_marks"]
    ages = F.expr(f"k_age = -1 OR k_age >= {2 * _YEARS} OR (m_age_max >= u_age_min - {s} AND m_age_min <= u_age_max + {s})")
    dates = F.expr("m_event_date IS NULL OR u_event_date IS NULL OR m_event_date <= u_event_date")
    return meet(left, right, keys).where(ages & dates).drop(*keys)


def _fitting(m: DataFrame, u: DataFrame, adjacency: DataFrame, same_place: bool) -> DataFrame:
    """(m_geo, m_sexo, k_age, u_geo, u_sexo, k_parts): which keys of found records go with one of missing records, and into how many parts the latter is dealt. m, u: the keys that occur, with their rows."""
    near = adjacency.groupBy("a").agg(F.collect_set("b").alias("near"))  # a place's neighbours
    all_keys = u.agg(F.collect_set("u_geo").alias("all_geo"), F.collect_set("u_sexo").alias("all_sex"))  # distinct places and sexes: one row
    m = m.join(F.broadcast(all_keys)).join(near, m["m_geo"] == near["a"], "left")
    any_ = F.lit(_ANY)
    geo = F.when(F.col("m_geo") == any_, F.col("all_geo")).otherwise(F.array_distinct(F.concat(F.array(F.col("m_geo"), any_), F.coalesce("near", F.array().cast("array<string>")))))
    geo = F.when(F.col("m_geo") != any_, F.array("m_geo")) if same_place else geo
    sex = F.when(F.col("m_sexo") == any_, F.col("all_sex")).otherwise(F.array("m_sexo", any_))
    pairs = m.select("m_geo", "m_sexo", "k_age", "m_n", F.explode(geo).alias("u_geo"), "all_sex").select("*", F.explode(sex).alias("u_sexo")).join(u, ["u_geo", "u_sexo", "k_age"])
    parts = F.sum("u_n").over(Window.partitionBy("m_geo", "m_sexo", "k_age")) * F.col("m_n") / F.lit(_PAIRS)
    return pairs.select("m_geo", "m_sexo", "k_age", "u_geo", "u_sexo", F.least("m_n", F.ceil(parts)).alias("k_parts"))


def feature_pairs(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Marks of both sides of a pair that are of one type."""
    side = lambda p: features.select(*[F.col(x).alias(f"{p}_{x}" if x != "feature_type" else "feature_type") for x in ("record_id", "place", "feature_type", "body_region", "laterality", "motif_category", "tokens")])
    p = pairs.select("m_id", "u_id")
    return p.join(side("a"), p["m_id"] == F.col("a_record_id")).join(side("b").withColumnRenamed("feature_type", "b_type"), (F.col("u_id") == F.col("b_record_id")) & (F.col("feature_type") == F.col("b_type"))).drop("a_record_id", "b_record_id", "b_type")


def mark_sets(features: DataFrame) -> DataFrame:
    """(record_id, marks_of): of each record with marks the least record that has the same ones, in any order; so equal sets of marks are scored once."""
    mark = F.struct("feature_type", "body_region", "laterality", "motif_category", F.array_sort(F.array_distinct("tokens")).alias("tokens"))
    sets = features.groupBy("record_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(mark))), 256).alias("_set"))  # a record's marks
    return sets.join(sets.groupBy("_set").agg(F.min("record_id").alias("marks_of")), "_set").select("record_id", "marks_of")


#: Up to how many pairs of different sets of marks are scored without making the pairs of records.
MOST_SETS = 1_000_000


def coded_sets(missing: DataFrame, found: DataFrame, most: int = MOST_SETS) -> DataFrame | None:
    """(m_marks_of, u_marks_of, m_code, u_code) of all pairs of the different sets of both sides; the sum of both codes is a pair's number from 0. None where there are over `most` of them."""
    sets = lambda df: df.select("marks_of").dropna().distinct()
    m, u = sets(missing), sets(found)
    n = u.count()
    if m.count() * n > most:
        return None
    code = F.row_number().over(Window.orderBy("marks_of")).cast("long") - 1  # no more than `most` rows
    return m.select(F.col("marks_of").alias("m_marks_of"), (code * n).alias("m_code")).crossJoin(F.broadcast(u.select(F.col("marks_of").alias("u_marks_of"), code.alias("u_code"))))


def score_marks(pairs: DataFrame, features: DataFrame, missing: DataFrame, found: DataFrame, most: int = MOST_SETS) -> DataFrame:
    """(m_marks_of, u_marks_of, s_marks, best, opposite) of the sets of marks that meet in pairs; features are those of all records.

    Where the different sets of both sides (marks_of of missing and found) make up to `most` pairs, all of these are scored, and the pairs needn't be made for it.
    """
    met = coded_sets(missing, found, most)
    if met is None:
        met = pairs.select("m_marks_of", "u_marks_of").dropna().distinct()
    scored = marks_score(score_features(feature_pairs(met.select(F.col("m_marks_of").alias("m_id"), F.col("u_marks_of").alias("u_id")), features)))
    return scored.select(F.col("m_id").alias("m_marks_of"), F.col("u_id").alias("u_marks_of"), "s_marks", "best", "opposite")


def _cluster(x: str) -> Column:
    out = F.lit(None).cast("string")
    for name, regions in V.CLUSTERS.items():
        out = F.when(F.col(x).isin(*regions), name).otherwise(out)
    return out


def score_features(pairs: DataFrame) -> DataFrame:
    """Each feature pair's score (null where the sides are opposite or the regions don't go together) and conflict."""
    a, b = F.array_distinct("a_tokens"), F.array_distinct("b_tokens")
    union = F.size(F.array_union(a, b))
    jaccard = F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
    conflict = F.expr("(a_laterality = 'izquierda' AND b_laterality = 'derecha') OR (a_laterality = 'derecha' AND b_laterality = 'izquierda')")
    vague = F.expr("coalesce(a_body_region, 'generico') = 'generico' OR coalesce(b_body_region, 'generico') = 'generico'")
    fits = vague | (F.col("a_body_region") == F.col("b_body_region")) | _cluster("a_body_region").eqNullSafe(_cluster("b_body_region"))
    s = 0.4 + F.when(F.col("a_body_region") == F.col("b_body_region"), 0.15).otherwise(0.0) + F.when(F.col("a_motif_category") == F.col("b_motif_category"), 0.25).otherwise(0.0) + 0.2 * jaccard
    return pairs.withColumns({"conflict": conflict, "score": F.when(~conflict & fits, F.least(s, F.lit(0.99)))})


def marks_score(scored: DataFrame) -> DataFrame:
    """Per pair: the best feature score, 0.05 if a feature of the first side meets only opposite sides."""
    per = scored.groupBy("m_id", "u_id", "a_place").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("best"), F.bool_or("conflict").alias("conflict"))
    out = per.groupBy("m_id", "u_id").agg(F.max("best").alias("best"), F.bool_or(F.col("conflict") & (F.col("best") == 0)).alias("opposite"))
    return out.select("m_id", "u_id", F.when(F.col("opposite"), 0.05).otherwise(half_up(F.col("best"))).alias("s_marks"), "best", "opposite")


def score_fields(pairs: DataFrame, marks: DataFrame, on: tuple[str, ...] = ("m_id", "u_id")) -> DataFrame:
    """Field scores; a field that can't be compared is null, but marks (0) and place (0.3). on: what the scores of marks are joined by."""
    steps = lambda x, cuts, last: _steps(x, cuts, last)
    p = pairs.join(marks, list(on), "left").withColumns({"s_marks": F.coalesce("s_marks", F.lit(0.0)), "best": F.coalesce("best", F.lit(0.0)), "opposite": F.coalesce("opposite", F.lit(False))})
    height = F.abs(F.col("m_height_cm") - F.col("u_height_cm"))
    middle = lambda s: (F.col(f"{s}_age_min") + F.coalesce(f"{s}_age_max", f"{s}_age_min")) / 2
    age = F.abs(middle("m") - middle("u"))
    in_order = F.col("m_event_date") <= F.col("u_event_date")
    geo = F.when(F.col("m_estado") == F.col("u_estado"), 1.0).when(F.col("m_estado").isNotNull() & F.col("u_estado").isNotNull(), 0.5).otherwise(0.3)
    return p.withColumns({"d_height": height, "d_age": age, "s_height": steps(height, ((2, 1.0), (5, 0.7), (8, 0.4)), 0.1), "s_age": steps(age, ((3, 1.0), (8, 0.7), (15, 0.35)), 0.05), "s_temporal": F.when(in_order, 1.0).when(~in_order, 0.0), "s_geo": geo})


def _steps(x: Column, cuts, last: float) -> Column:
    out = F.lit(last)
    for limit, value in reversed(cuts):
        out = F.when(x <= limit, value).otherwise(out)
    return F.when(x.isNotNull(), out)


def overall(df: DataFrame, cfg: RecordConfig = RecordConfig()) -> DataFrame:
    """Weighted mean of the fields present, to two decimals half up; a hard contradiction caps it."""
    total = sum((F.coalesce(F.col(f"s_{k}"), F.lit(0.0)) * w for k, w in cfg.weights), F.lit(0.0))
    weight = sum((F.when(F.col(f"s_{k}").isNotNull(), w).otherwise(0.0) for k, w in cfg.weights), F.lit(0.0))
    hard = F.col("opposite") | (F.coalesce("s_temporal", F.lit(1.0)) == 0) | F.coalesce(F.col("d_age") > cfg.age_conflict, F.lit(False))
    score = half_up(total / weight)
    return df.withColumns({"hard": hard, "overall_score": F.when(hard, F.least(score, F.lit(cfg.cap))).otherwise(score)})


def _evidence(cfg: RecordConfig) -> list[Column]:
    mark = F.regexp_replace(F.col("s_marks").cast("string"), r"\.0$", "")
    return [
        F.when(~F.col("opposite") & (F.col("best") > 0.5), F.concat(F.lit("Señas coinciden (score "), mark, F.lit("): tipo + región + motivo léxico"))),
        F.when(F.col("d_height").isNotNull(), F.concat(F.lit("Estatura: ficha "), F.col("m_height_cm"), F.lit("cm vs cuerpo "), F.col("u_height_cm"), F.lit("cm (Δ "), F.col("d_height"), F.lit("cm)"))),
        F.when(F.col("s_temporal") == 1, F.concat(F.lit("Temporal coherente: desaparición "), F.col("m_event_date").cast("string"), F.lit(" ≤ hallazgo "), F.col("u_event_date").cast("string"))),
        F.when(F.col("m_estado") == F.col("u_estado"), F.concat(F.lit("Mismo estado: "), F.col("m_estado"))),
    ]


def _contradictions(cfg: RecordConfig) -> list[Column]:
    return [
        F.when(F.col("opposite"), "CONTRADICCIÓN: lateralidad opuesta en seña (izquierda vs derecha) — incompatible"),
        F.when(F.col("d_age") > cfg.age_conflict, F.concat(F.lit("CONTRADICCIÓN: edad incompatible (Δ "), F.floor(F.col("d_age") + 0.5).cast("string"), F.lit(" años)"))),
        F.when(F.col("s_temporal") == 0, "CONTRADICCIÓN temporal: cuerpo hallado ANTES de la desaparición"),
    ]


def evidence(df: DataFrame, cfg: RecordConfig = RecordConfig()) -> DataFrame:
    return df.withColumns({"evidences": F.array_compact(F.array(*_evidence(cfg))), "contradictions": F.array_compact(F.array(*_contradictions(cfg)))})


def verify(df: DataFrame, cfg: RecordConfig = RecordConfig()) -> DataFrame:
    """Texts and a tier for the reviewer; no pair is ever confirmed here."""
    high, medium = cfg.tiers
    tier = F.when(F.col("hard"), "baja").when(F.col("overall_score") >= high, "alta").when(F.col("overall_score") >= medium, "media").otherwise("baja")
    evs, cons = _evidence(cfg), _contradictions(cfg)
    # joined from the parts themselves: nulls are left out, and no part is empty
    text = lambda parts, none: F.coalesce(F.nullif(F.concat_ws(". ", *parts), F.lit("")), F.lit(none))
    return df.withColumns({"evidence": text(evs, "Coincidencia parcial de señas y datos contextuales."), "contradiction": text(cons, "Sin contradicciones duras detectadas."), "tier": tier})


def bridge_tier(df: DataFrame, score: str = "overall_score") -> DataFrame:
    return df.withColumn("bridge_tier", F.when(F.col(score) >= 0.8, "alta").when(F.col(score) >= 0.6, "media").otherwise("baja"))
