"""Lookups and matches between posts, places and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinctum.functions import vocab as V
from vinctum.functions.clean import blank_to_null, c
from vinctum.functions.detect import matches
from vinctum.functions.text import tone_keywords
from vinctum.sources.scratch import materialize


def case_tones(cases: DataFrame) -> DataFrame:
    """(case_id, keywords, trigger) of cases with a text, written: everything else reads this small table, and each text is searched once."""
    low = cases.select("case_id", F.lower("text").alias("_low"))
    return materialize(low.select("case_id", F.array_sort(tone_keywords("_low", lowered=True)).alias("keywords"), matches(F.col("_low"), V.TRIGGERS).alias("trigger")), "tones")


def match_patterns(cases: DataFrame, patterns: DataFrame, limit: int = 5, least: float = 0.3, newest: int = 500) -> DataFrame:
    """Per case (case_id, text; or what case_tones gives) the best patterns by shared tone keywords: 0.6 of the overlap, 0.15 more if the case's text has a trigger. Only the `newest` patterns (by scraped_at, then the
    least pattern_id; null is oldest) are known, and of equal scores the newer one is first.

    Keywords are a fixed list, so cases and patterns fall into few kinds by their sets of keywords. Kinds are scored against each other, with the
    `limit` first patterns of each; a case then takes the result of its kind. A pair without a shared keyword can reach 0.15 at most.
    """
    k = (cases if "keywords" in cases.columns else case_tones(cases)).select("case_id", F.col("keywords").alias("ck"), "trigger")
    kinds = k.select("ck", "trigger").distinct()
    age = Window.orderBy(F.desc_nulls_last("scraped_at"), "pattern_id")
    known = patterns.select("pattern_id", "scraped_at", F.array_sort(F.array_distinct("keywords")).alias("pk")).orderBy(F.desc_nulls_last("scraped_at"), "pattern_id").limit(newest)
    known = known.withColumn("age", F.row_number().over(age))  # of `newest` rows
    first = Window.partitionBy("pk").orderBy("age")
    known = known.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit).drop("_n")
    mine = kinds.select("ck", "trigger", F.explode("ck").alias("keyword"))
    theirs = known.select("pattern_id", "age", "pk", F.explode("pk").alias("keyword"))
    both = mine.join(theirs, "keyword").groupBy("ck", "trigger", "pattern_id", "age", "pk").agg(F.count(F.lit(1)).alias("n"))
    tone = F.col("n") / F.greatest(F.size("ck"), F.size("pk"))
    s = both.withColumn("score", F.least(tone * 0.6 + F.when(F.col("trigger"), 0.15).otherwise(0.0), F.lit(1.0))).where(F.round("score", 9) >= least)
    reason = F.concat(F.lit("tone overlap "), F.round(tone * 100).cast("int").cast("string"), F.lit("%"), F.when(F.col("trigger"), "; case text triggers scam signatures").otherwise(""))
    w = Window.partitionBy("ck", "trigger").orderBy(F.desc(F.round("score", 9)), "age")
    best = s.withColumn("reason", reason).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).select("ck", "trigger", "pattern_id", "score", "reason")
    # at most `limit` rows for each of the sets of a dozen keywords
    return k.join(F.broadcast(best), ["ck", "trigger"]).select("case_id", "pattern_id", "score", "reason")


def contains_join(texts: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """Rows of both tables where `part` (not empty) occurs in `text`: an equality join on the part's first three characters, then the whole comparison.

    Both sides may grow; a text is looked up under each of its distinct runs of three, two and one characters.
    """
    n = F.length(text)
    grams = F.array_distinct(F.flatten(F.transform(F.array(F.lit(3), F.lit(2), F.lit(1)), lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.col(text).substr(i, k))).otherwise(F.array().cast("array<string>")))))
    left = texts.where(n > 0).withColumn("_gram", F.explode(grams))
    right = parts.where(F.length(part) > 0).withColumn("_gram", F.substring(part, 1, 3))
    return left.join(right, "_gram").where(F.contains(F.col(text), F.col(part))).drop("_gram")


def clean_place(x) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(c(x))), "[.,;]$", ""))


def gazetteer(df: DataFrame, place: str, table: DataFrame) -> DataFrame:
    """Adds lat, lng: the entry whose name is the cleaned place, else the first entry (by `ord`) whose name is part of it.

    The search for parts runs over the distinct places that have no exact entry.
    """
    t = table.select(F.lower("name").alias("_name"), "ord", "lat", "lng")
    places = df.select(clean_place(place).alias("_p")).where("_p <> ''").distinct()
    exact = places.join(t.groupBy("_name").agg(F.min_by("lat", "ord").alias("lat"), F.min_by("lng", "ord").alias("lng")), places["_p"] == F.col("_name")).select("_p", "lat", "lng")
    rest = places.join(exact, "_p", "left_anti")
    part = contains_join(rest, "_p", t, "_name").groupBy("_p").agg(F.min_by("lat", "ord").alias("lat"), F.min_by("lng", "ord").alias("lng"))
    return df.join(exact.unionByName(part), clean_place(place) == F.col("_p"), "left").drop("_p")


def coords_fallback(df: DataFrame, by_muni: DataFrame, by_state: DataFrame) -> DataFrame:
    """lat, lng of the municipality, else of the state; (0, 0) counts as absent."""
    real = lambda t, *keys, p: t.where("NOT (lat = 0 AND lng = 0)").select(*keys, F.col("lat").alias(f"{p}_lat"), F.col("lng").alias(f"{p}_lng"))
    j = df.join(real(by_muni, "estado", "municipio", p="m"), ["estado", "municipio"], "left").join(real(by_state, "estado", p="s"), "estado", "left")
    return j.withColumns({"lat": F.coalesce("m_lat", "s_lat"), "lng": F.coalesce("m_lng", "s_lng")}).drop("m_lat", "m_lng", "s_lat", "s_lng")


def per_capita(totals: DataFrame, population: DataFrame, key: str, per: int = 100_000) -> DataFrame:
    p = totals.join(population, key, "left")
    return p.withColumn("rate", F.when(F.col("population") > 0, F.floor(F.col("n") * per / F.col("population") * 10 + 0.5) / 10))


def place_lookup(df: DataFrame, keys: list[str], cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with cached coordinates by a canonical key of the given parts, and counts of keys found and missing."""
    key = F.concat_ws(", ", *[blank_to_null(F.trim(k)) for k in keys])
    keyed = df.withColumn("place_key", blank_to_null(key))
    wanted = keyed.select("place_key").where("place_key IS NOT NULL").distinct()
    got = wanted.join(cache, "place_key", "left")
    counts = got.agg(F.count_if(F.col("lat").isNotNull()).alias("n_found"), F.count_if(F.col("lat").isNull()).alias("n_missing"))
    return keyed.join(cache, "place_key", "left"), counts


def case_unlocked(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Links (case_id, user_id) to whose case another user is linked, or evidence of a different or unknown user exists."""
    others = links.select("case_id", F.col("user_id").alias("u")).unionByName(evidence.select("case_id", F.col("user_id").alias("u"))).distinct()
    # users per case are pre-aggregated: a case is open to a user if it knows anyone else
    known = others.groupBy("case_id").agg(F.count_distinct(F.coalesce(F.col("u").cast("string"), F.lit("?"))).alias("n"), F.min("u").alias("only"))
    return links.join(known, "case_id", "left").withColumn("unlocked", F.coalesce((F.col("n") > 1) | ~F.col("only").eqNullSafe(F.col("user_id")), F.lit(False))).drop("n", "only")


def events_of(artifacts: DataFrame, events: DataFrame, lineage: DataFrame) -> DataFrame:
    """Ids of events that come from any of the artifacts, directly or by lineage: two equality joins instead of one with OR."""
    direct = events.join(artifacts, events["artifact"] == artifacts["id"], "left_semi").select("id")
    lines = lineage.join(artifacts, lineage["artifact"] == artifacts["id"], "left_semi").select(F.col("event").alias("id"))
    return direct.unionByName(lines.join(events.select("id"), "id", "left_semi")).distinct()
