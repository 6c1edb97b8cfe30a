"""Top-k per group, latest rows, review priorities. Ties go to the least id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vinctum.operators.matching import contains_join
from vinctum.sources.scratch import materialize


def rank_with_rejected(scored: DataFrame, k: int, group: str = "b_id", id_col: str = "p_id", score: str = "score", rank_all: bool = True) -> DataFrame:
    """The k best of each group, and beyond them every contradicted pair (by n_contradictions, or by the texts).

    Rows are counted by group and score first. Then only the rows whose score is one of the k best or that of a contradicted row are moved and numbered, among their equals; the
    counts say how many lie above. So `scored` is read twice, and what is moved grows with the result, not with the pairs. Without rank_all contradicted rows beyond the k best
    have no rank and are not moved at all; `scored` is read once more for them.
    """
    against = F.coalesce(F.col("n_contradictions") > 0 if "n_contradictions" in scored.columns else F.size("contradictions") > 0, F.lit(False))
    rows = scored.withColumn("_s", F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))))
    above = Window.partitionBy("_g").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)  # a group's distinct scores
    cells = rows.groupBy(F.col(group).alias("_g"), "_s").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(against).alias("_against"))
    cells = cells.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    cells = materialize(cells.where((F.col("_above") < k) | (F.col("_against") if rank_all else F.lit(False))), "score-cells")
    mine = F.when(F.col("_against"), F.col("_s"))
    # one row a group, written, so that its size is known when it is joined
    edges = materialize(cells.groupBy("_g").agg(F.min(F.when(F.col("_above") < k, F.col("_s"))).alias("_least"), F.min(mine).alias("_low"), F.max(mine).alias("_high")), "score-edges")
    near = rows.join(edges, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    asked = near.where("_s >= _least OR _s BETWEEN _low AND _high" if rank_all else "_s >= _least").drop("_least", "_low", "_high")
    c = cells.select("_g", F.col("_s").alias("_c"), "_above")
    placed = asked.join(c, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_c")))
    w = Window.partitionBy(group, "_s").orderBy(id_col)
    ranked = placed.withColumn("rank", (F.col("_above") + F.row_number().over(w)).cast("int")).where((F.col("rank") <= k) | against)
    out = ranked.select(*scored.columns, "rank")
    if rank_all:
        return out
    return out.unionByName(near.where(against & (F.col("_s") < F.col("_least"))).select(*scored.columns, F.lit(None).cast("int").alias("rank")))


def latest_per(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_n(df: DataFrame, n: int, score: str, *ids: str) -> DataFrame:
    return df.orderBy(F.desc(score), *ids).limit(n)


def last_n_per(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def newest(df: DataFrame, ts: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(ts), tie).limit(n)


def priority_staleness(matches: DataFrame, now, half_life_s: int = 1800, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Urgency by tier weight, score and age; queue priority counts down from the number of matches. keep: the columns to keep, of which id is one; all rows are moved with these only.

    The countdown is a rank over all rows; it is computed from counts per score bucket, so no task sorts the whole table.
    """
    weight = F.when(F.col("tier") == "alta", 3.0).when(F.col("tier") == "media", 1.5).otherwise(0.5)
    age = F.coalesce((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("created_at")).cast("double"), F.lit(0.0))
    df = matches.withColumn("urgency", weight * F.coalesce("score", F.lit(0.0)) + 0.2 * F.least(age / half_life_s, F.lit(2.0)))
    return global_countdown(df if keep is None else df.select(*keep, "urgency"), "urgency", "id")


def global_countdown(df: DataFrame, score: str, tie: str) -> DataFrame:
    """queue_priority: rows minus rank + 1 by score descending, ties by id.

    Rows are dealt in ranges of (score, id), so one score that many rows share is split like any other; a range's rows are numbered in place,
    and only one count a range meets in one task. The ranges are written down, so that counts and rows see the same ones.
    """
    ranges = df.repartitionByRange(F.col(score).asc(), F.col(tie).desc()).sortWithinPartitions(F.col(score).asc(), F.col(tie).desc())
    number = F.monotonically_increasing_id()
    written = materialize(ranges.select("*", F.spark_partition_id().alias("_range"), (number.bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_r")), "ranges")
    below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0))).select("_range", "_below")
    return written.join(F.broadcast(offsets), "_range").withColumn("queue_priority", F.col("_below") + F.col("_r")).drop("_range", "_r", "_below")


def context_boost(df: DataFrame, events: DataFrame, boost: float = 0.2, places: DataFrame | None = None) -> DataFrame:
    """`boost` where the state of some event is part of the row's state; events are taken as their distinct states.

    places: a smaller table whose `estado` holds all of the rows' states. The states that are hit are written, so that their size is known: few are sent to the rows.
    """
    states = events.select(F.lower("estado").alias("_e")).distinct()
    mine = (df if places is None else places).select(F.lower(F.coalesce("estado", F.lit(""))).alias("_s")).distinct()
    near = contains_join(mine, "_s", states, "_e").select("_s").distinct()
    if states.where("_e = ''").limit(1).count():  # an empty name is part of every other
        near = mine
    near = materialize(near, "states-hit")
    return df.join(near.withColumn("_hit", F.lit(True)), F.lower(F.coalesce("estado", F.lit(""))) == F.col("_s"), "left").withColumn("boost", F.when(F.col("_hit"), boost).otherwise(0.0)).drop("_s", "_hit")


def priority_context(df: DataFrame, events: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """min(1, 0.6 score + boost + 0.2 confidence) to three decimals, with its reasons; places as in context_boost."""
    b = context_boost(df, events, places=places)
    p = F.floor(F.least(F.lit(1.0), F.col("score") * 0.6 + F.col("boost") + F.coalesce("confidence", F.lit(0.0)) * 0.2) * 1000 + 0.5) / 1000
    label = F.when(F.col("tier") == "alta", "ALTA prioridad").when(F.col("tier") == "media", "prioridad media").when(F.col("tier") == "baja", "baja prioridad").otherwise(F.col("tier"))
    reason = F.concat_ws(". ", F.concat(F.lit("Score "), F.format_string("%.2f", "score"), F.lit(" ("), label, F.lit(")")), F.when(F.col("boost") > 0, "evento social cercano (fosa/balacera en mismo estado)"), F.when(F.col("confidence") > 0.7, "extracción de alta confianza"))
    return b.withColumns({"priority": p, "reason": reason})
