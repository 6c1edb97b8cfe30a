"""Evaluation sets with planted matches and near misses, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def swap_sides(x: Column) -> Column:
    for a, b in (("IZQUIERDO", "DERECHO"), ("LADO IZQ", "LADO DER")):
        x = F.replace(F.replace(F.replace(x, F.lit(a), F.lit("§")), F.lit(b), F.lit(a)), F.lit("§"), F.lit(b))
    return x


def build_eval_set(people: DataFrame, n_true: int = 10, n_near: int = 3) -> DataFrame:
    """Bodies copied from personas whose marks name a side: the first n_true as they are, the next n_near with sides swapped."""
    sided = people.where("upper(sana_particular) RLIKE 'IZQ|DER'").orderBy("id_victimadirecta").limit(n_true + n_near)
    rows = sided.withColumn("n", F.row_number().over(Window.orderBy("id_victimadirecta")))  # n_true + n_near rows
    near = F.col("n") > n_true
    return rows.select(
        F.concat(F.when(near, "NM-").otherwise("TM-"), "id_victimadirecta").alias("codigo"), "sexo", (F.col("edad") - 2).alias("edad_min"), (F.col("edad") + 2).alias("edad_max"), F.lit(None).cast("int").alias("estatura_cm"),
        F.when(near, swap_sides(F.col("sana_particular"))).otherwise(F.col("sana_particular")).alias("sana_particular"), "estado", F.lit("2005-01-01").alias("fecha_hallazgo"), "media_filiacion",
    )


def labelled_pairs(bodies: DataFrame) -> DataFrame:
    """Ground truth from the codes' prefixes."""
    return bodies.where("codigo LIKE 'TM-%' OR codigo LIKE 'NM-%'").select(F.col("codigo").alias("b_id"), F.substring("codigo", 4, 100).alias("p_id"), F.col("codigo").startswith("TM-").alias("is_match"))


def evaluate(scored: DataFrame, key: DataFrame, found_at: float = 0.5, rejected_below: float = 0.3) -> DataFrame:
    """True matches found, and near misses that were blocked or scored low."""
    j = key.join(scored.select("b_id", "p_id", "score"), ["b_id", "p_id"], "left")
    return j.agg(F.count_if("is_match").alias("n_true"), F.count_if(F.col("is_match") & (F.col("score") >= found_at)).alias("n_found"), F.count_if(~F.col("is_match")).alias("n_near"), F.count_if(~F.col("is_match") & (F.coalesce("score", F.lit(0.0)) < rejected_below)).alias("n_rejected"))
