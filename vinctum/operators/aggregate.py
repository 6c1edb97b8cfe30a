"""Counts, shares, statistics, roll-ups and grids over registry rows. Every order has the key as its last part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vinctum.functions.clean import repair_state


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def grouped_counts(df: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """Counts of all the given groupings in one pass: level (their number from 0), the keys (null where a grouping has not got them), n. Rows with a null key of a grouping are not in it."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    # a row once for each grouping that it belongs to; partial sums are taken before the shuffle
    each = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in s], F.lit(True)), F.struct(F.lit(i).alias("level"), *[(F.col(k) if k in s else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in keys])) for i, s in enumerate(sets)]))
    return df.select(F.inline(each)).groupBy("level", *keys).agg(F.count(F.lit(1)).alias("n"))


def totals(df: DataFrame, status: str, open_states: list[str], source: str) -> DataFrame:
    """All rows, rows in some states, distinct sources."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(status).isin(*open_states)).alias("n_open"), F.count_distinct(source).alias("n_sources"))


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    return counts(df, key).orderBy(F.desc("n"), key).limit(n)


def argmax(df: DataFrame, key: str) -> DataFrame:
    """The most frequent key, the least one of equals."""
    return top_counts(df, key, 1)


def age_sex(df: DataFrame, bucket: str, sex: str) -> DataFrame:
    s = F.when(F.col(sex).isin("HOMBRE", "MUJER"), F.col(sex)).otherwise("NOINFO")
    return df.where(F.col(bucket).isNotNull()).groupBy(F.col(bucket).alias("bucket")).agg(*[F.count_if(s == k).alias(k.lower()) for k in ("HOMBRE", "MUJER", "NOINFO")])


def age_stats(df: DataFrame, age: str) -> DataFrame:
    """Mean to one decimal, upper median, population deviation to one decimal.

    The median comes from the counts per age (about a hundred rows), so nothing sorts the whole table.
    """
    per = df.where(F.col(age).isNotNull()).groupBy(F.col(age).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    ranked = per.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.orderBy("a").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    mean = F.sum(F.col("a") * F.col("n")) / F.sum("n")
    square = F.sum(F.col("a") * F.col("a") * F.col("n")) / F.sum("n")
    round1 = lambda x: F.floor(x * 10 + 0.5) / 10
    return ranked.agg(round1(mean).alias("mean"), F.min(F.when(F.col("upto") >= F.floor(F.col("all") / 2) + 1, F.col("a"))).alias("median"), round1(F.sqrt(square - mean * mean)).alias("std"))


def shares(df: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """Shares of a counter to four decimals; with `top`, of its largest entries only."""
    n = top_counts(df, key, top) if top else counts(df, key)
    total = n.agg(F.sum("n").alias("_all"))  # one row
    return n.join(F.broadcast(total)).withColumn("share", F.floor(F.col("n") / F.col("_all") * 10000 + 0.5) / 10000).drop("n", "_all")


def site_totals(df: DataFrame, *cols: str) -> DataFrame:
    """Sums of whole numbers; what isn't one counts 0."""
    return df.agg(F.count(F.lit(1)).alias("n_sites"), *[F.sum(F.coalesce(F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c)).try_cast("int"), F.lit(0))).alias(c) for c in cols])


def population_by_state(df: DataFrame, state: str, n: str) -> DataFrame:
    return df.groupBy(repair_state(state).alias("estado")).agg(F.sum(n).alias("population"))


def cluster_rollup(clusters: DataFrame) -> DataFrame:
    """Clusters (municipio, size, first, last) by municipality."""
    return clusters.groupBy("municipio").agg(F.sum("size").alias("members"), F.count(F.lit(1)).alias("clusters"), F.min("first").alias("first"), F.max("last").alias("last"))


def recency_bucket(df: DataFrame, ts: str, n: int = 20) -> DataFrame:
    """floor(n ln(t - min + 1) / ln(max - min + 1)), at most n - 1, in days; null where there is no span."""
    span = df.agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    d = df.join(F.broadcast(span))  # one row
    days = lambda a, b: (F.unix_seconds(F.col(a).cast("timestamp")) - F.unix_seconds(F.col(b).cast("timestamp"))) / 86400.0
    ratio = F.when(F.col("_hi") > F.col("_lo"), F.log(days(ts, "_lo") + 1) / F.log(days("_hi", "_lo") + 1))
    return d.withColumn("ratio", ratio).withColumn("bucket", F.least(F.floor(F.col("ratio") * n), F.lit(n - 1)).cast("int")).drop("_lo", "_hi")


def grid(df: DataFrame, cell: float, value: str) -> DataFrame:
    """Rows with coordinates per cell: count and mean value."""
    return df.where("lat IS NOT NULL AND lng IS NOT NULL").groupBy(F.floor(F.col("lat") / cell).alias("cell_y"), F.floor(F.col("lng") / cell).alias("cell_x")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def run_summary(df: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "")).alias(f"n_{f}") for f in fields])


def k_anonymous(df: DataFrame, n: str, k: int = 5) -> DataFrame:
    """Cells of at least k (1 at least) rows."""
    return df.where(F.greatest(F.floor(n), F.lit(0)) >= max(1, int(k)))


def with_coords(df: DataFrame) -> DataFrame:
    return df.where("lat IS NOT NULL AND lng IS NOT NULL")


def count_in_box(df: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    return df.where(F.col("lat").between(south, north) & F.col("lng").between(west, east)).agg(F.count(F.lit(1)).alias("n"))
