"""Versions in force at each event's time, and counts of ordered pairs, by hash joins and running sums instead of range joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinctum.sources.scratch import materialize


def _slot(day, step_days: int) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / step_days).cast("int")


def in_force_at(events: DataFrame, at: str, versions: DataFrame, keys: list[str], start: str, end: str, step_days: int = 30, name: str = "in_force") -> DataFrame:
    """events with `name`: an array of the versions (their columns but the keys) of the same key whose [start, end) holds the event's time, the latest start first.

    start, end and `at` are dates or timestamps. A null end never ends; a version without a start, or whose end is not after it, is never in force; an event without a time or key
    has none. Every event stays once. Each version is laid into the time slots of step_days that it touches, between the first and the last event; the versions
    of a key and slot become one array, which meets the events by equality, so events are neither multiplied nor grouped and a hot key's events may be split.
    """
    span = events.agg(F.min(_slot(at, step_days)).alias("_first"), F.max(_slot(at, step_days)).alias("_last"))  # one row
    rest = [c for c in versions.columns if c not in keys]
    known = versions.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))).join(F.broadcast(span))
    last = F.least(F.coalesce(_slot(end, step_days), F.col("_last")), F.col("_last"))
    first = F.greatest(_slot(start, step_days), F.col("_first"))
    laid = known.where(first <= last).withColumn("_slot", F.explode(F.sequence(first, last)))
    per = laid.groupBy(*keys, "_slot").agg(F.collect_list(F.struct(*rest)).alias("_versions"))  # of one key within step_days
    whole = [c for c in rest if c not in (start, end)]
    newest = F.reverse(F.array_sort(F.transform("_versions", lambda v: F.struct(v[start].alias("_s"), *[v[c].alias(c) for c in whole], v[end].alias("_e")))))
    placed = events.withColumn("_slot", _slot(at, step_days)).join(per.withColumn("_versions", newest), [*keys, "_slot"], "left")
    holds = F.filter("_versions", lambda v: (v["_s"] <= F.col(at)) & (v["_e"].isNull() | (v["_e"] > F.col(at))))
    back = F.transform(holds, lambda v: F.struct(*[(v["_s"] if c == start else v["_e"] if c == end else v[c]).alias(c) for c in rest]))
    kind = per.schema["_versions"].dataType.simpleString()
    return placed.withColumn(name, F.coalesce(back, F.array().cast(kind))).select(*events.columns, name)


def policy_at(events: DataFrame, at: str, policies: DataFrame, keys: list[str], start: str, end: str, **options) -> DataFrame:
    """events with the columns of the newest version in force at their time, null where none is.

    Of versions of a key with one start and one end only the last in order can be the answer, so the others go first; and the answer is looked up once for each distinct key and time
    of the events. With whole days both are bounded by the keys and days, whatever the rows.
    """
    rest = [c for c in policies.columns if c not in keys]
    whole = [c for c in rest if c not in (start, end)]
    if whole:  # in the order in which in_force_at puts the newest first
        last = policies.groupBy(*keys, start, end).agg(F.max(F.struct(*whole)).alias("_whole"))
        policies = last.select(*keys, start, end, *[F.col("_whole")[c].alias(c) for c in whole])
    moments = events.select(*keys, at).dropna().distinct()
    held = in_force_at(moments, at, policies.select(*keys, *rest), keys, start, end, name="_held", **options)
    new = [f"_new_{i}" for i in range(len(rest))]  # policies may share names with events
    held = materialize(held.select(*keys, at, *[F.get("_held", F.lit(0))[c].alias(n) for c, n in zip(rest, new)]), "policies-held")
    out = events.join(held, [*keys, at], "left")
    return out.select(*events.columns, *[F.col(n).alias(c) for c, n in zip(rest, new)])


def ordered_pairs(left: DataFrame, right: DataFrame, keys: list[str], x: str, n: str) -> DataFrame:
    """One row, n: the number of pairs of one key with left.x > right.x, both sides being counts (keys, x, n) of distinct values.

    A merged sort: per key both sides' values in descending order, and a running sum of the left counts; no pair is made. A key's rows are its distinct values.
    """
    side = lambda df, k: df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("_x")).agg(F.sum(n).cast("decimal(38,0)").alias("_n")).withColumn("_side", F.lit(k))
    both = side(right, 0).unionByName(side(left, 1))  # of equal values the right one comes first
    w = Window.partitionBy(*keys).orderBy(F.desc("_x"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    above = both.withColumn("_above", F.coalesce(F.sum(F.when(F.col("_side") == 1, F.col("_n"))).over(w), F.lit(0).cast("decimal(38,0)")))
    return above.where("_side = 0").agg(F.coalesce(F.sum(F.col("_n") * F.col("_above")), F.lit(0)).cast("decimal(38,0)").alias("n"))


def paired(left: DataFrame, right: DataFrame, keys: list[str], n: str) -> DataFrame:
    """One row, n: the number of pairs with equal keys, from counts of both sides."""
    side = lambda df, name: df.groupBy(*keys).agg(F.sum(n).cast("decimal(38,0)").alias(name))
    return side(left, "_l").join(side(right, "_r"), keys).agg(F.coalesce(F.sum(F.col("_l") * F.col("_r")), F.lit(0)).cast("decimal(38,0)").alias("n"))


def one_row(**counts: DataFrame) -> DataFrame:
    """One row with a column per one-row table (n)."""
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("name"), F.col("n").cast("decimal(38,0)").alias("n")) for name, df in counts.items()])
    return rows.agg(*[F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).cast("decimal(38,0)").alias(name) for name in counts])
