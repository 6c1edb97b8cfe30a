"""Joins whose result is far larger than both of their sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Into how many parts the rows of one key are dealt.
PARTS = 8


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """left joined to right on keys; the left rows of a key are dealt over PARTS tasks by a hash of `by`, and the right rows go to each of them."""
    on = [*keys, "_dealt"]
    a = left.withColumn("_dealt", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    b = right.withColumn("_dealt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return meet(a, b, on).drop("_dealt")


def meet(left: DataFrame, right: DataFrame, on: list[str], least: int = 1) -> DataFrame:
    """left joined to right on keys of which each makes a bounded number of pairs.

    Both sides are laid into as many partitions as spark.sql.shuffle.partitions says, `least` at the least: left to itself Spark would merge partitions by the bytes that come in, which tell
    nothing about the rows that go out. Pairs leave the task as they are made; only the sides are shuffled, and neither is sent whole to all (its size is underrated before it is dealt).
    """
    n = max(least, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return left.repartition(n, *on).join(right.repartition(n, *on).hint("merge"), on)
