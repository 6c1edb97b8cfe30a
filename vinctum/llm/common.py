"""Shared helpers: table reading, scratch tables and the two word definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import bucketed, materialize

#: ASCII white space, as a trim set and as a Java character class.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[ \t-\r]+"
#: What separates normalised alphanumeric words: every ASCII character that is no letter or digit.
NON_ALNUM_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, one for each of `names`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"_{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new)
        out.append(new)
    return out


def ascii_lower(col):
    """Lower-case A-Z only; other letters stay."""
    return F.translate(col, _UPPER, _LOWER)


def words_of(col, separators: str = SPACE_CLASS, trim: str = SPACE_CHARS):
    """Array of the maximal runs between separators; null and blank texts give an empty array.

    `trim` lists the same separators as single characters.
    """
    bare = F.btrim(F.coalesce(col, F.lit("")), F.lit(trim))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, separators))


def fenced_where(df: DataFrame, condition: str) -> DataFrame:
    """Filter on computed columns without their expressions being copied into the filter.

    The optimizer moves a filter below a projection by substitution, which would multiply expressions that build on
    each other; it doesn't move one that also needs a partition id.
    """
    return df.withColumn("_fence", F.spark_partition_id()).where(f"({condition}) AND _fence >= 0").drop("_fence")


def by_size(df: DataFrame, name: str, max_rows: int, weight=None) -> DataFrame:
    """A written copy of df, marked for broadcast if it has at most max_rows rows (or weight in all); beyond it joins shuffle."""
    df = materialize(df, name)
    n = df.agg(F.coalesce(F.sum(F.lit(1) if weight is None else weight), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if n <= max_rows else df


def without(docs: DataFrame, ids: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs whose doc_id isn't in the one column of ids; rows without doc_id stay."""
    name = fresh(docs, "gone")[0]
    gone = by_size(ids.toDF(name).distinct(), "gone", max_rows)
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
