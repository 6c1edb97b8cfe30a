"""Upserts, dedupe keys, pending work and set construction: each gives the next version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinctum.functions.clean import blank_to_null, last_of_keys


def _one_per_key(incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that share a key the one whose JSON text is the last in order; the join that follows uses the same shuffle."""
    row = F.struct(*incoming.columns)
    return incoming.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]).agg(F.max_by(row, F.to_json(row)).alias("_row")).select("_row.*")


def _merged(target: DataFrame, incoming: DataFrame, keys: list[str], pick) -> DataFrame:
    t, i = target.alias("t"), _one_per_key(incoming, keys).alias("i")
    on = [F.col(f"t.{k}") == F.col(f"i.{k}") for k in keys]
    there = F.col(f"i.{keys[0]}").isNotNull()
    j = t.join(i, on, "full_outer")
    return j.select(*[F.coalesce(f"t.{c}", f"i.{c}").alias(c) if c in keys else pick(c, there).alias(c) for c in target.columns])


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Incoming rows replace the listed columns of rows with their key; new keys are added. Of incoming rows with one key one counts."""
    pick = lambda c, there: F.when(there, F.col(f"i.{c}")).otherwise(F.col(f"t.{c}")) if c in cols else F.when(F.col(f"t.{keys[0]}").isNotNull(), F.col(f"t.{c}")).otherwise(F.col(f"i.{c}"))
    return _merged(target, incoming, keys, pick)


def upsert_coalesce(target: DataFrame, incoming: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """As upsert, but a null keeps the old value."""
    return _merged(target, incoming, keys, lambda c, there: F.coalesce(f"i.{c}", f"t.{c}") if c in cols else F.coalesce(f"t.{c}", f"i.{c}"))


def keep_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key; rows with a null key stay."""
    keyed = df.withColumn("_key", key)
    w = Window.partitionBy("_key").orderBy(*order)
    first = keyed.where("_key IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.unionByName(keyed.where("_key IS NULL")).drop("_key")


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    new = keep_first(incoming, F.struct(*keys), order)
    return target.unionByName(new.join(target, keys, "left_anti").select(*target.columns))


def dedupe_notices(df: DataFrame, order: list[str]) -> DataFrame:
    """By permalink where there is one, else by name, date and state where all are given; other rows all stay."""
    by_name = F.when(blank_to_null("name").isNotNull() & F.col("date").isNotNull() & F.col("state").isNotNull(), F.concat_ws("\u001f", F.lit("n"), "name", F.col("date").cast("string"), "state"))
    return keep_first(df, F.coalesce(F.concat(F.lit("p\u001f"), blank_to_null("permalink")), by_name), order)


def pending(base: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(done, keys, "left_anti")


def retry_split(log: DataFrame, base: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(log without failed rows, base rows whose key failed)."""
    return log.where("NOT (status <=> 'failed')"), base.join(log.where("status = 'failed'"), keys, "left_semi")


def assemble(df: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows in order, counts of ok and failed)."""
    return df.orderBy(order), df.agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "failed").alias("n_failed"))


def replace_subset(target: DataFrame, key: str, prefix: str, incoming: DataFrame) -> DataFrame:
    return target.where(~F.coalesce(F.col(key).startswith(prefix), F.lit(False))).unionByName(incoming)


def flatten_kv(entries: Column) -> Column:
    """[{key, value}] as a map; the last of equal keys wins, entries lacking either go."""
    return F.map_from_entries(last_of_keys(F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull())))


def sightings(df: DataFrame) -> DataFrame:
    """Per content hash: distinct (run, url) sightings, first and last time."""
    rows = df.dropDuplicates(["run_id", "url", "content_hash"])
    return rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("n_runs"), F.min("fetched").alias("first"), F.max("fetched").alias("last"))
