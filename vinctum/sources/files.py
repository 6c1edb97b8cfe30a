"""Readers and writers: registry CSV, nested JSON, JSON lines, GeoJSON. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_registry(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Header row, quoted fields, values trimmed, columns by name."""
    df = spark.read.schema(schema).csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False)
    return df.limit(limit) if limit else df


def read_nested(spark: SparkSession, path: str, array_path: str, schema: str) -> DataFrame:
    """The records of an array inside a JSON document."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline(array_path))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def records(df: DataFrame, record_type: str | None = None) -> DataFrame:
    return df.where(F.col("record_type") == record_type) if record_type else df


def features(df: DataFrame) -> DataFrame:
    """Tokens decoded from JSON; a missing side is 'na'."""
    return df.withColumns({"tokens": F.from_json("tokens", "array<string>"), "laterality": F.coalesce("laterality", F.lit("na"))})


def to_geojson(df: DataFrame, lng: str, lat: str, props: list[str], keep: list[str] | None = None) -> DataFrame:
    """One Feature per line (column value) for every row with both coordinates, beside the columns to keep."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(F.col(lng).cast("double"), F.col(lat).cast("double")).alias("coordinates")).alias("geometry"), F.struct(*props).alias("properties"))
    return df.where(F.col(lng).isNotNull() & F.col(lat).isNotNull()).select(*(keep or []), F.to_json(feature).alias("value"))


def write_feature_collection(df: DataFrame, path: str, lng: str, lat: str, props: list[str], totals: list[str], key: str) -> None:
    """A GeoJSON FeatureCollection as text files whose lines, in the order of the files, are one document.

    Its head holds the sums of `totals` over all rows (what isn't a whole number counts 0) and the number of sites with coordinates; features follow
    in the order of `key`. One feature is a line, so no task holds them all.
    """
    whole = {c: F.sum(F.coalesce(F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c)).try_cast("long"), F.lit(0))) for c in totals}
    sited = F.col(lng).isNotNull() & F.col(lat).isNotNull()
    sums = df.agg(F.count_if(sited).alias("num_sitios"), F.min(F.when(sited, F.col(key))).alias("_first"), *[F.coalesce(x, F.lit(0)).alias(f"total_{c}") for c, x in whole.items()])
    head = F.concat(F.lit('{"type":"FeatureCollection",'), *[p for c in [*[f"total_{t}" for t in totals], "num_sitios"] for p in (F.lit(f'"{c}":'), F.col(c).cast("string"), F.lit(","))], F.lit('"features":['))
    lines = df.select(F.lit(1).alias("part"), F.col(key).alias("key"), lng, lat, *[c for c in props if c not in (key, lng, lat)])
    lines = lines.withColumn(key, F.col("key")) if key in props else lines
    lines = to_geojson(lines, lng, lat, props, keep=["part", "key"])
    first = sums.select(F.col("_first"))
    lines = lines.join(F.broadcast(first)).select("part", "key", F.concat(F.when(F.col("key") == F.col("_first"), "").otherwise(","), "value").alias("value"))
    ends = sums.select(F.lit(0).alias("part"), F.lit(None).cast(df.schema[key].dataType).alias("key"), head.alias("value")).unionByName(sums.select(F.lit(2).alias("part"), F.lit(None).cast(df.schema[key].dataType).alias("key"), F.lit("]}").alias("value")))
    lines.unionByName(ends).orderBy("part", "key").select("value").write.text(path)


def write_ordered_json(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines whose files, in the order of their names, hold the rows in order."""
    df.orderBy(*order).select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
