"""Scratch tables below the folder that the session names in spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """This application's folder. Where spark.checkpoint.dir is unset a session on one machine gets a temporary one, any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="vinctum-scratch-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/vinctum-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below this application's folder."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}-{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """The same as a table dealt into buckets by a key: joins on it move the other side only. The catalog's entry goes at once, its files stay."""
    spark, table = df.sparkSession, f"vinctum_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", scratch(spark, name)).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved now
    spark.sql(f"DROP TABLE {table}")
    return out


def clean_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; call it when no result built on them is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
