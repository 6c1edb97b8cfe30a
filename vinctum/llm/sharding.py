"""Sharding by global byte-size prefix sums: blocks' totals are summed first, then each block's rows, and equal cuts of the sum are the shards.

The global order is doc_id (nulls first), then checksum and size; rows alike in all three are interchangeable.
A null text has no bytes: size 1, checksum 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Rows of a block, about; the number of blocks follows the table.
BLOCK_ROWS = 1_000_000


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))


def assign_shards(docs: DataFrame, n_shards: int = 8, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. Shards are contiguous in doc_id order and hold equal bytes, to a row's size.

    Blocks are ranges in the global order, of which rows alike (a null or repeated doc_id, equal texts) are dealt out by a number of their own, so no
    block is larger than others. They are written down as narrow rows; each is summed on its own, and only one row a block meets in one task.
    """
    n_blocks = max(1, -(-docs.count() // block_rows))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size"), F.col("_tie")]
    rows = sized(docs, id_col, text).withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n_blocks, *order)
    rows = materialize(rows.withColumn("block", F.spark_partition_id()), "blocks")
    totals = rows.groupBy("block").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(whole).alias("bytes_all"))
    inside = Window.partitionBy("block").orderBy(*order)
    running = rows.withColumns({"_b": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "_r": F.row_number().over(inside) - 1})
    placed = running.join(F.broadcast(totals), "block")  # a row for each block_rows rows
    # a row belongs to the shard in which its middle byte falls: exact in integers, times two
    placed = placed.withColumn("_middle", 2 * (F.col("_b") + F.col("bytes_before")) + F.col("size"))
    placed = placed.select("doc_id", "size", "text_crc32", F.expr(f"cast(_middle * {n_shards} div (2 * bytes_all) as int)").alias("shard"), (F.col("_r") + F.col("rows_before")).alias("_row"))
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"))
