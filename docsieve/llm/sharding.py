"""Byte-balanced contiguous shards from global prefix sums, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docsieve.llm.common import settle

#: Bytes that a row costs besides its text.
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Put the rows of ``docs`` (doc_id, text), ordered by doc_id, into ``shards`` contiguous shards of near-equal bytes.

    Returns doc_id, size, text_crc32, law ("bytes"), shard, slot and grown_shard (null: cuts move when a shard is added).
    A row of global byte range [b, b + size) goes to the shard that holds its middle, so each shard differs from the
    target by less than one row at either end. A null text has no bytes and the checksum of the empty string; null ids
    come first; equal ids are ordered by checksum and size, and rows that agree in all three are told apart arbitrarily.
    An empty table gives an empty result; other columns are ignored.

    Texts are read once; narrow rows are written, range-partitioned and written again; each partition's totals, one row a partition, give
    the global offsets. No task sees more than one range of rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    # Written first: ranges are drawn from a sample of the rows, which would else read every text once more.
    narrow = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    order = [F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "tie"]
    # A random tie-break lets the ranges cut through rows that are equal in everything else.
    ranged = settle(narrow.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row a partition: bounded by the number of partitions, whatever the number of documents.
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    starts = totals.select("part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"))
    whole = totals.agg(F.sum("part_bytes").alias("all_bytes"))
    within = W.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumn("local_bytes", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("local_row", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), "part")
        .crossJoin(F.broadcast(whole))
        .withColumn("row", F.col("rows_before") + F.col("local_row"))
        .withColumn("twice_middle", (F.col("bytes_before") + F.col("local_bytes")) * 2 + F.col("size"))
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, (cast(twice_middle as decimal(30,0)) * {shards}) div (cast(all_bytes as decimal(30,0)) * 2)) as int)"))
        .select("doc_id", "size", "text_crc32", "shard", "row")
    )
    # One row a shard.
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
