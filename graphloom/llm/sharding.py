"""Contiguous shards of near-equal bytes, cut from a global prefix sum.

Rows are dealt by ranges of the id, and that dealing (ids and sizes only) is written down, so that
totals and rows can never see different ranges. The ranges' totals, one row each, get a running sum;
added to the running sum inside its range it gives each row's global byte offset. Shard ``k`` of
``n`` holds the rows whose middle byte lies in the ``k``-th of ``n`` equal parts, so that no shard's
bytes are further from the target than one row. Only built-in DataFrame functions are used.

Defined results: null and empty texts have 8 bytes; a null id sorts first; repeated ids are placed by
their checksum and size; an empty table gives no rows; shards that get no row do not appear; columns
other than the id and the text are ignored. Contiguous shards keep neighbours, not equal texts,
together: a group of copies may hold a third of all bytes, and equal bytes are the law here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Bytes that each row takes besides its text.
OVERHEAD = 8


def shard_by_bytes(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; slots count from 0 in each shard."""
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[doc_id].alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    dealt = settle(rows.repartitionByRange(ranges, "doc_id", "text_crc32", "size").withColumn("range", F.spark_partition_id()))
    # One row a range: the only window without a key sees as many rows as there are ranges.
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    totals = totals.select(
        "range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("all_bytes"),
    )
    inside = Window.partitionBy("range").orderBy("doc_id", "text_crc32", "size")
    placed = dealt.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(inside))
    placed = placed.join(F.broadcast(totals), "range")
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")  # twice the byte offset of the row's middle
    cut = F.least(F.floor(middle.cast("decimal(38,0)") * shards / (2 * F.col("all_bytes"))).cast("int"), F.lit(shards - 1))
    placed = placed.select("doc_id", "size", "text_crc32", cut.alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("place"))
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
