"""Contiguous balanced shards by byte-size prefix sums.

The documents, in the order of their ids, get a running sum of sizes; shard
``k`` of ``n`` holds those whose middle falls into the ``k``-th equal part of
the total. No task sees all rows: ranges of ids are summed up on their own, and
only the ranges' totals are added up in a line. The ranges' ends are ids found
before and the same in every task, so any task can be run again at any time.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def byte_shards(docs: DataFrame, shards: int = 40, overhead: int = 16, partitions: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs``.

    ``size`` is the text's UTF-8 bytes (null: none) plus ``overhead``. Shards
    are contiguous in (doc_id nulls first, text_crc32, size); rows equal in all
    three are interchangeable. ``slot`` counts from 0 inside a shard. An empty
    table gives no rows; shards may stay empty where one row spans several
    targets. Other columns of ``docs`` are ignored.

    Rows that share an id which fills more than a range, and rows without one,
    are parted further by their checksum.
    """
    partitions = max(2, partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw).cast("long") + overhead).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))

    shares = F.array(*[F.lit(i / partitions) for i in range(1, partitions)])
    found = sized.agg(F.percentile_approx("doc_id", shares, 10_000).alias("m")).first().m or []
    # An id that ends several ranges holds about as many ranges' rows.
    hot = [m for m, n in Counter(found).items() if n > 1]
    ends = F.array(*[F.lit(m).cast("long") for m in sorted(set(found))])
    below = F.size(F.filter(ends, lambda m: m < F.col("doc_id")))
    is_hot = F.col("doc_id").isin(*hot) if hot else F.lit(False)
    part = F.when(F.col("doc_id").isNull(), -1).otherwise(2 * below + F.when(is_hot, 1).otherwise(0))
    finer = F.when(F.col("doc_id").isNull() | is_hot, F.floor(F.col("text_crc32") * partitions / (1 << 32))).otherwise(0)
    placed = sized.withColumn("_part", part).withColumn("_finer", finer)

    line = W.orderBy("_part", "_finer").rowsBetween(W.unboundedPreceding, -1)
    # A few rows for each range, so these windows are small whatever the data's size.
    totals = placed.groupBy("_part", "_finer").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    totals = totals.select("_part", "_finer", F.coalesce(F.sum("_bytes").over(line), F.lit(0)).alias("_before"), F.coalesce(F.sum("_rows").over(line), F.lit(0)).alias("_first"), F.sum("_bytes").over(W.partitionBy(F.lit(0))).alias("_all"))
    run = W.partitionBy("_part", "_finer").orderBy("doc_id", "text_crc32", "size")
    ended = F.col("_before") + F.sum("size").over(run.rowsBetween(W.unboundedPreceding, 0))
    # Twice the middle of the row, so that all stays in integers.
    middle = 2 * ended - F.col("size")
    n = placed.join(F.broadcast(totals), ["_part", "_finer"]).select(
        "doc_id", "size", "text_crc32",
        F.least(F.lit(shards - 1).cast("long"), F.floor(middle.cast("decimal(38,0)") * shards / (2 * F.col("_all")).cast("decimal(30,0)"))).cast("int").alias("shard"),
        (F.col("_first") + F.row_number().over(run) - 1).alias("_row"),
    )
    starts = n.groupBy("shard").agg(F.min("_row").alias("_start"))  # at most ``shards`` rows
    return n.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_start")).alias("slot"))
