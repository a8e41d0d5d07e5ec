"""Record logs derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeframe.functions.ordering import running_total
from lodeframe.schema import DELETE, PUT, SEGMENT_HEADER, physical, utf8_bytes

#: Bytes of put frames in a stride segment.
STRIDE = 65536
BATCH = 8
ABORT_EVERY = 20


def event_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mutation an event: (record_id, ord, batch_id, op, value, value_bytes, phys, aborted); a delete has no frame."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type") == "error", DELETE).otherwise(PUT).cast("long")
    batch = F.shiftright(F.col("event_id"), 3) + 1
    d = e.select((F.col("user_id") + 1).alias("record_id"), F.col("event_id").alias("ord"), batch.alias("batch_id"), op.alias("op"), F.col("props").alias("value"), utf8_bytes(F.col("props")).alias("value_bytes"))
    return d.withColumn("phys", F.when(F.col("op") == PUT, physical(F.col("value_bytes"))).otherwise(0)).withColumn("aborted", F.col("batch_id") % ABORT_EVERY == 0)


def event_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The put frames of event_mutations, with log_off and stride addresses."""
    puts = event_mutations(spark, sf_dir).where(F.col("op") == PUT)
    puts = running_total(puts, "ord", F.col("phys"), "log_end").withColumn("log_off", F.col("log_end") - F.col("phys"))
    return puts.withColumn("segment_id", F.floor(F.col("log_off") / STRIDE) + 1).withColumn("seg_off", F.col("log_off") % STRIDE + SEGMENT_HEADER)


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One single-mutation batch an order: (record_id, commit_seq, batch_id, op, value_bytes)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    seq = F.col("o_orderkey") + 1
    return o.select((F.col("o_custkey") + 1).alias("record_id"), seq.alias("commit_seq"), seq.alias("batch_id"), F.when(F.col("o_orderstatus") == "F", DELETE).otherwise(PUT).cast("long").alias("op"), utf8_bytes(F.col("o_orderpriority")).alias("value_bytes"))


def order_cuts(commits: DataFrame) -> tuple[int, int, int]:
    """(checkpoint cut, own-sequence limit, compare-and-set point): 2/3, 8/15 and 4/5 of the commits."""
    n = commits.count()
    return n * 2 // 3, n * 8 // 15, n * 4 // 5


def conditional_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-record commits with an expected revision: (record_id, seq, newrev, expected); null expected: blind."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seq = F.col("event_id") + 1
    by = W.partitionBy("user_id").orderBy("event_id")
    d = e.select("user_id", "event_id", "event_type", seq.alias("seq"))
    expected = F.when(F.col("event_type") == "purchase", F.lag("seq", 2, 0).over(by)).when(F.col("event_type") == "click", F.lag("seq", 1, 0).over(by))
    return d.withColumn("expected", expected).select((F.col("user_id") + 1).alias("record_id"), "seq", F.col("seq").alias("newrev"), "expected")


def document_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One put a document, in order of record_id: (record_id, value_bytes, phys)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = d.select((F.col("doc_id") + 1).alias("record_id"), F.coalesce(utf8_bytes(F.col("text")), F.lit(0)).alias("value_bytes"))
    return d.withColumn("phys", physical(F.col("value_bytes")))


def radix_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread-out distinct ids for the radix index."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select((F.col("o_custkey") * 1000003 + 1).alias("id")).distinct()
