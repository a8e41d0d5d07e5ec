"""The radix index of ids: eight levels of 512 slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.ordering import one_row
from lodeframe.schema import SPARSE_SLOTS, node_bytes, radix_prefix, radix_slot

LEVELS = 8


def slots(ids: DataFrame) -> DataFrame:
    """(id, level, prefix, slot) on each id's way from leaf (level 0) to root."""
    levels = F.array(*[F.struct(F.lit(level).cast("long").alias("level"), radix_prefix(F.col("id"), level).alias("prefix"), radix_slot(F.col("id"), level).alias("slot")) for level in range(LEVELS)])
    return ids.select("id", F.explode(levels).alias("x")).select("id", "x.level", "x.prefix", "x.slot")


def nodes(ids: DataFrame) -> DataFrame:
    """(level, prefix, used, encoding, bytes) of each node of the tree over ``ids``."""
    n = slots(ids).groupBy("level", "prefix").agg(F.countDistinct("slot").alias("used"))
    return n.withColumn("encoding", F.when(F.col("used") < SPARSE_SLOTS, "sparse").otherwise("dense")).withColumn("bytes", node_bytes(F.col("used")))


def levels(nodes: DataFrame) -> DataFrame:
    """(level, nodes, bytes)."""
    return nodes.groupBy("level").agg(F.count("*").alias("nodes"), F.sum("bytes").alias("bytes"))


def dirty(ids: DataFrame) -> DataFrame:
    """(level, rewritten): nodes that an incremental checkpoint of these ids writes anew."""
    return slots(ids).groupBy("level").agg(F.countDistinct("prefix").alias("rewritten"))


def lookup(ids: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, depth): how many levels from the root exist on each asked id's way; LEVELS and a used leaf slot mean it is there."""
    have = slots(ids).select("level", "prefix", "slot").distinct()
    return slots(asked).join(have, ["level", "prefix", "slot"], "left_semi").groupBy("id").agg(F.count("*").alias("depth"))


def space(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """(total_bytes, reachable_bytes, unreachable_bytes) after a full tree over ``before`` and an incremental checkpoint of the ids ``changed`` that led to ``after``."""
    full = nodes(before).agg(F.sum("bytes").alias("first"))
    new = nodes(after)
    on_the_way = slots(changed).select("level", "prefix").distinct()
    rewritten = new.join(on_the_way, ["level", "prefix"], "left_semi").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("again"))
    kept = new.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("reachable_bytes"))
    total = F.col("first") + F.col("again")
    return one_row(full, rewritten, kept).select(total.alias("total_bytes"), "reachable_bytes", (total - F.col("reachable_bytes")).alias("unreachable_bytes"))
