"""State of the store from its log: heads, cuts, overlays, checks of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeframe.functions.ordering import row_number
from lodeframe.schema import FRAME_TYPES, PUT, address_fault

PAYLOAD = ("op", "ord", "batch_id", "value_bytes", "phys")


def heads(commits: DataFrame, payload: tuple[str, ...] = PAYLOAD) -> DataFrame:
    """The last commit of each record, tombstones too: (record_id, commit_seq, *payload)."""
    return commits.groupBy("record_id").agg(F.max("commit_seq").alias("commit_seq"), *[F.max_by(c, "commit_seq").alias(c) for c in payload])


def heads_at(commits: DataFrame, cut: int, payload: tuple[str, ...] = PAYLOAD) -> DataFrame:
    """Heads as of a commit sequence number, it included."""
    return heads(commits.where(F.col("commit_seq") <= cut), payload)


def live(heads: DataFrame) -> DataFrame:
    return heads.where(F.col("op") == PUT)


def overlay(root: DataFrame, delta: DataFrame, columns: list[str]) -> DataFrame:
    """Delta over root by record_id: the delta's row where there is one, and no row where that is a tombstone."""
    d = delta.select("record_id", F.col("op").alias("__op"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = root.select("record_id", *columns).join(d, "record_id", "full_outer")
    return both.where("__op is null or __op = 1").select("record_id", *[F.when(F.col("__op").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def layered_lookup(layers: list[DataFrame], asked: DataFrame) -> DataFrame:
    """(record_id, layer, op) of the asked ids: from the newest layer that has an entry, a tombstone included; ``layers`` newest first."""
    union = layers[0].select("record_id", "op", F.lit(0).alias("layer"))
    for i, layer in enumerate(layers[1:], 1):
        union = union.unionByName(layer.select("record_id", "op", F.lit(i).alias("layer")))
    found = union.join(asked, "record_id", "left_semi").groupBy("record_id").agg(F.min("layer").alias("layer"), F.min_by("op", "layer").alias("op"))
    return asked.join(found, "record_id", "left")


def point_get(live: DataFrame, asked: DataFrame) -> DataFrame:
    """(record_id, found, revision, value_bytes) of each asked id."""
    values = live.select("record_id", F.col("batch_id").alias("revision"), "value_bytes")
    return asked.join(values, "record_id", "left").select("record_id", F.col("revision").isNotNull().alias("found"), "revision", "value_bytes")


def after(frames: DataFrame, segment: int, offset: int) -> DataFrame:
    """Frames at or past a replay start; both parts reach the scan as ranges of segment_id."""
    return frames.where((F.col("segment_id") >= segment) & ((F.col("segment_id") > segment) | (F.col("seg_off") >= offset)))


def history(commits: DataFrame, record_id: int) -> DataFrame:
    """A record's commits in order, each with the sequence number that replaced it."""
    mine = commits.where(F.col("record_id") == record_id)
    return mine.withColumn("replaced_by", F.lead("commit_seq").over(W.partitionBy("record_id").orderBy("commit_seq")))


def descriptor_faults(frames: DataFrame) -> DataFrame:
    """(batch_id, frames, islands) of batches whose descriptor frames aren't one run of frame_seq."""
    island = F.col("frame_seq") - F.row_number().over(W.partitionBy("batch_id").orderBy("frame_seq"))
    d = frames.withColumn("__i", island).groupBy("batch_id", "__i").agg(F.count("*").alias("n"))
    return d.groupBy("batch_id").agg(F.sum("n").alias("frames"), F.count("*").alias("islands")).where("islands > 1")


def sequence_faults(log: DataFrame, order: str = "commit_seq") -> DataFrame:
    """(rule, value) where a log's numbers repeat or leave a gap; they must be dense from 1."""
    numbered = row_number(log.select(order).distinct(), order, "__n")
    repeats = log.groupBy(order).count().where("count > 1").select(F.lit("repeated").alias("rule"), F.col(order).alias("value"))
    # The first number of a gap's far side is where the distance between number and rank grows.
    jump = numbered.withColumn("__d", F.col(order) - F.col("__n")).groupBy("__d").agg(F.min(order).alias("value")).where("__d > 0")
    return repeats.unionByName(jump.select(F.lit("gap").alias("rule"), "value"))


def duplicate_terminals(terminals: DataFrame) -> DataFrame:
    """(batch_id, terminals) of batches that end more than once."""
    return terminals.groupBy("batch_id").agg(F.count("*").alias("terminals")).where("terminals > 1")


def frame_fault(kind: Column, batch_id: Column, record_id: Column, payload_bytes: Column) -> Column:
    """The rule a frame breaks, or null; ``kind`` is one of FRAME_TYPES."""
    batched = ("commit_part", "commit_seal", "batch_abort", "relocation_part", "relocation_seal")
    system = ("id_reserve", "segment_seal", "batch_id_reserve")
    identity = F.when(kind == "put", (batch_id == 0) | (record_id == 0)).when(kind.isin(*batched), (batch_id == 0) | (record_id != 0)).when(kind.isin(*system), (batch_id != 0) | (record_id != 0))
    sizes = F.when(kind.isin("commit_part", "relocation_part"), (payload_bytes == 0) | (payload_bytes % 32 != 0)).when(kind.isin("commit_seal", "relocation_seal", "segment_seal"), payload_bytes != 64).when(kind == "batch_abort", payload_bytes != 32).when(kind.isin("id_reserve", "batch_id_reserve"), payload_bytes != 24).otherwise(False)
    return F.when(~kind.isin(*FRAME_TYPES), "type").when(identity, "identity").when(sizes, "payload")


def mutation_fault(kind: Column, op: Column, segment: Column, offset: Column, old_segment: Column) -> Column:
    """The rule a commit entry breaks, or null: puts have a good address, deletes none, relocations both."""
    bad = address_fault(segment, offset)
    commit = F.when(op == "put", F.when(bad.isNotNull() | old_segment.isNotNull(), "put_address")).when(op == "delete", F.when(segment.isNotNull() | old_segment.isNotNull(), "delete_address")).otherwise("operation")
    move = F.when((op != "relocate") | bad.isNotNull() | old_segment.isNull(), "relocation")
    return F.when(kind == "commit", commit).when(kind == "relocation", move).otherwise("kind")
