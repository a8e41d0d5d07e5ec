"""Mutations of a batch: collapse, limits, conditions, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.ordering import ordered_fold, row_number
from lodeframe.schema import PUT


def collapse(mutations: DataFrame) -> DataFrame:
    """The last mutation of each (batch_id, record_id) by ``ord``: (batch_id, record_id, ord, op, value_bytes, phys)."""
    # max_by of a fixed-width column keeps the hash aggregate, which a struct would not.
    last = [F.max_by(c, "ord").alias(c) for c in ("op", "value_bytes", "phys")]
    return mutations.groupBy("batch_id", "record_id").agg(F.max("ord").alias("ord"), *last)


def payloads(mutations: DataFrame) -> DataFrame:
    """(batch_id, mutations, deletes, appended_bytes, surviving_bytes): every put counts as appended, only final puts survive."""
    put = F.when(F.col("op") == PUT, F.col("value_bytes")).otherwise(0)
    appended = mutations.groupBy("batch_id").agg(F.sum(put).alias("appended_bytes"))
    final = collapse(mutations).groupBy("batch_id").agg(F.count("*").alias("mutations"), F.sum((F.col("op") != PUT).cast("long")).alias("deletes"), F.sum(put).alias("surviving_bytes"))
    return appended.join(final, "batch_id").select("batch_id", "mutations", "deletes", "appended_bytes", "surviving_bytes")


def limit_violations(mutations: DataFrame, max_bytes: int, max_mutations: int, max_value: int) -> DataFrame:
    """(rule, batch_id, amount) of each limit that a batch breaks; the mutation limit is on distinct ids."""
    p = payloads(mutations).join(mutations.groupBy("batch_id").agg(F.max(F.when(F.col("op") == PUT, F.col("value_bytes"))).alias("largest")), "batch_id")
    rules = F.array(
        F.struct(F.lit("batch_bytes").alias("rule"), F.col("appended_bytes").alias("amount"), (F.col("appended_bytes") > max_bytes).alias("broken")),
        F.struct(F.lit("batch_mutations").alias("rule"), F.col("mutations").alias("amount"), (F.col("mutations") > max_mutations).alias("broken")),
        F.struct(F.lit("value_bytes").alias("rule"), F.col("largest").alias("amount"), (F.col("largest") > max_value).alias("broken")),
    )
    return p.select("batch_id", F.explode(rules).alias("r")).where("r.broken").select("r.rule", "batch_id", "r.amount")


def condition_conflicts(conditions: DataFrame) -> DataFrame:
    """(batch_id, record_id, conditions): ids on which a batch set different conditions, (kind, revision); repeats are harmless."""
    distinct = conditions.select("batch_id", "record_id", "kind", "revision").distinct()
    return distinct.groupBy("batch_id", "record_id").agg(F.count("*").alias("conditions")).where("conditions > 1")


def commit_sequence(batches: DataFrame) -> DataFrame:
    """(batch_id, commit_seq): dense numbers of the distinct admitted batches, in order."""
    return row_number(batches.select("batch_id").distinct(), "batch_id", "commit_seq")


def groups(items: DataFrame, order: str, size: str, max_items: int, max_bytes: int, shard: str = "shard") -> DataFrame:
    """(shard, order, group_id): first in, first out; a group closes at ``max_items``, at ``max_bytes``, or when the next would exceed them. A group's first item always fits."""

    def step(state, at, bytes_):
        group, count, used = state
        if count and (count >= max_items or used >= max_bytes or bytes_ > max_bytes - used):
            group, count, used = group + 1, 0, 0
        return (group, count + 1, used + bytes_), (at, group)

    return ordered_fold(items, [shard], [order], [order, size], lambda: (1, 0, 0), step, f"{shard} long, {order} long, group_id long")
