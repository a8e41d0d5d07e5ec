"""Which conditional batches are admitted, and what a batch's status is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.ordering import ordered_fold, row_number, settled


def single_record(commits: DataFrame) -> DataFrame:
    """(record_id, seq, accepted, revision): whether each commit's expected revision was current, and the revision after it.

    ``expected`` null: blind, always accepted; 0: expects the record absent.
    Records are independent; blind commits need no earlier answer, but a
    conditional one does, so each record is a fold in order.
    """

    def step(current, seq, newrev, expected):
        accepted = expected is None or expected == current
        current = newrev if accepted else current
        return current, (seq, accepted, current)

    return ordered_fold(commits, ["record_id"], ["seq"], ["seq", "newrev", "expected"], lambda: 0, step, "record_id long, seq long, accepted boolean, revision long")


def linked(pairs: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): the smallest node reachable, by repeated minima and jumps."""
    edges = settled(pairs.union(pairs.select("b", "a")).distinct())
    labels = settled(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")))
    while True:
        near = edges.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        own = labels.join(near, "a").select("a", "l", F.least("l", "m").alias("m"))
        new = settled(own.join(labels.select(F.col("a").alias("m"), F.col("l").alias("jumped")), "m").select("a", "l", F.least("m", "jumped").alias("m")))
        moved = new.where("l <> m").limit(1).count()
        labels = new.select("a", F.col("m").alias("l"))
        if not moved:
            return labels.select(F.col("a").alias("node"), F.col("l").alias("component"))


def multi_record(entries: DataFrame) -> DataFrame:
    """(batch_id, accepted) from (batch_id, record_id, expected, writes boolean, op): a batch is admitted if all its conditions hold on what earlier admitted batches left.

    Only batches that share ids, directly or through others, have a say in each
    other, so each such component is folded on its own, in batch order.
    Conditions are read before the batch's own writes; a conflicting batch
    changes nothing. One giant component is one task, as its answers are a chain.
    """
    first = entries.groupBy("record_id").agg(F.min("batch_id").alias("a"))
    pairs = entries.join(first, "record_id").select("a", F.col("batch_id").alias("b"))
    component = linked(pairs).select(F.col("node").alias("batch_id"), "component")
    batches = entries.groupBy("batch_id").agg(F.collect_list(F.struct("record_id", "expected", "writes", "op")).alias("entries")).join(component, "batch_id")

    def step(revisions, batch_id, entries):
        accepted = all(e["expected"] is None or revisions.get(e["record_id"], 0) == e["expected"] for e in entries)
        if accepted:
            for e in entries:
                if e["writes"]:
                    revisions[e["record_id"]] = batch_id if e["op"] == 1 else 0
        return revisions, (batch_id, accepted)

    return ordered_fold(batches, ["component"], ["batch_id"], ["batch_id", "entries"], dict, step, "component long, batch_id long, accepted boolean").select("batch_id", "accepted")


def statuses(asked: DataFrame, batches: DataFrame, retention: int, recovery: tuple[int, int], issued: int) -> DataFrame:
    """(batch_id, status, commit_seq) of the asked ids.

    ``batches``: (batch_id, state, commit_seq, serial) in order of completion;
    OPEN ones have no serial. An open batch answers first, then a kept terminal
    one, then the range aborted by recovery, then expired below ``issued``.
    """
    kept = retained(batches.where("serial is not null"), retention).select("batch_id", "state", "commit_seq")
    known = batches.where("serial is null").select("batch_id", "state", "commit_seq").unionByName(kept)
    found = asked.join(known, "batch_id", "left")
    status = F.when(F.col("batch_id") <= 0, "INVALID").when(F.col("state").isNotNull(), F.col("state"))
    status = status.when((F.col("batch_id") >= recovery[0]) & (F.col("batch_id") < recovery[1]), "ABORTED").when(F.col("batch_id") < issued, "EXPIRED").otherwise("NOT_FOUND")
    return found.select("batch_id", status.alias("status"), "commit_seq")


def retained(batches: DataFrame, retention: int) -> DataFrame:
    """Terminal statuses that are kept: the newest ``retention`` resolved ones by serial, and every unknown."""
    resolved = row_number(batches.where("state <> 'UNKNOWN'"), "serial", "__n")
    kept = resolved.where(F.col("__n") > resolved.agg(F.max("__n")).scalar() - retention).drop("__n")
    return kept.unionByName(batches.where("state = 'UNKNOWN'"))


def checkpoint_needed(terminals_since_cut: Column, retention: int) -> Column:
    """Whether so many terminal statuses since the cut ask for a checkpoint: from three quarters of the retention on."""
    return terminals_since_cut >= max(1, retention - retention // 4)


def state_transition_faults(steps: DataFrame, key: str, order: str, phase: str) -> DataFrame:
    """(key, order, before, phase) of steps that neither repeat their predecessor's phase nor raise it by one."""
    from pyspark.sql import Window as W

    before = F.lag(phase).over(W.partitionBy(key).orderBy(order))
    d = steps.withColumn("before", before).where((F.col(phase) < F.col("before")) | (F.col(phase) > F.col("before") + 1))
    return d.select(key, order, "before", phase)
