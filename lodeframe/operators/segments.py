"""Where frames lie: rotation, footers, statistics, reclaiming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.ordering import ordered_fold
from lodeframe.schema import MUTATION_ENTRY, NODE_SLOTS, PUT, SEGMENT_FOOTER, SEGMENT_HEADER


def rotate(frames: DataFrame, order: str, size: str, segment_bytes: int, seal: int = 128, shard: str = "shard") -> DataFrame:
    """(shard, order, segment_id, seg_off): greedy filling in order. A frame that with the seal would pass the segment's end opens the next one; an empty segment never rotates."""

    def step(state, at, bytes_):
        segment, pos = state
        if bytes_ + seal > segment_bytes - SEGMENT_FOOTER - pos and pos > SEGMENT_HEADER:
            segment, pos = segment + 1, SEGMENT_HEADER
        return (segment, pos + bytes_), (at, segment, pos)

    return ordered_fold(frames, [shard], [order], [order, size], lambda: (1, SEGMENT_HEADER), step, f"{shard} long, {order} long, segment_id long, seg_off long")


def footers(puts: DataFrame) -> DataFrame:
    """(segment_id, frames, first_ord, last_ord, valid_end) of each segment."""
    return puts.groupBy("segment_id").agg(F.count("*").alias("frames"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.max(F.col("seg_off") + F.col("phys")).alias("valid_end"))


def footer_faults(footers: DataFrame, puts: DataFrame) -> DataFrame:
    """(segment_id, rule) where a stored footer and the segment's frames disagree."""
    own = puts.groupBy("segment_id").agg(F.count("*").alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.max(F.col("seg_off") + F.col("phys")).alias("end"))
    both = footers.join(own, "segment_id", "full_outer")
    rule = F.when(F.col("n").isNull(), "no_frames").when(F.col("frames").isNull(), "no_footer").when(F.col("n") != F.col("frames"), "count").when((F.col("lo") != F.col("first_ord")) | (F.col("hi") != F.col("last_ord")), "range").when(F.col("end") != F.col("valid_end"), "end")
    return both.select("segment_id", rule.alias("rule")).where("rule is not null")


def statistics(live_puts: DataFrame) -> DataFrame:
    """(segment_id, live_bytes, live_records) of segments with live records."""
    return live_puts.groupBy("segment_id").agg(F.sum("phys").alias("live_bytes"), F.count("*").alias("live_records"))


def statistics_faults(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(segment_id, stored_bytes, found_bytes, stored_records, found_records) where a checkpoint's statistics differ from recomputed ones."""
    s = stored.select("segment_id", F.col("live_bytes").alias("stored_bytes"), F.col("live_records").alias("stored_records"))
    f = found.select("segment_id", F.col("live_bytes").alias("found_bytes"), F.col("live_records").alias("found_records"))
    both = s.join(f, "segment_id", "full_outer").na.fill(0, ["stored_bytes", "stored_records", "found_bytes", "found_records"])
    return both.where("stored_bytes <> found_bytes or stored_records <> found_records").select("segment_id", "stored_bytes", "found_bytes", "stored_records", "found_records")


def live_puts(puts: DataFrame, live: DataFrame) -> DataFrame:
    """Puts that a live head points at: same record and same place in the log."""
    return puts.join(live.select("record_id", "ord"), ["record_id", "ord"], "left_semi")


def dead_puts(puts: DataFrame, live: DataFrame) -> DataFrame:
    """All other puts, those of aborted batches too."""
    return puts.join(live.select("record_id", "ord"), ["record_id", "ord"], "left_anti")


def alias_faults(addresses: DataFrame) -> DataFrame:
    """(segment_id, seg_off, records) of addresses that more than one record has."""
    return addresses.groupBy("segment_id", "seg_off").agg(F.countDistinct("record_id").alias("records")).where("records > 1")


def dangling(entries: DataFrame, puts: DataFrame) -> DataFrame:
    """Final put entries without their frame."""
    return entries.where(F.col("op") == PUT).join(puts.select("record_id", "ord", "batch_id"), ["record_id", "ord", "batch_id"], "left_anti")


def candidates(footers: DataFrame, stats: DataFrame, replay_segment: Column | int) -> DataFrame:
    """(segment_id, live_bytes, reclaimable): sealed segments before the replay start with anything to reclaim."""
    d = footers.where(F.col("segment_id") < replay_segment).join(stats, "segment_id", "left").na.fill(0, ["live_bytes", "live_records"])
    d = d.withColumn("reclaimable", F.col("valid_end") - SEGMENT_HEADER - F.col("live_bytes"))
    return d.where("reclaimable > 0").select("segment_id", "live_bytes", "live_records", "reclaimable")


def pick(candidates: DataFrame, open_refs: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` candidates with most to reclaim, lower ids first, of those that no open batch refers to."""
    free = candidates.join(open_refs.select("segment_id").distinct(), "segment_id", "left_anti")
    return free.orderBy(F.desc("reclaimable"), "segment_id").limit(n)


def copy_space(live_bytes: Column, live_records: Column, min_free: int, segment_bytes: int) -> Column:
    """Free bytes that relocating a segment asks for."""
    return F.lit(min_free) + live_bytes + MUTATION_ENTRY * live_records + 2 * segment_bytes


def checkpoint_space(entries: Column, min_free: int, segment_bytes: int) -> Column:
    """Free bytes that a checkpoint of so many entries asks for: a full node on each of eight levels, in whole segments."""
    per_segment = (segment_bytes - SEGMENT_HEADER - SEGMENT_FOOTER) // (64 + 8 * NODE_SLOTS)
    return F.ceil(entries * 8 / per_segment) * segment_bytes + min_free + segment_bytes


def throttle(copied: Column, elapsed: Column, rate: int) -> Column:
    """Seconds to wait so that copying stays at ``rate`` bytes a second."""
    return F.greatest(F.lit(0.0), copied / F.lit(float(rate)) - elapsed)


def relocate(wanted: DataFrame, now: DataFrame) -> DataFrame:
    """(record_id, commit_seq, applied): each entry applies if its record's head is still the row it was copied from."""
    head = now.select("record_id", F.col("commit_seq").alias("__now"), F.col("op").alias("__op"))
    return wanted.join(head, "record_id", "left").select("record_id", "commit_seq", ((F.col("__op") == PUT) & (F.col("__now") == F.col("commit_seq"))).alias("applied"))


def relocate_chain(steps: DataFrame) -> DataFrame:
    """(record_id, seq, applied, address) of user commits and relocations in one order: (record_id, seq, relocation boolean, expected, new_address).

    A user commit always applies (a null address deletes); a relocation does if
    the current address is the expected one. Relocated rows may be relocated
    again, so each record is a fold.
    """

    def step(current, seq, relocation, expected, new):
        applied = not relocation or (current is not None and current == expected)
        current = new if applied else current
        return current, (seq, applied, current)

    return ordered_fold(steps, ["record_id"], ["seq"], ["seq", "relocation", "expected", "new_address"], lambda: None, step, "record_id long, seq long, applied boolean, address long")


def resume_action(phase: Column, published: Column, in_manifest: Column, has_live: Column) -> Column:
    """What to do with an interrupted reclaiming of a segment.

    ``published``: the manifest's maintenance generation against the journal's,
    below 0, 0 or above; then whether the manifest lists the segment, and
    whether its statistics still count live records there. Up to phase 3 the
    work is given up, unless the checkpoint of phase 4 was published already.
    """
    corrupt, retire = F.lit("corrupt"), F.lit("check_empty_and_retire")
    early = F.when(published < 0, "give_up").when((published > 0) | (phase != 3), corrupt).when(has_live, "give_up").when(in_manifest, retire).otherwise(corrupt)
    late = F.when(phase == 4, F.when(in_manifest, retire).otherwise(corrupt)).when(phase == 5, F.when(in_manifest, "remove_from_manifest").otherwise("move_to_trash")).when(phase == 6, F.when(in_manifest, corrupt).otherwise("delete_from_trash")).when(phase == 7, "finish").otherwise(corrupt)
    return F.when(phase.between(1, 3), early).when(published != 0, corrupt).otherwise(late)


def admit_space(requests: DataFrame, available: int, watermark: int, refresh: int) -> DataFrame:
    """(window, ord, admitted, left): a request is admitted if its bytes leave the watermark; what is admitted is taken off until the next refresh, every ``refresh`` requests."""

    def step(left, at, bytes_):
        ok = left >= bytes_ + watermark
        left -= bytes_ if ok else 0
        return left, (at, ok, left)

    d = requests.withColumn("window", F.floor(F.col("ord") / refresh))
    return ordered_fold(d, ["window"], ["ord"], ["ord", "bytes"], lambda: available, step, "window long, ord long, admitted boolean, left long")
