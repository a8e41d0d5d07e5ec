"""The queries over the derived logs, one for each operator of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions import codec
from lodeframe.functions.ordering import one_row, row_number
from lodeframe.operators import admission, batches, catalog, radix, replay, reports, segments
from lodeframe.schema import DELTA_ENTRY, PUT, address_fault, address_offset, address_segment, pack_address, unsigned_decimal, unsigned_order
from lodeframe.sources import logs
from lodeframe.streaming.heads import stream_heads as run_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
LIVE = ("record_id", "commit_seq", "revision", "segment_id", "seg_off", "phys")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _commits(s: SparkSession, d: str) -> DataFrame:
    """Final mutations of committed batches with their commit_seq."""
    final = batches.collapse(logs.event_mutations(s, d).where("not aborted"))
    return final.join(batches.commit_sequence(final), "batch_id")


def _live(s: SparkSession, d: str) -> DataFrame:
    return replay.live(replay.heads(_commits(s, d)))


def _final(s: SparkSession, d: str) -> DataFrame:
    return batches.collapse(logs.event_mutations(s, d)).withColumn("aborted", F.col("batch_id") % logs.ABORT_EVERY == 0)


def _literal(s: SparkSession, values: list[int], name: str = "record_id") -> DataFrame:
    return s.createDataFrame([(v,) for v in values], f"{name} long")


@query
def put_frames(s, d):
    return logs.event_puts(s, d).select("record_id", "ord", "batch_id", "value_bytes", "phys", "segment_id", "seg_off")


@query
def batch_collapse(s, d):
    return batches.collapse(logs.event_mutations(s, d))


@query
def batch_payloads(s, d):
    return batches.payloads(logs.event_mutations(s, d))


@query
def commit_seq(s, d):
    return batches.commit_sequence(logs.event_mutations(s, d).where("not aborted"))


@query
def live_heads(s, d):
    at = logs.event_puts(s, d).select("ord", "segment_id", "seg_off")
    return _live(s, d).join(at, "ord").select("record_id", "commit_seq", F.col("batch_id").alias("revision"), "segment_id", "seg_off", "phys")


@query
def point_get(s, d):
    return replay.point_get(_live(s, d), _literal(s, [1, 2, 3, 5, 8, 13, 21, 34, 1_000_000]))


@query
def layered_lookup(s, d):
    c = logs.order_commits(s, d)
    cut, own, _ = logs.order_cuts(c)
    newest = replay.heads(c.where(F.col("commit_seq") > cut), ("op",))
    frozen = replay.heads(c.where((F.col("commit_seq") > own) & (F.col("commit_seq") <= cut)), ("op",))
    root = replay.live(replay.heads_at(c, own, ("op",)))
    return replay.layered_lookup([newest, frozen, root], c.select("record_id").distinct()).select("record_id", F.col("layer").cast("long").alias("layer"), "op")


@query
def heads_asof_cut(s, d):
    c = logs.order_commits(s, d)
    return replay.live(replay.heads_at(c, logs.order_cuts(c)[0], ("op", "value_bytes"))).select("record_id", "commit_seq", "value_bytes")


@query
def overlay_merge(s, d):
    c = logs.order_commits(s, d)
    cut = logs.order_cuts(c)[0]
    root = replay.live(replay.heads_at(c, cut, ("op", "value_bytes")))
    delta = replay.heads(c.where(F.col("commit_seq") > cut), ("op", "value_bytes"))
    return replay.overlay(root, delta, ["commit_seq", "value_bytes"])


@query
def tombstones(s, d):
    return replay.heads(_commits(s, d)).where(F.col("op") != PUT).select("record_id", "commit_seq", "batch_id")


@query
def delta_entries(s, d):
    c = logs.order_commits(s, d)
    cut = logs.order_cuts(c)[0]
    delta = replay.heads(c.where(F.col("commit_seq") > cut), ("op",))
    return delta.groupBy("op").agg(F.count("*").alias("entries"), (DELTA_ENTRY * F.count("*")).alias("charged_bytes"))


@query
def replay_window(s, d):
    return replay.after(logs.event_puts(s, d), 2, 12288).select("record_id", "ord", "segment_id", "seg_off")


@query
def history_of_record(s, d):
    return replay.history(_commits(s, d), 7).select("commit_seq", "batch_id", "op", "replaced_by")


@query
def log_sequence_check(s, d):
    """The commit numbers with every 50th dropped and every 70th doubled, as a damaged log."""
    c = batches.commit_sequence(logs.event_mutations(s, d).where("not aborted"))
    return replay.sequence_faults(c.where("commit_seq % 50 <> 0").unionByName(c.where("commit_seq % 70 = 0")))


def _terminals(s, d):
    b = _final(s, d).select("batch_id").distinct()
    c = batches.commit_sequence(b.where(F.col("batch_id") % logs.ABORT_EVERY != 0))
    state = F.when(F.col("batch_id") % 500 == 0, "OPEN").when(F.col("batch_id") % logs.ABORT_EVERY == 0, "ABORTED").when(F.col("batch_id") % 333 == 0, "UNKNOWN").otherwise("COMMITTED")
    b = b.join(c, "batch_id", "left").withColumn("state", state)
    return b.withColumn("serial", F.when(F.col("state") != "OPEN", F.col("batch_id")))


@query
def status_by_batch(s, d):
    t = _terminals(s, d)
    asked = t.select("batch_id").unionByName(_literal(s, [0, 1_000_001, 2_000_000], "batch_id"))
    return admission.statuses(asked, t, 64, (1_000_000, 1_000_500), 1_000_000)


@query
def status_retention(s, d):
    return admission.retained(_terminals(s, d).where("serial is not null"), 64).select("batch_id", "state", "commit_seq")


@query
def status_checkpoint(s, d):
    n = _terminals(s, d).where("serial is not null").agg(F.count("*").alias("terminals"))
    return n.select("terminals", admission.checkpoint_needed(F.col("terminals"), 1024).alias("needed"))


@query
def duplicate_terminals(s, d):
    t = _terminals(s, d).where("serial is not null").select("batch_id")
    return replay.duplicate_terminals(t.unionByName(t.where("batch_id % 40 = 0")))


@query
def condition_conflicts(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "click", "absent").otherwise("revision")
    c = e.where("event_type in ('click', 'view', 'purchase')").select((F.shiftright("event_id", 3) + 1).alias("batch_id"), (F.col("user_id") % 20 + 1).alias("record_id"), kind.alias("kind"), F.when(kind == "revision", F.col("event_id") % 3).otherwise(0).alias("revision"))
    return batches.condition_conflicts(c)


@query
def limit_violations(s, d):
    return batches.limit_violations(logs.event_mutations(s, d), 110, 7, 16)


@query
def live_puts(s, d):
    return segments.live_puts(logs.event_puts(s, d), _live(s, d)).select("record_id", "ord", "phys", "segment_id", "seg_off")


@query
def dead_puts(s, d):
    return segments.dead_puts(logs.event_puts(s, d), _live(s, d)).select("record_id", "ord", "phys", "segment_id", "seg_off")


@query
def verify_report(s, d):
    return reports.verify_report(logs.event_puts(s, d), _live(s, d), _final(s, d), _commits(s, d))


@query
def segment_stats(s, d):
    return segments.statistics(segments.live_puts(logs.event_puts(s, d), _live(s, d)))


@query
def segment_footer(s, d):
    return segments.footers(logs.event_puts(s, d))


@query
def footer_check(s, d):
    """Footers against a log that lost the frames of every 977th event."""
    puts = logs.event_puts(s, d)
    return segments.footer_faults(segments.footers(puts), puts.where("ord % 977 <> 5"))


@query
def alias_check(s, d):
    """Live addresses, with record 1 also at the first address of another one."""
    live = live_heads(s, d).select("record_id", "segment_id", "seg_off")
    extra = live.where("record_id > 1").groupBy().agg(F.min_by(F.struct("segment_id", "seg_off"), "record_id").alias("a")).where("a is not null")
    return segments.alias_faults(live.unionByName(extra.select(F.lit(1_000_000).cast("long").alias("record_id"), "a.segment_id", "a.seg_off")))


@query
def dangling_check(s, d):
    return segments.dangling(_commits(s, d), logs.event_puts(s, d).where("segment_id <> 3 or seg_off >= 8192")).select("record_id", "batch_id", "ord")


def _candidates(s, d):
    puts = logs.event_puts(s, d)
    feet = segments.footers(puts)
    stats = segments.statistics(segments.live_puts(puts, _live(s, d)))
    # The replay start lies in the last segment.
    return segments.candidates(feet, stats, feet.agg(F.max("segment_id")).scalar())


@query
def gc_candidates(s, d):
    return _candidates(s, d).select("segment_id", "live_bytes", "reclaimable")


@query
def gc_pick(s, d):
    refs = logs.event_puts(s, d).where("batch_id % 200 = 1")
    return segments.pick(_candidates(s, d), refs, 3).select("segment_id", "reclaimable")


@query
def gc_space_bound(s, d):
    return _candidates(s, d).select("segment_id", segments.copy_space(F.col("live_bytes"), F.col("live_records"), 1 << 20, 1 << 20).alias("copy_bytes"), segments.checkpoint_space(F.col("live_records"), 1 << 20, 1 << 20).alias("checkpoint_bytes"))


@query
def gc_throttle(s, d):
    return _candidates(s, d).select("segment_id", segments.throttle(F.col("live_bytes"), F.col("segment_id").cast("double") / 128, 1024).alias("delay"))


@query
def gc_resume(s, d):
    j = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 8 + 1).alias("phase"), (F.col("o_custkey") % 3 - 1).alias("published"), (F.col("o_orderkey") % 3 == 0).alias("in_manifest"), (F.col("o_custkey") % 2 == 0).alias("has_live"))
    return j.select("o_orderkey", segments.resume_action(F.col("phase"), F.col("published"), F.col("in_manifest"), F.col("has_live")).alias("action"))


def _relocation(s, d):
    c = logs.order_commits(s, d)
    cut, own, point = logs.order_cuts(c)
    wanted = replay.live(replay.heads_at(c, cut, ("op", "value_bytes"))).where(F.col("commit_seq") <= own)
    return wanted, segments.relocate(wanted, replay.heads_at(c, point, ("op",)))


@query
def relocation_cas(s, d):
    return _relocation(s, d)[1]


@query
def relocation_result(s, d):
    wanted, done = _relocation(s, d)
    both = done.join(wanted.select("record_id", "value_bytes"), "record_id")
    return both.agg(F.count("*").alias("candidates"), F.count(F.when(F.col("applied"), 1)).alias("relocated"), F.count(F.when(~F.col("applied"), 1)).alias("skipped"), F.coalesce(F.sum(F.when(F.col("applied"), F.col("value_bytes"))), F.lit(0)).alias("copied_value_bytes"))


@query
def relocation_chain(s, d):
    """Orders as puts of address seq, every fifth as a relocation that expects the address one, every tenth two puts back."""
    from pyspark.sql import Window as W

    by = W.partitionBy("record_id").orderBy("seq")
    o = logs.order_commits(s, d).select("record_id", F.col("commit_seq").alias("seq"), "op")
    move = F.col("seq") % 5 == 0
    back = F.when(F.col("seq") % 10 == 0, F.lag("seq", 2).over(by)).otherwise(F.lag("seq", 1).over(by))
    steps = o.select("record_id", "seq", move.alias("relocation"), F.when(move, back).alias("expected"), F.when(move | (F.col("op") == PUT), F.col("seq")).alias("new_address"))
    return segments.relocate_chain(steps)


@query
def gc_after_heads(s, d):
    """Heads after relocation: addresses move, revisions and values stay."""
    wanted, done = _relocation(s, d)
    c = logs.order_commits(s, d)
    now = replay.live(replay.heads_at(c, logs.order_cuts(c)[2], ("op", "batch_id", "value_bytes")))
    moved = done.where("applied").select("record_id", F.lit(True).alias("m"))
    return now.join(moved, "record_id", "left").select("record_id", F.col("batch_id").alias("revision"), "value_bytes", F.col("m").isNotNull().alias("moved"))


@query
def radix_slots(s, d):
    return radix.slots(logs.radix_ids(s, d))


@query
def radix_lookup(s, d):
    ids = logs.radix_ids(s, d)
    asked = s.range(1, 400).select((F.col("id") * 1000003 + F.col("id") % 2).alias("id"))
    return radix.lookup(ids, asked)


@query
def radix_nodes_by_level(s, d):
    return radix.levels(radix.nodes(logs.radix_ids(s, d)))


@query
def node_encoding(s, d):
    """Nodes over dense ids, so that both encodings are there."""
    return radix.nodes(s.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") + 1).alias("id")))


@query
def dirty_path(s, d):
    return radix.dirty(logs.radix_ids(s, d).where("id % 7 = 0"))


@query
def mapping_space(s, d):
    ids = logs.radix_ids(s, d)
    return radix.space(ids.where("id % 7 <> 0"), ids, ids.where("id % 7 = 0"))


@query
def address_codec(s, d):
    p = logs.event_puts(s, d).select("ord", pack_address(F.col("segment_id"), F.col("seg_off") + F.col("ord") % 97 % 2).alias("address"))
    return p.select("ord", "address", address_segment(F.col("address")).alias("segment_id"), address_offset(F.col("address")).alias("seg_off"), address_fault(address_segment(F.col("address")), address_offset(F.col("address"))).alias("fault"))


@query
def unsigned_ids(s, d):
    """Ids spread over all 64 bits, in unsigned order."""
    ids = s.read.parquet(f"{d}/nation.parquet").select(((F.col("n_nationkey").cast("long") - 12) * 768614336404564650).alias("id"))
    n = ids.withColumn("o", unsigned_order(F.col("id")))
    from pyspark.sql import Window as W

    # A table of 25 rows.
    return n.select(unsigned_decimal(F.col("id")).cast("string").alias("id"), F.row_number().over(W.orderBy("o")).cast("long").alias("rank"))


@query
def reserve_chain(s, d):
    """Reserves of 64 ids by batch, the seventh of them lost and the eleventh too long."""
    n = _final(s, d).select(F.shiftright(F.col("batch_id") - 1, 6).alias("g")).distinct().where("g <> 6")
    r = n.select(F.lit("batch").alias("kind"), (F.col("g") + 1).alias("generation"), (F.col("g") * 64 + 1).alias("prev_high"), ((F.col("g") + 1) * 64 + 1 + F.when(F.col("g") == 10, 8).otherwise(0)).alias("new_high"))
    return catalog.reserve_faults(r, 64)


@query
def id_holes(s, d):
    used = logs.order_commits(s, d).where("commit_seq % 3 = 0").select("record_id")
    high = s.read.parquet(f"{d}/customer.parquet").count() + 1
    return catalog.holes(used, high)


@query
def descriptor_islands(s, d):
    """Frames of two entries a part and a seal; the seal of every 97th batch comes late."""
    final = _final(s, d).where("not aborted")
    n = final.groupBy("batch_id").agg(F.ceil(F.count("*") / 2).alias("parts"))
    parts = n.select("batch_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts"))).alias("i"), "parts")
    late = (F.col("batch_id") % 97 == 0) & (F.col("i") == F.col("parts"))
    return replay.descriptor_faults(parts.select("batch_id", (F.col("batch_id") * 16 + F.col("i") + F.when(late, 5).otherwise(0)).alias("frame_seq")))


@query
def frame_checks(s, d):
    """Frame fields with a fault in some rows."""
    e = s.read.parquet(f"{d}/events.parquet")
    kinds = F.array(*[F.lit(k) for k in ("put", "commit_part", "commit_seal", "batch_abort", "id_reserve", "unknown")])
    f = e.select("event_id", F.get(kinds, (F.col("event_id") % 6).cast("int")).alias("kind"), (F.col("event_id") % 5).alias("b"), (F.col("user_id") % 2).alias("r"), (F.col("event_id") % 4 * 32).alias("p"))
    return f.select("event_id", "kind", replay.frame_fault(F.col("kind"), F.col("b"), F.col("r"), F.col("p")).alias("fault")).where("fault is not null")


@query
def journal_transitions(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    step = F.col("event_id") % 7
    j = e.select(F.floor(F.col("event_id") / 7).alias("operation"), step.alias("step"), (step + 1 + F.when((F.col("event_type") == "purchase") & (step == 3), 1).otherwise(0)).alias("phase"))
    return admission.state_transition_faults(j, "operation", "step", "phase")


@query
def stats_reconcile(s, d):
    """Statistics of a checkpoint at commit 600 against those of now."""
    puts, commits = logs.event_puts(s, d), _commits(s, d)
    then = segments.statistics(segments.live_puts(puts, replay.live(replay.heads_at(commits, 600))))
    return segments.statistics_faults(then, segments.statistics(segments.live_puts(puts, replay.live(replay.heads(commits)))))


@query
def file_set_diff(s, d):
    name = F.concat(F.lit("segment-"), F.col("segment_id").cast("string"))
    feet = logs.event_puts(s, d).select("segment_id").distinct()
    return catalog.set_difference(feet.select(name.alias("name")), feet.where("segment_id <> 2").select(name.alias("name")).unionByName(feet.where("segment_id = 1").select(F.lit("segment-999").alias("name"))))


@query
def cas_admission(s, d):
    return admission.single_record(logs.conditional_commits(s, d))


@query
def multi_record_admission(s, d):
    """Batches of two orders; the second expects its record's last seen revision."""
    from pyspark.sql import Window as W

    o = s.read.parquet(f"{d}/orders.parquet")
    batch = F.shiftright("o_orderkey", 1) + 1
    e = o.select(batch.alias("batch_id"), (F.col("o_custkey") + 1).alias("record_id"), "o_orderkey")
    seen = F.lag("batch_id", 1, 0).over(W.partitionBy("record_id").orderBy("o_orderkey"))
    e = e.withColumn("expected", F.when(F.col("o_orderkey") % 2 == 1, F.when(seen == F.col("batch_id"), None).otherwise(seen)))
    e = e.groupBy("batch_id", "record_id").agg(F.max("expected").alias("expected"))
    return admission.multi_record(e.withColumn("writes", F.lit(True)).withColumn("op", F.lit(1)))


@query
def group_formation(s, d):
    n = _final(s, d).where("not aborted").groupBy("batch_id").agg((24 * F.count("*") + 64).alias("bytes"))
    return batches.groups(n.withColumn("shard", F.lit(0).cast("long")), "batch_id", "bytes", 64, 4096).select("batch_id", "group_id")


@query
def gc_batches(s, d):
    p = logs.event_puts(s, d)
    return batches.groups(p.withColumnRenamed("segment_id", "shard"), "ord", "phys", 16, 1000).select(F.col("shard").alias("segment_id"), "ord", "group_id")


@query
def segment_rotation(s, d):
    p = logs.document_puts(s, d).withColumn("shard", F.lit(0).cast("long"))
    return segments.rotate(p, "record_id", "phys", 1 << 20).select("record_id", "segment_id", "seg_off")


@query
def disk_admission(s, d):
    r = logs.event_mutations(s, d).select("ord", (F.col("value_bytes") * 8).alias("bytes"))
    return segments.admit_space(r, 8192, 512, 100)


@query
def migration_path(s, d):
    n = s.read.parquet(f"{d}/nation.parquet")
    key = F.col("n_nationkey").cast("long")
    steps = n.select(F.col("n_name").alias("name"), key.alias("version_from"), (key + F.when(key % 3 == 0, 3).otherwise(1)).alias("version_to"))
    return catalog.migration_path(steps, 0, 21)


@query
def manifest_chain(s, d):
    """Generations with one lost."""
    g = s.read.parquet(f"{d}/nation.parquet").where("n_nationkey <> 9").select(F.lit("a").alias("store"), (F.col("n_nationkey") + 1).cast("long").alias("generation"))
    return catalog.manifest_faults(g)


@query
def current_manifest(s, d):
    g = s.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") + 1).cast("long").alias("generation"), F.col("n_name").alias("name"))
    return catalog.current_manifest(g)


def _metrics(s, d):
    m = _terminals(s, d).agg(F.count(F.when(F.col("state") == "COMMITTED", 1)).alias("committed_total"), F.count(F.when(F.col("state") == "ABORTED", 1)).alias("aborted_total"), F.count(F.when(F.col("state") == "UNKNOWN", 1)).alias("commit_unknown_total"), F.count("*").alias("commit_queued_total"))
    c = admission.single_record(logs.conditional_commits(s, d)).agg(F.count(F.when(~F.col("accepted"), 1)).alias("conflicts_total"))
    r = relocation_result(s, d).select(F.col("relocated").alias("gc_relocated_records_total"), F.col("skipped").alias("gc_skipped_records_total"))
    return reports.samples(one_row(m, c, r))


@query
def metric_samples(s, d):
    return _metrics(s, d)


@query
def metrics_text(s, d):
    return reports.exposition(_metrics(s, d), {"store": 'a"b\\c\nd', "app": "lode"})


@query
def json_report(s, d):
    return reports.as_json(verify_report(s, d).select("data_files", "put_records", "live_records", "live_bytes", "dead_records", "dead_bytes"))


@query
def backup_inventory(s, d):
    return catalog.inventory(s, [f"{d}/{t}.parquet" for t in ("region", "nation", "supplier")])


@query
def soak_values(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", reports.soak_value(F.col("user_id"), F.col("event_id"), 8 + F.col("event_id") % 57).alias("value"))


@query
def soak_maxima(s, d):
    p = logs.event_puts(s, d).groupBy("segment_id").agg(F.sum("value_bytes").alias("logical"), F.sum("phys").alias("allocated"))
    return p.agg(F.max("logical").alias("max_logical"), F.max("allocated").alias("max_allocated"))


@query
def frame_decode(s, d):
    """Puts encoded to frames, every 500th damaged, and decoded again."""
    p = row_number(logs.event_puts(s, d), "ord", "frame_seq")
    raw = codec.encode_puts(p)
    damaged = F.when(F.col("seg_off") % 4000 == 96, F.concat(F.substring("raw", 1, 66), F.lit(b"\xff"), F.substring("raw", 68, F.length("raw")))).otherwise(F.col("raw"))
    f = codec.decode_raw(raw.withColumn("raw", damaged))
    return f.select("segment_id", "seg_off", "frame_type", "frame_seq", "batch_id", "record_id", F.col("payload").cast("string").alias("value"), "phys", "fault")


@query
def stream_heads(s, d):
    def mutations(events):
        op = F.when(F.col("event_type") == "error", 2).otherwise(1).cast("long")
        return events.where((F.shiftright("event_id", 3) + 1) % logs.ABORT_EVERY != 0).select((F.col("user_id") + 1).alias("record_id"), F.col("event_id").alias("ord"), op.alias("op"))

    return run_stream(s, f"{d}/events.parquet", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", mutations)
