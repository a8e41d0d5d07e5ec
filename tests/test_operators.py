"""Operators on small logs, good and damaged, and against plain replay."""

import random

import pytest
from pyspark.sql import functions as F

from lodeframe.functions.ordering import row_number, running_total
from lodeframe.operators import admission, batches, catalog, replay, reports, segments
from lodeframe.schema import address_fault, align8, radix_slot, unsigned_decimal, unsigned_order


def test_running_total_over_many_buckets(spark):
    values = [(i * 37, i % 11) for i in range(500)]
    random.Random(1).shuffle(values)
    got = running_total(spark.createDataFrame(values, "o long, v long"), "o", F.col("v"), "t", bits=4).collect()
    total, want = 0, {}
    for o, v in sorted(values):
        total += v
        want[o] = total
    assert {r.o: r.t for r in got} == want
    n = row_number(spark.createDataFrame([(x,) for x in (5, -3, 9, 70000, 1 << 40)], "o long"), "o", "n").collect()
    assert {r.o: r.n for r in n} == {-3: 1, 5: 2, 9: 3, 70000: 4, 1 << 40: 5}


def test_unsigned_and_addresses(spark):
    d = spark.createDataFrame([(-1,), (0,), (5,), (-(1 << 63),)], "i long")
    r = d.select("i", radix_slot(F.col("i"), 6).alias("s6"), radix_slot(F.col("i"), 7).alias("s7"), unsigned_decimal(F.col("i")).cast("string").alias("u")).orderBy(unsigned_order(F.col("i"))).collect()
    assert [x.i for x in r] == [0, 5, -(1 << 63), -1]
    assert (r[3].s6, r[3].s7, r[3].u) == (511, 1, "18446744073709551615")
    f = spark.createDataFrame([(0, 4096), (1, 4088), (1, 4097), (1, 4096)], "s long, o long").select(address_fault(F.col("s"), F.col("o")).alias("f")).collect()
    assert [x.f for x in f] == ["segment", "header", "alignment", None]
    assert [r.a for r in spark.createDataFrame([(1,), (8,), (64,)], "x long").select(align8(F.col("x")).alias("a")).collect()] == [8, 8, 64]


def random_log(seed, n=400):
    rng = random.Random(seed)
    return [(rng.randrange(20) + 1, i, i // rng.choice([3, 3, 4]) + 1, rng.choice([1, 1, 1, 1, 2]), rng.randrange(50), 64) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_a_plain_one(spark, seed):
    log = sorted(random_log(seed), key=lambda r: (r[2], r[1]))
    aborted = {b for b in {r[2] for r in log} if b % 7 == 0}
    m = spark.createDataFrame(log, "record_id long, ord long, batch_id long, op long, value_bytes long, phys long")
    final = batches.collapse(m.where(~F.col("batch_id").isin(*aborted)))
    commits = final.join(batches.commit_sequence(final), "batch_id")
    state = {}
    for record, ord_, batch, op, size, _ in log:
        if batch not in aborted:
            state[record] = (op, size, batch)
    got = {r.record_id: (r.op, r.value_bytes, r.batch_id) for r in replay.heads(commits).collect()}
    assert got == state
    last = commits.agg(F.max("commit_seq")).first()[0]
    for cut in (0, last // 2, last):
        root = replay.live(replay.heads_at(commits, cut))
        delta = replay.heads(commits.where(F.col("commit_seq") > cut))
        merged = replay.overlay(root, delta, ["commit_seq", "value_bytes"]).collect()
        assert {(r.record_id, r.value_bytes) for r in merged} == {(k, v[1]) for k, v in state.items() if v[0] == 1}


def test_multi_record_admission_is_serial_order(spark):
    rng = random.Random(3)
    rows, state, want = [], {}, {}
    for b in range(1, 120):
        entries = []
        for r in rng.sample(range(1, 15), rng.randrange(1, 4)):
            expected = rng.choice([None, state.get(r, 0), 0, b - 1])
            entries.append((r, expected, rng.random() < 0.8, rng.choice([1, 1, 2])))
        ok = all(e is None or state.get(r, 0) == e for r, e, _, _ in entries)
        want[b] = ok
        if ok:
            for r, _, writes, op in entries:
                if writes:
                    state[r] = b if op == 1 else 0
        rows += [(b, *e) for e in entries]
    got = admission.multi_record(spark.createDataFrame(rows, "batch_id long, record_id long, expected long, writes boolean, op int")).collect()
    assert {r.batch_id: r.accepted for r in got} == want


def test_damaged_logs(spark):
    assert [r.batch_id for r in replay.descriptor_faults(spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, 14)], "batch_id long, frame_seq long")).collect()] == [2]
    f = {(r.rule, r.value) for r in replay.sequence_faults(spark.createDataFrame([(1,), (2,), (2,), (5,), (6,)], "commit_seq long")).collect()}
    assert f == {("repeated", 2), ("gap", 5)}
    assert [r.batch_id for r in replay.duplicate_terminals(spark.createDataFrame([(1,), (2,), (2,)], "batch_id long")).collect()] == [2]
    assert segments.alias_faults(spark.createDataFrame([(1, 4096, 7), (1, 4096, 8), (2, 4096, 9)], "segment_id long, seg_off long, record_id long")).count() == 1
    r = spark.createDataFrame([("id", 1, 1, 65), ("id", 2, 65, 129), ("id", 3, 200, 264)], "kind string, generation long, prev_high long, new_high long")
    assert [x.rule for x in catalog.reserve_faults(r, 64).collect()] == ["chain"]
    j = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 4)], "o long, s long, p long")
    assert [(x.before, x.p) for x in admission.state_transition_faults(j, "o", "s", "p").collect()] == [(2, 4)]


def test_migration(spark):
    steps = spark.createDataFrame([("a", 1, 2), ("b", 2, 3), ("c", 3, 1), ("d", 7, 8)], "name string, version_from long, version_to long")
    assert [r.name for r in catalog.migration_path(steps, 1, 3).orderBy("step").collect()] == ["a", "b"]
    assert catalog.migration_path(steps, 1, 9).count() == 0
    assert catalog.migration_path(steps, 7, 3).count() == 0


def test_relocation_is_by_entry(spark):
    s = spark.createDataFrame([(1, 1, False, None, 10), (1, 2, True, 10, 11), (1, 3, True, 10, 12), (2, 1, False, None, 20), (2, 2, False, None, None), (2, 3, True, 20, 21)], "record_id long, seq long, relocation boolean, expected long, new_address long")
    got = {(r.record_id, r.seq): (r.applied, r.address) for r in segments.relocate_chain(s).collect()}
    assert got == {(1, 1): (True, 10), (1, 2): (True, 11), (1, 3): (False, 11), (2, 1): (True, 20), (2, 2): (True, None), (2, 3): (False, None)}


def test_groups_and_rotation_limits(spark):
    d = spark.createDataFrame([(0, i, s) for i, s in enumerate([500, 10, 10, 10, 10, 90, 95])], "shard long, o long, s long")
    assert [r.group_id for r in batches.groups(d, "o", "s", 3, 100).orderBy("o").collect()] == [1, 2, 2, 2, 3, 3, 4]
    got = segments.rotate(spark.createDataFrame([(0, 1, 20000), (0, 2, 64), (0, 3, 64)], "shard long, o long, s long"), "o", "s", 16384).orderBy("o").collect()
    assert [(r.segment_id, r.seg_off) for r in got] == [(1, 4096), (2, 4096), (2, 4160)]


def test_metric_text():
    assert reports.label_text({"b": 'x"y', "a": "p\\q\nr"}) == '{a="p\\\\q\\nr",b="x\\"y"}' and reports.label_text({}) == ""
    assert len(reports.METRICS) == 32


@pytest.mark.parametrize("n", [1, 2, 7, 120])
def test_migration_path_of_any_length(spark, n):
    edges = [(f"m{i}", i, i + 1) for i in range(n)]
    steps = spark.createDataFrame(edges, "name string, version_from long, version_to long")
    got = sorted(tuple(r) for r in catalog.migration_path(steps, 0, n).collect())
    assert got == [(i + 1, *e) for i, e in enumerate(edges)]
    assert catalog.migration_path(steps, 0, n + 1).count() == 0


def test_migration_path_ends_in_a_cycle(spark):
    steps = spark.createDataFrame([("a", 0, 1), ("b", 1, 2), ("c", 2, 0)], "name string, version_from long, version_to long")
    assert catalog.migration_path(steps, 0, 9).count() == 0
    assert [r.name for r in catalog.migration_path(steps, 0, 2).orderBy("step").collect()] == ["a", "b"]
