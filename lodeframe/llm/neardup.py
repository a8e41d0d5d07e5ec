"""Near-duplicate documents by SetSketch registers.

1. Every whole text becomes a set of hashed word shingles, and the set a
   SetSketch: M registers, each the exponentially spaced, truncated logarithm
   of the least of independent exponential variables over the elements.
   Registers merge by maximum. Texts with equal sets form one class, named by
   its smallest doc_id, and only classes go on.
2. Classes are banded on BANDS x ROWS register values; a bucket is a band's
   values. Buckets with the same members count once.
3. In a bucket, pairs not yet linked are estimated jointly by maximum
   likelihood from the registers and the exact set sizes, and those that may
   reach the similarity are confirmed on the full sets. A confirmed link merges
   the two groups, so a group of n copies needs about n checks, not n * n.
   Nothing is emitted for a pair: a bucket gives each member its group.
   Large buckets are cut into blocks, and blocks are compared two by two in
   tasks of their own, so no task holds a whole hot bucket.
4. Components of these links by repeated minima over the neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import U64, lean, mix, settled, shingle_sets, slices, trimmed, utf8

#: Registers, of which the first BANDS * ROWS are banded. At similarity 0.8 a pair shares no band in 5 of 100,000 cases.
M, BANDS, ROWS = 128, 25, 5
#: SetSketch parameters: base, rate, highest register.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: A pair is confirmed on full sets if its likeliest similarity is within this of the asked one (over five standard errors).
SLACK = 0.2
#: Members of a bucket and bytes of their sets that one task compares.
BLOCK_ROWS, BLOCK_BYTES = 4096, 24 << 20
#: Labels of components that a task writes in a round.
LABELS_PER_FILE = 10_000
#: Members up to which their ids are broadcast to find their texts.
BROADCAST_IDS = 2_000_000
_SALT_A, _SALT_B, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03), U64(0xA0761D6478BD642F)


def setsketch(sets: list[np.ndarray], m: int = M) -> np.ndarray:
    """A row of ``m`` registers for each set of 64-bit hashes (empty: zeros).

    Each element runs a Poisson process of rate m * RATE whose arrivals carry a
    register at random; a register's first arrival is then exponential with
    rate RATE, independently. An element stops once its next arrival is later
    than every register's least, so a set of n costs about n + m log m steps.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    least = np.full(n * m, np.inf)
    if not sizes.sum():
        return np.zeros((n, m), np.uint16)
    state = np.concatenate(sets)
    row = np.repeat(np.arange(n), sizes)
    now = np.zeros(len(state))
    top = np.full(n, np.inf)
    turn = 0
    while len(state):
        state = mix(state + _STEP)
        now = now - np.log((mix(state ^ _SALT_A) >> U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / (m * RATE)
        register = ((state >> U64(40)) % U64(m)).astype(np.int64)
        np.minimum.at(least, row * m + register, now)
        turn += 1
        if turn < 4 or turn % 8 == 0:
            top = least.reshape(n, m).max(axis=1) if len(state) > n else top
            if len(state) <= n:
                alive = np.unique(row)
                top[alive] = least.reshape(n, m)[alive].max(axis=1)
            go = now < top[row]
            state, row, now = state[go], row[go], now[go]
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(least) / np.log(BASE))
    k[~np.isfinite(least)] = 0
    return np.clip(k, 0, LIMIT + 1).astype(np.uint16).reshape(n, m)


_GRID = np.linspace(0.0, 1.0, 51)


def likeliest(a: np.ndarray, na: float, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of one sketch with each of several, given the sizes of the sets."""
    m = b.shape[1]
    up, down = (a[None, :] > b).sum(axis=1), (a[None, :] < b).sum(axis=1)
    u = na / (na + nb)
    v = 1 - u
    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u)[:, None])

    def differ(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    p_up, p_down = differ(u[:, None] - v[:, None] * j), differ(v[:, None] - u[:, None] * j)
    tiny = 1e-9
    same = (m - up - down)[:, None]
    ll = up[:, None] * np.log(p_up + tiny) + down[:, None] * np.log(p_down + tiny) + same * np.log(np.maximum(1 - p_up - p_down, tiny))
    best = np.argmax(ll, axis=1)
    return j[np.arange(len(j)), best]


def groups(sets: list[np.ndarray], sketches: np.ndarray, percent: int, split: int | None = None) -> np.ndarray:
    """Each member's group (the first member's index) under links of ``percent`` % or more; with ``split``, only pairs across that index count."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    group = np.arange(n)
    everything = owner = None
    floor = percent / 100 - SLACK
    for i in range(n if split is None else split):
        first = i + 1 if split is None else split
        others = np.flatnonzero(group[first:] != group[i]) + first
        # Sets whose sizes alone rule the similarity out.
        others = others[(100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])) & (sizes[others] > 0)]
        if not len(others) or not sizes[i]:
            continue
        est = likeliest(sketches[i], sizes[i], sketches[others], sizes[others])
        others = others[est >= floor]
        if len(others) > 32:
            # Counts of shared elements with all at once, from the sorted elements of the block.
            if everything is None:
                everything, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
                order = np.argsort(everything, kind="stable")
                everything, owner = everything[order], owner[order]
            lo, hi = np.searchsorted(everything, sets[i], "left"), np.searchsorted(everything, sets[i], "right")
            span = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum())
            shared = np.bincount(owner[at], minlength=n)[others]
        else:
            shared = np.array([len(np.intersect1d(sets[i], sets[o], assume_unique=True)) for o in others], np.int64)
        linked = others[100 * shared >= percent * (sizes[i] + sizes[others] - shared)]
        if len(linked):
            joined = np.unique(np.append(group[linked], group[i]))
            group[np.isin(group, joined)] = joined[0]
    return group


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(*utf8(batch.column("text")), k)
            sums = [(mix(s ^ _SALT_A).sum(dtype=np.uint64), mix(s ^ _SALT_B).sum(dtype=np.uint64)) for s in sets]
            print_ = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
            regs = setsketch(sets)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(print_[:, 0]), pa.array(print_[:, 1]), pa.array([r.tobytes() for r in regs], pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "sketch"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("rep").to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        regs = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, M)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64) + _SALT_B), regs.shape[:2]).copy()
        for j in range(ROWS):
            key = mix(key ^ regs[:, :, j]) + _STEP
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(ids, BANDS)), pa.array(np.repeat(batch.column("n_shingles").to_numpy(zero_copy_only=False), BANDS))], names=["key", "rep", "n_shingles"])


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(*utf8(batch.column("text")), k)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([r.tobytes() for r in setsketch(sets)], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "sketch", "elements"])

    return run


def _compare(percent: int):
    """Links of rows (key, i, j, side, rep, sketch, elements) that come sorted by the first five; one (key, i, j) is in memory at a time."""

    def link(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        regs = np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(-1, M)
        split = sum(r[0] == 0 for r in rows)
        group = groups(sets, regs, percent, split if split < len(rows) else None)
        return [(rows[x][1], rows[g][1]) for x, g in enumerate(group.tolist()) if rows[x][1] != rows[g][1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        at, rows, found = None, [], []
        for batch in batches:
            c = [batch.column(n).to_pylist() for n in ("key", "i", "j", "side", "rep", "sketch", "elements")]
            for key, i, j, *row in zip(*c):
                if (key, i, j) != at:
                    found += link(rows)
                    at, rows = (key, i, j), []
                rows.append(tuple(row))
            if found:
                yield out(found)
                found = []
        found += link(rows)
        yield out(found)

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node of ``links`` (a, b): the smallest node that can be reached.

    Minima over neighbours, then over the label's own label, until nothing
    changes. Each round ends in the shared checkpoint folder.
    """
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    edges = settled(links.select(both.alias("e")).select("e.a", "e.b").distinct())
    # Each round writes a label for each node: in as few files as their number asks for.
    files = edges.count() // LABELS_PER_FILE + 1
    labels = settled(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).coalesce(files))
    while True:
        near = edges.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        # A label is a node too: its own label is the jump.
        own = labels.join(near, "a").select("a", "l", F.least("l", "m").alias("m"))
        jump = labels.select(F.col("a").alias("m"), F.col("l").alias("jumped"))
        new = settled(own.join(jump, "m").select("a", "l", F.least("m", "jumped").alias("m")).coalesce(files))
        moved = new.where("l <> m").limit(1).count()
        labels = new.select("a", F.col("m").alias("l"))
        if not moved:
            return labels.select(F.col("a").alias("node"), F.col("l").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Two texts are linked if their sets of distinct ``words``-word shingles have
    100 * intersection >= ``percent`` * union. ``component_id`` is the smallest
    doc_id reachable over links. Texts without words have an empty set and no
    link. Rows that share a doc_id are one document here. A null doc_id is in
    no component (null) and kept. An empty table gives no rows; other columns
    are ignored.
    """
    lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sketched = settled(docs.mapInArrow(trimmed(_sketches(words)), "doc_id long, n_shingles long, f1 long, f2 long, sketch binary"))
    live = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = settled(live.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")))
    nodes = classes.select("rep", "n_shingles", "sketch")

    banded = nodes.mapInArrow(trimmed(_bands), "key long, rep long, n_shingles long")
    tag = F.xxhash64("rep", F.lit(1))
    buckets = banded.groupBy("key").agg(F.count("*").alias("n"), F.sum(8 * F.col("n_shingles") + 2 * M).alias("bytes"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.bit_xor(tag).alias("x"), F.bit_xor(F.xxhash64(tag)).alias("y"))
    buckets = buckets.where("lo < hi").groupBy("n", "lo", "hi", "x", "y").agg(F.min("key").alias("key"), F.first("bytes").alias("bytes"))
    buckets = buckets.select("key", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    members = settled(banded.join(buckets, "key").select("key", "rep", "blocks"))

    ids = settled(members.select("rep").distinct())
    count = ids.count()
    # Few ids are broadcast so that no other text is shuffled; many are joined by shuffle.
    texts = docs.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, F.col("doc_id") == F.col("rep"))
    full = texts.select("rep", "text").dropDuplicates().mapInArrow(trimmed(_sets(words)), "rep long, sketch binary, elements binary")

    # A member of block b of n is compared in the tasks (min(b, x), max(b, x)) for all x: side says which block it is there.
    block = F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "rep", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"))
    together = dealt.join(full, "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "rep")
    pairs = together.select("key", "i", "j", "side", "rep", "sketch", "elements").mapInArrow(trimmed(_compare(percent)), "a long, b long")
    found = components(pairs)

    named = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("f1").alias("_1"), F.col("f2").alias("_2"), F.col("n_shingles").alias("_n"), F.coalesce("component", "rep").alias("_c"))
    out = sketched.join(named, (F.col("f1") == F.col("_1")) & (F.col("f2") == F.col("_2")) & (F.col("n_shingles") == F.col("_n")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
