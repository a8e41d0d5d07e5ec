"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words: its weight's share of the budget, held to
``cap`` times its words, the excess reshared by weight (water filling). Every
document of a source then gets ``floor(target / words)`` certain whole copies,
and some of the documents one more, with unequal probability: a document's
inclusion probability is ``min(1, level * weight)``, where the source's level
makes the expected words those that are left to it, and the weight is by
default the number of binary digits of the document's size, so fragments are
repeated less often than long texts. The sample's size is fixed, not expected:
with the random number U of a document and its inclusion probability p,
documents rank by ``(U / (1 - U)) / (p / (1 - p))``, lowest first, until the
words left are used up.

The cut is found without a sort of a whole source in a task: ranks fall into
``BUCKETS`` equal parts, sums of words for each (source, bucket) show in which
bucket the cut lies, and only that bucket's ranks are put in order, bucket
within bucket, twice. Rows of one rank are counted, not sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeframe.llm.common import count_words, settled

#: Parts of the rank's range at each of the two levels.
BUCKETS = 1024
#: Sources up to which their one-row-each table is broadcast.
BROADCAST_SOURCES = 200_000


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row each.

    Weights go to the sources by code point, null last, and repeat. The level
    t with sum(min(weight * t, cap * source_size)) = budget * total is found
    from sources sorted by the t at which they reach their cap. Where the
    budget is above all caps together, every source is at its cap.
    """
    by = W.orderBy(F.asc_nulls_last("source"))
    rank = F.row_number().over(by) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    every = W.partitionBy(F.lit(0))
    s = sizes.withColumn("_w", weight).withColumn("_cap", cap * F.col("source_size")).withColumn("_total", budget * F.sum("source_size").over(every))
    s = s.withColumn("_full_at", F.col("_cap") / F.col("_w"))
    up = W.orderBy("_full_at", F.asc_nulls_last("source"))
    capped = F.coalesce(F.sum("_cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("_w").over(up.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("_level", (F.col("_total") - capped) / open_)
    # Past the last capped source the levels only fall, so the first that holds is the largest.
    s = s.withColumn("_t", F.max(F.when(F.col("_level") <= F.col("_full_at"), F.col("_level"))).over(every))
    return s.select("source", "source_size", F.when(F.col("_t").isNull(), F.col("_cap")).otherwise(F.least(F.col("_w") * F.col("_t"), F.col("_cap"))).alias("target"))


def uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the key alone: 52 bits of an md5."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in key])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, cap: float = 2.0, seed: int = 7, weight_column: str | None = None) -> DataFrame:
    """``docs`` with columns size, source_size, target, copies, taken.

    ``size`` counts words (null text: 0), ``copies`` is 0 to ceil(cap), and
    ``taken`` = size * copies. A source's taken words miss its target by at
    most half a document at the cut. ``weight_column`` (positive, else 1; taken
    to the nearest eighth of a power of two) replaces the weights by size. Null
    is a source of its own. A document's random number depends on seed, doc_id
    and text, so reruns and any partitioning agree; rows that share or lack an
    id are drawn on their own. Of rows that are equal in id, text, source and
    weight as many are taken as the target asks for, whichever these are.
    Sources without words have target 0 and no copies. Existing columns with
    the names above are replaced.
    """
    own = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*own)
    text = F.col("text").cast("string")
    words = count_words(text)
    weight = F.length(F.bin(words)).cast("long")
    if weight_column:
        given = F.col(weight_column).cast("double")
        weight = F.pow(F.lit(2.0), F.round(F.log2(F.when((given > 0) & (given < float("inf")), given).otherwise(1.0)) * 8) / 8)
    u = uniform(seed, F.col("doc_id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    slim = settled(docs.select("source", words.alias("size"), weight.alias("_w"), u.alias("_u")))
    sizes = settled(slim.groupBy("source", "_w").agg(F.sum("size").alias("_words")))
    goal = targets(sizes.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, budget, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    goal = goal.withColumn("_whole", whole).withColumn("_left", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size")))
    goal = settled(inclusion(sizes, goal.withColumnRenamed("source", "_source")))
    # A row for each source and weight: broadcast only if few, else joined by shuffle, where adaptive execution splits hot sources.
    small = F.broadcast if goal.count() <= BROADCAST_SOURCES else (lambda x: x)
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_w") == F.col("_weight"))

    rank = _rank(F.col("_u"), F.col("_p"))
    cuts = settled(_cuts(slim.where("size > 0").join(small(goal), same).withColumn("_q", rank)))
    goal = goal.join(cuts, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")

    j = docs.withColumns({"size": words, "_w": weight, "_u": u}).join(small(goal), same).withColumn("_q", rank)
    able = (F.col("size") > 0) & (F.col("_left") > 0)
    out = [*docs.columns, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")]

    def finished(rows: DataFrame, extra: Column) -> DataFrame:
        return rows.withColumn("copies", (F.col("_whole") + F.when(able & extra, 1).otherwise(0)).cast("int")).select(*out)

    inside = F.col("_q_cut").isNull() | (F.col("_q") <= F.col("_q_cut"))
    if not cuts.where("_in < _tied").limit(1).count():
        return finished(j, inside)
    # Equal rows lie across a cut: they are numbered, each task's on their own.
    torn = F.coalesce(able & (F.col("_q") == F.col("_q_cut")) & (F.col("_in") < F.col("_tied")), F.lit(False))
    equal = settled(j.where(torn).withColumn("_task", F.spark_partition_id()))
    by = W.partitionBy("_source", "_task")
    before = equal.groupBy("_source", "_task").agg(F.count("*").alias("_n"))
    before = before.select(F.col("_source").alias("_s"), F.col("_task").alias("_t"), F.coalesce(F.sum("_n").over(W.partitionBy("_source").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    equal = equal.withColumn("_number", F.row_number().over(by.orderBy("_task"))).join(before, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_task") == F.col("_t")))
    return finished(j.where(~torn), inside).unionByName(finished(equal, F.col("_before") + F.col("_number") <= F.col("_in")))


def inclusion(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` by source and weight, with the inclusion probability ``_p`` of the last copy: ``min(1, level * weight)``, the source's level being such that the words expected are ``_left``.

    Levels are sought as in ``targets``: weights from the largest on, those
    before one being certain. Windows are over a source's weights, a few dozen
    rows.
    """
    s = sizes.withColumnRenamed("_w", "_weight").join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("source")
    of = W.partitionBy("_source")
    down = of.orderBy(F.desc("_weight"))
    certain = F.coalesce(F.sum("_words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("_weight") * F.col("_words")).over(down.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("_level", F.when(open_ > 0, (F.col("_left") - certain) / open_))
    s = s.withColumn("_t", F.max(F.when(F.col("_level") * F.col("_weight") <= 1, F.col("_level"))).over(of))
    p = F.coalesce(F.least(F.lit(1.0), F.col("_t") * F.col("_weight")), F.lit(1.0))
    return s.withColumn("_p", F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))).select("_source", "_weight", "source_size", "target", "_whole", "_left", "_p")


def _rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds, as q / (1 + q), which keeps the order and lies in (0, 1)."""
    q = (u / (1 - u)) / (p / (1 - p))
    return q / (1 + q)


def _cuts(ranked: DataFrame) -> DataFrame:
    """(_s, _q_cut, _tied, _in) by source: the last rank that gets one more copy, how many rows have it, and how many of them get it. A source without a row gives it to all."""
    b = F.least(F.lit(BUCKETS - 1), F.floor(F.col("_q") * BUCKETS)).cast("int")
    r = ranked.withColumn("_b", b)
    r = r.withColumn("_bb", F.least(F.lit(BUCKETS - 1), F.floor((F.col("_q") * BUCKETS - F.col("_b")) * BUCKETS)).cast("int"))
    fine = r.groupBy("source", "_b", "_bb").agg(F.sum("size").alias("_n"), F.first("_left").alias("_goal"))

    def first_over(sums: DataFrame, bucket: str, before: Column, keep: list[str]) -> DataFrame:
        run = W.partitionBy("source").orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)
        sums = sums.withColumn("_end", before + F.sum("_n").over(run)).where(F.col("_end") > F.col("_goal"))
        return sums.groupBy(F.col("source").alias("_s")).agg(F.min(F.struct(bucket, (F.col("_end") - F.col("_n")).alias("_done"), *keep)).alias("_at"))

    coarse = fine.groupBy("source", "_b").agg(F.sum("_n").alias("_n"), F.first("_goal").alias("_goal"))
    at = first_over(coarse, "_b", F.lit(0), []).select("_s", F.col("_at._b").alias("_cut_b"), F.col("_at._done").alias("_before"))
    inner = fine.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_cut_b"))).drop("_s")
    at = first_over(inner, "_bb", F.col("_before"), ["_cut_b"]).select("_s", F.col("_at._cut_b").alias("_cut_b"), F.col("_at._bb").alias("_cut_bb"), F.col("_at._done").alias("_before"))
    # Only ranks of the cut's bucket, about one in BUCKETS squared, meet in a window; equal ones as one row.
    edge = r.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_cut_b")) & (F.col("_bb") == F.col("_cut_bb")))
    edge = edge.groupBy("_s", "_q", "size").agg(F.count("*").alias("_tied"), F.first("_left").alias("_left"), F.first("_before").alias("_before"), F.first("_cut_b").alias("_cut_b"), F.first("_cut_bb").alias("_cut_bb"))
    earlier = W.partitionBy("_s").orderBy("_q", "size").rowsBetween(W.unboundedPreceding, -1)
    edge = edge.withColumn("_start", F.col("_before") + F.coalesce(F.sum(F.col("size") * F.col("_tied")).over(earlier), F.lit(0)))
    # The document across the cut is in if that ends nearer to the target: if its middle is not past it.
    fit = F.floor((2 * (F.col("_left") - F.col("_start")) + F.col("size")) / (2 * F.col("size")))
    edge = edge.withColumn("_in", F.greatest(F.lit(0), F.least(F.col("_tied"), fit)))
    below = F.col("_cut_b") / BUCKETS + F.col("_cut_bb") / (BUCKETS * BUCKETS)
    last = F.max(F.when(F.col("_in") > 0, F.struct("_q", "size", "_tied", "_in")))
    cut = edge.groupBy("_s").agg(last.alias("_last"), F.min(below).alias("_below"))
    return cut.select("_s", F.coalesce("_last._q", F.col("_below") - 1e-15).alias("_q_cut"), F.coalesce("_last._tied", F.lit(0)).alias("_tied"), F.coalesce("_last._in", F.lit(0)).alias("_in"))
