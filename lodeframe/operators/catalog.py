"""Allocation chains, file sets, inventories, migrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeframe.functions.ordering import settled


def reserve_faults(reserves: DataFrame, stride: int) -> DataFrame:
    """(kind, generation, rule) of reserves (kind, generation, prev_high, new_high) that don't extend the chain by one stride."""
    before = F.lag("new_high").over(W.partitionBy("kind").orderBy("generation"))
    rule = F.when(F.coalesce(before, F.lit(1)) != F.col("prev_high"), "chain").when(F.col("new_high") - F.col("prev_high") != stride, "stride").when(F.col("generation") != F.floor((F.col("new_high") - 1) / stride), "generation")
    return reserves.select("kind", "generation", rule.alias("rule")).where("rule is not null")


def holes(used: DataFrame, high: int) -> DataFrame:
    """(record_id) below ``high`` that no row uses."""
    spark = used.sparkSession
    return spark.range(1, high).withColumnRenamed("id", "record_id").join(used.select("record_id").distinct(), "record_id", "left_anti")


def set_difference(official: DataFrame, found: DataFrame) -> DataFrame:
    """(name, rule) of files that only one side has, counted with repeats."""
    return official.exceptAll(found).select("name", F.lit("missing").alias("rule")).unionByName(found.exceptAll(official).select("name", F.lit("unexpected").alias("rule")))


def current_manifest(manifests: DataFrame) -> DataFrame:
    """The row of the highest generation."""
    return manifests.orderBy(F.desc("generation")).limit(1)


def manifest_faults(manifests: DataFrame) -> DataFrame:
    """(generation, rule): generations rise by one in one store."""
    by = W.partitionBy("store").orderBy("generation")
    rule = F.when(F.col("generation") != F.coalesce(F.lag("generation").over(by), F.col("generation") - 1) + 1, "generation")
    return manifests.select("generation", rule.alias("rule")).where("rule is not null")


def inventory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(name, size, sha256) of whole files, read by Spark."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def migration_path(steps: DataFrame, first: int, last: int) -> DataFrame:
    """(step, name, version_from, version_to) along the only edges from ``first`` on, to ``last``; empty if it isn't reached. At most one edge leaves a version.

    Versions reached are found by doubling: those at most n steps away, and
    where n steps lead from each, give those at most 2n away. Rounds are the
    logarithm of the number of edges, which bounds a path, so a cycle ends.
    """
    edges = settled(steps.where(F.col("version_from") != last))
    reached = steps.sparkSession.range(1).select(F.lit(first).cast("long").alias("at"), F.lit(0).cast("long").alias("before"))
    jump = edges.select(F.col("version_from").alias("at"), F.col("version_to").alias("to"))
    span, count = 1, edges.count()
    while span <= count:
        ahead = reached.join(jump, "at").select(F.col("to").alias("at"), (F.col("before") + span).alias("before"))
        reached = settled(reached.unionByName(ahead).groupBy("at").agg(F.min("before").alias("before")))
        jump = settled(jump.join(jump.select(F.col("at").alias("to"), F.col("to").alias("then")), "to").select("at", F.col("then").alias("to")))
        span *= 2
    found = edges.join(reached, edges.version_from == reached["at"]).select((F.col("before") + 1).alias("step"), "name", "version_from", "version_to")
    return found.where(reached.agg(F.max((F.col("at") == last).cast("int"))).scalar() == 1)
