"""Work along one total order without sorting all rows into one task."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Order values in a bucket of the first level, as a power of two; buckets of 2**(2 * BITS) form the second.
BITS = 16


def running_total(df: DataFrame, order: str, value: Column, out: str, bits: int = BITS) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each, along the unique BIGINT ``order``.

    Rows are summed in buckets of order values, then bucket totals in buckets
    of buckets; only totals of those (one for 2**(2 * bits) order values) are
    added up in one place.
    """
    d = df.withColumn("__v", value).withColumn("__b", F.shiftright(F.col(order), bits))
    one = d.groupBy("__b").agg(F.sum("__v").alias("__s")).withColumn("__c", F.shiftright("__b", bits))
    two = one.groupBy(F.col("__c").alias("__k")).agg(F.sum("__s").alias("__t"))
    two = two.select("__k", F.coalesce(F.sum("__t").over(W.orderBy("__k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    before = F.coalesce(F.sum("__s").over(W.partitionBy("__c").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    one = one.withColumn("__own", before).join(two, F.col("__c") == F.col("__k")).select(F.col("__b").alias("__j"), (F.col("__own") + F.col("__before")).alias("__off"))
    inside = F.sum("__v").over(W.partitionBy("__b").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("__in", inside).join(one, F.col("__b") == F.col("__j"))
    return d.withColumn(out, F.col("__in") + F.col("__off")).drop("__v", "__b", "__in", "__j", "__off")


def row_number(df: DataFrame, order: str, out: str, bits: int = BITS) -> DataFrame:
    """``df`` numbered from 1 along the unique BIGINT ``order``."""
    return running_total(df, order, F.lit(1).cast("long"), out, bits)


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """A fold over each group's rows in order: ``state = start()``, then ``state, row = step(state, *columns)`` for each row.

    Rows stream through sorted by key and order, so a group of any size takes
    the memory of its state. Groups run in parallel; one group is one task, as
    the fold's answers depend on each other. ``schema`` names the keys, then
    what ``step`` returns.
    """
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            rows = []
            for values in zip(*[batch.column(c).to_pylist() for c in [*keys, *columns]]):
                if values[:n] != at:
                    at, state = values[:n], start()
                state, row = step(state, *values[n:])
                rows.append((*at, *row))
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = df.sparkSession.createDataFrame([], schema).schema
    names, arrow = parsed.names, to_arrow_schema(parsed)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def ready(spark: SparkSession) -> None:
    """Makes ``checkpoint()`` usable, in spark.checkpoint.dir, which a cluster must name; in local mode a temporary folder serves where it is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lode-"))


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: lineage ends there, and later readers see one fixed result."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A path in the shared checkpoint folder."""
    ready(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def one_row(*tables: DataFrame) -> DataFrame:
    """The columns of several tables of one row each, as one row."""
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    return union.agg(*[F.max(c).alias(c) for c in union.columns])
