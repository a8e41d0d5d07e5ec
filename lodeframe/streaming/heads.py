"""Heads kept up to date from a stream of commits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions.ordering import shared_folder


def stream_heads(spark: SparkSession, path: str, schema: str, mutations, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all files at ``path`` that are there, and returns its last heads (record_id, ord, op).

    ``mutations`` makes (record_id, ord, op) of the stream's rows. State is one
    row a record in the state store; a batch's heads are written whole to the
    shared folder by the batch's number, so a repeated batch overwrites itself.
    """
    folder = checkpoint or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    state = mutations(source).groupBy("record_id").agg(F.max("ord").alias("ord"), F.max_by("op", "ord").alias("op"))
    last: list[int] = []

    def write(heads: DataFrame, number: int) -> None:
        heads.write.mode("overwrite").parquet(f"{folder}/heads/{number}")
        last.append(number)

    query = state.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/heads/{last[-1]}") if last else spark.createDataFrame([], "record_id long, ord long, op long")
