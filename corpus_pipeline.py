"""From ``documents`` to packed training sequences.

Language ID drops what no language can be told of, near-dedup keeps one
document of each group, mixing repeats and drops documents so that sources come
near their target weights, and packing makes sequences of token ids. Each stage
takes (spark, docs, sf_dir); all but the last return the columns of
``documents``, whatever other columns come with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeframe.llm import langid, mixing, neardup, packing
from lodeframe.llm.common import ready, settled

#: Words in a shingle, and the similarity in %, at which documents are near copies.
SHINGLE, SIMILAR = 5, 80
WEIGHTS, BUDGET, CAP = (5.0, 2.0, 1.0), 1.5, 2.0


def _aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names renamed, and what they were called."""
    taken = {f"__own_{c}": c for c in docs.columns if c in names}
    for new, old in taken.items():
        docs = docs.withColumnRenamed(old, new)
    return docs, taken


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents for which a language is found, learned from the labelled ones, mixed ones included; null texts and texts without letters go."""
    columns = docs.columns
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    work, taken = _aside(docs, ["lang_pred", "score", "lang_spans"])
    known = langid.identify(work, model).where(F.col("lang_pred") != "und")
    return known.drop("lang_pred", "score", "lang_spans").withColumnsRenamed(taken).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies; one row of each doc_id. Rows without doc_id stay."""
    columns = docs.columns
    found = neardup.near_duplicates(docs, SHINGLE, SIMILAR)
    ids = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max((~F.col("kept")).cast("int")).alias("__out"), F.count("*").alias("__n"))
    ids = settled(ids.where("__out = 1 or __n > 1"))
    count = ids.count()
    # Dropped ids are broadcast while they are few; else all rows meet them by shuffle.
    marked = docs.join(F.broadcast(ids) if count <= neardup.BROADCAST_IDS else ids, F.col("doc_id") == F.col("__id"), "left")
    marked = marked.where("__out is null or __out = 0")
    once = marked.where("__n is null or __n <= 1").select(*columns)
    if not ids.where("__out = 0").limit(1).count():
        return once
    again = marked.where("__n > 1").withColumn("__row", F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")))
    return once.unionByName(again.where("__row = 1").select(*columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies of it, 0 to CAP."""
    columns = docs.columns
    own = ["size", "source_size", "target", "copies", "taken"]
    work, taken = _aside(docs, own)
    mixed = mixing.mix(work, WEIGHTS, BUDGET, CAP).where("copies > 0")
    mixed = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__copy", *own)
    return mixed.withColumnsRenamed(taken).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("mixing", mix_sources), ("packing", pack)]
#: Models, sketches and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's pieces; each stage's table lies in the shared checkpoint folder for the next."""
    ready(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
