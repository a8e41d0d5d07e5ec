"""The pipeline's stages on a small input, one after the other, and the registered queries."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import registry


def small(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 200")
    return d.withColumn("copies", F.col("doc_id") * 2).withColumn("score", F.lit("x")).withColumn("kept", F.lit(1))


def test_stages(spark, sf_dir):
    docs = small(spark, sf_dir)
    more = docs.limit(1).withColumn("doc_id", F.lit(9001).cast("long"))
    docs = docs.unionByName(more.withColumn("text", F.lit(None).cast("string"))).unionByName(more.withColumn("text", F.lit("123 456")).withColumn("doc_id", F.lit(9002).cast("long")))
    (_, first), (_, second), (_, third), (_, last) = corpus_pipeline.STAGES
    known = first(spark, docs, sf_dir)
    assert known.columns == docs.columns
    ids = {r.doc_id for r in known.select("doc_id").collect()}
    assert not ids & {9001, 9002} and len(ids) >= 195
    w = next(r.text for r in known.collect() if r.n_chars > 1500).split()
    near = list(w)
    near[random.Random(1).randrange(len(w))] = "edited"
    more = known.limit(1)
    planted = known.unionByName(more.withColumn("doc_id", F.lit(9003).cast("long")).withColumn("text", F.lit(" ".join(near)))).unionByName(more)
    once = second(spark, planted, sf_dir)
    rows = once.select("doc_id").collect()
    assert once.columns == docs.columns and 9003 not in {r.doc_id for r in rows} and len(rows) == len({r.doc_id for r in rows})
    mixed = third(spark, once, sf_dir)
    assert mixed.columns == docs.columns and {r["count"] for r in mixed.groupBy("doc_id").count().collect()} <= {1, 2}
    assert last(spark, mixed, sf_dir).select(F.sum("length")).first()[0] > 0
    for stage in (first, second, third, last):
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_registry(spark):
    names = sorted(registry.queries())
    assert [int(n[2:].split("_")[0]) for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = registry.queries()[name](spark, sf_dir).select(*columns)
    assert Counter(tuple(r) for r in got.collect()) == Counter(found.fetchall())
