"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import ann, html, langid, lm, mixing, neardup, packing, sharding, syncmers, urls


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "url_score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2, percent=80)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.byte_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.where("not held_out"))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "lang_spans")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_packing": op2_packing,
        "op3_nearest": op3_nearest,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_sharding": op6_sharding,
        "op7_main_text": op7_main_text,
        "op8_fingerprints": op8_fingerprints,
        "op9_language_id": op9_language_id,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_lm_scoring": OP5_SQL, "op10_mixing": OP10_SQL}


#: Words and their counts by document, in all, and so in all others; then each word's score from its longest history that others have.
OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), total AS (
  SELECT CAST(sum(len(ws)) AS BIGINT) AS n FROM d
), t AS (
  SELECT r, len(ws) AS size, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u
  FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)
), o1 AS (
  SELECT r, w, count(*) AS n FROM t GROUP BY ALL
), o2 AS (
  SELECT r, v, w, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY ALL
), o3 AS (
  SELECT r, u, v, w, count(*) AS n FROM t WHERE u IS NOT NULL GROUP BY ALL
), f1 AS (
  SELECT r, w, CAST(sum(n) OVER (PARTITION BY w) AS BIGINT) - n AS n FROM o1
), f2 AS (
  SELECT r, v, w, CAST(sum(n) OVER (PARTITION BY v, w) AS BIGINT) - n AS n FROM o2
), f3 AS (
  SELECT r, u, v, w, CAST(sum(n) OVER (PARTITION BY u, v, w) AS BIGINT) - n AS n FROM o3
), s1 AS (
  SELECT t.r, t.u, t.v, t.w, greatest(w1.n, 0.5::DOUBLE) / greatest(total.n - t.size, 1) AS s, v1.n AS nv, vw.n AS nvw, uv.n AS nuv, uvw.n AS nuvw
  FROM t CROSS JOIN total JOIN f1 w1 ON w1.r = t.r AND w1.w = t.w LEFT JOIN f1 v1 ON v1.r = t.r AND v1.w = t.v
  LEFT JOIN f2 vw ON vw.r = t.r AND vw.v = t.v AND vw.w = t.w LEFT JOIN f2 uv ON uv.r = t.r AND uv.v = t.u AND uv.w = t.v
  LEFT JOIN f3 uvw ON uvw.r = t.r AND uvw.u = t.u AND uvw.v = t.v AND uvw.w = t.w
), s2 AS (
  SELECT *, CASE WHEN v IS NULL THEN s WHEN nvw > 0 THEN nvw::DOUBLE / nv ELSE 0.4::DOUBLE * s END AS s2 FROM s1
), s3 AS (
  SELECT r, CASE WHEN u IS NULL THEN s2 WHEN nuvw > 0 THEN nuvw::DOUBLE / nuv ELSE 0.4::DOUBLE * s2 END AS s, CASE WHEN nvw > 0 OR nuvw > 0 THEN 1 ELSE 0 END AS seen FROM s2
), x AS (
  SELECT r, count(*) AS n_words, CAST(sum(seen) AS BIGINT) AS n_seen, CAST(sum(CAST(floor(ln(s) * 1000000 + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) AS units FROM s3 GROUP BY r
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_seen, 0) AS n_seen, coalesce(units, 0) / 1000000::DOUBLE AS score,
  CASE WHEN n_words > 0 THEN units / 1000000::DOUBLE / n_words END AS mean_score
FROM d LEFT JOIN x ON d.r = x.r
"""

#: Targets as in mixing.targets, inclusion as in mixing.inclusion, draws as in mixing.uniform.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
    2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s0
), s2 AS (
  SELECT *, cap / w AS full_at,
    (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1
), s3 AS (
  SELECT *, max(CASE WHEN level <= full_at THEN level END) OVER () AS t FROM s2
), s4 AS (
  SELECT source, source_size, CASE WHEN t IS NULL THEN cap ELSE least(w * t, cap) END AS target FROM s3
), s5 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12::DOUBLE) ELSE 0 END AS whole FROM s4
), s6 AS (
  SELECT *, greatest(0.0::DOUBLE, target - whole * source_size) AS part FROM s5
), c0 AS (
  SELECT source, length(bin(size)) AS weight, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL
), c1 AS (
  SELECT c0.source, weight, source_size, target, whole, part,
    coalesce(CAST(sum(words) OVER (PARTITION BY c0.source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS certain,
    CAST(sum(weight * words) OVER (PARTITION BY c0.source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS opened
  FROM c0 JOIN s6 ON c0.source IS NOT DISTINCT FROM s6.source
), c2 AS (
  SELECT *, CASE WHEN opened > 0 THEN (part - certain) / opened END AS level FROM c1
), c3 AS (
  SELECT *, max(CASE WHEN level * weight <= 1 THEN level END) OVER (PARTITION BY source) AS t FROM c2
), c AS (
  SELECT *, least(greatest(coalesce(least(1.0::DOUBLE, t * weight), 1.0::DOUBLE), 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) AS p FROM c3
), u AS (
  SELECT d.doc_id, d.source, d.size, c.source_size, c.target, c.whole, c.part, c.p,
    (CAST(('0x' || substr(md5('7' || chr(31) || coalesce(CAST(d.doc_id AS VARCHAR), chr(0)) || chr(31) || digest), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND length(bin(d.size)) = c.weight
), q AS (
  SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q0 FROM u
), r AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY q0 / (1 + q0), size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ended FROM q
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN size > 0 AND part > 0 AND 2 * ended - size <= 2 * part THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
