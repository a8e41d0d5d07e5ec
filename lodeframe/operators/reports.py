"""Reports and metrics as rows and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.ordering import one_row
from lodeframe.schema import ABORT_FRAME, FRAME_HEADER, MUTATION_ENTRY, SEAL_FRAME

PREFIX = "lode_"
# Metrics in their order, with c for counters and g for gauges.
METRICS = (
    ("commit_queued_total", "c"), ("commit_groups_total", "c"), ("commit_group_batches_total", "c"), ("committed_total", "c"), ("aborted_total", "c"), ("conflicts_total", "c"), ("commit_unknown_total", "c"), ("queue_wait_nanoseconds_total", "c"),
    ("validation_nanoseconds_total", "c"), ("write_sync_nanoseconds_total", "c"), ("publish_nanoseconds_total", "c"), ("delta_charged_bytes", "g"), ("delta_reserved_bytes", "g"), ("delta_soft_limit_bytes", "g"), ("delta_hard_limit_bytes", "g"), ("mapping_cache_bytes", "g"),
    ("gc_started_total", "c"), ("gc_completed_total", "c"), ("gc_failed_total", "c"), ("gc_no_candidate_total", "c"), ("gc_insufficient_space_total", "c"), ("gc_copied_bytes_total", "c"), ("gc_reclaimed_bytes_total", "c"), ("gc_relocated_records_total", "c"),
    ("gc_skipped_records_total", "c"), ("gc_duration_nanoseconds_total", "c"), ("gc_throttled_nanoseconds_total", "c"), ("disk_available_estimate_bytes", "g"), ("write_stop_free_bytes", "g"), ("write_stopped", "g"), ("write_stop_rejections_total", "c"), ("disk_space_check_errors_total", "c"),
)


def system_bytes(final: DataFrame) -> DataFrame:
    """(batch_id, system_bytes) of descriptors: a part of a batch's entries and its seal, or an abort."""
    n = final.groupBy("batch_id", "aborted").agg(F.count("*").alias("n"))
    return n.select("batch_id", F.when(F.col("aborted"), ABORT_FRAME).otherwise(FRAME_HEADER + MUTATION_ENTRY * F.col("n") + SEAL_FRAME).cast("long").alias("system_bytes"))


def verify_report(puts: DataFrame, live: DataFrame, final: DataFrame, commits: DataFrame) -> DataFrame:
    """One row: files, frames, live and dead records and bytes, bytes of system frames, entries, last commit. Each input is read once."""
    marked = puts.join(live.select("record_id", "ord", F.lit(True).alias("__live")), ["record_id", "ord"], "left")
    is_live = F.col("__live").isNotNull()
    a = marked.agg(
        F.countDistinct("segment_id").alias("data_files"), F.count("*").alias("put_records"), F.coalesce(F.sum("phys"), F.lit(0)).alias("put_bytes"),
        F.count(F.when(is_live, 1)).alias("live_records"), F.coalesce(F.sum(F.when(is_live, F.col("phys"))), F.lit(0)).alias("live_bytes"),
        F.count(F.when(~is_live, 1)).alias("dead_records"), F.coalesce(F.sum(F.when(~is_live, F.col("phys"))), F.lit(0)).alias("dead_bytes"),
    )
    b = system_bytes(final).agg(F.coalesce(F.sum("system_bytes"), F.lit(0)).alias("system_frame_bytes"))
    c = live.agg(F.count("*").alias("mapping_entries"))
    d = commits.agg(F.coalesce(F.max("commit_seq"), F.lit(0)).alias("current_commit_seq"))
    return one_row(a, b, c, d)


def samples(values: DataFrame) -> DataFrame:
    """(position, name, kind, value) in the fixed order from one row whose columns are metric names; absent ones are 0."""
    row = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("position"), F.lit(PREFIX + name).alias("name"), F.lit("counter" if kind == "c" else "gauge").alias("kind"), (F.col(name).cast("long") if name in values.columns else F.lit(0).cast("long")).alias("value")) for i, (name, kind) in enumerate(METRICS)])
    return values.select(F.explode(row).alias("m")).select("m.*")


def label_text(labels: dict[str, str]) -> str:
    """Labels in braces, sorted by name, with backslash, quote and newline escaped."""
    if not labels:
        return ""
    shown = [f'{k}="' + labels[k].replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"' for k in sorted(labels)]
    return "{" + ",".join(shown) + "}"


def exposition(samples: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(position, text): each sample's type line and value line."""
    text = F.concat(F.lit("# TYPE "), F.col("name"), F.lit(" "), F.col("kind"), F.lit("\n"), F.col("name"), F.lit(label_text(labels)), F.lit(" "), F.col("value").cast("string"), F.lit("\n"))
    return samples.select("position", text.alias("text"))


def as_json(report: DataFrame) -> DataFrame:
    """One column ``report``: each row as a JSON object."""
    return report.select(F.to_json(F.struct("*")).alias("report"))


def soak_value(index: Column, version: Column, size: Column) -> Column:
    """``index:version:`` repeated and cut to ``size`` characters."""
    one = F.concat(index.cast("string"), F.lit(":"), version.cast("string"), F.lit(":"))
    return F.substring(F.repeat(one, (F.floor(size / F.length(one)) + 1).cast("int")), F.lit(1), size.cast("int"))
