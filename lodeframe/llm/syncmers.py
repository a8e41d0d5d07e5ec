"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least hash of its inner
substrings of length S is that of its first or last one. Whether it is chosen
depends on its own characters only, so an edit elsewhere never moves an anchor:
anchors of an edited text are those of its unchanged parts, plus those across
the seams. About 2 in K - S + 1 k-mers are chosen, and no gap between two is
longer than K - S.

Texts of under 4 K code points have anchors of shorter k-mers too (FINER), so
that the two thirds that an edit leaves always yield some. Two fingerprints are
likened by the shortest k-mers that both have; a text of under 24 code points
and one of 96 or more have none in common, nor one of under 8 and one of 24 or
more: their likeness is 0.

A fingerprint holds every anchor with its position, so it grows with the text.
The likeness is taken over the union as multisets, the i-th place of a
hash in one being paired with its i-th in the other: the share that both hold in
the same order, the order being the longest increasing run of positions.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import U64, lean, mix, slices, trimmed

K, S = 24, 9
#: (k, s, limit): texts of under ``limit`` code points have closed syncmers (k, s) too. The limits leave a longer text and what an edit makes of it one k in common.
FINER = ((8, 3, 4 * K), (2, 1, K))
_MULT = np.random.default_rng(5).integers(1, 1 << 62, K, dtype=np.uint64) * U64(2) + U64(1)
#: Code points that numpy works on at once.
PART = 1 << 18


def _part(points: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    p = points.astype(np.uint64)
    window = k - s + 1
    n = len(p) - s + 1
    inner = p[:n] * _MULT[0]
    for j in range(1, s):
        inner += p[j : n + j] * _MULT[j]
    inner = mix(inner)
    least = inner
    width = 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: len(inner) - window + 1], least[window - width :])
    m = len(inner) - window + 1
    at = np.flatnonzero((inner[:m] == least) | (inner[window - 1 :] == least))
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h += p[at + j] * _MULT[j]
    return at, mix(h ^ U64(0x5851F42D4C957F2D))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _all(points: np.ndarray, k: int, s: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all closed syncmers (k, s); the last two bits of a hash are its level."""
    found = [(i, *_part(points[i : i + PART + k - 1], k, s)) for i in range(0, len(points) - k + 1, PART)]
    at, h = (np.concatenate(x) for x in ([i + at for i, at, _ in found], [h for _, _, h in found]))
    return at, (h & ~U64(3)) | U64(level)


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions, ascending, and hashes of all closed syncmers of a text, of all levels that its length has; a single code point is one anchor at 0, an empty text has none."""
    points = _points(text)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(points) == 1:
        return np.zeros(1, np.int64), (mix(points.astype(np.uint64) * _MULT[:1] + U64(1)) & ~U64(3)) | U64(len(FINER))
    found = [_all(points, K, S, 0)] if len(points) >= K else []
    found += [_all(points, k, s, i) for i, (k, s, limit) in enumerate(FINER, 1) if k <= len(points) < limit]
    if len(found) == 1:
        return found[0]
    at, h = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(at, kind="stable")
    return at[order], h[order]


def keep(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All anchors by hash, those of one hash by position."""
    # Positions ascend, so a stable sort leaves them so within a hash.
    order = np.argsort(h, kind="stable")
    return at[order], h[order]


def written(at: np.ndarray, h: np.ndarray) -> str:
    """A fingerprint as text: 16 hex digits of the hash and the position in hex, parted by dots."""
    return ".".join([f"{x:016x}{p:x}" for x, p in zip(h.tolist(), at.tolist())])


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    parts = fingerprint.split(".") if fingerprint else []
    return np.array([int(p[16:], 16) for p in parts], np.int64), np.array([int(p[:16], 16) for p in parts], np.uint64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """From 0 to 1; of two empty fingerprints 1, of an empty and another 0."""
    if not len(a[1]) or not len(b[1]):
        return float(len(a[1]) == len(b[1]))
    levels = [np.unique(x[1] & U64(3)) for x in (a, b)]
    if len(levels[0]) > 1 or len(levels[1]) > 1 or levels[0][0] != levels[1][0]:
        common = np.intersect1d(*levels)
        if not len(common):
            return 0.0
        a, b = ((at[own], h[own]) for at, h in (a, b) for own in [(h & U64(3)) == common[-1]])
    # Where the pair of each of a's places is, if b holds the hash so often.
    n = np.arange(len(a[1]))
    starts = np.concatenate(([True], a[1][1:] != a[1][:-1]))
    where = np.searchsorted(b[1], a[1]) + n - np.maximum.accumulate(np.where(starts, n, 0))
    inside = where < len(b[1])
    inside[inside] = b[1][where[inside]] == a[1][inside]
    if not inside.any():
        return 0.0
    order = np.argsort(a[0][inside], kind="stable")
    places = b[0][where[inside]][order]
    both = len(places)
    if (places[1:] > places[:-1]).all():
        run = both
    else:
        tails: list[int] = []
        for x in places.tolist():
            if not tails or x > tails[-1]:
                tails.append(x)
            else:
                tails[bisect_left(tails, x)] = x
        run = len(tails)
    return run / (len(a[1]) + len(b[1]) - both)


def _edited(text: str, own: tuple, other: str, others: tuple) -> tuple[str, tuple]:
    """The edited text and its anchors: those before the cut and of the inserted part, and new ones across the seam."""
    cut = len(text) - len(text) // 3
    new = text[:cut] + other[: len(text) // 3]
    added = len(new) - cut
    if len(new) < 4 * K or cut < K or added < K or len(text) < K or len(other) < K:
        return new, anchors(new)
    # The new text is long, so it has level 0 alone.
    before = (own[0] <= cut - K) & (own[1] & U64(3) == 0)
    after = (others[0] <= added - K) & (others[1] & U64(3) == 0)
    seam = _all(_points(new[cut - K + 1 : cut + K - 1]), K, S, 0)
    return new, (np.concatenate((own[0][before], seam[0] + (cut - K + 1), others[0][after] + cut)), np.concatenate((own[1][before], seam[1], others[1][after])))


def with_next(docs: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, text, _bucket, _guest): rows dealt into ranges of descending doc_id, each range sorted and ended by a copy of the next range's first row.

    Only ids are looked at to find the ranges; texts move once.
    """
    ids = docs.select("doc_id")
    marks = ids.where("doc_id is not null").selectExpr(f"percentile_approx(doc_id, {'array(' + ', '.join(str(i / partitions) for i in range(1, partitions)) + ')' if partitions > 1 else 'array(0.5)'}, 10000) AS m").first().m or []
    marks = sorted(set(marks), reverse=True) if partitions > 1 else []
    # Null ids come last.
    bucket = F.when(F.col("doc_id").isNull(), len(marks))
    if marks:
        falling = F.array(*[F.lit(m).cast("long") for m in marks])
        bucket = bucket.otherwise(F.size(F.filter(falling, lambda m: m > F.col("doc_id"))))
    else:
        bucket = bucket.otherwise(0)
    heads = {r._bucket: r.head for r in ids.withColumn("_bucket", bucket).groupBy("_bucket").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    pairs = [(b, heads[b], order[i - 1] if i else order[-1]) for i, b in enumerate(order)]
    placed = docs.withColumn("_bucket", bucket)
    if pairs:
        # Of the range's first rows, which share the largest id, the row comes first that has the least (hash, text).
        own_head, goes_to = {b: head for b, head, _ in pairs}, {b: before for b, _, before in pairs}
        to = F.array(*[F.lit(goes_to.get(b)).cast("int") for b in range(len(marks) + 1)])
        first = F.array(*[F.lit(own_head.get(b)).cast("long") for b in range(len(marks) + 1)])
        leads = F.col("doc_id").eqNullSafe(F.get(first, F.col("_bucket")))
        where = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("g")))
        placed = placed.withColumn("_to", F.explode(F.when(leads, F.concat(where, F.array(F.struct(F.get(to, F.col("_bucket")).alias("b"), F.lit(True).alias("g"))))).otherwise(where)))
        placed = placed.select("doc_id", "text", F.col("_to.b").alias("_bucket"), F.col("_to.g").alias("_guest"))
    else:
        placed = placed.select("doc_id", "text", "_bucket", F.lit(False).alias("_guest"))
    return placed.repartitionById(len(marks) + 1, F.col("_bucket")).sortWithinPartitions("_bucket", "_guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the row that waits for its next one

    def table(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows)) if rows else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in slices(batches, "text", 1 << 20):
        out = []
        for doc_id, text, bucket, guest in zip(*[batch.column(n).to_pylist() for n in ("doc_id", "text", "_bucket", "_guest")]):
            own = anchors(text)
            row = (doc_id, text, bucket, own, keep(*own))
            if held is not None and held[2] == bucket:
                _, before, _, theirs, theirs_kept = held
                new, fresh = _edited(before, theirs, text, own)
                fresh = keep(*fresh)
                out.append((held[0], len(before), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written(*theirs_kept), written(*fresh), likeness(theirs_kept, fresh), likeness(theirs_kept, row[4])))
            # The guest ends its range: it is next to the last own row and has no next row here.
            held = None if guest else row
        yield table(out)


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of ``docs``.

    The edited text of a document is its text with the last third (rounded
    down) replaced by the first as many code points, or all, of the next
    document: that of the next smaller doc_id, and after the smallest the
    largest. Rows of one doc_id follow each other by text hash, null ids come
    last; the only row of a table is its own next. Null text: empty, whose
    fingerprint is empty. An empty table gives no rows; other columns are
    ignored.
    """
    lean(docs.sparkSession)
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_next(slim, partitions).mapInArrow(trimmed(_rows), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
