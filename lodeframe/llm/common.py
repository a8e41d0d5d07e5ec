"""Pieces that the training-data operators share.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z. They
are found and hashed by numpy over the UTF-8 bytes of many texts at once; a
long text is cut at white space into slices, so memory stays bounded by
``CHUNK`` bytes (or by the longest single word).
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions.ordering import ready, settled

#: Bytes of text that numpy works on at once.
CHUNK = 1 << 18
#: Bytes of text handed out by ``slices``.
SLICE = 2 << 20

#: Bytes of rows in a batch between the JVM and Python.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
_BASE = int(_RNG.integers(1 << 62, 1 << 63, dtype=np.uint64)) * 2 + 1 & (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE[SPACE] = 0
_POWERS: dict[int, np.ndarray] = {}
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, CHUNK), U64)
        have[1:] = U64(base)
        np.multiply.accumulate(have, out=have)
        if n <= 4 * CHUNK:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column (null: empty), and each row's offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of ``column``; a longer text comes alone."""
    for batch in batches:
        _, at = utf8(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that at its end gives free memory back to the system: workers stay on for the next stage's tasks."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return outer


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the offsets of each text's words among them."""
    n = len(raw)
    cuts = np.zeros(n + 1, bool)
    cuts[at] = True
    found, first = [], []
    pos = 0
    while pos < n:
        end = min(n, pos + CHUNK)
        if end < n:
            back = np.flatnonzero(SPACE[raw[pos:end]] | cuts[pos + 1 : end + 1])
            if len(back):
                end = pos + int(back[-1]) + 1
            else:
                while end < n and not cuts[end] and not SPACE[raw[end - 1]]:
                    step = np.flatnonzero(SPACE[raw[end : end + CHUNK]] | cuts[end + 1 : end + 1 + len(raw[end : end + CHUNK])])
                    end = end + int(step[0]) + 1 if len(step) else min(n, end + CHUNK)
        b = raw[pos:end]
        solid = ~SPACE[b]
        opens = solid.copy()
        opens[1:] &= ~solid[:-1] | cuts[pos + 1 : end]
        shuts = solid.copy()
        shuts[:-1] &= ~solid[1:] | cuts[pos + 1 : end]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(shuts)
        total = np.zeros(len(b) + 1, U64)
        np.cumsum(_BYTE[b] * _powers(_BASE, len(b)), out=total[1:])
        h = (total[ends + 1] - total[starts]) * _powers(_BASE_INV, len(b))[starts]
        h += (ends - starts).astype(U64)
        found.append(mix(h))
        first.append(starts + pos)
        pos = end
    hashes = np.concatenate(found) if found else np.zeros(0, U64)
    begins = np.concatenate(first) if first else np.zeros(0, np.int64)
    return hashes, np.searchsorted(begins, at)


_MULT = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashed ``k``-word shingles; with fewer words the whole sequence is the one shingle."""
    words, of = word_hashes(raw, at)
    rolled = np.zeros(max(0, len(words) - k + 1), U64)
    for j in range(k):
        rolled += words[j : len(words) - k + 1 + j] * _MULT[j] if len(rolled) else 0
    rolled = mix(rolled)
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
        if b - a >= k:
            s = rolled[a : b - k + 1].copy()
            s.sort()
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
        elif b > a:
            out.append(mix((words[a:b] * _MULT[: b - a]).sum(keepdims=True) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def sampled(df: DataFrame, share: float, *key: str | Column) -> DataFrame:
    """About a ``share`` of the rows, drawn by a 64-bit hash of ``key``, the same in each run; all of them from a share of 1 on. Any share that a table of up to 2**63 rows can ask for has hashes below its bound."""
    if share >= 1:
        return df
    return df.where(F.xxhash64(F.lit("sample"), *key) < F.lit(int(share * 2.0**64) - (1 << 63)).cast("long"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def count_words(text: Column) -> Column:
    """Words of a text as a long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lean(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES; their default of 64 MB is kept several times over, outside the JVM's heap and in Python."""
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, BATCH_BYTES)
