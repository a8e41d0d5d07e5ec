"""Packing token sequences by minimum bin slack.

Whole capacities are cut off long documents first. What remains of each
document is an item of 1 to ``capacity`` - 1 ids in a pool; once the pool holds
WINDOW items, sequences are filled from it until half are left. A sequence
starts with the longest item; a bitset subset-sum program over the multiset of
the other lengths then finds the largest sum that still fits, and the counts of
each length are read back from its steps. With a pool of this size the sum is
nearly always exactly the capacity. If more than TOLERANCE ids would stay
unfilled, one more item is cut to fill the sequence.

A task packs its own documents in one pass over them, without a shuffle, in
memory bounded by the pool. The last, short sequence of a task is divided into
powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import U64, lean, mix, slices, trimmed

CAPACITY = 2048
WINDOW = 512
#: Unfilled ids for which no item is cut.
TOLERANCE = 8
#: Plain words whose ids a worker keeps, at most; their ids are at most four times as many.
REMEMBER = 300_000
#: Words of other texts that are kept, at most, twice over.
MIXED = 20_000
#: A longer word is encoded each time.
LONGEST = 128
#: Bytes of text that are encoded at once.
TOGETHER = 2 << 20

#: Texts of these characters only, in Latin-1, need no Unicode normalisation, and their words are found by numpy.
PLAIN = bytes(c for c in range(256) if c < 28 or 32 <= c < 127 or c in (0xA1, 0xBF) or c >= 0xC0 and c not in (0xD7, 0xF7))
LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: Kinds of plain characters: white space, letters, digits, all others.
_BLANK, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(9, 14), 32]] = _BLANK
_KIND[[*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_KIND[48:58] = _DIGIT
#: Letters after an apostrophe that are one word with it.
_ENDINGS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def plain_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-case plain text, as the tokenizer splits it: runs of letters, single digits, runs of other characters, and an apostrophe with one of _ENDINGS."""
    kind = _KIND[raw]
    starts = np.concatenate((np.zeros(1, np.int64), np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) + 1))
    ends = np.append(starts[1:], len(raw))
    of = kind[starts]
    # An apostrophe on its own before letters: with an ending of one or two letters it is a word, and what is left of the letters is another one.
    mark = np.flatnonzero((raw[starts[:-1]] == 39) & (ends[:-1] - starts[:-1] == 1) & (of[1:] == _LETTER))
    if len(mark):
        at, room = starts[mark + 1], ends[mark + 1] - starts[mark + 1]
        takes = np.zeros(len(mark), np.int64)
        for x in _ENDINGS:
            fits = room >= len(x)
            for j, c in enumerate(x):
                fits[fits] = raw[at[fits] + j] == c
            takes[fits] = len(x)
        ends[mark] += takes
        starts[mark + 1] += takes
    kept = (of != _BLANK) & (starts < ends)
    return starts[kept], ends[kept]


def word_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of single-byte text, eight bytes at a time; among words of one length up to 8 no two share one."""
    eights = np.ndarray(len(raw) + 1, "<u8", np.concatenate((raw, np.zeros(8, np.uint8))), strides=(1,))
    at, left = starts, ends - starts
    out = mix((eights[at] & _HEAD[np.minimum(left, 8)]) ^ left.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    more = np.flatnonzero(left > 8)
    at, left = at[more], left[more]
    while len(more):
        at, left = at + 8, left - 8
        out[more] = mix(out[more] + U64(0xA0761D6478BD642F) ^ (eights[at] & _HEAD[np.minimum(left, 8)]))
        on = left > 8
        more, at, left = more[on], at[on], left[on]
    return out


class WordIds:
    """Token ids of texts by a lower-casing BPE tokenizer with word ends that drops white space, words' ids remembered.

    Such a tokenizer treats words on their own, so a text's ids are those of
    its words in a row. Plain texts are split by ``plain_words``; others at
    white space; texts with the information separators x1C to x1F, which
    ``str.split`` would cut at too, go through the tokenizer whole. Ids of
    plain words lie in one flat array, from which a batch's ids are gathered at
    once. When words or ids pass their bound, the half of the words that came
    most often stays, so memory is bounded and frequent words aren't forgotten.
    """

    def __init__(self, path: str):
        # A task has one core; threads of the tokenizer's own would each keep memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        #: Plain words' keys in order; where their ids start in ``flat``, how many they are, how often the word came.
        self.keys = np.zeros(0, np.uint64)
        self.starts, self.lengths, self.hits = (np.zeros(0, np.int64) for _ in range(3))
        self.flat, self.used = np.zeros(4096, "<u4"), 0
        self.odd = 0
        self.young: dict[str, np.ndarray] = {}
        self.old: dict[str, np.ndarray] = {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _singly(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single plain words in a row and how many each has: encoded together, cut after each word's last id."""
        ids, counts = [], []
        parts = [words[i : i + 500] for i in range(0, len(words), 500)]
        for some, encoding in zip(parts, self.tokenizer.encode_batch_fast([" ".join(some) for some in parts], add_special_tokens=False)):
            got = np.array(encoding.ids, "<u4")
            stops = np.flatnonzero(self.ends[got]) + 1
            if len(stops) != len(some):
                each = self._whole(some)
                got, stops = np.concatenate(each), np.cumsum([len(x) for x in each])
            ids.append(got)
            counts.append(np.diff(stops, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, hits: np.ndarray) -> None:
        """Takes in words with new ``keys``, which ascend."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys)
        starts = self.used + np.cumsum(counts) - counts
        self.keys, self.starts, self.lengths, self.hits = (np.insert(x, at, y) for x, y in ((self.keys, keys), (self.starts, starts), (self.lengths, counts), (self.hits, hits)))
        self.used += len(ids)

    def _forget(self) -> None:
        if len(self.keys) <= REMEMBER and self.used <= 4 * REMEMBER:
            return
        order = np.argsort(-self.hits, kind="stable")
        order = np.sort(order[np.cumsum(self.lengths[order]) <= 2 * REMEMBER][: REMEMBER // 2])
        keys, ids, counts, hits = self.keys[order], self._gather(order), self.lengths[order], self.hits[order] // 2
        self.keys, self.starts, self.lengths, self.hits = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        self.used = 0
        self._learn(keys, ids, counts, hits)

    def _gather(self, words: np.ndarray) -> np.ndarray:
        """The ids of these words in a row."""
        counts = self.lengths[words]
        ends = np.cumsum(counts)
        return self.flat[np.repeat(self.starts[words] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of plain texts in Latin-1."""
        raw = np.frombuffer(b"\n".join([*texts, b""]).translate(LOWER), np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        starts, ends = plain_words(raw)
        keys = word_keys(raw, starts, ends)
        long = np.flatnonzero(ends - starts > LONGEST)
        # Keys that are met only once: such a word is encoded, and forgotten for want of hits.
        self.odd += len(long)
        keys[long] = mix(np.arange(self.odd - len(long), self.odd, dtype=np.uint64) ^ U64(0xD1B54A32D192ED03))
        distinct, first, at, hits = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        where = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = where < len(self.keys)
        new[inside] = self.keys[where[inside]] != distinct[inside]
        if new.any():
            spelled = [raw[a:b].tobytes().decode("latin-1") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            self._learn(distinct[new], *self._singly(spelled), 0)
            where = np.searchsorted(self.keys, distinct)
        self.hits[where] += hits
        each = where[at]
        ids = self._gather(each)
        cuts = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.lengths[each])))[np.searchsorted(starts, begins)].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _mixed(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of other texts, which white space splits into words."""
        words = [t.split() for t in texts]
        if len(self.young) > MIXED:
            self.young, self.old = {}, self.young
        have = {w: self.young.get(w, self.old.get(w)) for w in set(chain.from_iterable(words))}
        new = [w for w, ids in have.items() if ids is None]
        have.update(zip(new, self._whole(new)))
        self.young.update((w, ids) for w, ids in have.items() if len(w) <= LONGEST)
        none = np.zeros(0, "<u4")
        return [np.concatenate([none, *map(have.__getitem__, ws)]) for ws in words]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """A text's ids each. Memory follows ``texts`` and what is remembered."""
        self._forget()
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        plain, mixed, whole = {}, {}, {}
        for i, t in enumerate(texts):
            try:
                raw = t.encode("latin-1")
            except UnicodeEncodeError:
                raw = None
            if raw is not None and not raw.translate(None, PLAIN) and b"<|" not in raw:
                plain[i] = raw
            else:
                (whole if SEPARATORS.search(t) else mixed)[i] = t
        for encode, some in ((self._plain, plain), (self._mixed, mixed), (self._whole, whole)):
            if some:
                for i, ids in zip(some, encode(list(some.values()))):
                    out[i] = ids
        return out


def fill(lengths: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, count) of the sub-multiset of ``lengths`` with the largest sum up to ``room``.

    Bit s of ``reach`` says whether sum s can be made. Counts are split into
    powers of two, each a step; the steps are undone from the best sum.
    """
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in sorted(lengths, reverse=True):
        if length > room:
            continue
        left, part = min(lengths[length], room // length), 1
        while left:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= reach << length * part & mask
            left, part = left - part, part * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    counts: dict[int, int] = defaultdict(int)
    for length, part, before in reversed(steps):
        if not before >> best & 1:
            counts[length] += part
            best -= length * part
    return list(counts.items())


class Packer:
    """Takes documents' ids, gives pieces (row, start, ids, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, window: int = WINDOW, tolerance: int = TOLERANCE):
        self.capacity, self.window, self.tolerance = capacity, window, tolerance
        self.pool: dict[int, deque] = {}
        self.lengths: dict[int, int] = {}
        self.items = self.sequence = 0

    def add(self, row, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            yield row, start, ids[start : start + self.capacity], self._next(), 0
        if whole < len(ids):
            self._put(row, whole, ids[whole:])
        if self.items >= self.window:
            while self.items > self.window // 2:
                yield from self._sequence()

    def end(self) -> Iterator[tuple]:
        while sum(k * n for k, n in self.lengths.items()) >= self.capacity:
            yield from self._sequence()
        rest = [item for length in sorted(self.pool, reverse=True) for item in self.pool[length]]
        left = sum(len(ids) for _, _, ids in rest)
        self.pool, self.lengths, self.items = {}, {}, 0
        size = used = sequence = 0
        for row, start, ids in rest:
            while len(ids):
                if used == size:
                    size, used, sequence = 1 << left.bit_length() - 1, 0, self._next()
                    left -= size
                take = min(len(ids), size - used)
                yield row, start, ids[:take], sequence, used
                start, ids, used = start + take, ids[take:], used + take

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def _put(self, row, start: int, ids: np.ndarray) -> None:
        self.pool.setdefault(len(ids), deque()).append((row, start, ids))
        self.lengths[len(ids)] = self.lengths.get(len(ids), 0) + 1
        self.items += 1

    def _get(self, length: int) -> tuple:
        item = self.pool[length].popleft()
        self.lengths[length] -= 1
        if not self.lengths[length]:
            del self.lengths[length], self.pool[length]
        self.items -= 1
        return item

    def _sequence(self) -> Iterator[tuple]:
        got = [self._get(max(self.lengths))]
        room = self.capacity - len(got[0][2])
        for length, count in fill(self.lengths, room):
            got += [self._get(length) for _ in range(count)]
            room -= length * count
        if room > self.tolerance and self.items:
            # Nothing in the pool fits the room, or it would have been chosen, so the next item is longer.
            row, start, ids = self._get(min(k for k in self.lengths if k > room))
            got.append((row, start, ids[:room]))
            self._put(row, start + room, ids[room:])
        sequence, used = self._next(), 0
        for row, start, ids in got:
            yield row, start, ids, sequence, used
            used += len(ids)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all ``docs``: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    A document is its text's ids (null: none) followed by ``end_id``; ``ids``
    holds a piece's ids as little-endian unsigned 32-bit integers, ``start``
    counts the document's ids before it. Offsets in a sequence are gapless from
    0. A sequence holds at most ``capacity`` ids; all but those of a power of
    two lack at most TOLERANCE. Rows that share a doc_id, null too, are packed
    each on its own. An empty table gives no rows. ``tokenizer`` is the path of
    the tokenizer's file, the same on every executor. ``sequence_id`` holds the
    task's number in its upper bits, so it is unique, not gapless.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = WordIds(tokenizer), Packer(capacity)
        base = TaskContext.get().partitionId() << 40

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0][0] for p in pieces], pa.int64()), pa.array([p[1] for p in pieces], pa.int64()), pa.array([len(p[2]) for p in pieces], pa.int64()), pa.array([p[2].tobytes() for p in pieces], pa.binary()), pa.array([p[0][1] for p in pieces], pa.int64()), pa.array([base + p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64())],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        end = np.array([end_id], "<u4")
        for batch in slices(batches, "text", TOGETHER):
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode([t or "" for t in batch.column("text").to_pylist()])):
                ids = np.concatenate((ids, end))
                out.extend(packer.add((doc_id, len(ids)), ids))
            if out:
                yield table(out)
        if out := list(packer.end()):
            yield table(out)

    lean(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(trimmed(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
