"""Stupid-backoff scores from the whole corpus's counts, computed relationally.

1. Documents are read in blocks of about BLOCK_WORDS words. A block's distinct
   words and bigrams, each with its count in the block, go to their hash
   partitions: that is partial aggregation, and it parts a hot n-gram by
   blocks, so the commonest is one row a block. On their way the n-grams of one
   block and partition travel as arrays of one row, which is exploded on
   arrival: ``grams`` has a row for each (block, n-gram).
2. ``counts`` is the count table, partitioned by hash: n-grams with their count
   in the corpus, of which those in one block only say nothing new.
3. ``grams`` is joined with ``counts`` by n-gram, inside the hash partitions,
   and what is found goes back to its block.
4. The same again for trigrams, of which only those are asked for whose two
   bigrams other documents have: no other can be in another document.
5. A block's documents are scored word by word, and the scores, a row for each
   document and order, are summed by document.

A document is scored by the counts of all other rows: its own n-grams are taken
off first. With f the counts so left, N their words and ALPHA the penalty, a
word w after u v has

    S(w | u v) = f(u v w) / f(u v)                  if f(u v w) > 0
               = ALPHA * f(v w) / f(v)              else if f(v w) > 0
               = ALPHA ** 2 * max(f(w), 1/2) / N    else,

and the first words of a document, which have shorter histories, start at the
order that these allow, without its penalty. Logarithms are summed in whole
millionths, so the sum doesn't depend on its order.

Words are compared by 64-bit hashes, n-grams by 48 bits and those that choose
their partition, of which there is one for PART_WORDS words. A (block,
partition) row holds fewer n-grams the larger the corpus is, from some ten
thousand at a billion words down to one; then it is a plain row an n-gram, and
cost is linear in those.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import SPACE, U64, lean, mix, slices, trimmed, utf8, word_hashes

ALPHA = 0.4
ORDER = 3
#: Words of a block, but for a longer document.
BLOCK_WORDS = 1_000_000
#: Words of the corpus for each hash partition, which bounds the n-grams that a task counts.
PART_WORDS = 500_000
#: Bits by which n-grams of one partition are told apart.
KEY_BITS = 48
#: Parts of a unit in which logarithms are summed.
UNIT = 1_000_000
_MULT = (U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F))
#: Joins by (partition, n-gram) may run where the partition's rows are.
_COLOCATED = "spark.sql.requireAllClusterKeysForCoPartition"
#: The first, small map of hash aggregates is of no use where nearly every key is new.
_SMALL_MAP = "spark.sql.codegen.aggregate.map.twolevel.enabled"


@functools.cache
def _zstd() -> tuple:
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(x: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed."""
    return _zstd()[0].compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unpacked(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(_zstd()[1].decompress(b), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of words of a task's texts."""
    n = 0
    for batch in slices(batches, "text"):
        raw, at = utf8(batch.column("text"))
        solid = ~SPACE[raw]
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        # A text that begins without white space begins with a word.
        begins = at[:-1][np.diff(at) > 0]
        n += int(opens.sum() + (solid[begins] & ~opens[begins]).sum())
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, docs, lengths, words, sequence): a block's documents, their numbers of words, its distinct words' hashes, the commonest first, and all its words as indices of those."""
    import pandas as pd

    base, number = TaskContext.get().partitionId() << 24, 0
    ids: list = []
    lengths: list[np.ndarray] = []
    hashes: list[np.ndarray] = []

    def block() -> pa.RecordBatch:
        nonlocal number
        at, words = pd.factorize(np.concatenate(hashes))
        order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        row = [base + number, ids.copy(), np.concatenate(lengths).astype("<u4").tobytes(), words[order].tobytes(), _packed(rank[at])]
        number += 1
        ids.clear(), lengths.clear(), hashes.clear()
        return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in row[2:]]], names=["block", "docs", "lengths", "words", "sequence"])

    held = 0
    for batch in slices(batches, "text"):
        h, at = word_hashes(*utf8(batch.column("text")))
        ids += batch.column("doc_id").to_pylist()
        lengths.append(np.diff(at))
        hashes.append(h)
        held += len(h)
        if held >= BLOCK_WORDS:
            yield block()
            held = 0
    if ids:
        yield block()


def _order(x: np.ndarray, most: int, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of whole numbers from 0 up to ``most``, as their ascending ``places``, or else 0, 1, ..., and the numbers in it."""
    places = np.arange(len(x)) if places is None else places
    bits = int(places[-1]).bit_length() if len(x) else 0
    if most.bit_length() + bits > 63:
        order = np.argsort(x, kind="stable")
        return places[order], x[order]
    # Numbers that carry their places are sorted as they are, several times faster than places by numbers.
    both = x.astype(np.int64) << bits
    both |= places
    both.sort()
    return both & ((1 << bits) - 1), both >> bits


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a number differs from the one before; at the first too."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


class _Grams:
    """A block's distinct n-grams of each order in turn, numbered through: where they begin in the block, how often they come, and their hashes. Trigrams are numbered by ``wanted``, when the bigrams are known."""

    def __init__(self, lengths: bytes, words: bytes, sequence: bytes):
        self.lengths = np.frombuffer(lengths, "<u4").astype(np.int64)
        self.words = np.frombuffer(words, np.uint64)
        self.sequence = _unpacked(sequence, np.uint32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        #: For each order: first words of its n-grams, by n-gram and then by place; the first of each n-gram among them; and the n-grams' counts and hashes.
        self.at, self.new, self.counts, self.hashes = [], [], [], []
        self.ends = [0]
        #: What is known of each n-gram's count in the corpus: at first, its count here.
        self.totals: list[np.ndarray] = []
        for k in range(2):
            self._number(k, self.inside(k))

    def inside(self, k: int) -> np.ndarray:
        """Whether k more words of the document follow a word, but for the last k words."""
        return self.doc[: max(0, len(self.doc) - k)] == self.doc[k:]

    def _number(self, k: int, begins: np.ndarray) -> None:
        """Numbers the n-grams of k + 1 words that begin where it is said."""
        many, n = max(1, len(self.words)), len(begins)
        if k == 0:
            at, codes = _order(self.sequence, many)
        else:
            if k == 1:
                before = self.sequence
            else:
                before = np.zeros(len(self.doc), np.int64)
                before[self.at[-1]] = np.cumsum(self.new[-1]) - 1
            first = np.flatnonzero(begins)
            at, codes = _order(before[:n][begins] * many + self.sequence[k:][begins], len(self.counts[-1]) * many, first)
        new = _changes(codes)
        starts = np.flatnonzero(new)
        codes = codes[starts]
        self.hashes.append(self.hashes[-1][codes // many] + self.words[codes % many] * _MULT[k] + U64(k) if k else self.words * _MULT[0])
        self.at.append(at)
        self.new.append(new)
        self.counts.append(np.diff(starts, append=len(at)))
        self.totals.append(self.counts[-1].copy())
        self.ends.append(self.ends[-1] + len(starts))

    def wanted(self, order: int) -> range:
        """Orders of the n-grams that are asked for: all words and bigrams first; then, these being known, trigrams whose bigrams other documents have. No other trigram can be in another document, here or elsewhere."""
        if order == 1:
            return range(2)
        if len(self.at) == 2:
            #: Kept, as ``left`` gives it for bigrams.
            self.pairs = self.left(1)
            after = self.pairs > 0
            begins = self.inside(2)
            begins &= after[: len(begins)]
            begins &= after[1 : len(begins) + 1]
            self._number(2, begins)
        return range(2, 3)

    def dealt(self, orders: range, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, keys, partitions, starts): places of the orders' n-grams by hash partition, the keys of the n-grams, and where each partition's begin."""
        h = mix(np.concatenate([self.hashes[k] for k in orders]))
        keys = h // U64(parts)
        h -= keys * U64(parts)
        keys &= U64((1 << KEY_BITS) - 1)
        places, part = _order(h, parts)
        starts = np.flatnonzero(_changes(part))
        return places, keys, part[starts].astype(np.int32), starts

    def learn(self, orders: range, parts: int, answers: list) -> None:
        """Takes in what came back for the n-grams asked for."""
        if not answers:
            return
        places, _, used, starts = self.dealt(orders, parts)
        begins = dict(zip(used.tolist(), starts.tolist()))
        totals = np.concatenate([self.totals[k] for k in orders])
        for x in answers:
            place = begins[x["part"]] + np.cumsum(_unpacked(x["places"], np.uint32).astype(np.int64))
            totals[places[place]] = _unpacked(x["totals"], np.uint64).astype(np.int64)
        for k in orders:
            self.totals[k] = totals[self.ends[k] - self.ends[orders[0]] : self.ends[k + 1] - self.ends[orders[0]]]

    def left(self, k: int) -> np.ndarray:
        """Counts in other documents of the n-grams of k + 1 words, by first word; 0 where none begins."""
        at, new = self.at[k], self.new[k]
        # An n-gram's places in a document are next to each other.
        mine = np.flatnonzero(new | _changes(self.doc[at]))
        own = np.diff(mine, append=len(at))
        out = np.zeros(len(self.doc), np.int64)
        out[at] = np.repeat(self.totals[k], self.counts[k]) - np.repeat(own, own)
        return out


def _requests(parts: int, order: int):
    """Rows (part, block, his, los, ns) of a block's n-grams: the upper 32 and lower 16 bits of their keys, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["block", "lengths", "words", "sequence", *(["answers1"] if order > 1 else [])]
            for block, lengths, words, sequence, *answers in zip(*[batch.column(n).to_pylist() for n in names]):
                g = _Grams(lengths, words, sequence)
                if order > 1:
                    g.learn(g.wanted(1), parts, answers[0])
                orders = g.wanted(order)
                places, keys, used, starts = g.dealt(orders, parts)
                keys, ends = keys[places], np.append(starts, len(keys))
                counts = np.concatenate([g.counts[k] for k in orders]).astype(np.int32)[places]
                lists = [(keys >> U64(16)).astype(np.uint32).view(np.int32), (keys & U64(0xFFFF)).astype(np.uint16).view(np.int16), counts]
                for a in range(0, len(used), 64):
                    b = min(len(used), a + 64)
                    cut = slice(ends[a], ends[b])
                    yield pa.RecordBatch.from_arrays([pa.array(used[a:b]), pa.array(np.full(b - a, block)), *[pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.array(x[cut])) for x in lists]], names=["part", "block", "his", "los", "ns"])

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, part, i, total), those found of a part and block, as rows (block, part, places, totals)."""
    for batch in batches:
        places, totals = [], []
        for i, total in zip(batch.column("i"), batch.column("total")):
            i, total = i.values.to_numpy(), total.values.to_numpy()
            if (i[1:] < i[:-1]).any():
                order = np.argsort(i)
                i, total = i[order], total[order]
            places.append(_packed(np.diff(i, prepend=np.int32(0)).astype(np.uint32)))
            totals.append(_packed(total.astype(np.uint64)))
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("part"), pa.array(places, pa.binary()), pa.array(totals, pa.binary())], names=["block", "part", "places", "totals"])


def _scores(parts: int, corpus: int, alpha: float):
    """Rows (block, row, doc_id, n_words, n_seen, units): of each document, the words that each order scored and their summed logarithms, and a row of order 0 that every document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, docs, lengths, words, sequence, *answers in zip(*[batch.column(n).to_pylist() for n in ("block", "docs", "lengths", "words", "sequence", "answers1", "answers2")]):
                g = _Grams(lengths, words, sequence)
                for order, got in enumerate(answers, 1):
                    g.learn(g.wanted(order), parts, got)
                left = [g.left(0), g.pairs, g.left(2)]
                n = len(g.lengths)
                scored = np.zeros(len(g.doc), np.int32)
                value = np.maximum(left[0], 0.5) / np.maximum(corpus - g.lengths, 1)[g.doc]
                for k in range(1, ORDER):
                    # n-grams of k + 1 words, by their last word; none that others have begins at a document's last k words.
                    inside, last = g.inside(k), value[k:]
                    top, low = left[k][: len(inside)], left[k - 1][: len(inside)]
                    seen = top > 0
                    last[:] = np.where(seen, top / np.maximum(low, 1), np.where(inside, alpha * last, last))
                    scored[k:][seen] = k
                units = np.floor(np.log(value) * UNIT + 0.5).astype(np.int64)
                # A row for each document and order that scored some of it, and one that says how many words it has.
                slot = g.doc * ORDER + scored
                many = np.bincount(slot, minlength=n * ORDER)
                sums = np.zeros(n * ORDER, np.int64)
                np.add.at(sums, slot, units)
                some = np.flatnonzero((many > 0) | (np.arange(n * ORDER) % ORDER == 0))
                doc, k = some // ORDER, some % ORDER
                ids = pa.array(docs, pa.int64()).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(doc), ids, pa.array(many[some]), pa.array(np.where(k > 0, many[some], 0)), pa.array(sums[some])], names=["block", "row", "doc_id", "n_words", "n_seen", "units"])

    return run


_REQUEST = "part int, block long, his array<int>, los array<short>, ns array<int>"


def _found(requests: DataFrame, parts: int) -> DataFrame:
    """(block, answers) of the n-grams in ``requests`` that other blocks have too: their counts in the corpus."""
    dealt = requests.repartitionById(parts, "part").select("part", "block", "los", "ns", F.posexplode("his").alias("i", "hi"))
    key = F.shiftleft(F.col("hi").cast("long"), 16).bitwiseOR(F.get("los", F.col("i")).cast("long").bitwiseAND(F.lit(0xFFFF)))
    grams = dealt.select("part", "block", "i", key.alias("key"), F.get("ns", F.col("i")).alias("n"))
    counts = grams.groupBy("part", "key").agg(F.sum("n").alias("total"), F.count("block").alias("blocks")).where("blocks > 1").select("part", "key", "total")
    # A block has one row for an n-gram, and counting ``block`` keeps the columns, so that both readers share one shuffle. Most n-grams are in one block only, so what is left of the count table is the smaller side.
    found = grams.join(counts.hint("shuffle_hash"), ["part", "key"]).where("total > n")
    # Python gets a row for each block: at each row Spark takes the size of its Arrow batch anew, which costs more than the join.
    found = found.groupBy("part", "block").agg(F.collect_list("i").alias("i"), F.collect_list("total").alias("total"))
    answers = found.mapInArrow(trimmed(_answers), "block long, part int, places binary, totals binary")
    # A block's answers are as many as its n-grams, so a group is as large as a block.
    return answers.groupBy("block").agg(F.collect_list(F.struct("part", "places", "totals")).alias("answers"))


def score(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_words, n_seen, score, mean_score) of every row of ``docs``.

    ``score`` is the sum of log S over a document's words, ``n_seen`` how many
    of them end a bigram or trigram that other rows have, ``mean_score`` the
    score by word. A text without words, or null, has score 0 and no mean. Rows
    that share a doc_id, null too, are scored on their own; copies count for
    each other. An empty table gives no rows; other columns are ignored. The
    session's _COLOCATED and _SMALL_MAP are set to false.
    """
    spark = docs.sparkSession
    lean(spark)
    spark.conf.set(_COLOCATED, "false")
    spark.conf.set(_SMALL_MAP, "false")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    corpus = slim.select("text").mapInArrow(trimmed(_counted), "n long").agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-corpus // PART_WORDS))
    blocks = slim.mapInArrow(trimmed(_blocks), "block long, docs array<long>, lengths binary, words binary, sequence binary").repartition("block")
    first = _found(blocks.mapInArrow(trimmed(_requests(parts, 1)), _REQUEST), parts).withColumnRenamed("answers", "answers1")
    known = blocks.join(first, "block", "left")
    # All columns stay, so that the three readers of ``blocks`` share one shuffle.
    second = _found(known.mapInArrow(trimmed(_requests(parts, 2)), _REQUEST), parts).withColumnRenamed("answers", "answers2")
    scored = known.join(second, "block", "left")
    scored = scored.mapInArrow(trimmed(_scores(parts, corpus, alpha)), "block long, row long, doc_id long, n_words long, n_seen long, units long")
    summed = scored.groupBy("block", "row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "n_seen", "units")])
    total = F.col("units") / float(UNIT)
    return summed.select("doc_id", "n_words", "n_seen", total.alias("score"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_score"))
