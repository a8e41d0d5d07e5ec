"""Language identification with spans.

A word's score for each language is the mean log probability of its letter
n-grams (orders 1 to 4 with word edges, hashed into BUCKETS), times a length
weight. Script ranges come first: the letters of a word fall into scripts, and
languages which were hardly ever seen in a word's script are no candidates for
it. A Viterbi pass over a text's words, with PENALTY for a change of language,
labels spans; the text's language is the one with most letters in its spans.

Models are tables of counts by (language, bucket), gathered from all training
rows or a bounded sample of them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import U64, lean, slices, trimmed

ORDERS = (1, 2, 3, 4)
BITS = 15
BUCKETS = 1 << BITS
#: Log-probability units that a change of language between two words costs.
PENALTY = 6.0
#: Characters whose n-grams are scored at once, and texts up to which the Viterbi pass leaves numpy.
TOGETHER, FEW = 1 << 18, 3
#: Training rows at most, chosen by a hash of doc_id; the rest of the labelled rows is not needed.
TRAIN_ROWS = 20_000
#: A language is a candidate for a word in a script that held at least this share of its training letters.
SCRIPT_SHARE = 0.005
#: Upper ends of letter ranges and the script of each, by code point; a letter beyond a table entry has the next entry's script.
SCRIPT_ENDS = np.array([0x24F, 0x2AF, 0x36F, 0x3FF, 0x52F, 0x58F, 0x5FF, 0x77F, 0x8FF, 0x97F, 0x9FF, 0xA7F, 0xAFF, 0xB7F, 0xBFF, 0xC7F, 0xCFF, 0xD7F, 0xDFF, 0xE7F, 0xEFF, 0xFFF, 0x109F, 0x10FF, 0x11FF, 0x137F, 0x17FF, 0x1DFF, 0x1EFF, 0x1FFF, 0x2E7F, 0x303F, 0x30FF, 0x318F, 0x31FF, 0x9FFF, 0xABFF, 0xD7FF, 0xFFFF, 0x1FFFF, 0x10FFFF])
SCRIPTS = ("latin", "latin", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "arabic", "devanagari", "bengali", "gurmukhi", "gujarati", "oriya", "tamil", "telugu", "kannada", "malayalam", "sinhala", "thai", "lao", "tibetan", "myanmar", "georgian", "hangul", "ethiopic", "khmer", "other", "latin", "greek", "other", "cjk", "kana", "hangul", "cjk", "cjk", "other", "hangul", "other", "other", "cjk")
_NAMES = sorted(set(SCRIPTS))
_SCRIPT = np.array([_NAMES.index(s) for s in SCRIPTS], np.int8)
_LETTER = np.zeros(0x3000, bool)
_LETTER[[c for c in range(0x3000) if unicodedata.category(chr(c))[0] == "L"]] = True
_MARK = np.zeros(0x3000, bool)
_MARK[[c for c in range(0x3000) if unicodedata.category(chr(c))[0] == "M"]] = True
_MULT = np.random.default_rng(11).integers(1, 1 << 62, 8, dtype=np.uint64) * U64(2) + U64(1)
#: Han and kana carry no spaces: every letter from here on is a word.
_ALONE = 0x2E80


def _letters(points: np.ndarray) -> np.ndarray:
    low = points < 0x3000
    out = np.zeros(len(points), bool)
    out[low] = _LETTER[points[low]]
    high = np.flatnonzero(~low)
    if len(high):
        kinds = {c: unicodedata.category(chr(c))[0] == "L" for c in np.unique(points[high]).tolist()}
        out[high] = [kinds[c] for c in points[high].tolist()]
    return out


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points (lower case) of all texts, each with its word's number or -1; each word's text; each word's script.

    A word is a maximal run of letters; combining marks join their word.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
    letter = _letters(points)
    small = points < 0x3000
    solid = letter | (small & _MARK[np.where(small, points, 0)])
    before = np.concatenate(([False], solid[:-1]))
    alone = points >= _ALONE
    hangul = (points >= 0xAC00) & (points <= 0xD7FF)
    alone &= ~hangul
    begins = solid & (~before | alone | np.concatenate(([False], alone[:-1])))
    number = np.where(solid, np.cumsum(begins) - 1, -1)
    starts = np.flatnonzero(begins)
    text_of = np.searchsorted(ends, starts, "right")
    script = _SCRIPT[np.minimum(np.searchsorted(SCRIPT_ENDS, points[starts]), len(SCRIPT_ENDS) - 1)]
    return points, number, text_of, script


def grams(points: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every n-gram of the words, each set between two edge marks."""
    at = np.flatnonzero(number >= 0)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = number[at]
    n_words = int(w[-1]) + 1
    lengths = np.bincount(w, minlength=n_words)
    # Symbols with a mark 1 at each word's start and end.
    to = np.arange(len(at)) + 2 * w + 1
    symbols = np.ones(len(at) + 2 * n_words, np.uint64)
    symbols[to] = points[at]
    word = np.repeat(np.arange(n_words), lengths + 2)
    buckets, owners = [], []
    for order in ORDERS:
        n = len(symbols) - order + 1
        if n <= 0:
            continue
        h = np.full(n, U64(order) * _MULT[7])
        for j in range(order):
            h += symbols[j : n + j] * _MULT[j]
        same = word[:n] == word[order - 1 :]
        if order == 1:
            same = same & (symbols != 1)
        # The upper bits of a sum of random odd multiples are hashed well.
        buckets.append((h[same] >> U64(64 - BITS)).astype(np.int64))
        owners.append(word[:n][same])
    return np.concatenate(buckets), np.concatenate(owners)


def _parts(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in pieces of TOGETHER characters at most, and whose each piece is; a piece ends at a space where there is one, so no word is cut."""
    owners: list[int] = []
    pieces: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = len(text) if len(text) - at <= TOGETHER else text.rfind(" ", at, at + TOGETHER) + 1 or at + TOGETHER
            if pieces and size + end - at > TOGETHER:
                yield owners, pieces
                owners, pieces, size = [], [], 0
            owners.append(i)
            pieces.append(text[at:end])
            size, at = size + end - at, end
            if at == len(text):
                break
    if pieces:
        yield owners, pieces


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of buckets, and of letters by script, for each language of a task; at most languages x (BUCKETS + scripts) rows."""
    total: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text"):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for owners, pieces in _parts(batch.column("text").to_pylist()):
            points, number, text_of, script = words(pieces)
            bucket, owner = grams(points, number)
            lengths = np.bincount(number[number >= 0], minlength=len(text_of))
            own = langs[owners]
            for lang in set(own.tolist()):
                mine = (own == lang)[text_of]
                have = total.setdefault(lang, np.zeros(BUCKETS + len(_NAMES), np.int64))
                have[:BUCKETS] += np.bincount(bucket[mine[owner]], minlength=BUCKETS)
                have[BUCKETS:] += np.bincount(script[mine], weights=lengths[mine], minlength=len(_NAMES)).astype(np.int64)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at])], names=["lang", "slot", "n"])


class Model:
    """Learned languages in order of code point, log probabilities (bucket, language), and which scripts are theirs."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams_, scripts = counts[:, :BUCKETS].astype(np.float64), counts[:, BUCKETS:].astype(np.float64)
        p = (grams_ + 0.5) / (grams_.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        self.log = np.log(p).T.astype(np.float32) if langs else np.zeros((BUCKETS, 0), np.float32)
        self.own = (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)) if langs else np.zeros((0, len(_NAMES)), bool)


def train(docs: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """A model from (doc_id, text, lang) rows; rows with null text or lang teach nothing.

    Of more than ``most`` rows a part is taken by a hash of doc_id, the same in
    each run. Texts stay on the executors; the driver gets one count for each
    language and slot.
    """
    lean(docs.sparkSession)
    rows = docs.where("text is not null and lang is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    share = most / max(1, rows.select("doc_id").count())
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id")), F.lit(1_000_000)) < int(share * 1_000_000))
    got = rows.select("text", "lang").mapInArrow(trimmed(_count), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BUCKETS + len(_NAMES)), np.int64)
    place = {x: i for i, x in enumerate(langs)}
    counts[[place[x] for x in got.column("lang").to_pylist()], got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return Model(langs, counts)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word: ``scores`` (word, language) of texts in a row, ``counts`` words of each.

    All texts advance together, longest first, so numpy works on a word of each
    at once; the last few long ones go on by themselves.
    """
    n, langs = scores.shape
    best = np.zeros(n, np.int32)
    if not n or langs == 1:
        return best
    order = np.argsort(-counts, kind="stable")
    begins = (np.cumsum(counts) - counts)[order]
    counts = counts[order]
    longest = int(counts[0])
    alive = np.searchsorted(-counts, -np.arange(longest), "left")  # texts with more than t words
    together = int(np.searchsorted(-alive, -FEW, "right"))  # steps that more than FEW texts take
    came = np.zeros((n, langs), np.int16)
    state = scores[begins[: alive[0]]].astype(np.float64)
    here = np.arange(langs, dtype=np.int16)
    final = np.zeros(len(counts), np.int64)
    for t in range(1, max(1, together)):
        live = alive[t]
        if live < len(state):
            final[live : len(state)] = state[live:].argmax(axis=1)
            state = state[:live]
        top = state.argmax(axis=1)
        jump = state[np.arange(live), top] - penalty
        stay = state >= jump[:, None]
        came[begins[:live] + t] = np.where(stay, here[None, :], top[:, None])
        state = np.where(stay, state, jump[:, None]) + scores[begins[:live] + t]
    final[: len(state)] = state.argmax(axis=1)
    together = max(1, together)
    now = np.zeros(len(counts), np.int64)
    for i in range(min(FEW, len(counts))):
        if counts[i] > together:
            first, last = int(begins[i]) + together, int(begins[i] + counts[i])
            path, now[i] = _alone(scores[first:last].tolist(), state[i].tolist(), penalty)
            best[first:last] = path
    for t in range(min(together, longest) - 1, -1, -1):
        live = alive[t]
        ends = counts[:live] == t + 1
        now[:live][ends] = final[:live][ends]
        at = begins[:live] + t
        best[at] = now[:live]
        if t:
            now[:live] = came[at, now[:live]]
    return best


def _alone(scores: list[list[float]], state: list[float], penalty: float) -> tuple[list[int], int]:
    """The rest of one text's path from ``state``, and the language of the word before it."""
    langs = range(len(state))
    came = []
    for row in scores:
        high = max(state)
        top, jump = state.index(high), high - penalty
        came.append([i if state[i] >= jump else top for i in langs])
        state = [(x if x >= jump else jump) + y for x, y in zip(state, row)]
    now = state.index(max(state))
    path = []
    for back in reversed(came):
        path.append(now)
        now = back[now]
    return path[::-1], now


def word_scores(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, letters, scores by language) of each word of ``texts``, in order."""
    points, number, text_of, script = words(texts)
    lengths = np.bincount(number[number >= 0], minlength=len(text_of)).astype(np.int64)
    bucket, owner = grams(points, number)
    per = np.bincount(owner, minlength=len(text_of))
    scores = np.empty((len(text_of), len(model.langs)), np.float32)
    # A word's grams overlap and aren't independent: their mean counts, times the root of the word's letters.
    weight = 2 * np.sqrt(lengths) / np.maximum(per, 1)
    for i in range(len(model.langs)):
        scores[:, i] = np.bincount(owner, weights=model.log[:, i][bucket], minlength=len(text_of)) * weight
    out = ~model.own.T[script]
    scores[out & ~out.all(axis=1)[:, None]] -= 1e3
    return text_of, lengths, scores


def label(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, language, letters) of each word of ``texts``, in order."""
    if not model.langs:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    parts = []
    for owners, pieces in _parts(texts):
        # Scores of some pieces at a time: their n-grams take far more memory than their words.
        of, lengths, scores = word_scores(pieces, model)
        parts.append((np.array(owners)[of], lengths, scores))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    text_of, lengths, scores = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return text_of, viterbi(scores, np.bincount(text_of, minlength=len(texts))), lengths


def spans(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(first word, words, language) of each span of a text."""
    _, lang, _ = label([text], model)
    cuts = np.flatnonzero(np.diff(lang)) + 1
    return [(int(a), int(b - a), model.langs[lang[a]]) for a, b in zip([0, *cuts], [*cuts, len(lang)]) if b > a]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and lang_spans, from ``text`` alone.

    ``lang_pred`` is the language with most letters in the text's spans (ties:
    the first by code point), ``score`` its share of the letters; ``und`` with
    score 0 if the text is null or has no letter, or nothing was learned. Long
    texts are labelled whole. An empty table gives no rows; existing columns
    with these names are replaced.
    """
    own = ["lang_pred", "score", "lang_spans"]
    docs = docs.drop(*own)
    spark = docs.sparkSession
    lean(spark)
    shared = spark.sparkContext.broadcast(model)  # languages x BUCKETS x 4 bytes
    kept = docs.columns
    plain = docs.schema["text"].dataType.simpleString() == "string"
    text = f"c{kept.index('text')}" if plain else "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, text, 8 << 20):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            text_of, lang, lengths = label(texts, m)
            n = max(1, len(m.langs))
            letters = np.bincount(text_of * n + lang, weights=lengths, minlength=len(texts) * n).reshape(len(texts), n)
            changes = np.bincount(text_of[1:], weights=(lang[1:] != lang[:-1]) & (text_of[1:] == text_of[:-1]), minlength=len(texts)) if len(lang) else np.zeros(len(texts))
            all_ = letters.sum(axis=1)
            top = letters.argmax(axis=1)
            some = (all_ > 0) & bool(m.langs)
            names = [m.langs[i] if s else "und" for i, s in zip(top, some)]
            share = np.where(some, letters[np.arange(len(texts)), top] / np.maximum(all_, 1), 0.0)
            arrays = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(names, pa.string()), pa.array(share), pa.array((changes + some).astype(np.int64))], names=[f"c{i}" for i in range(len(kept))] + own)

    fields = docs.schema
    schema = fields.__class__.fromJson(fields.jsonValue())
    for i, f in enumerate(schema.fields):
        f.name = f"c{i}"
    schema.names = [f.name for f in schema.fields]
    schema = schema.add("lang_pred", "string").add("score", "double").add("lang_spans", "long")
    wide = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], *([] if plain else [F.col("text").cast("string").alias("__text")]))
    out = wide.mapInArrow(trimmed(run), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *own)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its doc_id as text, modulo 4, is 2; null: no."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
