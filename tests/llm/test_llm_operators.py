"""The training-data operators on small inputs, against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import ann, common, html, langid, lm, mixing, neardup, packing, sharding, syncmers, urls

DOCS = "doc_id long, text string, source string, lang string"
WORD = re.compile("[^\x20\x09-\x0d]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(UP))


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghijklmnoprstuvwxyzé") for _ in range(rng.randrange(1, 8))) for _ in range(n)]


def documents(seed=1, n=150):
    rng = random.Random(seed)
    words = vocabulary(rng)
    rows, base = [], None
    for i in range(n):
        k = rng.choice([0, 1, 2, 5, 20, 60, 200])
        text = " ".join(rng.choice(words) for _ in range(k))
        if i % 5 == 0 or base is None:
            base = " ".join(rng.choice(words) for _ in range(80))
        elif i % 5 < 3:
            w = base.split()
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        rows.append((i, text, f"s{i % 4}" if i % 17 else None, "en"))
    rows += [(n, None, "s1", None), (n + 1, "", "s1", None), (n + 2, " \n\t", None, "en"), (n + 3, rows[7][1].upper(), "s9", "en"), (n + 4, "x" * 5000, "s2", "en"), (n + 5, "long " * 60000, "s2", "en"), (n + 6, "𝔘𝔫𝔦 ñ 你好 ok", "s3", None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# Words and sketches


def test_word_hashes_over_slices(monkeypatch):
    import pyarrow as pa

    texts = [t for _, t, _, _ in documents(3)]
    whole = common.word_hashes(*common.utf8(pa.array(texts)))
    monkeypatch.setattr(common, "CHUNK", 97)
    parts = common.word_hashes(*common.utf8(pa.array(texts)))
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    want = [len(split(t)) for t in texts]
    assert np.diff(whole[1]).tolist() == want
    by = {}
    for t, a, b in zip(texts, whole[1], whole[1][1:]):
        for w, h in zip(split(t), whole[0][a:b].tolist()):
            assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_setsketch_estimates_and_merges():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    sa, sb, su = neardup.setsketch([a, b, np.union1d(a, b)])
    assert (np.maximum(sa, sb) == su).all()
    assert abs(neardup.likeliest(sa, len(a), sb[None], np.array([len(b)]))[0] - 1500 / 2500) < 0.15
    assert neardup.likeliest(sa, len(a), sa[None], np.array([len(a)]))[0] == 1
    assert (neardup.setsketch([np.zeros(0, np.uint64)]) == 0).all()


# 1 URL filter


def test_url_parts_and_rules(spark):
    rows = [("HTTP://A.Example.COM/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"), ("x://example.com/en/8#f", "example.com", "/en/8", "com/en/", "block"), ("x://badexample.com/en/7", "badexample.com", "/en/7", "com/en/", "block"), ("x://h.net?a/b", "h.net", "", None, None), ("x://a.example.net/de/81", "a.example.net", "/de/81", "example.net/de/8", "block"), ("x://n.net/de/", "n.net", "/de/", "net/de/", "allow"), ("no host", "", "", None, None), ("a://b://c", "b:", "//c", None, None), ("", "", "", None, None), (None, "", "", None, None)]
    d = spark.createDataFrame([(i, r[0], "other") for i, r in enumerate(rows)] + [(99, rows[1][0], "twice")], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in urls.judge(d).collect()}
    for i, (_, h, p, rule, verdict) in enumerate(rows):
        assert (got[i].host, got[i].path, got[i].rule) == (h, p, rule)
        assert got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)
    assert got[9].verdict == "block" and got[99].verdict == "block" and len(got) == len(rows) + 1
    assert urls.judge(d.limit(0)).count() == 0


def test_url_scores_equal_a_plain_model(spark):
    rng = random.Random(4)
    good = [f"https://news.example.org/story/{rng.randrange(999)}" for _ in range(60)]
    bad = [f"http://win-casino{rng.randrange(9)}.example.biz/bet?id={rng.randrange(99)}" for _ in range(60)]
    labels = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "url string, accepted boolean")
    asked = spark.createDataFrame([(u,) for u in good + bad + ["https://news.example.org/" + "a" * 3000]], "url string")
    scores, threshold = urls.url_scores(asked, labels)
    got = {r.url: r.score for r in scores.collect()}
    fold = {r.url: r.f for r in labels.select("url", F.pmod(F.xxhash64("url"), F.lit(5)).alias("f")).collect()}

    def codes(u):
        return [urls.ALPHABET.find(c) + 1 or urls.OTHER for c in re.sub("[1-9]", "0", u.lower())]

    def counts(us):
        c = Counter()
        for u in us:
            x = [0] * urls.ORDER + codes(u)
            for i in range(urls.ORDER, len(x)):
                for o in range(urls.ORDER + 1):
                    c[tuple(x[i - o : i + 1])] += 1
        return c

    def p(c, gram):
        out = 1 / (urls.OTHER + 1)
        for o in range(urls.ORDER + 1):
            g = gram[urls.ORDER - o :]
            same = {k: n for k, n in c.items() if len(k) == o + 1 and k[:-1] == g[:-1]}
            n, t = sum(same.values()), len(same)
            if n >= (urls.MIN_CONTEXT if o else 1):
                out = (same.get(g, 0) + t * out) / (n + t)
        return out

    a, b = (counts([u for u in dict.fromkeys(us) if fold[u]]) for us in (good, bad))
    for u in (good[0], bad[0]):
        x = [0] * urls.ORDER + codes(u)
        want = [math.log(p(a, g)) - math.log(p(b, g)) for g in (tuple(x[i - urls.ORDER : i + 1]) for i in range(urls.ORDER, len(x)))]
        assert got[u] == pytest.approx(sum(want) / len(want))
    assert min(got[u] for u in good) >= threshold > max(got[u] for u in bad)


# 2 Packing


def test_fill_is_the_best_subset():
    rng = random.Random(5)
    for _ in range(60):
        lengths = Counter(rng.randrange(1, 30) for _ in range(rng.randrange(1, 9)))
        room = rng.randrange(1, 70)
        sums = {0}
        for k, n in lengths.items():
            sums |= {s + k * i for s in sums for i in range(1, n + 1) if s + k * i <= room}
        got = packing.fill(lengths, room)
        assert sum(k * n for k, n in got) == max(sums) and all(n <= lengths[k] for k, n in got)


def test_pack_keeps_every_id(spark, docs, none):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(500, "It's <|endoftext|> don't\x1cstop", "s", None), (501, "Σας É İ ½ “q” e\u0301", "s", None)], DOCS)
    both = docs.unionByName(extra)
    rows = packing.pack(both.withColumn("ids", F.lit(0)), path).collect()
    want = Counter(np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for r in both.collect())
    whole, used = Counter(), {}
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length > 0
    for (doc, n), ps in pieces.items():
        ps.sort()
        raw = b"".join(p for _, p in ps)
        assert len(raw) == 4 * n and [s for s, _ in ps] == [len(b"".join(p for _, p in ps[:i])) // 4 for i in range(len(ps))]
        whole[raw] += 1
    assert whole == want
    padding = total = 0
    for s in used.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))]
        n = sum(k for _, k in s)
        assert n <= 2048
        total, padding = total + n, padding + (0 if n & n - 1 == 0 else 2048 - n)
    assert padding <= 0.005 * total and packing.pack(none, path).count() == 0


@pytest.mark.parametrize("remember", [300_000, 40])
def test_word_ids_equal_the_tokenizer(monkeypatch, remember):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "REMEMBER", remember)
    monkeypatch.setattr(packing, "MIXED", remember)
    whole, mine, rng = Tokenizer.from_file(path), packing.WordIds(path), random.Random(13)
    parts = [*"abcst' re'VEd\t\n0123.,!-ÀÉßÿ×÷¡¿Σ½“ \x00\x1b\x1c\x85\xa0你é\x7f\xad\u200bİſ", "'s", "'re", "don't", "''s", "'LL", "<|endoftext|>", "x" * 130, "É" * 200]
    for turn in range(40):
        texts = ["".join(rng.choice(parts) if rng.random() < 0.5 else rng.choice("abc 's't") for _ in range(rng.randrange(40))) for _ in range(30)]
        if turn % 2:
            texts = ["".join(c for c in t if " " <= c <= "~") for t in texts]
        assert [x.tolist() for x in mine(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


# 3 Nearest neighbours


@pytest.mark.parametrize("deep", [4000, 60])
def test_nearest_with_copies_and_bad_rows(spark, monkeypatch, deep):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (6, 16))
    x = centres[rng.integers(0, 6, 700)] + rng.normal(0, 0.4, (700, 16))
    x[300:340] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] + [1.0] * 15), (1300, [float("inf")] * 16), (1400, [1.0] * 3), (1500, [None] + [1.0] * 15), (None, [1.0] * 16)]
    d = spark.createDataFrame(rows + bad + [rows[5]], "vec_id long, embedding array<double>").withColumn("part", F.lit("clash")).withColumn("key", F.lit(0))
    if deep == 60:
        # Parts of some two hundred vectors are parted again, and the copies of a query vector shared out.
        monkeypatch.setattr(ann, "COPIES", 7)
    some = dict(leaf=20, most=4, deep=deep, recall=0.99) if deep == 60 else {}
    got = {}
    for r in ann.search(d, d.where("vec_id % 100 = 0 or vec_id between 300 and 339"), 10, **some).collect():
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == sorted({*range(0, 700, 100), *range(300, 340)})
    hits = 0
    for q, rs in got.items():
        rs.sort(key=lambda r: r.rank)
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        dist[q] = np.inf
        best = np.lexsort((np.arange(700), dist))[:10]
        hits += len(set(best.tolist()) & {r.vec_id for r in rs}) if q % 100 == 0 else 0
        assert [r.rank for r in rs] == list(range(1, 11)) and all(abs(r.score - dist[r.vec_id]) < 1e-12 for r in rs)
        if 300 <= q < 340:
            assert [r.vec_id for r in rs] == best.tolist()
    assert hits >= 0.9 * 70
    assert ann.search(d.limit(0), d.limit(0)).count() == 0
    three = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert ann.search(three, three.where("vec_id = 0")).count() == 2


def test_routing_asks_few_parts_of_clustered_vectors(spark):
    rng = np.random.default_rng(16)
    centres = rng.normal(0, 1, (60, 24))
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(0, 0.35, (6000, 24))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked, distinct = ann._inputs(d, d.where("vec_id % 100 = 0"), 10)
    work = ann._work(asked, distinct, ann.SAMPLE, ann.RECALL, ann.LEAF, ann.MOST_PARTS, ann.DEEP)
    sizes = {r.part: r["count"] for r in work.where("not query").groupBy("part").count().collect()}
    assert sum(sizes.values()) == 6000
    read = sum(sizes.get(p, 0) for r in work.where("query").select("parts").collect() for p in r.parts)
    got = {}
    for r in ann.search(d, d.where("vec_id % 100 = 0"), 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 100):
        dist = ((x - x[q]) ** 2).sum(axis=1)
        dist[q] = np.inf
        hits += len(got[q] & set(np.argsort(dist)[:10].tolist()))
    assert hits >= 0.9 * 600 and read <= 0.2 * 60 * 6000


def test_parts_are_balanced():
    x = np.random.default_rng(7).normal(0, 1, (600, 8))
    sizes = np.bincount(ann.balanced_parts(x, ann.neighbour_graph(x, 8), 6), minlength=6)
    assert sizes.max() <= 105 + 1 and sizes.min() > 50


# 4 Near-duplicates


@pytest.mark.parametrize("k", [2, 5])
@pytest.mark.parametrize("block", [4096, 7])
def test_near_duplicates_equal_brute_force(spark, docs, none, monkeypatch, k, block):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    rng = random.Random(8)
    base = vocabulary(rng, 120)
    hot = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 14):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(999)}"
        hot.append((1000 + i, " ".join(w), "s", None))
    d = docs.unionByName(spark.createDataFrame(hot + [(2000, hot[3][1], "s", None), (0, documents()[0][1], "s", None), (None, "no id", "s", None)], DOCS)).withColumn("kept", F.lit("mine"))
    rows = d.collect()

    def shingles(t):
        w = split(t)
        return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = {r.doc_id: shingles(r.text) for r in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for i in ids:
        for j in ids:
            if j > i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = neardup.near_duplicates(d, k, 80).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert neardup.near_duplicates(none, k).count() == 0


# 5 Language-model scores


@pytest.mark.parametrize("words", [1_500_000, 700])
def test_scores_equal_plain_backoff(spark, docs, none, monkeypatch, words):
    # Few words for a hash partition give many partitions; a block of few words cuts the corpus into many.
    monkeypatch.setattr(lm, "PART_WORDS", words)
    monkeypatch.setattr(lm, "BLOCK_WORDS", words)
    copy = documents()[5]
    d = docs.unionByName(spark.createDataFrame([copy, (None, "no id, but words of its own", "s", None), (None, copy[1], "s", None)], DOCS))
    rows = [(r.doc_id, split(r.text)) for r in d.collect()]

    def grams(w):
        return Counter(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))

    c = Counter()
    for _, w in rows:
        c.update(grams(w))
    n = sum(len(w) for _, w in rows)
    want = Counter()
    for i, w in rows:
        own = grams(w)
        left = lambda *g: c[g] - own[g]  # noqa: E731, B023
        total = seen = 0
        for k, x in enumerate(w):
            s = max(left(x), 0.5) / max(1, n - len(w))
            hit = False
            for j in (1, 2):
                if k >= j:
                    h = w[k - j : k]
                    if left(*h, x) > 0:
                        s, hit = left(*h, x) / left(*h), True
                    else:
                        s *= lm.ALPHA
            seen += hit
            total += math.floor(math.log(s) * lm.UNIT + 0.5)
        want[(i, len(w), seen, total / lm.UNIT, total / lm.UNIT / len(w) if w else None)] += 1
    got = Counter((r.doc_id, r.n_words, r.n_seen, r.score, r.mean_score) for r in lm.score(d.withColumn("score", F.lit("x"))).collect())
    assert got == want
    assert lm.score(none).count() == 0


def test_found_ngrams_reach_python_as_one_row_a_block_and_partition(spark, docs, monkeypatch):
    rows, run = spark.sparkContext.accumulator(0), lm._answers

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    monkeypatch.setattr(lm, "_answers", lambda batches: run(counted(batches)))
    assert sum(r.n_seen for r in lm.score(docs.repartition(3)).collect()) > 100
    # One hash partition, at most three blocks, two rounds.
    assert 0 < rows.value <= 6


def test_texts_without_words_alone(spark):
    got = lm.score(spark.createDataFrame([(1, "", "s", None), (2, None, "s", None), (None, " \n", "s", None)], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_seen, r.score, r.mean_score) for r in got) == [(0, 0, 0, 0.0, None), (1, 0, 0, 0.0, None), (2, 0, 0, 0.0, None)]


def test_orders_of_numbers_with_and_without_room_for_places():
    rng = np.random.default_rng(5)
    for most in (1, 40, 1 << 62):
        x = rng.integers(0, most, 1000)
        x[::3] = x[0]
        places = np.cumsum(rng.integers(1, 9, 1000))
        by = np.argsort(x, kind="stable")
        for given, want in ((None, by), (places, places[by])):
            order, numbers = lm._order(x, most, given)
            assert order.tolist() == want.tolist() and numbers.tolist() == x[by].tolist()
    assert [len(y) for y in lm._order(np.zeros(0, np.int64), 5)] == [0, 0]


@pytest.mark.parametrize("texts", [[""], ["a"], ["a b"], ["", "a", "", "a a", "b a a a", ""], ["a a a a a a"]])
def test_ngrams_of_tiny_blocks(texts):
    words = [t.split() for t in texts]
    seen = sorted({w for t in words for w in t})
    flat = np.array([seen.index(w) for t in words for w in t], np.uint32)
    g = lm._Grams(np.array([len(t) for t in words], "<u4").tobytes(), np.arange(1, len(seen) + 1, dtype=np.uint64).tobytes(), lm._packed(flat))
    for k in range(3):
        grams = [(d, tuple(t[i : i + k + 1])) for d, t in enumerate(words) for i in range(len(t)) if i + k < len(t)]
        all_, own = Counter(x for _, x in grams), Counter(grams)
        if k < 2:
            assert sorted(g.counts[k].tolist()) == sorted(all_.values())
        else:
            g.wanted(2)
        want = [all_[x] - own[d, x] if len(x := tuple(t[i : i + k + 1])) == k + 1 else 0 for d, t in enumerate(words) for i in range(len(t))]
        assert g.left(k).tolist() == want


# 6 Shards


def test_shards_are_contiguous_and_even(spark, docs, none):
    d = docs.unionByName(spark.createDataFrame([(None, "null id", "s", None), (3, "twice", "s", None)], DOCS)).withColumn("size", F.lit("clash"))
    got = sharding.byte_shards(d, 5, partitions=3).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in d.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    got.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size))
    total, run, slots = sum(r.size for r in got), 0, Counter()
    for r in got:
        assert r.shard == min(4, (2 * run + r.size) * 5 // (2 * total)) and r.slot == slots[r.shard]
        slots[r.shard] += 1
        run += r.size
    assert sharding.byte_shards(none, 5).count() == 0
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    slots = Counter((r.shard, r.slot) for r in sharding.byte_shards(hot, 5, partitions=6).collect())
    assert max(slots.values()) == 1 and len(slots) == 3000 and all((s, x - 1) in slots for s, x in slots if x)
    even = sharding.byte_shards(spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("text")), 40, partitions=7)
    sizes = [r.s for r in even.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) < 250


# 7 Main text


PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset=utf-8><title>T</title><style>p{}</style><script>var t="</p>";</script>
<body class="has-sidebar"><header id="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-banner">We use cookies, and you can say no to them at any time.</div><!-- <p>not text</p> -->
<article class="post comments-open"><header><h1>A headline &amp; more</h1></header><p><b>First paragraph, with some words in it,<br>and a   second line.
<p>Second &lt;tag&gt; paragraph; it is long enough to be an article&#39;s.</p><div class="ad">Buy now, it is cheap and it is good, believe us.</div>
<form><input name=q><label>Name</label></form><ul><li>an item of the article's list</li></ul><p>Last words.</p></article>
<aside><p>Other stories that you may like, with a sentence or two.</p></aside><section id="comments"><article class="comment"><p>I liked this article a lot, thank you for it, really.</p></article></section>
<footer>&copy; 2020 Example</footer></body></html>"""
TEXT = "A headline & more\nFirst paragraph, with some words in it, and a second line.\nSecond <tag> paragraph; it is long enough to be an article's.\nan item of the article's list\nLast words."


def test_main_text(spark):
    assert html.main_text(PAGE) == TEXT
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<script>only"), (6, "u", "<body><article>" + "<p>A sentence that is part of a very long article, said again.</p>" * 20000), (1, "u", PAGE)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html.extract(d).collect()
    assert sorted(r.page_id for r in got) == [1, 1, 2, 3, 4, 5, 6] and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == TEXT and by[2] == by[3] == by[5] == "" and by[6].count("\n") == 19999
    assert html.extract(d.limit(0)).count() == 0


SOUP = """<body><div class="c1"><div><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sports today</a></div><div class="c3"><div class="c5"><div>The council has decided on Monday, after a long debate, that the bridge will be built.</div>
<div>It was close.</div><div>Of the members, twelve were for it, and ten against; the mayor did not vote at all.</div><div>Why?</div><div>Nobody could say, as the meeting was held behind closed doors, without any of the press.</div></div></div>
<div class="c6"><a href="/1">Another story that is linked here</a><a href="/2">And one more that you may like</a></div><div class="c7">&copy; 2024 Example Media</div></div></body>"""


def test_the_cut_saves_short_lines_and_paragraphs_with_misleading_names():
    found = html.blocks(SOUP)
    before, after = html.leanings(found, html.PRIOR, html.marks_of(found)) > 0, html.content(found)
    want = np.array(["href" not in b.text and not b.linked and "©" not in b.text for b in found])
    assert (after == want).all() and (before != after).sum() == 1
    page = "<article><h1>Head</h1><p>First paragraph, with a number of words in it.</p><div class='related-work'><p>Others found it before.</p></div><div class=ad>Buy now, it is cheap and it is good, believe us.</div><p>Yes.</p></article>"
    found = html.blocks(page)
    assert [b.text for b, z in zip(found, html.leanings(found, html.PRIOR, html.marks_of(found))) if z < 0] == ["Others found it before.", "Buy now, it is cheap and it is good, believe us."]
    assert html.main_text(page) == "Head\nFirst paragraph, with a number of words in it.\nOthers found it before.\nYes."
    assert html.main_text("<div class='share-price'><p>The share price rose by ten percent on Monday, after the results.</p></div>").startswith("The share")


def test_markup_that_is_easily_misread():
    assert html.main_text("<article><p title=it's>First one of the paragraphs.</p><p id=a=\"b c='>'>Second one of them, after it.</p></article>") == "First one of the paragraphs.\nSecond one of them, after it."
    assert html.main_text("<article><p a='x>y' b = \"<p>\">It is <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>x+1</annotation></math> then, and so on.</p></article>") == "It is x+1 then, and so on."
    assert html.main_text("<article><p>An unclosed quote, it swallows what follows.</p><p class='a>Gone with the tag.</p>") == "An unclosed quote, it swallows what follows."


def test_extract_equals_the_articles(spark, sf_dir):
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.blocks, self.inside = [""], False

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            if tag in ("p", "h1", "article"):
                self.blocks.append("")
            if tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "article"
            if tag in ("p", "h1", "article"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        article = Article()
        article.feed(r.html)
        article.close()
        assert got[r.page_id] == "\n".join(x for b in article.blocks if (x := re.sub(r"\s+", " ", b).strip()))


def test_a_tiny_share_still_draws_rows(spark):
    d = spark.range(200_000).select(F.col("id").alias("doc_id"))
    assert 20 < common.sampled(d, 50 / 200_000, "doc_id").count() < 110
    bound = lambda share: common.sampled(d, share, "doc_id")._jdf.queryExecution().analyzed().toString()
    assert bound(1e-12) != bound(1e-11) and common.sampled(d, 1.0, "doc_id") is d


def test_min_cut_is_least():
    rng = random.Random(9)
    for _ in range(40):
        n = rng.randrange(1, 8)
        costs = np.array([[rng.random() * 4, rng.random() * 4] for _ in range(n)])
        ties = [(a, b, rng.random() * 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(labels):
            return sum(costs[i][1 if x else 0] for i, x in enumerate(labels)) + sum(c for a, b, c in ties if labels[a] != labels[b])

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost(html.min_cut(costs, ties).tolist()) == pytest.approx(best)


# 8 Fingerprints


def test_syncmers_are_context_free():
    rng = random.Random(10)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    at, h = syncmers.anchors(text)
    keyed = dict(zip(at.tolist(), h.tolist()))

    def inner(s):
        p = np.array([ord(c) for c in s], np.uint64)
        return common.mix((p * syncmers._MULT[: syncmers.S]).sum(keepdims=True, dtype=np.uint64))[0]

    for i in range(0, 400):
        ks = [inner(text[i + j : i + j + syncmers.S]) for j in range(syncmers.K - syncmers.S + 1)]
        assert (i in keyed) == (min(ks) in (ks[0], ks[-1]))
    assert np.diff(at).max() <= syncmers.K - syncmers.S
    moved = dict(zip(*[x.tolist() for x in syncmers.anchors("zz" + text)]))
    assert all(moved[i + 2] == x for i, x in keyed.items())


@pytest.mark.parametrize("partitions", [1, 4])
def test_fingerprints_equal_direct_ones(spark, docs, none, partitions):
    d = docs.withColumn("fingerprint", F.lit(1))
    got = {r.doc_id: r for r in syncmers.fingerprints(d, partitions).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in d.collect()), reverse=True)
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(rows):
        other, m, r = rows[(i + 1) % len(rows)][1], len(text) // 3, got[doc]
        new = text[: len(text) - m] + other[:m]
        own, fresh, next_ = (syncmers.keep(*syncmers.anchors(t)) for t in (text, new, other))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (syncmers.written(*own), syncmers.written(*fresh))
        assert (r.near_edited, r.near_next) == (syncmers.likeness(own, fresh), syncmers.likeness(own, next_))
        assert 0 <= r.near_edited <= 1 and (text != "" or r.fingerprint == "")
    assert syncmers.fingerprints(none).count() == 0
    one = syncmers.fingerprints(spark.createDataFrame([(4, "only one text here", "s", None)], DOCS)).first()
    assert one.near_next == 1.0
    same = syncmers.fingerprints(spark.createDataFrame([(4, "a", "s", None), (4, "b", "s", None), (None, None, "s", None)], DOCS), 2)
    assert same.count() == 3


def test_fingerprints_hold_every_anchor():
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    shared = letters(300)
    a, b = letters(9000) + shared + letters(9000), letters(4000) + shared + letters(14000)
    one, two = (syncmers.keep(*syncmers.anchors(t)) for t in (a, b))
    assert sorted(one[0].tolist()) == syncmers.anchors(a)[0].tolist() and syncmers.read(syncmers.written(*one))[0].tolist() == one[0].tolist()
    inside = sum(9000 <= p <= 9300 - syncmers.K for p in one[0].tolist())
    assert inside > 10 and syncmers.likeness(one, two) == inside / (len(one[0]) + len(two[0]) - inside)
    # A passage that comes again counts each time.
    thrice, once = (syncmers.keep(*syncmers.anchors(shared * n)) for n in (3, 1))
    assert len(thrice[0]) > 2.5 * len(once[0]) and syncmers.likeness(thrice, once) == len(once[0]) / len(thrice[0])
    assert syncmers.likeness(thrice, thrice) == 1.0


def test_short_texts_share_anchors_with_their_edits():
    rng = random.Random(12)
    for n in range(3, 200):
        for size in (n // 3, n // 6):  # the next text may be too short to fill the third
            text, other = ("".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(m)) for m in (n, size))
            new = text[: n - n // 3] + other
            own, fresh, apart = (syncmers.keep(*syncmers.anchors(t)) for t in (text, new, other * 9))
            assert syncmers.likeness(own, fresh) > 0.1 > syncmers.likeness(own, apart) and syncmers.likeness(own, own) == 1.0
            # Anchors put together from those of the parts are those of the text.
            for o in (other, other * 9):
                made, found = syncmers._edited(text, syncmers.anchors(text), o, syncmers.anchors(o))
                assert [x.tolist() for x in syncmers.anchors(made)] == [x.tolist() for x in found]


# 9 Language


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(11)
    for _ in range(30):
        counts = rng.integers(0, 40, 9)
        scores = rng.normal(0, 3, (counts.sum(), 4))
        got, a = langid.viterbi(scores, counts), 0
        for c in counts:
            x, path = scores[a : a + c], got[a : a + c]
            if c:
                state = x[0]
                for row in x[1:]:
                    state = (state[:, None] - langid.PENALTY * (1 - np.eye(4))).max(axis=0) + row
                assert x[np.arange(c), path].sum() - langid.PENALTY * (np.diff(path) != 0).sum() == pytest.approx(state.max())
            a += c


def test_language_of_held_out_and_mixed_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.where("not held_out"))
    got = langid.identify(docs.where("held_out").withColumn("score", F.lit("clash")), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    en, de = (next(r.text for r in got if r.lang == x and 300 < r.n_chars < 3000 and r.score == 1) for x in ("en", "de"))
    assert [s[2] for s in langid.spans(en + " " + de, model)] == ["en", "de"]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, en * 200), (5, en), (5, en)], "doc_id long, text string")
    r = {x.doc_id: x for x in langid.identify(odd, model).collect()}
    assert [r[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"] and r[1].score == 0 and r[5].score == 1
    assert langid.identify(odd.limit(0), model).count() == 0
    empty = langid.train(docs.limit(0))
    assert {x.lang_pred for x in langid.identify(odd, empty).collect()} == {"und"}


def test_scripts_narrow_candidates(spark):
    d = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("мир дом лес река", "ru"), ("world house wood river", "en"), ("世界家", "zh")] * 5)], "doc_id long, text string, lang string")
    model = langid.train(d)
    r = langid.identify(spark.createDataFrame([(1, "лесом"), (2, "woods"), (3, "家世"), (4, "ωμέγα")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [x.lang_pred for x in r][:3] == ["ru", "en", "zh"] and r[3].lang_pred in model.langs


# 10 Mixing


def test_mix_reaches_its_targets(spark, docs, none):
    d = docs.withColumn("size", F.lit("clash"))
    got = mixing.mix(d).collect()
    want = {r.doc_id: len(split(r.text)) for r in d.collect()}
    assert {r.doc_id: r.size for r in got} == want
    size, source = Counter(), {r.doc_id: r.source for r in got}
    for r in got:
        size[r.source] += r.size
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(size.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    for s in names:
        rs = [r for r in got if r.source == s]
        assert rs[0].target == pytest.approx(target[s]) and all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in rs)
        largest = max(r.size for r in rs)
        assert abs(sum(r.taken for r in rs) - target[s]) <= largest / 2 + 1e-6
    again = {r.doc_id: r.taken for r in mixing.mix(d.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in got} and source
    assert mixing.mix(none).count() == 0
    nothing = mixing.mix(spark.createDataFrame([(1, None, "a", None), (2, "", None, None)], DOCS)).collect()
    assert [(r.target, r.taken) for r in nothing] == [(0.0, 0), (0.0, 0)]


def test_pareto_sampling_keeps_size_and_inclusion(spark):
    d = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("one").alias("text"), F.lit("a").alias("source"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("w"))
    got = mixing.mix(d, budget=0.3, weight_column="w").groupBy((F.col("doc_id") % 2).alias("m")).agg(F.sum("taken").alias("n")).collect()
    n = {r.m: r.n for r in got}
    # Inclusion 0.48 and 0.12, and a fixed size.
    assert n[0] + n[1] == 6000 and abs(n[0] - 4800) < 150
    most = mixing.mix(d, budget=0.55, weight_column="w").groupBy((F.col("doc_id") % 2).alias("m")).agg(F.sum("taken").alias("n")).collect()
    n = {r.m: r.n for r in most}
    # The level would give the heavy ones 0.88 and the light ones 0.22.
    assert n[0] + n[1] == 11000 and abs(n[0] - 8800) < 150
    # By default long texts are likelier.
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("w "), 200)).otherwise("w").alias("text"), F.lit("a").alias("source"))
    got = mixing.mix(d, budget=0.5).groupBy((F.col("doc_id") % 2).alias("m")).agg(F.sum("copies").alias("n")).collect()
    n = {r.m: r.n for r in got}
    assert 900 < n[0] < 1100 and 60 < n[1] < 200


def test_mix_draws_rows_without_an_id_of_their_own(spark):
    """Rows that share or lack an id are drawn on their own, equal ones too; a third of the rows are equal."""
    words = "one two three four five six seven eight nine"
    rows = [(None, words, "a", None) for _ in range(900)] + [(7, words, "b", None) for _ in range(300)] + [(None, f"{words} {i}", "a", None) for i in range(600)] + [(i % 3, f"{words} {i}", "b", None) for i in range(900)] + [(None, None, "a", None), (None, "", "c", None)]
    d = spark.createDataFrame(rows, DOCS).repartition(4)
    for budget in (0.31, 0.7, 1.5):
        got = mixing.mix(d, budget=budget).collect()
        assert len(got) == len(rows)
        for s in ("a", "b"):
            mine = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 5 and max(r.copies for r in mine) <= 2
        again = Counter((r.doc_id, r.text, r.taken) for r in mixing.mix(d.repartition(3), budget=budget).collect())
        assert again == Counter((r.doc_id, r.text, r.taken) for r in got)
    alike = mixing.mix(spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(words).alias("text"), F.lit("a").alias("source")), budget=0.25).collect()
    assert sum(r.copies for r in alike) == 250
