"""Nearest neighbours by learned partitions.

On a bounded sample of the vectors a neighbour graph is built and cut into
parts of nearly equal size with few cut edges. A small classifier, a softmax
over the parts, learns which parts a vector's neighbours lie in. Every vector
is indexed under its most probable part; a query asks its most probable parts
until their probabilities come to what the calibration found necessary, and all
vectors there are reranked by exact distance.

Parts aim at LEAF vectors, so their number grows with the table. One classifier
has MOST_PARTS of them; parts that are still large are parted again, each by a
classifier of its own that a task fits on a bounded sample of the part. So the
work of a query depends on how its neighbours scatter, not on the table's size.

Parts lie in blocks of neighbouring numbers and of bounded size, a crowded one
in several; a task holds a block and streams the block's queries against it.
Equal vectors are searched once: of each distinct vector the K + 1 smallest ids
are kept, as no result can hold more of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeframe.llm.common import sampled, settled, trimmed

#: Vectors that train and calibrate a classifier, at most; taken by a hash of the id.
SAMPLE = 8000
#: Vectors for each part that the number of parts aims at, parts of one classifier at most, and vectors from which a part is parted again, to so many levels.
LEAF, MOST_PARTS, DEEP, LEVELS = 100, 512, 4000, 6
NEIGHBOURS = 10
#: Recall of NEIGHBOURS on the sample that the asked parts must reach, over all levels.
RECALL = 0.94
#: Parts that make a block, and vectors of a block that a task holds.
TOGETHER, BLOCK = 16, 20_000
#: Rows up to which a table of one row for each block or large part is broadcast.
FEW = 200_000
#: Copies of a query vector for each task that gives them its neighbours.
COPIES = 10_000


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` nearest other rows of each row."""
    k = min(k, len(x) - 1)
    norms = (x * x).sum(axis=1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 500):
        d = norms[None, :] - 2 * x[i : i + 500] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + 500] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.05, rounds: int = 12) -> np.ndarray:
    """A part for each row: halves along principal axes, then moves of rows to the part of most of their neighbours while sizes stay within ``slack``."""
    n = len(x)
    part = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1 or len(rows) < 2:
            part[rows] = first
            continue
        y = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.eigh(y.T @ y)[1][:, -1]
        left = count // 2
        order = np.argsort(y @ axis, kind="stable")
        cut = len(rows) * left // count
        todo += [(rows[order[:cut]], first, left), (rows[order[cut:]], first + left, count - left)]
    most = int(np.ceil(n / parts * (1 + slack)))
    both_a = np.concatenate((np.repeat(np.arange(n), graph.shape[1]), graph.ravel()))
    both_b = np.concatenate((graph.ravel(), np.repeat(np.arange(n), graph.shape[1])))
    for _ in range(rounds):
        votes = np.bincount(both_a * parts + part[both_b], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        sizes = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < most:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if moved < n // 500:
            break
    return part


@dataclass
class Router:
    """A softmax over parts; a query asks parts, the likeliest first, until they have more than ``enough`` of the probability."""

    w: np.ndarray
    b: np.ndarray
    enough: float = 1.0

    def probable(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.w + self.b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def home(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.w + self.b).argmax(axis=1)

    def before(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of each row, the likeliest first, and the probability of those before each."""
        p = self.probable(x)
        order = np.argsort(-p, axis=1, kind="stable")
        p = np.take_along_axis(p, order, axis=1)
        return order, np.cumsum(p, axis=1) - p

    def asked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) of the parts that each row asks."""
        order, before = self.before(x)
        row, place = np.nonzero(before <= self.enough)
        return row, order[row, place]

    def packed(self) -> bytes:
        return np.concatenate(([self.w.shape[0], self.enough], self.b, self.w.ravel())).tobytes()

    @staticmethod
    def unpacked(raw: bytes) -> Router:
        x = np.frombuffer(raw, np.float64)
        dim = int(x[0])
        parts = (len(x) - 2) // (dim + 1)
        return Router(x[2 + parts :].reshape(dim, parts), x[2 : 2 + parts], float(x[1]))


def train_router(x: np.ndarray, part: np.ndarray, goal: np.ndarray, sharp: float = 20.0, epochs: int = 5, seed: int = 3) -> Router:
    """Fits the share of neighbours in each part by cross entropy, with Adam, from the parts' centroids on."""
    rng = np.random.default_rng(seed)
    scale = float(1 / max(1e-300, np.sqrt((x * x).sum(axis=1).mean())))
    x = x * scale
    parts = goal.shape[1]
    n = np.maximum(np.bincount(part, minlength=parts), 1)
    centres = np.zeros((parts, x.shape[1]))
    np.add.at(centres, part, x)
    centres /= n[:, None]
    p = [np.ascontiguousarray(sharp * centres.T), -sharp / 2 * (centres * centres).sum(axis=1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            a, g = x[order[i : i + 256]], goal[order[i : i + 256]]
            d = (Router(*p).probable(a) - g) / len(a)
            t += 1
            for q, (w, grad) in enumerate(zip(p, (a.T @ d, d.sum(axis=0)))):
                m[q] = 0.9 * m[q] + 0.1 * grad
                v[q] = 0.999 * v[q] + 0.001 * grad * grad
                w -= 0.02 * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)
    return Router(p[0] * scale, p[1])


def fit(x: np.ndarray, total: int, recall: float = RECALL, leaf: int = LEAF, most: int = MOST_PARTS) -> Router:
    """A router from sample rows ``x`` of ``total`` vectors."""
    parts = max(1, min(round(total / leaf), most, len(x) // 8))
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1))
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(x, graph, parts)
    near = np.concatenate((graph, np.arange(len(x))[:, None]), axis=1)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.arange(len(x))[:, None], part[near]), 1 / near.shape[1])
    # A fifth stays out of training, to find how much probability must be asked.
    held = np.arange(len(x)) % 5 == 0
    router = train_router(x[~held], part[~held], goal[~held])
    order, before = router.before(x[held])
    by_part = np.empty_like(before)
    np.put_along_axis(by_part, order, before, axis=1)
    needed = np.take_along_axis(by_part, router.home(x)[graph[held]], axis=1)
    router.enough = float(np.quantile(needed, recall, method="higher"))
    return router


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


#: A vector has one part; a query has those of one block that it asks. Parts are numbered as in a heap: the children of part p are p * most + 1 to p * most + most.
ROWS = "query boolean, key long, ids array<long>, vec array<double>, block long, parts array<long>"


def _routed(router: Router, batch: pa.RecordBatch, parent: int, most: int) -> pa.RecordBatch:
    """Rows (query, key, ids, vec) under the children of ``parent``."""
    x, query = _vectors(batch), batch.column("query").to_numpy(zero_copy_only=False)
    own, asks = np.flatnonzero(~query), np.flatnonzero(query)
    row, part = router.asked(x[asks]) if len(asks) else (np.zeros(0, np.int64),) * 2
    row, part = np.concatenate((own, asks[row])), np.concatenate((router.home(x[own]) if len(own) else np.zeros(0, np.int64), part)) + parent * most + 1
    block = part // TOGETHER
    order = np.lexsort((part, block, row))
    row, part, block = row[order], part[order], block[order]
    cuts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (block[1:] != block[:-1]))))
    parts = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(part)), pa.int32()), pa.array(part))
    take = pa.array(row[cuts])
    return pa.RecordBatch.from_arrays([*[batch.column(n).take(take) for n in ("query", "key", "ids", "vec")], pa.array(block[cuts]), parts], names=["query", "key", "ids", "vec", "block", "parts"])


def _root(router, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _routed(router.value, batch, 0, most)

    return run


def _deeper(most: int):
    """Rows sorted by (part, share, first the part's model): the others under the children of their part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, router = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").to_numpy()
            model = batch.column("model").is_valid().to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero((part[1:] != part[:-1]) | model[1:] | model[:-1]) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if model[a]:
                    at, router = part[a], Router.unpacked(batch.column("model")[a].as_py())
                else:
                    assert at == part[a], "a part's model comes first"
                    yield _routed(router, batch.slice(a, b - a), int(part[a]), most)

    return run


def _parted(rows: DataFrame, sample: int, recall: float, leaf: int, most: int, deep: int) -> DataFrame:
    """``rows`` (ROWS) with large parts parted again, level by level; each level is written once."""

    def learn(one):
        x = np.array(one["vec"].tolist())
        return one[["part"]].head(1).assign(model=[fit(x, int(one["n"].iloc[0]), recall, leaf, most).packed()])

    for _ in range(LEVELS - 1):
        large = settled(rows.where("not query").groupBy(F.col("parts")[0].alias("part")).agg(F.count("*").alias("n")).where(F.col("n") > deep))
        count = large.count()
        if not count:
            return rows
        few = F.broadcast if count <= FEW else (lambda x: x)
        flat = rows.select("query", "key", "ids", "vec", F.explode("parts").alias("part")).join(few(large), "part", "left")
        inside = flat.where("n is not null")
        # Compared as doubles: however small the share is, hashes have a range far finer.
        drawn = inside.where(~F.col("query") & (F.xxhash64(F.lit("sample"), "key").cast("double") < F.lit(sample * 2.0**64) / F.col("n") - 2.0**63))
        models = drawn.select("part", "n", "vec").groupBy("part").applyInPandas(learn, "part long, model binary")
        shares = F.ceil(F.col("n") / BLOCK).cast("int")
        moving = inside.select("part", F.pmod(F.xxhash64("key"), shares).cast("int").alias("share"), "query", "key", "ids", "vec", F.lit(None).cast("binary").alias("model"))
        leading = models.join(few(large), "part").select("part", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.lit(False).alias("query"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<double>").alias("vec"), "model")
        work = moving.unionByName(leading).repartition("part", "share").sortWithinPartitions("part", "share", F.col("model").isNull())
        finer = work.mapInArrow(trimmed(_deeper(most)), ROWS)
        stay = flat.where("n is null").select("query", "key", "ids", "vec", F.floor(F.col("part") / TOGETHER).alias("block"), F.array("part").alias("parts"))
        rows = settled(stay.unionByName(finer))
    return rows


def _search(k: int):
    """Rows sorted by (block, share, vectors before queries, first part): the ``k`` nearest vectors of each query among the parts that it asks. A task holds one block and some queries."""

    def nearest(key: np.ndarray, q: np.ndarray, asks: list, first: np.ndarray, ids: list, x: np.ndarray, norms: np.ndarray, spans: dict) -> list[tuple]:
        d = np.full((len(q), len(x)), np.inf)
        by_part: dict[int, list[int]] = {}
        for row, parts in enumerate(asks):
            for p in parts:
                by_part.setdefault(p, []).append(row)
        for p, rows in by_part.items():
            if p in spans:
                a, b = spans[p]
                d[rows, a:b] = norms[None, a:b] - 2 * q[rows] @ x[a:b].T
        out = []
        some = min(len(x), 2 * k + 10)
        cut = np.partition(d, some - 1, axis=1)[:, some - 1] if some < len(x) else np.full(len(q), np.inf)
        most = norms.max()
        for row in range(len(q)):
            # Equal sums stay in, and so does what rounding may have pushed out.
            c = np.flatnonzero((d[row] <= cut[row] + 1e-9 * (1 + abs(cut[row]) + most)) & (d[row] < np.inf))
            exact = np.sqrt(((x[c] - q[row]) ** 2).sum(axis=1))
            out += [(int(key[row]), ids[c[b]], float(exact[b])) for b in np.lexsort((first[c], exact))[:k]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.float64())], names=["q", "ids", "score"])

        at, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, share, query = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("block", "share", "query"))
            key, part, x = batch.column("key").to_numpy(), batch.column("part").to_numpy(), _vectors(batch)
            cuts = (np.flatnonzero((block[1:] != block[:-1]) | (share[1:] != share[:-1]) | (query[1:] != query[:-1])) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if (block[a], share[a]) != at:
                    at, held, ready = (block[a], share[a]), [], None
                if not query[a]:
                    held.append((batch.column("ids").slice(a, b - a).to_pylist(), x[a:b].copy(), part[a:b].copy()))
                    continue
                if not held:
                    continue
                if ready is None:
                    ids = [i for h in held for i in h[0]]
                    all_x, parts = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
                    begins = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1]))).tolist()
                    spans = {int(parts[i]): (i, j) for i, j in zip(begins, [*begins[1:], len(parts)])}
                    ready = (np.array([i[0] for i in ids]), ids, all_x, (all_x * all_x).sum(axis=1), spans)
                for i in range(a, b, 256):
                    j = min(b, i + 256)
                    yield table(nearest(key[i:j], x[i:j], batch.column("parts").slice(i, j - i).to_pylist(), *ready))

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = SAMPLE, recall: float = RECALL, leaf: int = LEAF, most: int = MOST_PARTS, deep: int = DEEP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found rows of ``vectors`` (vec_id, embedding) for each row of ``queries``, which must be rows of it.

    Distance is Euclidean, in double precision, on the original vectors; ties
    go to the smaller vec_id; a row is no neighbour of itself, but of its
    copies. Vectors that are null, zero, hold null, NaN or infinity, or aren't
    of the commonest dimension take no part, nor do null ids. Rows repeated
    with one id count as one. Fewer than ``k`` candidates give all of them,
    none gives no row. Other columns are ignored.
    """
    spark = vectors.sparkSession
    asked, distinct = _inputs(vectors, queries, k)
    if asked is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    work = _work(asked, distinct, sample, recall, leaf, most, deep)
    found = work.mapInArrow(trimmed(_search(k + 1)), "q long, ids array<long>, score double")
    best = found.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("score", F.element_at("ids", 1)))).where(F.col("n") <= k + 1)
    # Back from distinct query vectors to the rows that hold them; those of one vector are shared out if they are many.
    crowds = settled(asked.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") > COPIES))
    keys = asked.select(F.col("id").alias("query_id"), "q")
    near = best.select("q", F.explode("ids").alias("vec_id"), "score")
    if crowds.limit(1).count():
        shares = F.coalesce(F.ceil(F.col("n") / COPIES), F.lit(1)).cast("int")
        keys = keys.join(crowds, "q", "left").withColumn("share", F.pmod(F.xxhash64("query_id"), shares).cast("int")).drop("n")
        near = near.join(crowds, "q", "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("n")
    pairs = keys.join(near, [c for c in keys.columns if c != "query_id"]).where("vec_id <> query_id")
    ranked = pairs.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _inputs(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Query rows (id, vec, q), q being the vector's 64-bit hash, and distinct vectors (key, ids, vec)."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    valid = vectors.select(F.col("vec_id").cast("long").alias("id"), x.alias("vec")).where("id is not null and vec is not null").where(fine)
    dim = valid.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dim:
        return None, None
    # -0.0 and 0.0 are one number.
    valid = valid.where(F.size("vec") == dim[0].d).withColumn("vec", F.transform("vec", lambda v: v + 0.0)).withColumn("hash", F.xxhash64("vec"))
    # The row limit by window is applied before the shuffle too, so a vector with many copies brings k + 1 rows from each task.
    few = valid.dropDuplicates(["hash", "vec", "id"]).withColumn("n", F.row_number().over(W.partitionBy("hash", "vec").orderBy("id"))).where(F.col("n") <= k + 1)
    distinct = settled(few.groupBy("hash", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("key"), "ids", "vec"))
    wanted = queries.select(F.col("vec_id").cast("long").alias("id")).where("id is not null").distinct()
    asked = valid.select("id", "vec", F.col("hash").alias("q")).join(wanted, "id", "left_semi").dropDuplicates(["id", "vec"])
    return settled(asked), distinct


def _work(asked: DataFrame, distinct: DataFrame, sample: int, recall: float, leaf: int, most: int, deep: int) -> DataFrame:
    """Vectors and queries by (block, share), as _search takes them."""
    spark = distinct.sparkSession
    total = distinct.count()
    got = sampled(distinct.select("key", "vec"), sample / total, "key").orderBy("key").toArrow()
    rows = got.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, -1)
    levels = max(1, math.ceil(math.log(max(2.0, total / leaf)) / math.log(most)))
    recall = recall ** (1 / levels)
    router = spark.sparkContext.broadcast(fit(rows, total, recall, leaf, most))
    ask = asked.groupBy("q").agg(F.first("vec").alias("vec")).select(F.lit(True).alias("query"), F.col("q").alias("key"), F.array("q").alias("ids"), "vec")
    both = distinct.select(F.lit(False).alias("query"), "key", "ids", "vec").unionByName(ask)
    placed = _parted(settled(both.mapInArrow(trimmed(_root(router, most)), ROWS)), sample, recall, leaf, most, deep)

    shares = settled(placed.where("not query").groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("shares")))
    few = F.broadcast if shares.count() <= FEW else (lambda x: x)
    placed = placed.join(few(shares), "block")
    own = placed.where("not query").withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int"))
    asking = placed.where("query").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    work = own.unionByName(asking).withColumn("part", F.col("parts")[0]).drop("shares")
    return work.repartition("block", "share").sortWithinPartitions("block", "share", "query", "part", "key")
