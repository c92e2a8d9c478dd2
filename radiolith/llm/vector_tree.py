"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first traversal.

The tree is fitted on a bounded sample; every vector is then assigned to a leaf. A query goes down the tree by a
priority queue of nodes, nearest centre first, and collects leaves in the order it reaches them. How many it visits
is calibrated: visits are doubled until rows of the sample that the tree was not fitted on find ``recall`` of
their neighbours, against brute force over the sample.

Equal vectors are one class with its smallest ids, which is all that a ranking with ties by id can use.
Leaves are packed into blocks of bounded size, a large leaf into several, so that a query is sent once to a block; there
it meets the vectors of the leaves that it visits, and no others.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, materialize, shuffle_width

SAMPLE = 16_384
BRANCH = 16
LEAF = 48
BLOCK = 4096
QUERIES = 256


class Tree:
    """Centres of all nodes and, for each, its first child and number of children (0: a leaf with a number)."""

    def __init__(self, centres: np.ndarray, first: np.ndarray, count: np.ndarray, leaf: np.ndarray) -> None:
        self.centres, self.first, self.count, self.leaf = centres, first, count, leaf

    @property
    def leaves(self) -> int:
        return int(self.leaf.max(initial=0)) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row, going to the nearest child at each level."""
        node = np.zeros(len(x), dtype=np.int64)
        open_ = np.arange(len(x))
        while len(open_ := open_[self.count[node[open_]] > 0]):
            for at in np.unique(node[open_]):
                rows = open_[node[open_] == at]
                lo = self.first[at]
                node[rows] = lo + _squares(x[rows], self.centres[lo : lo + self.count[at]]).argmin(axis=1)
        return self.leaf[node]

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves for a query, best bin first."""
        out, heap = [], [(0.0, 0)]
        while heap and len(out) < most:
            _, at = heapq.heappop(heap)
            while self.count[at]:
                lo = int(self.first[at])
                d = ((self.centres[lo : lo + self.count[at]] - q) ** 2).sum(axis=1)
                best = int(d.argmin())
                for i, v in enumerate(d.tolist()):
                    if i != best:
                        heapq.heappush(heap, (v, lo + i))
                at = lo + best
            out.append(int(self.leaf[at]))
        return out


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of ``x`` to the rows of ``y``, also where squares leave the range of doubles."""
    away = y - x
    with np.errstate(over="ignore", under="ignore"):
        d = np.sqrt((away * away).sum(axis=1))
    odd = np.flatnonzero(~np.isfinite(d) | (d < 1e-140))
    if len(odd):
        most = np.abs(away[odd]).max(axis=1, initial=0)
        odd, most = odd[np.isfinite(most) & (most > 0)], most[np.isfinite(most) & (most > 0)]
        d[odd] = most * np.sqrt(((away[odd] / most[:, None]) ** 2).sum(axis=1))
    return d


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _squares(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    near = _squares(x, centres).argmin(axis=1)
    used = np.unique(near)
    return centres[used], np.searchsorted(used, near)


def fit(x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 0) -> Tree:
    """Split the sample until parts have at most ``leaf`` rows or no two different ones."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1] if x.ndim == 2 else 0
    centres, first, count, leaves, n_leaves = [np.zeros(dim)], [0], [0], [-1], 0
    work = [(0, x)]
    while work:
        at, rows = work.pop()
        parts = None
        if len(rows) > leaf:
            c, near = _kmeans(rows, min(branch, len(rows)), rng)
            if len(c) > 1:
                parts = c, near
        if parts is None:
            leaves[at] = n_leaves
            n_leaves += 1
            continue
        c, near = parts
        first[at], count[at] = len(centres), len(c)
        for i in range(len(c)):
            work.append((len(centres), rows[near == i]))
            centres.append(c[i])
            first.append(0)
            count.append(0)
            leaves.append(-1)
    return Tree(np.array(centres), np.array(first), np.array(count), np.array(leaves))


def calibrate(tree: Tree, x: np.ndarray, held: int, k: int, recall: float, probes: int = 256) -> int:
    """Least power of two of leaf visits with which the last ``held`` rows, that the tree was not fitted on, reach ``recall`` against brute force over the sample."""
    asked = np.arange(len(x) - min(held, probes), len(x))
    if len(x) < 2 or not len(asked):
        return tree.leaves
    d = _squares(x[asked], x)
    d[np.arange(len(asked)), asked] = np.inf
    true = np.argsort(d, axis=1)[:, : min(k, len(x) - 1)]
    leaf = tree.assign(x)
    place = np.empty((len(asked), tree.leaves), dtype=np.int64)
    for r, i in enumerate(asked):
        order = tree.visits(x[i], tree.leaves)
        place[r, order] = np.arange(len(order))
    needed = place[np.arange(len(asked))[:, None], leaf[true]]
    n = 1
    while n < tree.leaves and (needed < n).mean() < recall:
        n *= 2
    return min(n, tree.leaves)


def pack(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """``(first block, number of blocks)`` of each leaf: neighbouring small leaves share a block, a large one is dealt to several."""
    first, number, at, held = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if n > block:
            at += held > 0
            first[i], number[i] = at, -(-n // block)
            at, held = at + int(number[i]), 0
            continue
        if held + n > block:
            at, held = at + 1, 0
        first[i], held = at, held + n
    return first, number


def _classes(vectors: DataFrame, dim: int, keep: int) -> DataFrame:
    """``(cid, vec, ids)``: distinct vectors, the smallest id of each, and its ``keep`` smallest ids."""
    key = F.xxhash64("vec")
    first = Window.partitionBy("key", "vec").orderBy("vec_id")
    ranked = vectors.withColumn("key", key).withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= keep)
    return ranked.groupBy("key", "vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("cid"), "vec", "ids")


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, vec)`` of the rows that take part: no null id, no null, zero or non-finite vector, no null component."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", fine) & F.exists("vec", lambda x: x != 0))
    return rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # one zero


def nearest(table: DataFrame, every: int = 100, k: int = 10, recall: float = 0.97, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id ``every`` divides the ``k`` nearest found of all other rows.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go to the smaller id, fewer candidates
    give fewer rows. Null ids, and vectors that are null, zero or hold null or non-finite components, take no part; nor do
    vectors of another length than the most frequent (the smaller of two as frequent). Rows that repeat an id and a vector are one;
    an id with two different vectors asks and answers once for each. Other columns are not read. An empty table gives no rows.
    """
    spark = table.sparkSession
    rows = materialize(usable(table, id_col, vec_col).distinct(), "ann-vectors")
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = lengths[0]["n"] if lengths else 0
    rows = rows.where(F.size("vec") == dim)
    classes = materialize(_classes(rows, dim, k + 1), "ann-classes")
    top = rows.agg(F.max(F.array_max(F.transform("vec", F.abs))).alias("m")).first()["m"] or 1.0
    unit = 1.0 if 1e-60 < top < 1e60 else 2.0 ** math.frexp(top)[1] if top < 1e300 else top  # squares of vectors by this unit are doubles
    drawn = classes.orderBy(F.xxhash64("cid"), "cid").select("vec").limit(sample).collect()
    x = np.array([r["vec"] for r in drawn], dtype=np.float64).reshape(len(drawn), dim) / unit
    own_rows = max(1, len(x) - len(x) // 4)
    tree = fit(x[:own_rows])
    visits = calibrate(tree, x, len(x) - own_rows, k, recall)
    held = spark.sparkContext.broadcast((tree.centres, tree.first, tree.count, tree.leaf))

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tree(*held.value)
        for b in batches:
            v = np.array(b.column(1).to_pylist(), dtype=np.float64).reshape(b.num_rows, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.assign(v / unit).astype(np.int32)), b.column(1), b.column(2)], names=["cid", "leaf", "vec", "ids"])

    placed = materialize(classes.select("cid", "vec", "ids").mapInArrow(to_leaf, "cid long, leaf int, vec array<double>, ids array<long>"), "ann-leaves")
    sizes = np.zeros(tree.leaves, dtype=np.int64)
    for r in placed.groupBy("leaf").count().collect():  # a row a leaf, at most as many as the sample has rows
        sizes[r["leaf"]] = r["count"]
    first, number = pack(sizes, BLOCK)
    plan = spark.sparkContext.broadcast((first, number, visits))
    dealt = F.broadcast(spark.createDataFrame([(i, int(f), int(n)) for i, (f, n) in enumerate(zip(first, number, strict=True))], "leaf int, first long, number long"))
    blocks = placed.join(dealt, "leaf").select((F.col("first") + F.pmod(F.xxhash64("cid"), F.col("number"))).alias("block"), "leaf", "cid", "vec", "ids")
    # queries are asked once for each distinct vector
    own = rows.where(F.col("vec_id") % every == 0).withColumn("key", F.xxhash64("vec"))
    named = materialize(classes.select("cid", "vec", F.xxhash64("vec").alias("k")), "ann-named")
    own = materialize(own, "ann-queries")
    asked = materialize(own.join(named, (own["key"] == named["k"]) & (own["vec"] == named["vec"])).select("vec_id", "cid", own["vec"]), "ann-asked")

    def to_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, (first, number, most) = Tree(*held.value), plan.value
        schema = pa.schema([("block", pa.int64()), ("cid", pa.int64()), ("vec", pa.list_(pa.float64())), ("leaves", pa.list_(pa.int64()))])
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for cid, vec in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                asked: dict[int, list[int]] = {}
                for x in tree.visits(np.array(vec) / unit, most):
                    for i in range(int(number[x])):
                        asked.setdefault(int(first[x]) + i, []).append(x)
                for block, leaves in sorted(asked.items()):
                    for col, v in zip(out, (block, cid, vec, leaves), strict=True):
                        col.append(v)
            yield batch(schema, out)

    probes = asked.groupBy("cid", "vec").agg(F.count("*").alias("n")).select("cid", "vec").mapInArrow(to_visits, "block long, cid long, vec array<double>, leaves array<long>")
    schema = pa.schema([("asked", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, its classes first, by leaf, then its queries with the leaves that they visit."""
        now, ids, vecs, place, matrix, waiting = None, [], [], {}, None, []

        def answer() -> pa.RecordBatch:
            nonlocal matrix
            out: list[list] = [[], [], []]
            if ids and waiting:
                if matrix is None:
                    matrix = np.array(vecs, dtype=np.float64)
                q = np.array([v for _, v, _ in waiting], dtype=np.float64)
                small, asks = matrix / unit, q / unit
                rough = np.full((len(q), len(ids)), np.inf)
                visitors: dict[int, list[int]] = {}
                for i, (_, _, leaves) in enumerate(waiting):
                    for leaf in leaves:
                        visitors.setdefault(leaf, []).append(i)
                for leaf, who in visitors.items():
                    lo, hi = place.get(leaf, (0, 0))
                    rough[who, lo:hi] = _squares(asks[who], small[lo:hi])
                scale = 1e-9 * ((small * small).sum(axis=1).max() + (asks * asks).sum(axis=1).max())
                top = min(k + 1, len(ids))
                limit = np.partition(rough, top - 1, axis=1)[:, top - 1] + scale
                for i, (cid, _, _) in enumerate(waiting):
                    near = np.flatnonzero((rough[i] <= limit[i]) & (rough[i] < np.inf))
                    for j, d in zip(near.tolist(), distances(q[i], matrix[near]).tolist(), strict=True):
                        for col, v in zip(out, (cid, ids[j], d), strict=True):
                            col.append(v)
            waiting.clear()
            return batch(schema, out)

        for b in batches:
            for block, asks, leaf, cid, vec, own_ids, leaves in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != now:
                    if waiting:
                        yield answer()
                    now, matrix = block, None
                    for held_ in (ids, vecs, place):
                        held_.clear()
                if asks:
                    waiting.append((cid, vec, leaves))
                    if len(waiting) == QUERIES:
                        yield answer()
                else:
                    place[leaf] = (place.get(leaf, (len(ids),))[0], len(ids) + 1)
                    ids.append(own_ids)
                    vecs.append(vec)
        if waiting:
            yield answer()

    none = lambda kind: F.lit(None).cast(kind)
    both = blocks.select("block", F.lit(False).alias("asks"), "leaf", "cid", "vec", "ids", none("array<long>").alias("leaves"))
    both = both.union(probes.select("block", F.lit(True), none("int"), "cid", "vec", none("array<long>"), "leaves"))
    met = both.repartition(shuffle_width(spark), "block").sortWithinPartitions("block", "asks", "leaf").mapInArrow(meet, "asked long, ids array<long>, score double")
    best = Window.partitionBy("asked").orderBy("score", F.element_at("ids", 1))
    met = materialize(met.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1).groupBy("asked").agg(F.collect_list(F.struct("score", "ids")).alias("found")), "ann-found")
    answers = asked.select("vec_id", "cid").join(met, F.col("cid") == F.col("asked"))
    answers = answers.select(F.col("vec_id").alias("query_id"), F.explode(F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct(f["score"].alias("score"), i.alias("vec_id")))))).alias("c"))
    answers = answers.select("query_id", "c.vec_id", "c.score").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return answers.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
