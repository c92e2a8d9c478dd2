"""Exact k-means over integers by filtering with kd-trees.

Kanungo et al., "An Efficient k-Means Clustering Algorithm: Analysis and Implementation" (2002). Each task packs its vectors
into kd-trees of bounded size, once. A node holds the number of its vectors, their sums and their box. In a round the
candidates of a node are its parent's without those strictly farther from every point of its box than another one; with one
candidate left the node is assigned as a whole, a leaf with more meets its vectors. All sums are of integers, so the
order of tasks changes nothing, and a lost task is done again to the same result. Only centroids and their sums reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, discard, materialize, trim

#: Vectors of a tree, and of a leaf at most.
TREE, LEAF = 8192, 32
#: Components after scaling are smaller: all that is computed from squares of up to 64 components stays within 64 bits.
REACH = 1 << 26
#: Integers up to here are exact in floating point, where products of matrices are fast.
EXACT = 1 << 53


def scaled(table: DataFrame, dim: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, x)``: vectors of ``dim`` finite components, each as ``floor(scale * component)``."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < REACH)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    rows = rows.where((F.size("x") == dim) & F.forall("x", fine))
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("int")).alias("x"))


def depth_of(n: int) -> int:
    """Levels of splits until each leaf has ``LEAF`` points at most."""
    depth = 0
    while n > LEAF << depth:
        depth += 1
    return depth


def spans(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """First and last-but-one point of the nodes of each level: every node is halved."""
    lo, hi = np.array([0]), np.array([n])
    out = [(lo, hi)]
    for _ in range(depth_of(n)):
        mid = (lo + hi) // 2
        lo, hi = np.stack([lo, mid], 1).ravel(), np.stack([mid, hi], 1).ravel()
        out.append((lo, hi))
    return out


def plant(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(order, low, high, sums)`` of a kd-tree: points by leaf, boxes and sums of the nodes level by level. Nodes split at the median of their widest side."""
    order = np.arange(len(x))
    levels = spans(len(x))
    for lo, hi in levels[:-1]:
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            part = x[order[a:b]]
            side = int((part.max(axis=0) - part.min(axis=0)).argmax())
            order[a:b] = order[a:b][np.argpartition(part[:, side], (a + b) // 2 - a)]
    x = x[order]
    low, high, sums = [], [], []
    for lo, _ in levels:  # the nodes of a level follow one another without gaps
        low.append(np.minimum.reduceat(x, lo))
        high.append(np.maximum.reduceat(x, lo))
        sums.append(np.add.reduceat(x.astype(np.int64), lo))
    return order, np.concatenate(low), np.concatenate(high), np.concatenate(sums)


def _product(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The exact matrix product ``x @ y.T``, whose terms' sums do not exceed ``most`` in size."""
    if most < EXACT:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x.astype(np.int64) @ y.T.astype(np.int64)


class Filter:
    """Centroids that trees are filtered by. Of equal ones only the first is a candidate: ties go to it."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.all = centroids.astype(np.int64)
        _, first = np.unique(self.all, axis=0, return_index=True)
        self.number = np.sort(first)
        self.z = self.all[self.number]
        self.norm = (self.z * self.z).sum(axis=1)
        away = self.z[None, :, :] - self.z[:, None, :]  # [best, other]
        self.up, self.down = np.maximum(away, 0), np.minimum(away, 0)
        self.gap = self.norm[None, :] - self.norm[:, None]

    def assign(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, node_done=None) -> np.ndarray:
        """The number of the nearest centroid of each point of a tree, in the tree's order.

        ``node_done(node, centroid)`` is told whole nodes, and then their points have no number here (-1).
        """
        n, dim = x.shape
        k = len(self.z)
        reach = max(int(np.abs(x).max(initial=0)), int(np.abs(self.z).max(initial=0)), 1)
        most = 16 * dim * reach * reach
        label = np.full(n, -1, dtype=np.int64)
        node, open_, first = np.array([0]), np.ones((1, k), dtype=bool), 0
        levels = spans(n)
        far = np.iinfo(np.int64).max
        for at, (lo, hi) in enumerate(levels):
            boxes = first + node
            a, b = low[boxes].astype(np.int64), high[boxes].astype(np.int64)
            # the candidate nearest to the middle of the box, all doubled
            to_middle = np.where(open_, 4 * self.norm - 4 * _product(a + b, self.z, most), far)
            best = to_middle.argmin(axis=1)
            keep = open_.copy()
            for z in np.unique(best):
                rows = np.flatnonzero(best == z)
                # the point of the box that is nearest to the other centroid, as seen from this one
                nearest = _product(b[rows], self.up[z], most) + _product(a[rows], self.down[z], most)
                keep[rows] &= self.gap[z] - 2 * nearest <= 0
                keep[rows, z] = True
            single = keep.sum(axis=1) == 1
            for i in np.flatnonzero(single):
                c = int(self.number[best[i]])
                if node_done is None:
                    label[lo[node[i]] : hi[node[i]]] = c
                else:
                    node_done(int(boxes[i]), int(hi[node[i]] - lo[node[i]]), c)
            node, open_ = node[~single], keep[~single]
            if not len(node):
                break
            if at < len(levels) - 1:
                first += len(lo)
                node, open_ = np.stack([2 * node, 2 * node + 1], 1).ravel(), np.repeat(open_, 2, axis=0)
                continue
            own = np.concatenate([np.arange(lo[i], hi[i]) for i in node])
            mask = np.repeat(open_, (hi - lo)[node], axis=0)
            d = np.where(mask, self.norm - 2 * _product(x[own], self.z, most), far)
            label[own] = self.number[d.argmin(axis=1)]
        return label


def _trees(rows: DataFrame, dim: int) -> DataFrame:
    """``(ids, x, low, high, sums)``: a row a tree, arrays as bytes; each task packs what it reads."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("x", "low", "high", "sums")]])

    def row(ids: list, x: np.ndarray) -> pa.RecordBatch:
        order, low, high, sums = plant(x)
        return batch(schema, [[[ids[i] for i in order]], *[[np.ascontiguousarray(c).tobytes()] for c in (x[order], low, high, sums)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []
        for b in batches:
            own = b.column(0).to_pylist()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(b.num_rows, dim)
            at = 0
            while at < b.num_rows:
                n = min(TREE - len(ids), b.num_rows - at)
                ids += own[at : at + n]
                held.append(x[at : at + n])
                at += n
                if len(ids) == TREE:
                    yield row(ids, np.concatenate(held))
                    ids, held = [], []
        if ids:
            yield row(ids, np.concatenate(held))
        trim()

    return rows.mapInArrow(run, "ids array<long>, x binary, low binary, high binary, sums binary")


def _points(data: bytes, kind: type, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype=kind).reshape(-1, dim)


def _round(trees: DataFrame, centroids: np.ndarray, dim: int) -> list[tuple[int, list[int]]]:
    """``(number of vectors, sums)`` of each centroid, exact."""
    held = trees.sparkSession.sparkContext.broadcast(centroids)
    k = len(centroids)
    schema = pa.schema([("cluster", pa.int32()), ("at", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(held.value)
        total = np.zeros((k, dim + 1), dtype=np.int64)
        for b in batches:
            for x, low, high, sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, low, high, sums = _points(x, np.int32, dim), _points(low, np.int32, dim), _points(high, np.int32, dim), _points(sums, np.int64, dim)

                def whole(node: int, n: int, c: int, sums: np.ndarray = sums) -> None:
                    total[c, :dim] += sums[node]
                    total[c, dim] += n

                label = own.assign(x, low, high, whole)
                open_ = label >= 0
                for c in np.unique(label[open_]):
                    total[c, :dim] += x[label == c].sum(axis=0, dtype=np.int64)
                    total[c, dim] += int((label == c).sum())
        used = np.flatnonzero(total[:, dim])
        yield batch(schema, [np.repeat(used, dim + 1).astype(np.int32), np.tile(np.arange(dim + 1), len(used)).astype(np.int32), total[used].ravel()])
        trim()

    parts = trees.select("x", "low", "high", "sums").mapInArrow(run, "cluster int, at int, n long")
    out = [(0, [0] * dim) for _ in range(k)]
    whole: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():  # a row for each component of a centroid
        whole.setdefault(r["cluster"], [0] * (dim + 1))[r["at"]] = int(r["n"])
    for c, v in whole.items():
        out[c] = (v[dim], v[:dim])
    return out


def _labels(trees: DataFrame, centroids: np.ndarray, dim: int) -> DataFrame:
    held = trees.sparkSession.sparkContext.broadcast(centroids)
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(held.value)
        for b in batches:
            for ids, x, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = _points(x, np.int32, dim)
                label = own.assign(x, _points(low, np.int32, dim), _points(high, np.int32, dim))
                away = x.astype(np.int64) - own.all[label]
                yield batch(schema, [ids, label.astype(np.int32), (away * away).sum(axis=1)])
        trim()

    return trees.select("ids", "x", "low", "high").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(table: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of each vector kept.

    Kept are vectors with ``dim`` components (64 at most), none null or not finite, each turned into ``floor(scale * component)``. A vector with
    a component of 2^26 or more in size after scaling takes no part: its squared distances would not fit into 64 bits. The centroids start as the ``k`` kept
    vectors with the smallest SHA-256 of ``seed:id``, in that order; equal ids go by their vectors, null ids come last. ``rounds`` times each
    vector goes to the nearest centroid (squared distance, ties to the smaller number) and each centroid that has vectors becomes the
    floor of their mean; at last vectors are assigned once more. With fewer than ``k`` vectors there are fewer
    centroids. Rows that repeat are vectors of their own. A sum of distances beyond 64 bits is null. Other columns are not read. An empty table gives no rows.
    """
    spark = table.sparkSession
    rows = scaled(table, dim, scale, id_col, vec_col)
    first = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    drawn = first.orderBy(F.asc_nulls_last("h"), "x").select("x").limit(k).collect()
    centroids = np.array([r["x"] for r in drawn], dtype=np.int64).reshape(len(drawn), dim)
    trees = materialize(_trees(rows, dim), "kd-trees")
    for _ in range(rounds if len(drawn) else 0):
        for c, (n, sums) in enumerate(_round(trees, centroids, dim)):
            if n:
                centroids[c] = [s // n for s in sums]
    labels = materialize(_labels(trees, centroids, dim), "kd-labels")
    discard(trees)
    named = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())], "c int, centroid_sha256 string")
    inertia = labels.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    inertia = inertia.select(F.col("cluster").alias("own"), "cluster_inertia").join(F.broadcast(named), F.col("own") == F.col("c"))  # a row a centroid
    whole = labels.agg(F.try_sum("distance").alias("inertia"))
    inertia = materialize(inertia.select("own", "cluster_inertia", "centroid_sha256"), "kd-inertia")
    total = whole.first()["inertia"]
    out = labels.join(F.broadcast(inertia), F.col("cluster") == F.col("own"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")


def oracle_sql(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same in SQL over ``embeddings``, without repeated ids among the first centroids."""
    near = "select vec_id, v, arg_min(c, (d, c)) as c, min(d) as d from (select n.vec_id, n.v, n.row, z.c, list_sum(list_transform(range(1, {dim} + 1), lambda i: (n.v[i] - z.v[i]) * (n.v[i] - z.v[i]))) as d from n, {z} z) group by vec_id, v, row"
    steps = [
        "n as (select vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v, row_number() over () as row from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: isfinite(x))) = {dim})",
        "z0 as (select cast(row_number() over (order by sha256(concat('{seed}:', vec_id))) - 1 as integer) as c, v from n qualify c < {k})",
    ]
    for r in range(rounds):
        steps.append(f"a{r} as ({near.replace('{z}', f'z{r}')})")
        steps.append(f"m{r} as (select c, list(m order by i) as v from (select c, i, cast(floor(sum(x) / count(*)) as bigint) as m from (select c, unnest(v) as x, unnest(range(1, {{dim}} + 1)) as i from a{r}) group by c, i) group by c)")
        steps.append(f"z{r + 1} as (select z.c, coalesce(m.v, z.v) as v from z{r} z left join m{r} m on z.c = m.c)")
    steps.append(f"a as ({near.replace('{z}', f'z{rounds}')})")
    text = "with " + ",\n".join(steps) + f"\nselect a.vec_id, a.c as cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia, sha256(array_to_string(z.v, ',')) as centroid_sha256 from a join z{rounds} z on a.c = z.c"
    return text.replace("{dim}", str(dim)).replace("{scale}", str(scale)).replace("{seed}", str(seed)).replace("{k}", str(k))
