"""Nearest neighbours by forests of random-projection trees.

Rows are dealt into cells of bounded size by hash of their id. Each cell has a
forest of its own over all its rows: a tree halves its rows again and again at
the median of their projections on a direction, drawn at random and then bent
towards the rows' spread by two power steps. A query takes leaves from all trees
of a cell through one shared priority queue, nearest region first, as many as the
budget says. The vectors of its leaves, each once, are scored exactly.

A region's distance never falls on the way down and one child has its parent's.
So the nearest L leaves have no ancestor that isn't among the nearest L nodes of
its level: the queue is worked off level by level for many queries at once, with
L places for each query, and gives the leaves it would give one by one.

The largest inner product is sought. Vectors get one more component that brings
all of them to the largest norm of the cell, which makes it the smallest distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a node that its direction is bent by, at most.
SPREAD_ROWS = 64


@dataclass(frozen=True)
class Settings:
    """``leaf``: rows of a leaf at most; ``cell_bytes``: of a cell's vectors; a query's leaves hold ``factor * n ** power`` of a cell's n vectors, one met twice counted twice; up to ``whole`` vectors are searched whole; ``part``: queries of a cell that one task answers where cells are few, ``tasks`` in all."""

    trees: int = 32
    leaf: int = 32
    factor: float = 5.5
    power: float = 0.74
    whole: int = 512
    cell_bytes: int = 64 << 20
    part: int = 1024
    tasks: int = 16
    seed: int = 5

    def leaves(self, n: int, depth: int) -> int:
        """Leaves that a query takes among ``n`` vectors."""
        size = max(1, n >> depth)
        return max(1, min(self.trees << depth, int(self.factor * n**self.power / size) + 1))


class Tree:
    """A balanced tree: node j of level l holds ``order[edges(l)[j]:edges(l)[j + 1]]``, its plane ``planes[l][j]`` is cut at ``cuts[l][j]``."""

    def __init__(self, points: np.ndarray, leaf: int, rng: np.random.Generator):
        n, reach = len(points), 2.5 * float(np.linalg.norm(points[0]))
        self.depth = 0
        while n > leaf << self.depth:
            self.depth += 1
        self.order = np.arange(n, dtype=np.int32)
        self.planes, self.cuts = [], []
        for level in range(self.depth):
            edges = self.edges(level)
            sizes = np.diff(edges)
            planes = self._directions(points, edges, sizes, rng)
            along = np.empty(n, np.float32)
            if level < 9:
                for a, z, plane in zip(edges, edges[1:], planes):
                    along[a:z] = points[self.order[a:z]] @ plane
            else:
                along = np.einsum("nd,nd->n", points[self.order], np.repeat(planes, sizes, axis=0))
            # all points have the same norm, so this sorts within each node
            ranked = np.argsort(np.repeat(np.arange(len(sizes)), sizes) + (along / reach).astype(np.float64))
            self.order, along = self.order[ranked], along[ranked]
            middle = self.edges(level + 1)[1::2]
            self.planes.append(planes)
            self.cuts.append((along[middle - 1] + along[middle]) / 2)
        self.leaves = self.edges(self.depth)

    def edges(self, level: int) -> np.ndarray:
        return len(self.order) * np.arange((1 << level) + 1, dtype=np.int64) >> level

    def _directions(self, points: np.ndarray, edges: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        some = min(SPREAD_ROWS, int(sizes.max()))
        at = edges[:-1, None] + (rng.random((len(sizes), some)) * sizes[:, None]).astype(np.int64)
        rows = points[self.order[at]]
        rows = rows - rows.mean(axis=1, keepdims=True)
        out = rng.normal(size=(len(sizes), points.shape[1])).astype(points.dtype)
        for _ in range(2):
            bent = np.matmul(rows.transpose(0, 2, 1), np.matmul(rows, out[:, :, None]))[:, :, 0]
            size = np.linalg.norm(bent, axis=1, keepdims=True)
            out = np.where(size > 1e-12, bent / np.maximum(size, 1e-12), out)
        return out / np.linalg.norm(out, axis=1, keepdims=True)


#: Queries that go through the trees, and through the scoring, together.
ABREAST, SCORED = 64, 256


class Cell:
    """Some rows' different vectors, their ids, and a forest over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, settings: Settings):
        whole = np.ascontiguousarray(vectors)
        _, first, back = np.unique(whole.view(np.dtype((np.void, whole.dtype.itemsize * whole.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.vectors, self.settings = whole[first], settings
        order = np.lexsort((ids, back))
        self.ids, self.bounds = ids[order], np.append(0, np.cumsum(np.bincount(back)))
        # geometry and rough scores are scaled to components of one at most: none can overflow
        self.scale = float(np.abs(self.vectors).max())
        scaled = self.vectors / self.scale
        squares = (scaled * scaled).sum(axis=1)
        self.norm = float(np.sqrt(squares.max()))
        self.rough = scaled.astype(np.float32)
        self.planes_met = self.vectors_met = self.queries = 0
        self.trees: list[Tree] = []
        if len(self.vectors) > settings.whole:
            points = np.hstack([scaled, np.sqrt(np.maximum(0, squares.max() - squares))[:, None]]).astype(np.float32)
            rng = np.random.default_rng(settings.seed)
            self.trees = [Tree(points, settings.leaf, rng) for _ in range(settings.trees)]
            self.depth = self.trees[0].depth
            self.planes = [np.concatenate([t.planes[level] for t in self.trees]) for level in range(self.depth)]
            self.cuts = [np.concatenate([t.cuts[level] for t in self.trees]) for level in range(self.depth)]
            self.order = np.stack([t.order for t in self.trees])
            self.edges = self.trees[0].edges(self.depth)

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """For each query point the leaves that the shared queue gives, numbered through all trees."""
        places = self.settings.leaves(len(self.vectors), self.depth)
        node = np.broadcast_to(np.arange(len(self.trees)), (len(points), len(self.trees)))
        reach = np.zeros(node.shape, np.float32)
        for level in range(self.depth):
            self.planes_met += node.size
            if node.shape[1] == len(self.planes[level]):  # all nodes of the level, in order
                gap = points @ self.planes[level].T - self.cuts[level]
            else:
                gap = np.matmul(self.planes[level][node], points[:, :, None])[:, :, 0] - self.cuts[level][node]
            low, high = np.maximum(reach, gap), np.maximum(reach, -gap)
            reach = np.stack([low, high], axis=2).reshape(len(points), -1)
            node = np.stack([2 * node, 2 * node + 1], axis=2).reshape(len(points), -1)
            if node.shape[1] > places:
                near = np.argpartition(reach, places - 1, axis=1)[:, :places]
                reach, node = np.take_along_axis(reach, near, 1), np.take_along_axis(node, near, 1)
        return node

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """Matrix of which vectors each query meets in its leaves."""
        met = np.zeros((len(queries), len(self.vectors)), bool)
        if not self.trees:
            met[:] = True
            return met
        points = np.hstack([queries / self.scale, np.zeros((len(queries), 1))]).astype(np.float32)
        width = int(np.diff(self.edges).max())
        for a in range(0, len(points), ABREAST):
            leaf = self.leaves(points[a : a + ABREAST])
            tree, at = leaf >> self.depth, leaf & (1 << self.depth) - 1
            inside = np.minimum(self.edges[at][:, :, None] + np.arange(width), self.edges[at + 1][:, :, None] - 1)
            rows = self.order[tree[:, :, None], inside]
            met[np.arange(a, a + len(leaf))[:, None], rows.reshape(len(leaf), -1)] = True
        return met

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids, scores) of the k best rows met whose id isn't its own, best first, ties to the smaller id."""
        for a in range(0, len(queries), SCORED):
            some = queries[a : a + SCORED]
            met = self.candidates(some)
            for query, mine, who in zip(some, met, own[a : a + SCORED].tolist()):
                at = np.flatnonzero(mine)
                scaled = query / self.scale
                rough = self.rough[at] @ scaled.astype(np.float32)
                slack = 3e-7 * len(query) * self.norm * float(np.linalg.norm(scaled)) + 1e-30
                if len(at) > k + 1:  # one of k + 1 vectors may be the query's own only
                    at = at[rough >= np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1] - 2 * slack]
                self.queries += 1
                self.vectors_met += len(rough)
                yield self._rows(at, exact_scores(query, self.vectors[at]), who, k)

    def _rows(self, at: np.ndarray, score: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(at) > k + 1:  # one of k + 1 vectors may be the query's own only
            least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            at, score = at[score >= least], score[score >= least]
        sizes = np.minimum(self.bounds[at + 1] - self.bounds[at], 4 * k + 4)
        places = np.concatenate([np.arange(a, a + n) for a, n in zip(self.bounds[at], sizes)])
        ids, score = self.ids[places], np.repeat(score, sizes)
        ids, score = ids[ids != own], score[ids != own]
        order = np.lexsort((ids, -score))
        ids, score = ids[order], score[order]
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first)[:k]
        return ids[first], score[first]


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed component by component: equal vectors score equally."""
    total = np.zeros(len(vectors))
    for d in range(len(query)):
        total += query[d] * vectors[:, d]
    return total


def usable(vectors: Column) -> Column:
    """Whether a vector takes part: no null, all components finite, not zero."""
    fine = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vectors.isNotNull() & fine & F.exists(vectors, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries_every: int = 20, k: int = 20, settings: Settings | None = None) -> DataFrame:
    """For each row whose vec_id is divisible by ``queries_every`` its ``k`` nearest other rows found.

    Returns query_id, rank (from 1), vec_id, score: the inner product in double
    precision, nearest first, ties to the smaller vec_id. Rows with a null id or
    with a vector that is null, zero or not finite take no part. Vectors of
    different lengths have no inner product and aren't candidates of each other.
    Repeated ids count once, with their best score. An empty table gives no
    rows; other columns are ignored.

    Rows go to cells of ``settings.cell_bytes`` by hash of their id, so that no
    vector, however frequent, overfills one; queries go to every cell. Nothing
    but two counts comes to the driver. Where cells are few, a cell's queries are
    dealt to several tasks, each of which builds its forest.
    """
    own = settings or Settings()
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    base = base.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    asks = F.pmod("vec_id", F.lit(queries_every)) == 0
    held, asked = (int(x or 0) for x in base.agg(F.sum(F.size("v").cast("long") * 8), F.sum(F.when(asks, 1).otherwise(0))).first())
    cells = max(1, -(-held // own.cell_bytes))
    parts = max(1, min(-(-asked // own.part), own.tasks // cells))
    hashed = F.xxhash64("vec_id")
    rows = base.select(F.pmod(hashed, F.lit(cells)).cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("role"), "vec_id", "v")
    queries = base.where(asks).select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.pmod(F.shiftright(hashed, 20), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("role"), "vec_id", "v")
    keys = ["cell", "part", "size"]
    dealt = rows.union(queries).withColumn("size", F.size("v")).select(*keys, "role", "vec_id", "v")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: of each cell and length its vectors, then the queries."""
        at, ids, flat, cell = None, [], [], None
        for b in batches:
            heads = list(zip(*(b.column(i).to_pylist() for i in range(4))))
            numbers = b.column(4).to_numpy()
            edges = [0, *(i for i in range(1, len(heads)) if heads[i] != heads[i - 1]), len(heads)]
            out: list[tuple] = []
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                *key, role = heads[a]
                some = np.asarray(b.column(5).slice(a, z - a).flatten()).reshape(z - a, key[2])
                if key != at:
                    at, ids, flat, cell = key, [], [], None
                if role == 0:
                    ids.append(numbers[a:z])
                    flat.append(some)
                    continue
                if cell is None:
                    if not ids:
                        continue
                    cell = Cell(np.concatenate(ids), np.concatenate(flat), own)
                for number, (near, scores) in zip(numbers[a:z].tolist(), cell.nearest(some, numbers[a:z], k)):
                    out.append((np.full(len(near), number), near, scores))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    n_tasks = max(cells * parts, 1)
    sorted_rows = dealt.repartition(n_tasks, "cell", "part").sortWithinPartitions(*keys, "role")
    scored = sorted_rows.mapInArrow(score, "query_id long, vec_id long, score double")
    each = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
