"""Approximate nearest neighbours by a hierarchical k-means tree (operator 7).

The tree is fitted on a bounded sample, every row is put into a leaf, and each query goes through
the tree best bin first: a priority queue holds unvisited branches by distance and gives leaves in
the order of their promise. How many leaves a query visits is widened until queries whose true
neighbours are known (by brute force over all rows, in blocks) find the wanted share of them.

Neighbouring leaves form a bundle. Its rows, and queries that visit any of its leaves, are dealt into
blocks of bounded size, so a vector shared by any part of the rows makes more blocks, not a larger
task; a query's finds are cut to k in each block before they are shuffled. Scores are double-precision cosines of
the original vectors. Equal vectors tie and go by id; a block keeps the k+1 smallest ids of equal
vectors, which cannot lose a neighbour.

Defined cases: null, zero, non-finite or null-holding vectors, null ids, and vectors of another
length than the commonest take no part; rows that share an id count once, with their best score;
with fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import hash_sample, materialise, row_count

SAMPLE = 20_000
#: Rows of the sample for a leaf, at the least: more rows make larger leaves then, searched in more blocks.
LEAST_SAMPLE = 5
BRANCH = 8
LEAF_ROWS = 160
CALIBRATION = 160
RECALL = 0.95
BLOCK = 4096
#: Leaves that follow each other in the tree are searched together: a bundle for so many rows, 64 at least.
BUNDLE_ROWS, BUNDLES = 100_000, 64


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Tree:
    """Nodes with their centres; a node without children is a leaf."""

    def __init__(self, sample: np.ndarray, leaves: int, branch: int = BRANCH):
        self.children: list[list[int]] = []
        self.centres: list[np.ndarray] = []
        self.leaf_of: dict[int, int] = {}
        rng = np.random.Generator(np.random.PCG64(7))
        self._grow(_unit(sample), max(1, len(sample) // max(1, leaves)), branch, rng)

    def _grow(self, x: np.ndarray, least: int, branch: int, rng) -> int:
        node = len(self.children)
        self.children.append([])
        self.centres.append(np.zeros((0, x.shape[1] if x.ndim == 2 else 0)))
        kinds = len(np.unique(x, axis=0)) if len(x) > least else 1
        if kinds < 2:
            self.leaf_of[node] = len(self.leaf_of)
            return node
        centres, parts = _k_means(x, min(branch, kinds), rng)
        if len(parts) < 2:
            self.leaf_of[node] = len(self.leaf_of)
            return node
        self.centres[node] = centres
        self.children[node] = [self._grow(p, least, branch, rng) for p in parts]
        return node

    @property
    def n_leaves(self) -> int:
        return len(self.leaf_of)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of unit vectors: the nearest child, down from the root."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf_of[node]
                continue
            nearest = np.argmax(x[rows] @ self.centres[node].T, axis=1)
            todo += [(child, rows[nearest == i]) for i, child in enumerate(self.children[node]) if (nearest == i).any()]
        return out

    def best_bins(self, q: np.ndarray, visits: int | None = None) -> list[int]:
        """Leaves in best-bin-first order, ``visits`` of them (all, if None)."""
        out: list[int] = []
        queue = [(-1.0, 0)]
        while queue and (visits is None or len(out) < visits):
            _, node = heapq.heappop(queue)
            while self.children[node]:
                near = self.centres[node] @ q
                best = int(np.argmax(near))
                for i, child in enumerate(self.children[node]):
                    if i != best:
                        heapq.heappush(queue, (-float(near[i]), child))
                node = self.children[node][best]
            out.append(self.leaf_of[node])
        return out


def _k_means(x: np.ndarray, k: int, rng, rounds: int = 8) -> tuple[np.ndarray, list[np.ndarray]]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        full = [i for i in range(len(centres)) if (near == i).any()]
        centres = _unit(np.array([x[near == i].mean(0) for i in full]))
    near = np.argmax(x @ centres.T, axis=1)
    full = [i for i in range(len(centres)) if (near == i).any()]
    return centres[full], [x[near == i] for i in full]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (array<double>) of the rows that take part."""
    whole = F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(whole & ~bad)
    rows = rows.where(F.exists("embedding", lambda v: v != 0))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (sizes["d"] if sizes else 0)).withColumnRenamed("embedding", "vec")


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of paired rows; each depends on its two vectors alone, not on their neighbours."""
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def _first(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"])
    return found.groupby("query_id", sort=False).head(k)


def block_top(q_ids, q, v_ids, x, k: int) -> pd.DataFrame:
    """The k nearest rows of a block for every query of a block, own ids left out."""
    order = np.argsort(v_ids, kind="stable")
    v_ids, x = v_ids[order], np.ascontiguousarray(x[order])
    _, kind = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    by = np.lexsort((v_ids, kind))
    fresh = np.concatenate([[True], (kind[by][1:] != kind[by][:-1]) | (v_ids[by][1:] != v_ids[by][:-1])])
    by = by[fresh]
    start = np.concatenate([[True], kind[by][1:] != kind[by][:-1]])
    nth = np.arange(len(by)) - np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))
    keep = np.sort(by[nth <= k])
    v_ids, x = v_ids[keep], x[keep]
    near = _unit(q) @ _unit(x).T
    near[q_ids[:, None] == v_ids[None, :]] = -np.inf
    floor = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(q), -np.inf)
    i, j = np.nonzero((near >= floor[:, None] - 1e-9) & np.isfinite(near))
    out = pd.DataFrame({"query_id": q_ids[i], "vec_id": v_ids[j], "score": _scores(q[i], x[j])})
    return _first(out, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's finds: at most k rows from each block that it visited."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Exact neighbours of a bounded block of queries, against all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches):
        ids, q = shared.value
        for b in batches:
            if len(b):
                v, x = b.column(0).to_numpy(), _matrix(b.column(1))
                for s in range(0, len(v), BLOCK):
                    yield pa.RecordBatch.from_pandas(block_top(ids, q, v[s : s + BLOCK], x[s : s + BLOCK], k), preserve_index=False)

    return _best(rows.mapInArrow(run, "query_id long, vec_id long, score double"), k)


class Index:
    """A fitted tree, every row in its leaf (a written table), and the calibrated width."""

    def __init__(self, vectors: DataFrame, is_query, k: int = 5, recall: float = RECALL):
        self.k = k
        rows = usable(vectors)
        sample = sorted(hash_sample(rows, SAMPLE, "vec_id").collect())
        self.empty = not sample
        if self.empty:
            self.rows = rows
            return
        self.n = n = row_count(rows)
        self.tree = Tree(np.array([r.vec for r in sample]), max(1, min(len(sample) // LEAST_SAMPLE, n // LEAF_ROWS)))
        shared = rows.sparkSession.sparkContext.broadcast(self.tree)

        def put(batches):
            for b in batches:
                if len(b):
                    leaf = shared.value.assign(_unit(_matrix(b.column(1))))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], ["vec_id", "vec", "leaf"])

        self.shared = shared
        self.rows = materialise(rows.mapInArrow(put, "vec_id long, vec array<double>, leaf int"))
        self.queries = self.rows.where(is_query)
        self.visits, self.calibrated = self._calibrate(recall)

    def _calibrate(self, recall: float) -> tuple[int, float]:
        known = sorted(hash_sample(self.queries, CALIBRATION, "vec_id").collect())
        if not known:
            return 1, 1.0
        ids, q = np.array([r.vec_id for r in known]), np.array([r.vec for r in known])
        true = brute_force(self.rows.select("vec_id", "vec"), ids, q, self.k)
        leaves = true.join(self.rows.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()
        order = {i: {leaf: n for n, leaf in enumerate(self.tree.best_bins(x))} for i, x in zip(ids, _unit(q), strict=True)}
        depth = np.sort([order[r.query_id][r.leaf] for r in leaves]) + 1
        if not len(depth):
            return self.tree.n_leaves, 1.0
        visits = 1
        while (found := float((depth <= visits).mean())) < recall and visits < self.tree.n_leaves:
            visits = min(self.tree.n_leaves, visits + max(1, visits // 4))
        return visits, found

    def search(self) -> DataFrame:
        """query_id, rank, vec_id, score: the k nearest found of every query."""
        if self.empty:
            return self.rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        shared, visits, k = self.shared, self.visits, self.k

        per = max(1, -(-self.tree.n_leaves // max(BUNDLES, self.n // BUNDLE_ROWS)))

        def bins(batches):
            for b in batches:
                if len(b):
                    ids, x = b.column(0), _unit(_matrix(b.column(1)))
                    rows, bundles, leaves = [], [], []
                    for i, q in enumerate(x):
                        found = np.sort(np.array(shared.value.best_bins(q, visits), np.int32))
                        kinds, first = np.unique(found // per, return_index=True)
                        rows += [i] * len(kinds)
                        bundles.append(kinds)
                        leaves += np.split(found, first[1:])
                    columns = [ids.take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(np.concatenate(bundles).astype(np.int32)), pa.array(leaves, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "q", "bundle", "leaves"])

        asked = materialise(self.queries.select("vec_id", "vec").mapInArrow(bins, "query_id long, q array<double>, bundle int, leaves array<int>"))
        held = self.rows.withColumn("bundle", F.floor(F.col("leaf") / F.lit(per)).cast("int"))
        # one row per bundle, of which the tree's leaves are the bound: how many blocks each side is cut into
        cut = lambda df, name: df.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias(name))
        blocks = F.broadcast(materialise(cut(held, "nv").join(cut(asked, "nq"), "bundle")))
        salt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(blocks, "bundle").withColumn("bq", salt("query_id", "nq")).withColumn("bv", spread("nv"))
        right = held.join(blocks, "bundle").withColumn("bv", salt("vec_id", "nv")).withColumn("bq", spread("nq"))

        def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            """Leaf by leaf, the queries that visit it; k finds of each query leave the block."""
            found = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
            if len(a) and len(b):
                asks, visited = np.repeat(np.arange(len(a)), a.leaves.map(len)), np.concatenate(a.leaves.to_numpy())
                q_ids, q, v_ids, x, own = a.query_id.to_numpy(), np.stack(a.q.to_numpy()), b.vec_id.to_numpy(), np.stack(b.vec.to_numpy()), b.leaf.to_numpy()
                for leaf in np.unique(own):
                    ask, rows = asks[visited == leaf], own == leaf
                    if len(ask):
                        found.append(block_top(q_ids[ask], q[ask], v_ids[rows], x[rows], k))
            return _first(pd.concat(found[1:] or found), k)

        key = ["bundle", "bq", "bv"]
        found = left.select(*key, "query_id", "q", "leaves").groupBy(*key).cogroup(right.select(*key, "vec_id", "vec", "leaf").groupBy(*key)).applyInPandas(match, "query_id long, vec_id long, score double")
        return _best(found, k)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = RECALL) -> DataFrame:
    """The k nearest rows of each row whose id is divisible by ``every``."""
    return Index(vectors, F.col("vec_id") % every == 0, k, recall).search()
