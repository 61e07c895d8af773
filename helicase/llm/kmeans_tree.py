"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row of the table is then put into a leaf. A query walks the tree best bin
first: a priority queue holds nodes by the inner product of query and centre, the best one is taken out, and either it is a
leaf, which is visited next, or its children are put in. How many leaves a query visits is found by widening that number
until a calibration set, whose true neighbours are known from all rows, reaches the recall asked for.

Rows are stored in order of their leaves, in bounded tiles; queries meet all tiles that hold one of their leaves, and score
the rows of these leaves only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helicase.llm import tiles
from helicase.llm.common import ship, staged

ship(__name__)

#: Rows the tree is fitted on (about), children of a node, and sample rows in a leaf at most.
FIT_ROWS, BRANCHES, LEAF_ROWS = 20_000, 8, 64
#: Rows of a tile of candidates and of a tile of queries.
TILE, QUERIES = 8192, 4096
#: Calibration queries (about), and more results kept than asked for while scores come from matrix products, whose last bits may differ.
CALIBRATION, SPARE = 256, 8


@dataclass
class Tree:
    centres: np.ndarray
    children: list[list[int]]  # none for a leaf
    leaf: np.ndarray  # a leaf's number, else -1

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the tree to the nearest centre."""
        at = np.zeros(len(x), np.int64)
        open_rows = np.flatnonzero(self.leaf[at] < 0)
        while len(open_rows):
            for node in np.unique(at[open_rows]):
                own = open_rows[at[open_rows] == node]
                kids = np.array(self.children[node])
                at[own] = kids[_nearest(x[own], self.centres[kids])]
            open_rows = open_rows[self.leaf[at[open_rows]] < 0]
        return self.leaf[at]

    def order(self, q: np.ndarray) -> Iterator[Iterator[int]]:
        """For each query its leaves, best bin first."""
        for s in q @ self.centres.T:
            yield self._walk(s.tolist())

    def _walk(self, s: list[float]) -> Iterator[int]:
        queue = [(-s[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield int(self.leaf[node])
            for kid in self.children[node]:
                heapq.heappush(queue, (-s[kid], kid))

    def visits(self, q: np.ndarray, n: int, rows: int, sizes: np.ndarray) -> np.ndarray:
        """Mask of the first n leaves of each query, and of more until they hold `rows` rows."""
        out = np.zeros((len(q), self.n_leaves), bool)
        for i, walk in enumerate(self.order(q)):
            there = 0
            for at, leaf in enumerate(walk):
                if at >= n and there >= rows:
                    break
                out[i, leaf] = True
                there += sizes[leaf]
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)


def fit(sample: np.ndarray, rounds: int = 8) -> Tree:
    """A tree over the sample's rows by k-means at every node; the same rows give the same tree."""
    centres, children, leaf = [], [], []
    todo = [(np.arange(len(sample)), -1)]
    n_leaves = 0
    for own, parent in todo:
        node = len(centres)
        x = sample[own]
        centres.append(x.mean(0) if len(x) else np.zeros(sample.shape[1]))
        children.append([])
        if parent >= 0:
            children[parent].append(node)
        groups = []
        if len(x) > LEAF_ROWS:
            c = x[np.linspace(0, len(x) - 1, BRANCHES).astype(int)]
            for _ in range(rounds):
                near = _nearest(x, c)
                c = np.stack([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
            near = _nearest(x, c)
            groups = [own[near == k] for k in range(len(c)) if (near == k).any()]
        if len(groups) > 1:
            leaf.append(-1)
            todo += [(g, node) for g in groups]
        else:  # few rows, or all alike
            leaf.append(n_leaves)
            n_leaves += 1
    return Tree(np.stack(centres), children, np.array(leaf))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, each summed in the same order."""
    return (q * x).sum(1)


def _search(k: int):
    """Neighbours of each query (id, key, v, leaves) among the rows (id, v, leaf) of a tile."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query": [], "key": [], "id": [], "leaf": [], "score": []}
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            x, ids, of_leaf = tiles.matrix(right["v"]), right["id"].to_numpy(), right["leaf"].to_numpy()
            q, query, key = tiles.matrix(left["v"]), left["id"].to_numpy(), left["key"].to_numpy()
            visits = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for b in left["leaves"].to_pylist()]).astype(bool)
            _, one, same = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{8 * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
            columns = [(leaf, np.flatnonzero(of_leaf == leaf)) for leaf in np.unique(of_leaf)]
            for at in tiles.steps(len(q), len(x)):
                s = np.full((len(q[at]), len(x)), -np.inf)
                for leaf, own in columns:
                    asked = np.flatnonzero(visits[at, leaf])
                    if len(asked):
                        distinct, back = np.unique(same[own], return_inverse=True)  # equal vectors get equal scores
                        s[np.ix_(asked, own)] = (q[at][asked] @ x[one[distinct]].T)[:, back]
                s[query[at][:, None] == ids[None]] = -np.inf
                r, c = np.nonzero(tiles.first(s, k + SPARE))
                exact = _exact(q[at][r], x[c])
                best = np.lexsort((ids[c], -exact, r))
                r, c, exact = r[best], c[best], exact[best]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                found["query"].append(query[at][r][keep])
                found["key"].append(key[at][r][keep])
                found["id"].append(ids[c][keep])
                found["leaf"].append(of_leaf[c][keep])
                found["score"].append(exact[keep])
        kinds = {"query": pa.int64(), "key": pa.int64(), "id": pa.int64(), "leaf": pa.int32(), "score": pa.float64()}
        return pa.table({c: pa.array(np.concatenate(v) if v else [], kinds[c]) for c, v in found.items()})

    return run


FOUND = "query bigint, key bigint, id bigint, leaf int, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query", "key").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _asking(rows: DataFrame, tree: Tree, n: int, least: int, sizes: np.ndarray) -> DataFrame:
    """Queries with the mask of the leaves they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in tiles.steps(b.num_rows, 1 << 10):
                part = b.slice(at.start, at.stop - at.start)
                q = tiles.matrix(part.column("v"), tree.centres.shape[1])
                mask = tree.visits(q, n, least, sizes)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), part.column("v"), pa.array([m.tobytes() for m in np.packbits(mask, axis=1)], pa.binary())], ["id", "key", "v", "leaves"])

    return rows.select("id", "key", "v").mapInArrow(run, "id bigint, key bigint, v array<double>, leaves binary")


class Index:
    """A tree and all rows of a table in its leaves.

    `rows` has id and vector. Rows with a null id, and vectors that are null, zero or hold a null or non-finite component, are left
    out; repeated rows count once; shorter vectors end in zeros. The tree depends on the rows only, not on their order or files.
    """

    def __init__(self, rows: DataFrame):
        good = F.col("id").isNotNull() & tiles.valid("vector") & F.exists("vector", lambda x: x != 0)
        rows = rows.filter(good).dropDuplicates(["id", "vector"])
        v = F.transform("vector", lambda x: x.cast("double"))
        self.rows = staged(rows.select(F.col("id").cast("bigint").alias("id"), F.xxhash64("id", "vector").alias("key"), v.alias("v")), "ann-rows")
        facts = self.rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
        self.n, self.width = facts["n"], max(facts["width"] or 0, 1)
        self.tree = fit(tiles.matrix(self._sample(FIT_ROWS, 0)["v"], self.width))
        tree = self.tree

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in tiles.steps(b.num_rows, 512):
                    part = b.slice(at.start, at.stop - at.start)
                    x = tiles.matrix(part.column("v"), tree.centres.shape[1])
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), tiles.lists(x, pa.float64()), pa.array(tree.leaves_of(x), pa.int32())], ["id", "key", "v", "leaf"])

        leaves = staged(self.rows.mapInArrow(run, "id bigint, key bigint, v array<double>, leaf int"), "ann-leaves")
        self.tiles = tiles.dealt(leaves, TILE, "leaf", "id", "key")
        held = self.tiles.groupBy("leaf").count().toArrow()
        self.sizes = np.zeros(tree.n_leaves, np.int64)
        self.sizes[held["leaf"].to_numpy()] = held["count"].to_numpy()
        self.copies = self.rows.groupBy("id").count().agg(F.max("count")).first()[0] or 0  # rows of one id

    def _sample(self, size: int, turn: int) -> pa.Table:
        """About `size` rows (all, if there are fewer), by hash."""
        draw = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(1 << 30))
        some = self.rows.withColumn("draw", draw).filter(F.col("draw") < 1.2 * size / max(self.n, 1) * (1 << 30))
        return some.orderBy("draw", "id", "key").limit(size).select("id", "key", "v").toArrow()

    def calibrated(self, k: int, recall: float) -> int:
        """Leaves to visit: the first number at which the calibration queries find so many of their true k neighbours."""
        sample = self._sample(CALIBRATION, 1)
        queries = self.rows.sparkSession.createDataFrame(sample, "id bigint, key bigint, v array<double>")
        asking = staged(_asking(queries, self.tree, self.tree.n_leaves, 0, self.sizes).withColumn("tile", F.lit(0)), "ann-calibration")
        true = _best(tiles.products(asking, self.tiles, _search(k), FOUND), k).select("query", "key", "leaf").toArrow()
        place = {}
        for i, key, walk in zip(sample["id"].to_pylist(), sample["key"].to_pylist(), self.tree.order(tiles.matrix(sample["v"], self.width))):
            place[i, key] = {leaf: at for at, leaf in enumerate(walk)}
        at = [place[q, key][leaf] for q, key, leaf in zip(*(true[c].to_pylist() for c in ("query", "key", "leaf")))]
        seen, n = np.bincount(np.array(at, np.int64), minlength=self.tree.n_leaves), 1
        while n < self.tree.n_leaves and seen[:n].sum() < recall * seen.sum():
            n += 1
        return n

    def search(self, queries: Column, k: int, recall: float) -> DataFrame:
        """query_id, rank (from 1), vec_id, score: of each row that `queries` holds for, the k rows of largest inner product found in the leaves visited.

        Ties go to the smaller id; a row with the query's own id is none of its results. A query goes on until the visited leaves hold k
        candidates, so fewer results mean that there are no more. Different rows with one id each ask and are found. An empty table gives none.
        """
        n = self.calibrated(k, recall)
        asking = staged(_asking(self.rows.filter(queries), self.tree, n, k + self.copies, self.sizes), "ann-asking")
        asking = tiles.dealt(asking, QUERIES, "leaves", "id", "key")
        found = _best(tiles.products(asking, self.tiles, _search(k), FOUND), k)
        return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
