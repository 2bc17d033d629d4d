"""Approximate nearest neighbours by a hierarchical k-means tree, best bin first.

Nearness is the inner product in double precision; ties go to the smaller id.

1. The tree is built on a bounded sample (``sample_rows`` rows of least hash) and
   has at most ``sample_rows`` leaves; every vector of the table is then dropped
   into its leaf, and the vectors of a leaf are dealt into blocks of about
   ``block_rows``, so that a leaf with a third of all rows is many blocks.
2. A query walks the tree with a priority queue: the open node whose centre has
   the largest inner product goes next, until ``visits`` leaves (and more than k
   vectors) are reached.
3. ``visits`` is calibrated: for ``calibration`` queries the true neighbours are
   found by brute force over all rows, in blocks, and visits are widened until
   the share of them in visited leaves reaches ``recall``.
4. Queries go to the blocks of their leaves, in Spark, and are scored there; each
   block returns at most k rows a query, none below the worst of the k best sample
   rows in the query's leaves, and the best k of them are the result.

Defined results
  null vectors, null, infinite or NaN components, zero vectors, null ids, and
  vectors of another length than most   take no part
  repeated rows        rows of one id are one vector, the least of them
  ties                 smaller vec_id first
  fewer than k others  all of them
  empty table          empty result
  extra columns        not read
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import col, small_batches, stored


@dataclass(frozen=True)
class Params:
    sample_rows: int = 20_000   # most rows the tree is fitted on
    branch: int = 8
    leaf_rows: int = 24         # sample rows of a leaf, at most
    rounds: int = 8             # of k-means at each node
    calibration: int = 100      # queries with true neighbours
    recall: float = 0.96        # share of true neighbours to reach on them
    block_rows: int = 2_048
    query_rows: int = 4_096     # queries in a block
    seed: int = 7


@dataclass
class Tree:
    centers: np.ndarray    # (nodes, dimension)
    children: np.ndarray   # (nodes, branch), -1 where there is none
    leaf: np.ndarray       # (nodes,): number of the leaf, or -1

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def drop(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the tree by nearest centre."""
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.leaf[node] < 0)
            if not len(inner):
                return self.leaf[node]
            kids = self.children[node[inner]]
            away = ((self.centers[kids] - x[inner, None, :]) ** 2).sum(axis=2)
            node[inner] = kids[np.arange(len(inner)), np.where(kids < 0, np.inf, away).argmin(axis=1)]

    def walk(self, near: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first; ``near`` has the query's product with each centre."""
        heap = [(-near[0], 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                yield int(self.leaf[node])
            for kid in self.children[node]:
                if kid >= 0:
                    heapq.heappush(heap, (-near[kid], int(kid)))


def grow(x: np.ndarray, p: Params) -> Tree:
    random = np.random.RandomState(p.seed)
    centers, children, leaf, leaves = [x.mean(axis=0)], [[-1] * p.branch], [-1], 0
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, own = todo.pop()
        rows = x[own]
        parts = []
        if len(own) > p.leaf_rows and (rows != rows[0]).any():
            mid = rows[random.choice(len(own), min(p.branch, len(own)), replace=False)]
            for _ in range(p.rounds):
                at = ((mid ** 2).sum(axis=1) - 2 * rows @ mid.T).argmin(axis=1)
                mid = np.array([rows[at == c].mean(axis=0) if (at == c).any() else mid[c]
                                for c in range(len(mid))])
            at = ((mid ** 2).sum(axis=1) - 2 * rows @ mid.T).argmin(axis=1)
            parts = [(mid[c], own[at == c]) for c in range(len(mid)) if (at == c).any()]
        if len(parts) < 2:   # small, or all rows alike: a leaf
            leaf[node] = leaves
            leaves += 1
            continue
        for c, (center, part) in enumerate(parts):
            children[node][c] = len(centers)
            todo.append((len(centers), part))
            centers.append(center)
            children.append([-1] * p.branch)
            leaf.append(-1)
    return Tree(np.array(centers), np.array(children, dtype=np.int64), np.array(leaf, dtype=np.int64))


def matrix(rows: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in rows], dtype=np.float64)


def valid(vectors: DataFrame, name: str, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("v")
    good = (F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))
    rows = (vectors.select(col(name).alias("vec_id"), col(vector).alias("v"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & good))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("v") == (size["size"] if size else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def best_of(scores: np.ndarray, x: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """(ids, scores) of the k nearest among finite ``scores``. Matrix products round
    unlike for equal rows, so all within a hair of the k-th are scored again, row by row."""
    some = np.flatnonzero(scores > -np.inf)
    if len(some) > k:
        kth = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= kth - 1e-9 * max(1.0, abs(kth))]
    exact = (x[some] * q).sum(axis=1)
    order = np.lexsort([ids[some], -exact])[:k]
    return ids[some][order], exact[order]


def search(vectors: DataFrame, is_query: Column, k: int = 20, name: str = "vec_id",
           vector: str = "embedding", params: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that
    ``is_query`` (an expression over vec_id) names."""
    spark, p = vectors.sparkSession, params
    small_batches(spark)
    result = "query_id long, vec_id long, score double"
    rows = stored(valid(vectors, name, vector).withColumn("query", is_query), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample_rows).select("vec_id", "v").toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = grow(matrix(sample["v"]), p)
    shared = spark.sparkContext.broadcast(vars(tree))   # at most 2 x sample_rows centres
    known = matrix(sample["v"])
    probe = spark.sparkContext.broadcast((known, tree.drop(known), sample["vec_id"].to_numpy()))   # sample_rows rows

    @F.pandas_udf("int")
    def leaf_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = Tree(**shared.value)
        for part in parts:
            yield pd.Series(t.drop(matrix(part)) if len(part) else [], dtype="int32")

    placed = stored(rows.withColumn("leaf", leaf_of("v")), "leaves")
    counts = np.zeros(tree.leaves, dtype=np.int64)
    for r in placed.groupBy("leaf").count().collect():   # at most one row a leaf
        counts[r["leaf"]] = r["count"]
    visits = calibrate(placed, tree, counts, k, p)

    # Blocks: a large leaf is several, small leaves in a row share one.
    first, blocks, n, filled = np.zeros(len(counts), dtype=int), np.ones(len(counts), dtype=int), 0, 0
    for i, c in enumerate(counts.tolist()):
        if c > p.block_rows or filled + c > p.block_rows:
            n, filled = n + (filled > 0), 0
        first[i], blocks[i] = n, max(1, -(-c // p.block_rows))
        if blocks[i] > 1:
            n += int(blocks[i])
        else:
            filled += c
    layout = spark.createDataFrame(   # one row a leaf
        [(i, int(first[i]), int(blocks[i])) for i in range(len(counts))], "leaf int, first int, blocks int")
    n_queries = placed.where("query").count()
    parts_of_queries = max(1, -(-n_queries // p.query_rows))
    part_of = F.pmod(F.xxhash64("vec_id"), F.lit(parts_of_queries)).cast("int")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Tree(**shared.value)
        held, held_leaf, held_ids = probe.value
        for batch in batches:
            out = []
            if len(batch):
                x = matrix(batch["v"])
                near, with_held = x @ t.centers.T, x @ held.T
                for n_query, (q, part, v, row) in enumerate(zip(batch["vec_id"], batch["part"], x, near)):
                    to, seen = {}, 0
                    for n, leaf in enumerate(t.walk(row)):
                        if n >= visits and seen > k:
                            break
                        seen += counts[leaf]
                        for b in range(first[leaf], first[leaf] + blocks[leaf]):
                            to.setdefault(b, []).append(leaf)
                    # k sample rows of the visited leaves are found for sure: blocks need
                    # to return nothing below the worst of them.
                    reached = np.zeros(len(counts), dtype=bool)
                    reached[[y for ys in to.values() for y in ys]] = True
                    sure = with_held[n_query][reached[held_leaf] & (held_ids != q)]
                    bound = float(np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else -np.inf
                    out += [(b, part, q, v, leaves, bound) for b, leaves in to.items()]
            yield pd.DataFrame(out, columns=["block", "part", "query_id", "v", "leaves", "bound"]).astype(
                {"block": "int32", "part": "int32", "query_id": "int64", "bound": "float64"})

    queries = (placed.where("query").select("vec_id", "v", part_of.alias("part"))
               .mapInPandas(route, "block int, part int, query_id long, v array<double>, leaves array<int>, bound double"))
    stay = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    there = (placed.join(F.broadcast(layout), "leaf")
             .select((F.col("first") + stay).alias("block"), "vec_id", "leaf", "v",
                     F.explode(F.sequence(F.lit(0), F.lit(parts_of_queries - 1))).alias("part")))

    def score(here: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(here) and len(asked):
            x, q = matrix(here["v"]), matrix(asked["v"])
            ids, names = here["vec_id"].to_numpy(), asked["query_id"].to_numpy()
            leaf, bound = here["leaf"].to_numpy(), np.maximum(asked["bound"].to_numpy(dtype=float), -1e300)
            askers: dict[int, list[int]] = {}
            for i, leaves in enumerate(asked["leaves"]):
                for one in leaves:
                    askers.setdefault(int(one), []).append(i)
            scores = np.full((len(q), len(x)), -np.inf)
            for one in np.unique(leaf):
                who, which = askers.get(int(one)), np.flatnonzero(leaf == one)
                if who:
                    scores[np.ix_(who, which)] = q[who] @ x[which].T
            scores[names[:, None] == ids[None, :]] = -np.inf
            for i, who in enumerate(names):
                found, exact = best_of(scores[i], x, q[i], ids, k)
                good = exact >= bound[i] - 1e-9 * max(1.0, abs(bound[i]))
                out += zip([who] * int(good.sum()), found[good], exact[good])
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = (there.groupBy("block", "part").cogroup(queries.groupBy("block", "part"))
             .applyInPandas(score, result))
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def calibrate(placed: DataFrame, tree: Tree, counts: np.ndarray, k: int, p: Params) -> int:
    """The least number of leaves whose visit finds the share ``recall`` of the true
    neighbours of the calibration queries."""
    some = (placed.where("query").orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(p.calibration)
            .select("vec_id", "v").toPandas())
    if not len(some):
        return 1
    names, q = some["vec_id"].to_numpy(), matrix(some["v"])

    def brute(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            if len(part):
                x, ids, leaf = matrix(part["v"]), part["vec_id"].to_numpy(), part["leaf"].to_numpy()
                scores = q @ x.T
                scores[names[:, None] == ids[None, :]] = -np.inf
                place = {i: n for n, i in enumerate(ids.tolist())}
                for i in range(len(q)):
                    found, exact = best_of(scores[i], x, q[i], ids, k)
                    out += [(i, v, s, leaf[place[v]]) for v, s in zip(found.tolist(), exact.tolist())]
            yield pd.DataFrame(out, columns=["q", "vec_id", "score", "leaf"]).astype(
                {"q": "int32", "vec_id": "int64", "score": "float64", "leaf": "int32"})

    place = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    true = (placed.select("vec_id", "v", "leaf").mapInPandas(brute, "q int, vec_id long, score double, leaf int")
            .withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select("q", "leaf").toPandas())   # k rows a calibration query
    near = q @ tree.centers.T
    order = []
    for i in range(len(q)):
        at = {leaf: n for n, leaf in enumerate(tree.walk(near[i]))}
        order += [at[leaf] for leaf in true.loc[true["q"] == i, "leaf"]]
    if not order:
        return 1
    order = np.sort(order)
    return int(order[min(len(order) - 1, int(np.ceil(p.recall * len(order))) - 1)]) + 1
