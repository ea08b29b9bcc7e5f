"""Nearest neighbours by inner product with vantage-point trees, one for each shard.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, queries get 0 there; the nearest by
Euclidean distance are then exactly those of largest inner product, and the triangle inequality holds. A tree splits its
points at the median distance from a vantage point and keeps the least and greatest distance of each side. A query
leaves out a side whose distances lie further from its own than its k-th best so far; ``relax`` multiplies that gap, so
larger values prune more, and 1 restores exact search. How much a factor loses depends on the vectors (norms that vary and few dimensions
make it lose much), so the factor is chosen from recall measured on a sample of the queries in the index itself, down to 1.

Shards are regions: the top of one tree, with at most ``TOP_LEAVES`` leaves, is fitted on a bounded sample (about
``SAMPLE`` distinct vectors a leaf), every row is routed to its leaf, and the bounds of the leaves are taken over all rows. A
leaf with more than ``shard_rows`` rows, such as one of many copies, is dealt to several shards. Each query first searches
the shards of its own leaf; with the k-th best found there it then goes to the other leaves that the relaxed bounds leave
open, and to no others. A shard's tree is built once for up to ``block_rows`` queries that visit it.

Each group has at most about ``shard_rows`` vectors and ``block_rows`` queries. Results meet as k rows for each query and shard.

Defined results: vectors that are null, zero, of another length than most, or holding null or non-finite components take no
part; ids that repeat are rows of their own, as queries too; a query never finds its own id; scores are summed in the order of
components, and equal scores go to the smaller id; fewer candidates than k give fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, ship, written

ship(__name__)

LEAF = 32
TOP_LEAVES, SAMPLE, SAMPLE_BYTES = 4096, 64, 1 << 26
FACTORS = (2.0, 1.5, 1.25, 1.0)


def distances(points: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - v) ** 2).sum(axis=1))


class Tree:
    def __init__(self, points: np.ndarray, leaf: int = LEAF, depth: int | None = None, seed: int = 1):
        self.points, self.leaf, self.leaves, self.rng = points, leaf, 0, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)), depth)

    def _build(self, own: np.ndarray, depth: int | None):
        if len(own) <= self.leaf or depth == 0:
            self.leaves += 1
            return own if depth is None else self.leaves - 1
        v = self.points[own[self.rng.integers(len(own))]]
        d = distances(self.points[own], v)
        order = np.argsort(d, kind="stable")
        half = len(own) // 2
        below = None if depth is None else depth - 1
        return v, d[order[half]], [(d[s].min(), d[s].max(), self._build(own[s], below)) for s in (order[:half], order[half:])]


def route(root, points: np.ndarray) -> tuple[np.ndarray, list[list[float]]]:
    """The leaf of a top tree for each point, and its distances from the vantage points on the way."""
    leaf, ways = np.zeros(len(points), np.int64), [[] for _ in points]

    def down(node, own: np.ndarray) -> None:
        if not isinstance(node, tuple):
            leaf[own] = node
            return
        d = distances(points[own], node[0])
        for i, x in zip(own.tolist(), d.tolist()):
            ways[i].append(x)
        for (_, _, side), mine in zip(node[2], (d < node[1], d >= node[1])):
            if mine.any():
                down(side, own[mine])

    if len(points):
        down(root, np.arange(len(points)))
    return leaf, ways


def rebound(node, bounds: dict[int, tuple[list[float], list[float]]], depth: int = 0):
    """The top tree with the bounds of all rows routed; empty sides go. Returns the node, and the bounds of each depth below it."""
    if not isinstance(node, tuple):
        return (node, *bounds[node]) if node in bounds else None
    sides = [x for x in (rebound(side, bounds, depth + 1) for _, _, side in node[2]) if x]
    if not sides:
        return None
    low = [min(x[1][i] for x in sides) for i in range(depth + 1)]
    high = [max(x[2][i] for x in sides) for i in range(depth + 1)]
    return (node[0], node[1], [(x[1][depth], x[2][depth], x[0]) for x in sides]), low, high


def open_sides(node, queries: np.ndarray, active: np.ndarray, reach, relax: float | np.ndarray) -> Iterator[tuple[object, np.ndarray]]:
    """The sides of a node with the queries that may not leave them out, first the side that is nearer to more of them."""
    d = distances(queries[active], node[0])
    gaps = np.stack([np.maximum(np.maximum(d - hi, lo - d), 0) for lo, hi, _ in node[2]])
    nearer = np.bincount(gaps.argmin(axis=0), minlength=len(gaps))
    for s in np.argsort(-nearer, kind="stable"):
        go = active[gaps[s] * np.broadcast_to(relax, len(queries))[active] <= reach(active)]
        if len(go):
            yield node[2][s][2], go


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, biggest: float, k: int, relax: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best of each query (-1: none) and their scores; ``least``: scores below it are of no use; ``relax`` may differ by query.

    Each query first takes the leaf it falls into, then all go down the tree together, so that a leaf is opened once more at most.
    """
    lift = np.sqrt(np.maximum(biggest**2 - (vectors**2).sum(axis=1), 0))
    tree = Tree(np.c_[vectors, lift])
    lifted, relax = np.c_[queries, np.zeros(len(queries))], np.broadcast_to(relax, len(queries))
    best, score = np.full((len(queries), k), -1), np.full((len(queries), k), -np.inf)
    home = np.full(len(queries), -1)
    q2 = (queries**2).sum(axis=1)
    margin = 1e-9 * (np.sqrt(q2) + biggest)
    error = 1e-13 * queries.shape[1] * np.sqrt(q2) * biggest  # of a sum of products taken in another order
    big = np.iinfo(np.int64).max

    def reach(active: np.ndarray) -> np.ndarray:
        kth = np.maximum(score[active, -1], least[active])
        return np.where(np.isinf(kth), np.inf, np.sqrt(np.maximum(q2[active] + biggest**2 - 2 * np.where(np.isinf(kth), 0, kth), 0)) + margin[active])

    def leaf(own: np.ndarray, active: np.ndarray) -> None:
        y, x = queries[active], vectors[own]
        a, b = np.nonzero((y @ x.T >= (np.maximum(score[active, -1], least[active]) - error[active])[:, None]) & (ids[own][None, :] != query_ids[active, None]))
        if not len(a):
            return
        exact = np.zeros(len(a))
        for j in range(x.shape[1]):  # in order of components, so that equal sums are equal
            exact += y[a, j] * x[b, j]
        rows, a = np.unique(a, return_inverse=True)
        s = np.full((len(rows), len(own)), -np.inf)
        s[a, b] = exact
        active = active[rows]
        all_s = np.concatenate([score[active], s], axis=1)
        all_i = np.concatenate([best[active], np.broadcast_to(own, s.shape)], axis=1)
        key = np.where(np.isinf(all_s), big, np.where(all_i >= 0, ids[all_i], big))
        order = np.lexsort((key, -all_s), axis=1)[:, :k]
        score[active], best[active] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)
        best[active] = np.where(np.isinf(score[active]), -1, best[active])

    def settle(node, active: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            home[active] = node[0]
            return leaf(node, active)
        d = distances(lifted[active], node[0])
        for (_, _, side), mine in zip(node[2], (d < node[1], d >= node[1])):
            if mine.any():
                settle(side, active[mine])

    def visit(node, active: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            active = active[home[active] != node[0]]
            return leaf(node, active) if len(active) else None
        for side, go in open_sides(node, lifted, active, reach, relax):
            visit(side, go)

    settle(tree.root, np.arange(len(queries)))
    visit(tree.root, np.arange(len(queries)))
    return best, score


def nearest(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 20, k: int = 20,
    relax: float | None = None, least_recall: float = 0.97, sample_queries: int = 256, shard_rows: int = 16384, block_rows: int = 16384,
) -> DataFrame:
    """query_id, rank, id and score: for each row whose id is divisible by ``query_every``, its k nearest other rows.

    Without ``relax`` the factor is the largest of ``FACTORS`` whose recall against factor 1 reaches ``least_recall`` for about ``sample_queries`` queries.
    """
    spark = vectors.sparkSession
    v = vectors.select(col(id_col).cast("long").alias("id"), col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(~F.coalesce(bad, F.lit(False)) & F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).collect()
    schema = "query_id long, rank int, id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    width, n, m = max(sizes, key=lambda r: (r["n"], r["d"]))
    v = v.filter(F.size("v") == width)
    biggest = float(np.sqrt(m))
    levels = min(int(log2(TOP_LEAVES)), max(0, ceil(log2(n / shard_rows))))

    def lift(x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(biggest**2 - (x**2).sum(axis=1), 0))]

    top = 0
    if levels:
        share = min(1.0, SAMPLE * 2**levels / n, SAMPLE_BYTES / (8 * width * n))
        some = v.filter(F.pmod(F.xxhash64("v"), F.lit(2**30)) < share * 2**30).select("v").distinct().sort("v").collect()
        if some:
            top = Tree(lift(np.array([r["v"] for r in some])), leaf=1, depth=levels).root

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                leaf, ways = route(top, lift(np.stack(pdf["v"].to_numpy())))
                yield pdf.assign(leaf=leaf, way=ways)

    rows = v.mapInPandas(routed, "id long, v array<double>, leaf long, way array<double>").withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "routed")  # row numbers hold from here on
    least = [F.min(F.get("way", F.lit(i))).alias(f"low{i}") for i in range(levels)]
    most = [F.max(F.get("way", F.lit(i))).alias(f"high{i}") for i in range(levels)]
    leaves = rows.groupBy("leaf").agg(F.count("*").alias("n"), *least, *most).collect()  # one row a leaf
    whole = rebound(top, {r["leaf"]: ([r[f"low{i}"] for i in range(levels)], [r[f"high{i}"] for i in range(levels)]) for r in leaves})[0]
    shards = {r["leaf"]: -(-r["n"] // shard_rows) for r in leaves}

    def pair(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if points.empty or queries.empty:
            return pd.DataFrame({"query": [], "query_id": [], "relax": [], "id": [], "score": []})
        points = points.sort_values(["id", "row"], kind="stable")
        x, y = np.stack(points["v"].to_numpy()), np.stack(queries["v"].to_numpy())
        ids = points["id"].to_numpy()
        best, score = search(x, ids, y, queries["id"].to_numpy(), queries["least"].to_numpy(float), biggest, k, queries["relax"].to_numpy())
        at, place = np.nonzero(best >= 0)
        return pd.DataFrame({"query": queries["row"].to_numpy()[at], "query_id": queries["id"].to_numpy()[at], "relax": queries["relax"].to_numpy()[at], "id": ids[best[at, place]], "score": score[at, place]})

    def searched(queries: DataFrame) -> DataFrame:
        """What the shards of ``leaf`` have for each query; no leaf's table here has more than TOP_LEAVES rows."""
        visits = queries.groupBy("leaf").count().collect()
        plan = spark.createDataFrame([(r["leaf"], shards[r["leaf"]], -(-r["count"] // block_rows)) for r in visits], "leaf long, shards int, blocks int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        to = lambda count: F.pmod(F.xxhash64("row"), F.col(count)).cast("int")
        points = rows.join(F.broadcast(plan), "leaf").select("leaf", to("shards").alias("shard"), every("blocks").alias("block"), "id", "v", "row")
        asked = queries.join(F.broadcast(plan), "leaf").select("leaf", every("shards").alias("shard"), to("blocks").alias("block"), "id", "v", "row", "least", "relax")
        asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # new columns: both sides come from one table
        keys = ["leaf", "shard", "block"]
        return points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(pair, "query long, query_id long, relax double, id long, score double")

    def best_of(found: DataFrame) -> DataFrame:
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))), 1, k)
        return found.groupBy("query", "query_id", "relax").agg(best.alias("best"))

    def elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query once for every leaf that its bounds leave open, but its own."""
        for pdf in batches:
            if not len(pdf):
                continue
            y, home, least = np.stack(pdf["v"].to_numpy()), pdf["leaf"].to_numpy(), pdf["least"].to_numpy(float)
            q2, lifted, factor = (y**2).sum(axis=1), np.c_[y, np.zeros(len(y))], pdf["relax"].to_numpy()
            far = np.sqrt(np.maximum(q2 + biggest**2 - 2 * np.where(np.isinf(least), 0, least), 0)) + 1e-9 * (np.sqrt(q2) + biggest)
            far = np.where(np.isinf(least), np.inf, far)
            at, to = [], []

            def visit(node, active: np.ndarray) -> None:
                if isinstance(node, tuple):
                    for side, go in open_sides(node, lifted, active, lambda x: far[x], factor):
                        visit(side, go)
                else:
                    active = active[home[active] != node]
                    at.append(active)
                    to.append(np.full(len(active), node))

            visit(whole, np.arange(len(y)))
            yield pdf.iloc[np.concatenate(at)].assign(leaf=np.concatenate(to))

    def answered(queries: DataFrame) -> DataFrame:
        """query, query_id, relax and best: what each query (id, v, leaf, row, relax) finds in its own leaf, then in the open ones."""
        found = searched(queries.withColumn("least", F.lit(float("-inf"))))
        if len(leaves) == 1:
            return best_of(found)
        found = written(best_of(found), "home")
        kth = found.select(F.col("query").alias("row"), "relax", F.when(F.size("best") == k, -F.element_at("best", -1)["minus"]).alias("kth"))
        asked = queries.join(kth, ["row", "relax"], "left").withColumn("least", F.coalesce("kth", F.lit(float("-inf")))).drop("kth")
        more = written(asked.select("id", "v", "leaf", "row", "least", "relax").mapInPandas(elsewhere, "id long, v array<double>, leaf long, row long, least double, relax double"), "visits")
        again = found.select("query", "query_id", "relax", F.explode("best").alias("b")).select("query", "query_id", "relax", F.col("b.id").alias("id"), (-F.col("b.minus")).alias("score"))
        return best_of(again.unionByName(searched(more)))

    queries = rows.filter(F.col("id") % query_every == 0).select("id", "v", "leaf", "row")
    if relax is None:
        relax = tuned(queries, answered, least_recall, sample_queries)
    ranked = answered(queries.withColumn("relax", F.lit(float(relax)))).select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("id"), (-F.col("b.minus")).alias("score"))


def tuned(queries: DataFrame, answered, least_recall: float, sample_queries: int) -> float:
    """The largest factor whose recall against factor 1 is ``least_recall`` or more, measured in one run of the index for a hashed sample of the queries."""
    share = min(1.0, sample_queries / max(1, queries.count()))
    some = queries.filter(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(2**30)) < share * 2**30).withColumn("relax", F.explode(F.array(*[F.lit(x) for x in FACTORS])))
    found = written(answered(some).select("query", "relax", F.explode("best").alias("b")).select("query", "relax", F.col("b.id").alias("id")), "tuning")
    exact = found.filter(F.col("relax") == 1).select("query", "id").distinct()
    hits = {r["relax"]: r["n"] for r in found.distinct().join(exact, ["query", "id"], "left_semi").groupBy("relax").agg(F.count("*").alias("n")).collect()}
    return max(x for x in FACTORS if x == 1 or hits.get(x, 0) >= least_recall * hits.get(1.0, 0))
