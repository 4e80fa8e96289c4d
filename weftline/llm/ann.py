"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample of the vectors: each node cuts by the direction between two of
its sample vectors, at the sample's median, so leaves are about equal. Their depth follows the number
of vectors, for LEAF vectors a leaf. Every different vector is then routed to one leaf of each tree. A
query walks all trees with one shared priority queue, which holds nodes by the squares of the margins
that their path crossed to the far side, summed, and visits the best leaves of the whole forest. How many it
visits also follows the number of vectors: the share of them that a query meets falls as their number to
the power FALL. Queries and vectors meet by bunches of leaves, in blocks of bounded size, and what comes
out is reranked by the exact inner product in double precision.

A query also knows a bound: the product with one of its best vectors of a small sample, at least the
(k + 2)nd. Candidates below it can't be among its k nearest, so leaves don't send them on; this drops no
result.

Copies of a vector are one index entry. The k + 1 least ids of each are kept, which is all that k
results can need, as ties go to smaller ids.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import ship, staged

#: Vectors that trees are fitted on, those of the least hash; the bound on what reaches the driver.
SAMPLE = 16_384
TREES = 8
#: Vectors that a leaf aims at, and sample vectors that it has at least.
LEAF, LEAST = 32, 4
#: A query meets all of WHOLE vectors or fewer, in one tree; beyond, a share that falls with their number, copies in several trees counted.
WHOLE, FALL = 9_000, 0.43
#: The bound looks at this share of the vectors, of those in the sample.
BOUND_SHARE = 1 / 16
#: Vectors routed, and queries walked, at a time.
ROUTED, WALKED = 4096, 64
#: Groups of neighbouring leaves that a tree is cut into, and most index vectors, and queries, that meet in one.
BUNCHES, BLOCK = 16, 4096
#: Candidates kept besides k, for the query's own entry and the matrix product's rounding.
SLACK = 8
SEED = 7


@dataclass
class Forest:
    """Heap-ordered trees: node i has children 2i + 1 and 2i + 2; after 2**depth - 1 nodes come the leaves."""

    directions: np.ndarray
    cuts: np.ndarray
    depth: int

    @property
    def inner(self) -> int:
        return (1 << self.depth) - 1

    def margins(self, x: np.ndarray, tree: int) -> np.ndarray:
        return x @ self.directions[tree].T - self.cuts[tree]

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of each vector: one product for each level, not for each node."""
        node = np.zeros(len(x), np.int64)
        for start in range(0, len(x), ROUTED):
            some, at = x[start : start + ROUTED], node[start : start + ROUTED]
            for _ in range(self.depth):
                at[:] = 2 * at + 1 + (np.einsum("ij,ij->i", some, self.directions[tree][at]) > self.cuts[tree][at])
        return node - self.inner

    def visits(self, x: np.ndarray, count: int, held: np.ndarray) -> list[tuple[int, int]]:
        """The ``count`` leaves (tree, leaf) that one query reaches first by the shared queue, of those that are ``held`` by a vector."""
        margins = [self.margins(x[None, :], t)[0] for t in range(len(self.cuts))]
        queue, out = [(0.0, t, 0) for t in range(len(margins))], []
        while queue and len(out) < count:
            far, tree, node = heapq.heappop(queue)
            if node >= self.inner:
                if held[tree, node - self.inner]:
                    out.append((tree, node - self.inner))
                continue
            m = margins[tree][node]
            heapq.heappush(queue, (far + max(m, 0.0) ** 2, tree, 2 * node + 1))
            heapq.heappush(queue, (far + min(m, 0.0) ** 2, tree, 2 * node + 2))
        return out


def forest_depth(vectors: int, sample: int) -> int:
    """Levels for ``vectors`` vectors, of which ``sample`` are there to fit them."""
    return max(1, round(math.log2(max(2, min(vectors / LEAF, sample / LEAST)))))


def forest_visits(vectors: int, depth: int) -> int:
    """Leaves of the forest that a query visits, so that it meets the share of all vectors that recall takes."""
    return math.ceil((WHOLE / max(WHOLE, vectors)) ** FALL * (1 << depth))


def fit_forest(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    inner = (1 << depth) - 1
    directions, cuts = np.zeros((trees, inner, sample.shape[1])), np.zeros((trees, inner))
    for t in range(trees):
        sets = {0: np.arange(len(sample))}
        for node in range(inner):
            rows = sets.pop(node)
            pair = sample[rng.choice(rows, 2)] if len(rows) else np.zeros((2, sample.shape[1]))
            way = pair[0] - pair[1]
            if not (norm := np.linalg.norm(way)):  # few or equal vectors: any direction
                way = rng.normal(size=sample.shape[1])
                norm = np.linalg.norm(way)
            directions[t, node] = way / norm
            at = sample[rows] @ directions[t, node]
            cuts[t, node] = np.median(at) if len(rows) else 0.0
            sets[2 * node + 1], sets[2 * node + 2] = rows[at <= cuts[t, node]], rows[at > cuts[t, node]]
    return Forest(directions, cuts, depth)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector isn't null, empty or zero and whose components are all finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    return df.where(F.col(vector).isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, visits: int | None = None) -> DataFrame:
    """The k nearest of ``vectors`` to each of ``queries`` (both vec_id, embedding) by inner product.

    Returns query_id, rank, vec_id, score; ties go to smaller vec_id, null ids last. A query meets every
    vector but the rows of its own id. Vectors null, empty, zero or holding null or non-finite components
    take no part on either side, nor do queries with a null id; ``visits`` leaves are visited, by default as
    many as ``forest_visits`` says; lengths must agree, and vectors of another length than most
    of the sample take none either. Repeated ids are rows like any other among the vectors; equal query
    rows count once. Other columns are ignored; empty tables give an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors.select("vec_id", "embedding"), "embedding")
    rows = rows.withColumn("node", F.unhex(F.md5(F.to_json(F.struct("embedding")).cast("binary"))))
    least = Window.partitionBy("node").orderBy(F.asc_nulls_last("vec_id"))
    few = staged(rows.select("node", "vec_id").withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).drop("n"), "ann-ids")
    firsts = few.groupBy("node").agg(F.min("vec_id").alias("least")).withColumnRenamed("node", "of")
    first = rows.join(firsts, (rows["node"] == F.col("of")) & rows["vec_id"].eqNullSafe(F.col("least")))
    index = staged(first.dropDuplicates(["node"]).select("node", "embedding"), "ann-index")
    sample = np.array([r[0] for r in index.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").collect()], dtype=object)
    lengths = [len(v) for v in sample]
    size = max(set(lengths), key=lengths.count) if lengths else 0
    sample = np.array([v for v in sample.tolist() if len(v) == size], dtype=np.float64).reshape(-1, max(1, size))
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = index.where(F.size("embedding") == size)
    asked = usable(queries.where("vec_id is not null").select("vec_id", "embedding"), "embedding").where(F.size("embedding") == size)
    asked = asked.select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    count = index.count()
    forest = fit_forest(sample, forest_depth(count, len(sample)), TREES if count > WHOLE else 1)
    visits = visits or forest_visits(count, forest.depth)
    bunch = max(1, (1 << forest.depth) // BUNCHES)
    near = sample[: math.ceil(count * BOUND_SHARE)]
    known = spark.sparkContext.broadcast((forest, near))
    # About 3k vectors of the whole index should pass a bound, so that what the trees miss is made up for.
    place = max(k + 2, math.ceil(3 * k * len(near) / max(1, count)))

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, _ = known.value
        for part in parts:
            x = _matrix(part["embedding"])
            for t in range(len(forest.cuts)):
                yield pd.DataFrame({"tree": np.int32(t), "leaf": forest.leaves(x, t).astype(np.int32), "node": part["node"], "embedding": part["embedding"]})

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, near = known.value
        for part in parts:
            for start in range(0, len(part), WALKED):
                some = part.iloc[start : start + WALKED]
                x = _matrix(some["embedding"])
                among = x @ near.T
                bound = np.partition(among, -place, axis=1)[:, -place] if near.shape[0] >= place else np.full(len(x), -np.inf)
                rows = []
                for i, q in enumerate(x):
                    by_bunch: dict[tuple[int, int], list[int]] = {}
                    for tree, leaf in forest.visits(q, visits, held):
                        by_bunch.setdefault((tree, leaf // bunch), []).append(leaf)
                    rows += [(tree, group, leaves, i) for (tree, group), leaves in by_bunch.items()]
                tree, group, leaves, at = zip(*rows, strict=True) if rows else ((), (), (), ())
                at = np.array(at, np.int64)
                yield pd.DataFrame({"tree": np.array(tree, np.int32), "bunch": np.array(group, np.int32), "leaves": leaves, "query_id": some["query_id"].to_numpy()[at], "bound": bound[at], "query": some["embedding"].to_numpy()[at]})

    element = index.schema["embedding"].dataType.simpleString()
    routed = staged(index.mapInPandas(route, f"tree int, leaf int, node binary, embedding {element}"), "ann-routed")
    held = np.zeros((len(forest.cuts), forest.inner + 1), bool)
    for r in routed.select("tree", "leaf").distinct().collect():  # a row for each leaf of the forest at most
        held[r["tree"], r["leaf"]] = True
    # A query goes to a bunch once, with the leaves that it visits there; the walk is dealt over tasks, as queries are few rows.
    dealt = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query_id")
    walked = staged(dealt.mapInPandas(walk, f"tree int, bunch int, leaves array<int>, query_id long, bound double, query {element}"), "ann-walked")
    # A bunch of leaves with more than BLOCK vectors or queries is cut both ways, and each pair of cuts is a group.
    routed = routed.withColumn("bunch", F.floor(F.col("leaf") / bunch).cast("int"))
    cuts = lambda df, name: df.groupBy("tree", "bunch").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    both = staged(cuts(routed, "rows").join(cuts(walked, "asks"), ["tree", "bunch"]), "ann-cuts")
    sides = [F.broadcast(both.toDF("tree", "bunch", f"rows{i}", f"asks{i}")) for i in (0, 1)]  # a row for each bunch of the forest
    spread = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = routed.join(sides[0], ["tree", "bunch"]).withColumn("row_cut", F.pmod(F.xxhash64("node"), "rows0").cast("int")).withColumn("ask_cut", spread("asks0"))
    right = walked.join(sides[1], ["tree", "bunch"]).withColumn("ask_cut", F.pmod(F.xxhash64("query_id"), "asks1").cast("int")).withColumn("row_cut", spread("rows1"))
    key = ["tree", "bunch", "row_cut", "ask_cut"]

    def meet(some: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(some) and len(asks):
            x, y = _matrix(some["embedding"]), _matrix(asks["query"])
            ids, nodes, bounds = asks["query_id"].to_numpy(), some["node"].to_numpy(), asks["bound"].to_numpy()
            row_leaf, at = some["leaf"].to_numpy(), asks["leaves"].to_numpy()
            visitor, ask_leaf = np.repeat(np.arange(len(at)), [len(v) for v in at]), np.concatenate(at)
            for leaf in np.intersect1d(row_leaf, ask_leaf):
                b, a = np.flatnonzero(row_leaf == leaf), visitor[ask_leaf == leaf]
                score, least = y[a] @ x[b].T, bounds[a]
                if score.shape[1] > k + 1:  # the query's own entry is one of them; slack is for rounding
                    kth = np.partition(score, -k - 1, axis=1)[:, -k - 1]
                    least = np.maximum(least, kth)
                i, j = np.nonzero(score >= (least - 1e-9 * np.abs(least))[:, None] if np.isfinite(least).all() else score >= least[:, None])
                out.append((a[i], b[j], score[i, j]))
            if out:  # of a query's candidates in all these leaves, too, no more than k + 1 can matter
                q, b, score = map(np.concatenate, zip(*out, strict=True))
                order = np.lexsort((b, -score, q))
                q, b, score = q[order], b[order], score[order]
                place = np.arange(len(q)) - np.maximum.accumulate(np.where(np.concatenate([[True], q[1:] != q[:-1]]), np.arange(len(q)), 0))
                front = place <= k + SLACK
                out = [(ids[q[front]], nodes[b[front]], score[front])]
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "node", "about"), columns, strict=True)))

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "query_id long, node binary, about double")
    found = found.groupBy("query_id", "node").agg(F.max("about").alias("about"))
    # Entries in front by the matrix product, a few more than k against its rounding; then the exact measure.
    front = Window.partitionBy("query_id").orderBy(F.desc("about"), "node")
    found = staged(found.withColumn("n", F.row_number().over(front)).where(F.col("n") <= k + SLACK).select("query_id", "node"), "ann-found")
    dot = F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), F.col("query").cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    exact = found.join(index, "node").join(asked.toDF("query_id", "query"), "query_id").select("query_id", "node", dot.alias("score"))
    listed = exact.join(few, "node").where(~F.col("vec_id").eqNullSafe(F.col("query_id"))).select("query_id", "vec_id", "score")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return listed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
