"""Approximate nearest neighbours: a hierarchical k-means tree, traversed best bin first.

Index: the tree is fitted in NumPy on a sample of at most about ``SAMPLE`` distinct vectors (chosen by a hash of vec_id);
every row of the table is then filed in its leaf. The tree has at most SAMPLE / 16 leaves, so its size is bounded.

Search: a priority queue opens the node whose centroid is nearest to the query, so leaves come nearest first. The number of
leaves visited is calibrated: the true neighbours of ``CALIBRATION`` vectors are found by brute force over all rows, and
visits widen until ``RECALL`` of them lie in visited leaves. A query that has fewer than k candidates by then goes on.
Queries meet the rows of their leaves in blocks of bounded size on either side; each block keeps its k nearest, and these are merged.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without a vec_id
or of another dimension than most (for queries: than the index's); rows with the query's vec_id are its own; other repeated rows are separate candidates;
a query id that occurs twice is asked once; equal distances go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import table, written

SAMPLE, BRANCHES, LEAF_ROWS = 20_000, 8, 200
CALIBRATION, RECALL = 128, 0.96
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


@dataclass
class Tree:
    """Nodes by number, the root first: centroids, the children of each, and the leaf number (-1 inside)."""

    centroids: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max(initial=-1)) + 1

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest child at every level."""
        node = np.zeros(len(x), dtype=np.int64)
        inner = np.array([bool(c) for c in self.children])
        while (todo := inner[node]).any():
            for k in np.unique(node[todo]):
                rows = np.flatnonzero(node == k)
                kids = np.array(self.children[k])
                node[rows] = kids[_nearest(x[rows], self.centroids[kids])]
        return self.leaf[node]

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, k = heapq.heappop(queue)
            if not self.children[k]:
                yield int(self.leaf[k])
                continue
            kids = self.children[k]
            d = ((self.centroids[kids] - q) ** 2).sum(1)
            for c, dist in zip(kids, d):
                heapq.heappush(queue, (float(dist), c))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)


def _k_means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = _nearest(x, centroids)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def fit_tree(x: np.ndarray, leaves: int, branches: int = BRANCHES) -> Tree:
    """Splits the node with the most rows until there are enough leaves."""
    x = np.unique(x, axis=0)
    centroids, children, rows = [x.mean(0)], [[]], {0: np.arange(len(x))}
    heap = [(-len(x), 0)]
    while heap and len(rows) < leaves:
        _, k = heapq.heappop(heap)
        own = rows[k]
        if len(own) < 2 * branches:
            continue
        cents = _k_means(x[own], branches, seed=k)
        at = _nearest(x[own], cents)
        parts = [own[at == c] for c in range(branches) if (at == c).any()]
        if len(parts) < 2:
            continue
        del rows[k]
        for part in parts:
            centroids.append(x[part].mean(0))
            children.append([])
            children[k].append(len(centroids) - 1)
            rows[len(centroids) - 1] = part
            heapq.heappush(heap, (-len(part), len(centroids) - 1))
    leaf = np.full(len(centroids), -1)
    for n, k in enumerate(sorted(rows)):
        leaf[k] = n
    return Tree(np.array(centroids), children, leaf)


def usable(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """vec_id and embedding (double) of the rows that take part: those of the dimension, by default of the commonest."""
    v = F.col("embedding")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & whole & F.exists(v, lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))
    if dimension is None:
        sizes = ok.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dimension = sizes["n"] if sizes else 0
    return ok.filter(F.size("embedding") == dimension)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _top(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest by (d, id)."""
    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
    return near[np.lexsort((ids[near], d[near]))[:k]]


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(1))


class Index:
    """The filed rows (a written table: vec_id, embedding, leaf), the tree, and the calibrated number of visits."""

    def __init__(self, vectors: DataFrame, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, recall: float = RECALL, k: int = 10) -> None:
        spark = vectors.sparkSession
        rows = usable(vectors)
        self.rows = rows.count()
        self.k = k
        if not self.rows:
            return
        share = min(1.0, sample / self.rows)
        chosen = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
        # Ordered, so that the sample is the same in every run, however often an id repeats.
        ordered = lambda df, n: df.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(n).toPandas()["embedding"]
        fitted = ordered(chosen, 2 * sample)
        self.tree = fit_tree(_matrix(fitted if len(fitted) else ordered(rows, 100)), max(1, min(self.rows // leaf_rows, sample // 16)))
        self.shared = spark.sparkContext.broadcast(self.tree)  # at most sample / 16 leaves
        shared = self.shared

        def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield b.assign(leaf=shared.value.file(_matrix(b["embedding"])))

        self.dimension = len(self.tree.centroids[0])
        self.filed = written(rows.mapInPandas(file, "vec_id long, embedding array<double>, leaf long"), "ann")
        self.sizes = {r["leaf"]: r["count"] for r in self.filed.groupBy("leaf").count().collect()}  # one row per leaf
        self.visits = self.calibrate(recall)

    def calibrate(self, recall: float) -> int:
        """The fewest visits that reach ``recall`` of the true neighbours of a fixed sample, found over all rows."""
        k = self.k
        asked = self.filed.orderBy(F.xxhash64(F.col("vec_id") + 1), "vec_id").limit(CALIBRATION).toPandas()
        ids, x = asked["vec_id"].to_numpy(), _matrix(asked["embedding"])

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[int, pd.DataFrame] = {}
            for b in batches:
                if not len(b):
                    continue
                m, vec, leaf = _matrix(b["embedding"]), b["vec_id"].to_numpy(), b["leaf"].to_numpy()
                for i, q in enumerate(x):
                    d = _distances(q, m)
                    d[vec == ids[i]] = np.inf
                    at = _top(d, vec, k)
                    new = pd.DataFrame({"i": i, "d": d[at], "vec_id": vec[at], "leaf": leaf[at]})
                    best[i] = pd.concat([best[i], new]).nsmallest(k, ["d", "vec_id"]) if i in best else new
            if best:
                yield pd.concat(best.values())

        near = self.filed.mapInPandas(scan, "i long, d double, vec_id long, leaf long")
        rank = F.row_number().over(W.partitionBy("i").orderBy("d", "vec_id"))
        true = near.filter(F.col("d") < float("inf")).withColumn("r", rank).filter(F.col("r") <= k).toPandas()  # CALIBRATION * k rows
        places = []
        for i, q in enumerate(x):
            at = {leaf: n for n, leaf in enumerate(self.tree.visit(q), 1)}
            places += [at[leaf] for leaf in true.loc[true["i"] == i, "leaf"]]
        if not places:
            return self.tree.leaves
        places = np.sort(places)
        return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)])

    def search(self, queries: DataFrame) -> DataFrame:
        """queries: vec_id, embedding -> query_id, rank, vec_id, score."""
        out = "query_id long, vec_id long, score double"
        spark = queries.sparkSession
        if not self.rows:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        k, visits, sizes, shared = self.k, self.visits, self.sizes, self.shared

        def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                at, found = [], []
                for i, q in enumerate(b["embedding"]):
                    seen = 0
                    for n, leaf in enumerate(shared.value.visit(np.asarray(q, dtype=np.float64))):
                        if n >= visits and seen > k:
                            break
                        seen += sizes.get(leaf, 0)
                        if leaf in sizes:
                            at.append(i)
                            found.append(leaf)
                part = b.iloc[at]
                yield pd.DataFrame({"query_id": part["vec_id"].to_numpy(), "q": part["embedding"].to_numpy(), "leaf": np.array(found, dtype=np.int64)})

        asked = written(usable(queries, self.dimension).dropDuplicates(["vec_id"]).mapInPandas(leaves, "query_id long, q array<double>, leaf long"), "ann-asked")
        # Both sides of a leaf are cut into blocks, and each block of rows meets each block of queries once.
        cuts = asked.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("qs"))
        here = {r["leaf"]: r["qs"] for r in cuts.collect()}  # one row per leaf
        plan = spark.createDataFrame([(leaf, -(-n // BLOCK_ROWS), here[leaf]) for leaf, n in sizes.items() if leaf in here] or [(-1, 1, 1)], "leaf long, bs int, qs int")
        plan = F.broadcast(plan)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = self.filed.join(plan, "leaf").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("bs")).cast("int")).withColumn("c", every("qs")).select("leaf", "b", "c", "vec_id", "embedding")
        qs = asked.join(plan, "leaf").withColumn("c", F.pmod(F.xxhash64("query_id"), F.col("qs")).cast("int")).withColumn("b", every("bs")).select("leaf", "b", "c", "query_id", "q")

        def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
            m, vec, parts = _matrix(left["embedding"]), left["vec_id"].to_numpy(), []
            for query, q in zip(right["query_id"], right["q"]):
                d = _distances(np.asarray(q, dtype=np.float64), m)
                d[vec == query] = np.inf
                at = _top(d, vec, k)
                at = at[np.isfinite(d[at])]
                parts.append(pd.DataFrame({"query_id": query, "vec_id": vec[at], "score": d[at]}))
            return pd.concat(parts)

        keys = ["leaf", "b", "c"]
        found = rows.groupBy(*keys).cogroup(qs.groupBy(*keys)).applyInPandas(nearest, out)
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return Index(vectors).search(vectors.filter(F.col("vec_id") % 100 == 0))


QUERIES = {"op6_ann_tree": op6_ann_tree}
