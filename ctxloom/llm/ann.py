"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on the driver from a bounded sample (``max_sample`` vectors) and sent to the tasks; every row is put in
its leaf. A query descends the tree through a priority queue of branches by distance, and visits leaves, nearest first,
as many as a calibration on the sample needs for the wanted recall. Rows and queries meet in buckets of leaves; large leaves
are split among buckets, and buckets of many queries are repeated, so a task holds a block of each. Distances are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.llm._common import table

MAX_SAMPLE = 40_000
BRANCHES = 16
#: Sample vectors of a leaf, at most; more only where they are equal.
LEAF_SIZE = 64
#: Rows and queries of a bucket of leaves that meet in one task; and the least number of buckets.
ROW_BLOCK, VISIT_BLOCK, LEAST_BUCKETS = 20_000, 2_000, 12


@dataclass
class Tree:
    """children[n] are node numbers with their centroids; a node without children is leaf number leaf[n]."""

    children: list[list[int]] = field(default_factory=list)
    centroids: list[np.ndarray | None] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    n_leaves: int = 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            near = _distances(x[rows], self.centroids[node]).argmin(1)
            todo += [(child, rows[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    def visit(self, q: np.ndarray, n: int) -> list[int]:
        """The first n leaves, best bin first."""
        heap, out = [(0.0, 0)], []
        while heap and len(out) < n:
            _, node = heapq.heappop(heap)
            while self.children[node]:
                d = ((self.centroids[node] - q) ** 2).sum(1)
                best = int(d.argmin())
                for k, child in enumerate(self.children[node]):
                    if k != best:
                        heapq.heappush(heap, (float(d[k]), child))
                node = self.children[node][best]
            out.append(self.leaf[node])
        return out


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None], 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from random rows; centroids that get no rows are dropped."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        used, near = np.unique(near, return_inverse=True)
        sums = np.zeros((len(used), x.shape[1]))
        np.add.at(sums, near, x)
        c = sums / np.bincount(near)[:, None]
    return c


def build(x: np.ndarray, branches: int = BRANCHES, leaf_size: int = LEAF_SIZE, seed: int = 5) -> Tree:
    """A tree over the distinct rows of x."""
    tree, rng = Tree(), np.random.default_rng(seed)

    def add(rows: np.ndarray) -> int:
        node = len(tree.children)
        tree.children.append([])
        tree.centroids.append(None)
        tree.leaf.append(-1)
        if len(rows) > leaf_size:
            c = _kmeans(x[rows], min(branches, -(-len(rows) // leaf_size)), rng)
            near = _distances(x[rows], c).argmin(1)
            used = np.unique(near)
            if len(used) > 1:
                tree.centroids[node] = c[used]
                tree.children[node] = [add(rows[near == k]) for k in used]
                return node
        tree.leaf[node] = tree.n_leaves
        tree.n_leaves += 1
        return node

    x = np.unique(x, axis=0)
    add(np.arange(len(x)))
    return tree


def _nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row id, distance) of the k nearest rows of each query, without rows of its own id; ties to smaller ids.

    A product of matrices picks the candidates with a margin beyond its rounding; their distances are then taken from
    differences in double precision.
    """
    d = _distances(q, x)
    d[q_ids[:, None] == ids[None]] = np.inf
    worst = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else d.max(1, initial=0)
    scale = (q * q).sum(1) + float((x * x).sum(1).max(initial=0))
    at_q, at_x = np.nonzero(np.isfinite(d) & (d <= np.where(np.isfinite(worst), worst, np.inf)[:, None] + 1e-9 * scale[:, None]))
    exact = np.empty(len(at_q))
    for lo in range(0, len(at_q), 65_536):
        part = slice(lo, lo + 65_536)
        exact[part] = np.sqrt(((q[at_q[part]] - x[at_x[part]]) ** 2).sum(1))
    order = np.lexsort([ids[at_x], exact, at_q])
    at_q, found, exact = at_q[order], ids[at_x][order], exact[order]
    rank = np.arange(len(at_q)) - np.searchsorted(at_q, at_q)
    return at_q[rank < k], found[rank < k], exact[rank < k]


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float, n_queries: int = 200) -> int:
    """The least number of leaves to visit for the wanted recall of queries from the sample against the whole sample."""
    x = np.unique(x, axis=0)
    step = max(1, len(x) // n_queries)
    ids, q_ids = np.arange(len(x)), np.arange(0, len(x), step)[:n_queries]
    at, found, _ = _nearest(x[q_ids], q_ids, x, ids, k)
    leaf = tree.assign(x)
    place = np.empty(len(found), np.int64)
    for n, row in enumerate(q_ids):
        order = np.empty(tree.n_leaves, np.int64)
        order[tree.visit(x[row], tree.n_leaves)] = np.arange(tree.n_leaves)
        place[at == n] = order[leaf[found[at == n]]]
    if not len(place):
        return tree.n_leaves
    return int(np.sort(place)[max(0, int(np.ceil(recall * len(place))) - 1)]) + 1


def _deal(sizes: np.ndarray, buckets: int) -> list[list[int]]:
    """The buckets of each leaf: the emptiest first, the largest leaves first; a leaf of several shares goes to several."""
    share = max(1.0, sizes.sum() / buckets)
    heap = [(0.0, b) for b in range(buckets)]
    out: list[list[int]] = [[] for _ in sizes]
    for leaf in np.argsort(-sizes, kind="stable"):
        parts = min(buckets, max(1, int(np.ceil(sizes[leaf] / share))))
        taken = [heapq.heappop(heap) for _ in range(parts)]
        for filled, b in taken:
            out[leaf].append(b)
            heapq.heappush(heap, (filled + sizes[leaf] / parts, b))
    return out


def usable(column: Column, dims: int | None = None) -> Column:
    """True for vectors that take part: not null, no null or non-finite components, not zero (and of ``dims`` dimensions)."""
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ok = column.isNotNull() & finite & F.exists(column, lambda v: v != 0)
    return F.coalesce(ok if dims is None else ok & (F.size(column) == dims), F.lit(False))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.97, id_column: str = "vec_id", vector: str = "embedding", max_sample: int = MAX_SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance in double precision) of each query's k nearest found rows.

    ``recall`` is reached on the sample, where neighbours are farther than among all rows. Vectors that are null, zero, or
    hold null or non-finite components take no part, nor do rows without an id, or of another number of dimensions than
    most of the sample. A query's own id is no candidate; rows that repeat an id or vector are candidates each; of queries
    that repeat an id the one with the least vector counts. An empty table gives no rows, fewer candidates than k all of
    them; further columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    asked = queries.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    n, n_asked = rows.agg(F.count(F.lit(1))).first()[0], asked.agg(F.count(F.lit(1))).first()[0]
    schema = "query_id long, rank int, vec_id long, score double"
    if not n or not n_asked:
        return spark.createDataFrame([], schema)
    share = min(1.0, max_sample / n)
    picked = rows if share == 1.0 else rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(share * (1 << 30)))
    taken = picked.select("v").limit(2 * max_sample).toPandas()["v"]
    if not len(taken):
        taken = rows.select("v").limit(max_sample).toPandas()["v"]
    sizes = taken.map(len)
    dims = int(sizes.value_counts().index[0])
    sample = np.stack(taken[sizes == dims].to_list())
    tree = build(sample)
    visits = calibrate(tree, sample, k, recall)
    # How many rows and visits each leaf will have, from the sample: leaves go to buckets of about equal rows, the largest
    # first; one with more rows than a bucket should have is split among several.
    per_leaf = np.bincount(tree.assign(sample), minlength=tree.n_leaves) * (n / len(sample))
    buckets = max(LEAST_BUCKETS, int(np.ceil(n / ROW_BLOCK)))
    homes = _deal(per_leaf, buckets)
    probes = sample[:: max(1, len(sample) // 1000)]
    reach = np.zeros(buckets)
    for p in probes:
        reach[sorted({h for leaf in tree.visit(p, visits) for h in homes[leaf]})] += n_asked / len(probes)
    visit_parts = np.maximum(1, np.ceil(reach / VISIT_BLOCK)).astype(np.int64)
    sent = spark.sparkContext.broadcast((tree, homes, visit_parts))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows by bucket, once for each part of the bucket's queries."""
        tree, homes, visit_parts = sent.value
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["v"].to_list())
            leaf = tree.assign(x)
            bucket = np.array([homes[k][i % len(homes[k])] for i, k in enumerate(leaf.tolist())], np.int64)
            times = visit_parts[bucket]
            at = np.repeat(np.arange(len(b)), times)
            part = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            yield pd.DataFrame({"bucket": bucket[at], "part": part, "vec_id": b["vec_id"].to_numpy()[at], "v": list(x[at]), "leaves": [[k] for k in leaf[at].tolist()]})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries by bucket, with the leaves to visit there."""
        tree, homes, visit_parts = sent.value
        for b in batches:
            rows = []
            for q, name in zip(b["v"], b["vec_id"], strict=True):
                wanted: dict[int, list[int]] = {}
                for leaf in tree.visit(np.asarray(q), visits):
                    for home in homes[leaf]:
                        wanted.setdefault(home, []).append(leaf)
                rows += [(home, name // 100 % int(visit_parts[home]), name, q, leaves) for home, leaves in wanted.items()]
            yield pd.DataFrame(rows, columns=["bucket", "part", "vec_id", "v", "leaves"])

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(left) or not len(right):
            return none
        x, ids, leaf = np.stack(left["v"].to_list()), left["vec_id"].to_numpy(), left["leaves"].map(lambda v: v[0]).to_numpy()
        order = np.argsort(leaf, kind="stable")
        x, ids, leaf = x[order], ids[order], leaf[order]
        q, q_ids = np.stack(right["v"].to_list()), right["vec_id"].to_numpy()
        asked: dict[int, list[int]] = {}
        for i, leaves in enumerate(right["leaves"]):
            for k in leaves:
                asked.setdefault(int(k), []).append(i)
        out = [none]
        for k, who in asked.items():
            lo, hi = np.searchsorted(leaf, k), np.searchsorted(leaf, k, "right")
            for j in range(0, len(who) if hi > lo else 0, 128):
                w = np.array(who[j : j + 128])
                at, found, score = _nearest(q[w], q_ids[w], x[lo:hi], ids[lo:hi], k_nearest)
                out.append(pd.DataFrame({"query_id": q_ids[w][at], "vec_id": found, "score": score}))
        near = pd.concat(out).sort_values(["query_id", "score", "vec_id"], kind="stable")
        return near[near.groupby("query_id").cumcount() < k_nearest]

    k_nearest = k
    keyed = "bucket long, part long, vec_id long, v array<double>, leaves array<long>"
    sized = lambda df: df.where(F.size("v") == dims)
    placed = sized(rows).mapInPandas(place, keyed).groupBy("bucket", "part")
    probes_ = sized(asked).groupBy("vec_id").agg(F.min("v").alias("v")).mapInPandas(probe, keyed).groupBy("bucket", "part")
    near = placed.cogroup(probes_).applyInPandas(meet, "query_id long, vec_id long, score double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    """op2_ann."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
