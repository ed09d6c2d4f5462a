"""Exact nearest neighbours with pruning: vectors are stored in blocks about centres, and a block is read for a query only if it can hold a near one.

The distance of a query to a block's centre, less the block's radius, is the least that any of its rows can have. A query first meets
the blocks whose centres are nearest; the k-th distance found there bounds what is left, and by the triangle inequality most blocks
fall away. What remains is compared in full, so the result is that of a comparison with every row. How much falls away depends on the
vectors: where there are no clusters, little does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions import vector as X
from ctxloom.operators.retrieval import QUERY_BLOCK, ROW_BLOCK, blocks_compared
from ctxloom.sources.tables import written

#: Rows that centres are drawn from, and their greatest number: what is sent to tasks is bounded by it.
SAMPLE, MOST_BLOCKS = 20_000, 2048


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def centres(vectors: DataFrame, blocks: int, rounds: int = 4, seed: int = 7) -> np.ndarray:
    """Centres by some rounds of Lloyd's method on a bounded sample, the rows with the least hashes of their ids."""
    rows = vectors.where("vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(X.double(F.col("vector")).alias("v")).toPandas()["v"]
    if not len(rows):
        return np.zeros((0, 0))
    x = np.stack(rows.to_list())
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(blocks, MOST_BLOCKS, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class BlockIndex:
    """Vectors (id, vector) by block, and one row for each block: block, centre, radius, rows."""

    def __init__(self, rows: DataFrame, heads: DataFrame):
        self.rows, self.heads = rows, heads

    @staticmethod
    def build(vectors: DataFrame, blocks: int = 64) -> BlockIndex:
        """Every row goes to its nearest centre; the table is written by block. Null vectors take no part."""
        c = centres(vectors, blocks)
        sent = vectors.sparkSession.sparkContext.broadcast(c)

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            c, x = sent.value, np.stack(v.to_list())
            return pd.Series(((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1))

        known = vectors.where("vector IS NOT NULL").select("id", X.double(F.col("vector")).alias("vector"))
        placed = known.withColumn("block", nearest("vector")) if len(c) else known.withColumn("block", F.lit(0))
        table = vectors.sparkSession.createDataFrame([(k, v.tolist()) for k, v in enumerate(c)], "block int, centre array<double>")  # at most MOST_BLOCKS
        placed = written(placed.join(F.broadcast(table), "block").withColumn("away", _distance(F.col("vector"), F.col("centre"))).drop("centre").repartition("block").sortWithinPartitions("block"))
        sizes = placed.groupBy("block").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("rows"))
        return BlockIndex(placed, written(table.join(sizes, "block")))

    def candidates(self, queries: DataFrame, k: int, first: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(looked, begun, left): what each query (query_id, query) has found in its nearest blocks, ``first`` of them or as many as hold k
        rows; the (query_id, block) of these; and those that are left after them by the bound."""
        asked = written(queries.where("query IS NOT NULL").select("query_id", X.double(F.col("query")).alias("query")))
        w = Window.partitionBy("query_id").orderBy("to_centre", "block")
        seen = F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1))
        bounds = asked.join(F.broadcast(self.heads), F.lit(True)).withColumn("to_centre", _distance(F.col("query"), F.col("centre")))  # at most MOST_BLOCKS a query
        # The nearest blocks, and as many more as k rows need.
        near = written(bounds.select("query_id", "block", "to_centre", "radius", "rows").withColumn("begin", (F.row_number().over(w) <= first) | (F.coalesce(seen, F.lit(0)) < k)))
        looked = self._compared(asked, near.where("begin"), k)
        worst = looked.groupBy("query_id").agg(F.max("distance").alias("worst"), F.count(F.lit(1)).alias("n"))
        left = near.where("NOT begin").join(worst, "query_id").where((F.col("n") < k) | (F.col("to_centre") - F.col("radius") <= F.col("worst") + 1e-9))
        return looked, near.where("begin").select("query_id", "block"), left.select("query_id", "block")

    def _compared(self, asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        # A block is cut into parts, and so are its queries; each part of both is one matrix product.
        sizes = self.heads.select("block", F.ceil(F.col("rows") / ROW_BLOCK).cast("int").alias("parts"))
        met = pairs.select("query_id", "block").join(asked, "query_id")
        busy = met.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("cuts")).join(sizes, "block")
        busy = F.broadcast(written(busy))  # at most MOST_BLOCKS
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = met.join(busy, "block").select("block", "query_id", "query", F.pmod(F.xxhash64("query_id"), F.col("cuts")).cast("int").alias("cut"), each("parts").alias("part"))
        two = self.rows.join(busy, "block").select("block", "id", "vector", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), each("cuts").alias("cut"))
        scored = blocks_compared(one, two, k, ("block", "cut", "part"), distance=True).withColumnRenamed("score", "distance")
        w = Window.partitionBy("query_id").orderBy("distance", "id")
        return written(scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, id, distance, rank of the k nearest rows, ties to the smaller id: those of a comparison with every row."""
        looked, _, left = self.candidates(queries, k)
        asked = queries.where("query IS NOT NULL").select("query_id", X.double(F.col("query")).alias("query"))
        both = looked.drop("rank").unionByName(self._compared(asked, left, k).drop("rank"))
        w = Window.partitionBy("query_id").orderBy("distance", "id")
        return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def rows_looked_at(self, queries: DataFrame, k: int = 10) -> int:
        """How many comparisons a search makes: the rows of all blocks that its queries meet."""
        _, begun, left = self.candidates(queries, k)
        return int(begun.unionByName(left).join(self.heads, "block").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
