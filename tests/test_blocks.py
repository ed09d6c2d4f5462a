"""Exact search in blocks: as a comparison with every row, with fewer rows looked at where vectors lie in clusters."""

import numpy as np
from pyspark.sql import functions as F

from ctxloom.operators.blocks import BlockIndex


def _vectors(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")


def _nearest(x, q, k):
    d = np.sqrt(((x - q) ** 2).sum(1))
    order = np.lexsort([np.arange(len(x)), d])[:k]
    return [(int(i), float(d[i])) for i in order]


def _check(spark, x, queries, k, blocks):
    index = BlockIndex.build(_vectors(spark, x), blocks)
    asked = spark.createDataFrame([(j, q.tolist()) for j, q in enumerate(queries)], "query_id long, query array<double>")
    got = {}
    for r in index.search(asked, k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.distance))
    for j, q in enumerate(queries):
        have = sorted(got[j])
        want = _nearest(x, q, k)
        assert [i for _, i, _ in have] == [i for i, _ in want] and np.allclose([d for *_, d in have], [d for _, d in want])
    return index, asked


def test_clusters_fall_away(spark):
    r = np.random.default_rng(1)
    centres = r.normal(0, 10, (12, 6))
    x = np.concatenate([c + r.normal(0, 0.3, (80, 6)) for c in centres])
    queries = x[::97] + 0.01
    index, asked = _check(spark, x, queries, 5, 30)
    assert index.rows_looked_at(asked, 5) < 0.4 * len(x) * len(queries)
    assert index.heads.agg(F.sum("rows")).first()[0] == len(x)


def test_without_clusters_it_is_exact_too(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 16))
    x[50] = x[51] = x[52]  # ties go to the smaller id
    _check(spark, x, np.concatenate([x[50:51], r.normal(size=(6, 16))]), 7, 9)


def test_few_rows_and_nulls(spark):
    x = np.eye(4)
    _check(spark, x, np.ones((1, 4)), 10, 3)
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, vector array<double>")
    index = BlockIndex.build(rows, 4)
    asked = spark.createDataFrame([(7, [0.0, 0.0]), (8, None)], "query_id long, query array<double>")
    assert [(r.query_id, r.id, r.distance) for r in index.search(asked, 3).collect()] == [(7, 1, 1.0)]
    assert BlockIndex.build(rows.limit(0), 4).search(asked, 3).count() == 0
