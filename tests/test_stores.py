"""Stored vectors, CSV rows in order, the session's functions, contexts of matches, and search by Parzen estimators."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.functions import session
from ctxloom.functions import text as T
from ctxloom.functions import vocabulary as V
from ctxloom.operators import search
from ctxloom.sources import corpus, vectors


def _rows(spark, rows):
    return spark.createDataFrame([(i, [float(x)], {"k": str(x)}, s, d) for i, x, s, d in rows], vectors.ROW)


def _there(table):
    return {r.id: r.vector[0] for r in table.rows().collect()}


def test_upserts(spark, tmp_path):
    table = vectors.VectorTable(spark, str(tmp_path), buckets=4)
    assert _there(table) == {}
    table.upsert(_rows(spark, [("a", 1, 1, False), ("b", 2, 1, None), ("b", 3, 2, False), ("c", 4, 1, False)]), 0)
    assert _there(table) == {"a": 1.0, "b": 3.0, "c": 4.0}
    table.upsert(_rows(spark, [("b", 9, 1, False), ("c", 5, 2, True), ("d", 6, 1, False)]), 1)  # b's is older, c is deleted
    want = {"a": 1.0, "b": 3.0, "d": 6.0}
    assert _there(table) == want
    before = table.commits().count()
    table.upsert(_rows(spark, [("a", 100, 9, False)]), 1)  # the batch has been
    table.upsert(_rows(spark, []), 2)
    assert _there(vectors.VectorTable(spark, str(tmp_path), buckets=4)) == want and table.commits().count() == before + 1
    table.upsert(_rows(spark, [("c", 7, 1, False)]), 3)  # older than its deletion
    assert _there(table) == want


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = vectors.VectorTable(spark, str(tmp_path), buckets=8)
    table.upsert(_rows(spark, [(f"id{k}", k, 1, False) for k in range(60)]), 0)
    table.upsert(_rows(spark, [("id7", 700, 2, False)]), 1)
    assert table.commits().where("batch = 1").count() == 1 and table.commits().where("batch = 0").count() == 8
    assert _there(table) == {f"id{k}": 700.0 if k == 7 else float(k) for k in range(60)}


def test_a_batch_that_failed_half_way(spark, tmp_path):
    table = vectors.VectorTable(spark, str(tmp_path), buckets=2)
    table.upsert(_rows(spark, [("a", 1, 1, False)]), 0)
    # Data of batch 1 without its commit.
    _rows(spark, [("a", 50, 5, False)]).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")).write.partitionBy("bucket").parquet(f"{tmp_path}/data/1")
    assert _there(table) == {"a": 1.0}
    table.upsert(_rows(spark, [("a", 2, 2, False)]), 1)
    assert _there(table) == {"a": 2.0}


def test_stream_of_upserts(spark, tmp_path):
    for k, rows in enumerate([[("a", 1, 1, False), ("b", 2, 1, False)], [("a", 3, 2, False)], [("b", 0, 3, True)]]):
        _rows(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    table = vectors.VectorTable(spark, f"{tmp_path}/t", buckets=4)
    source = spark.readStream.schema(vectors.ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    table.start(source, f"{tmp_path}/cp", once=True).awaitTermination()
    assert _there(table) == {"a": 3.0} and {r.batch for r in table.commits().collect()} == {0, 1, 2}


def test_csv_rows_in_order_over_splits(spark, tmp_path):
    """Many splits of one file: row numbers are those of the file, and repeated ids get their suffix in its order."""
    path = tmp_path / "rows.csv"
    path.write_text("id,text\n" + "".join(f"{'' if k % 3 else 'same'},text of row {k:05d}\n" for k in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = corpus.read_csv_corpus(spark, str(path), multi_line=False)
        assert spark.read.csv(str(path)).rdd.getNumPartitions() > 1
        got = {r.text: r.id for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    same = 0
    for k in range(3000):
        want = f"row_{k + 1}" if k % 3 else "same" if k == 0 else f"same_{k // 3}"
        same += k % 3 == 0
        assert got[f"text of row {k:05d}"] == want


def test_csv_headers(spark, tmp_path):
    named, bare, empty = tmp_path / "a.csv", tmp_path / "b.csv", tmp_path / "c.csv"
    named.write_text("doc_id,title,age\nx1,First,10\nx2,Second,20\nx3,Third,30\n")
    bare.write_text("11,12,13\n21,22,23\n31,32,33\n")
    empty.write_text("id,text\n,\n , \n")
    assert corpus.has_header(spark, str(named)) and not corpus.has_header(spark, str(bare))
    assert [(r.id, r.title) for r in corpus.read_csv_corpus(spark, str(named), None).orderBy("id").collect()] == [("x1", "First"), ("x2", "Second"), ("x3", "Third")]
    assert [(r.id, r.text) for r in corpus.read_csv_corpus(spark, str(bare), None).orderBy("id").collect()] == [("row_1", "11 | 12 | 13"), ("row_2", "21 | 22 | 23"), ("row_3", "31 | 32 | 33")]
    with pytest.raises(ValueError):
        corpus.read_csv_corpus(spark, str(empty), header=True)


def test_flags_with_free_contexts(spark):
    """The rule over random texts, where contexts overlap and reach into other matches; characters beyond 16 bits count once."""
    r = random.Random(4)
    parts = ["subject to ", "notwithstanding ", "NOTWITHSTANDING the foregoing ", "excluding ", "plain words ", "é日𝄞 ", "\n", "in no event shall ", "unless otherwise agreed "]
    texts = [(k, "".join(r.choice(parts) for _ in range(r.randrange(40)))) for k in range(60)] + [(99, "notwithstanding " * 400), (100, "")]
    got = {}
    for x in spark.createDataFrame(texts, "id long, text string").select("id", F.posexplode(T.contradiction_flags(F.col("text"))).alias("k", "f")).collect():
        got.setdefault(x.id, []).append((x.k, x.f.indicator, x.f.snippet))
    for i, t in texts:
        want = [(m[0], t[max(0, m.start() - 30) : m.end() + 50].strip()) for p in V.QUALIFIERS for m in re.finditer(p, t, re.I)]
        assert [(a, b) for _, a, b in sorted(got.get(i, []))] == want, i


def test_functions_are_exchanged_by_name(spark):
    session.register(spark)
    text = "SELECT ctx_entails('the fee is due', 'fee due') AS e, ctx_contradicts('a', 'b') AS c, ctx_parse('The Fees are payable, Fees') AS p, size(ctx_embed('a b')) AS n"
    row = spark.sql(text).first()
    assert (row.e, row.c, row.n) == (1.0, 0.0, 256) and row.p == ["fees", "payable"]
    session.register(spark, {"ctx_contradicts": ("a STRING, b STRING", "DOUBLE", "CASE WHEN a <> b THEN 0.5D ELSE 0.0D END"), "ctx_embed": lambda s: s.map(lambda t: [float(len(t))])})
    row = spark.sql(text).first()
    assert (row.c, row.n) == (0.5, 1)
    with pytest.raises(ValueError):
        session.register(spark, {"ctx_unknown": ("a STRING", "STRING", "a")})
    session.register(spark)
    plan = spark.sql("SELECT ctx_entails(text, 'x') AS e FROM VALUES ('a') t(text)")._jdf.queryExecution().toString()
    assert "Python" not in plan  # the optimizer takes SQL functions in


def test_parzen_beats_random():
    """On two known surfaces, of equal numbers of trials, in the mean over seeds; error rows are left out."""
    space = {"x": (-2.0, 2.0), "y": (0.0, 10.0)}
    surfaces = [lambda t: -((t["x"] - 0.7) ** 2) - ((t["y"] - 3) / 5) ** 2, lambda t: np.exp(-((t["x"] + 1) ** 2) * 8) + 0.3 * np.exp(-((t["y"] - 8) ** 2))]
    for f in surfaces:
        best = {}
        for method in ("parzen", "random"):
            best[method] = np.mean([max(r for _, r in search.search(lambda b: [float(f(t)) for t in b], space, 8, 6, seed, method)) for seed in range(20)])
        assert best["parzen"] > best["random"]
    failing = search.search(lambda b: [None if t["x"] < 0 else float(surfaces[0](t)) for t in b], space, 6, 6, 3)
    assert len(failing) == 36 and max(r for _, r in failing if r is not None) > -0.1
    again = search.search(lambda b: [None if t["x"] < 0 else float(surfaces[0](t)) for t in b], space, 6, 6, 3)
    assert again == failing and all(-2 <= t["x"] <= 2 and 0 <= t["y"] <= 10 for t, _ in failing)
