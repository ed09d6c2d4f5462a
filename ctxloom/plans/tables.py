"""Queries of stored tables and of the session's functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxloom.functions import session
from ctxloom.functions import vocabulary as V
from ctxloom.operators.blocks import BlockIndex
from ctxloom.plans.registry import query, read
from ctxloom.sources.tables import new_folder
from ctxloom.sources.vectors import VectorTable


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE CAST(label AS VARCHAR) END AS label, round(CASE WHEN vec_id % 5 = 0 THEN -CAST(embedding[1] AS DOUBLE) ELSE CAST(embedding[1] AS DOUBLE) END, 6) AS first FROM embeddings WHERE vec_id % 7 <> 0")
def vector_upserts(spark, d):
    """All vectors, then a batch that renews every fifth and deletes every seventh of them; both batches come twice."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("n"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.col("label").cast("string").alias("label"))
    first = e.select("id", "vector", F.create_map(F.lit("label"), F.col("label")).alias("metadata"), F.lit(1).cast("long").alias("seq"), F.lit(False).alias("deleted"))
    later = e.where("n % 5 = 0 OR n % 7 = 0").select("id", F.transform("vector", lambda x: -x).alias("vector"), F.create_map(F.lit("label"), F.lit("new")).alias("metadata"), F.lit(2).cast("long").alias("seq"), (F.col("n") % 7 == 0).alias("deleted"))
    table = VectorTable(spark, new_folder(spark, "vectors"))
    for batch, rows in ((0, first), (1, later), (0, first), (1, later)):
        table.upsert(rows, batch)
    return table.rows().select("id", F.col("metadata")["label"].alias("label"), F.round(F.get("vector", F.lit(0)), 6).alias("first"))


_LEAD = "substring(text, 1, 200)"
_SQL_TOKENS = "list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z]+'), lambda x: lower(x)))"
_STOP = "[" + ", ".join(f"'{w}'" for w in V.ENTAILMENT_STOPWORDS) + "]"


@query(
    f"WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT doc_id, text, list_filter({_SQL_TOKENS.format('text')}, lambda w: NOT list_contains({_STOP}, w)) AS p, list_filter({_SQL_TOKENS.format(_LEAD)}, lambda w: NOT list_contains({_STOP}, w)) AS h FROM t) "
    "SELECT doc_id, CASE WHEN len(p) > 0 AND len(h) > 0 AND len(list_intersect(p, h)) >= 0.3 * len(h) THEN 1.0 ELSE 0.2 END AS entails, 0.0 AS contradicts, CASE WHEN len(regexp_extract_all(lower(text), '[a-z0-9.]+')) = 0 THEN 0.0 ELSE 1.0 END AS itself FROM c"
)
def session_functions(spark, d):
    """One query in Spark SQL, over all documents, by the functions that are registered with the session."""
    session.register(spark)
    read(spark, d, "documents").createOrReplaceTempView("ctx_documents")
    return spark.sql(f"""
        SELECT doc_id, ctx_entails(text, {_LEAD}) AS entails, ctx_contradicts(text, {_LEAD}) AS contradicts, round(coalesce(ctx_cosine(v, v), 0.0D), 6) AS itself
        FROM (SELECT doc_id, text, ctx_embed(text) AS v FROM ctx_documents)""")


@query(
    "WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT query_id, vec_id AS id, list_distance(q, CAST(embedding AS DOUBLE[])) AS distance FROM q, embeddings) "
    "SELECT query_id, id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS INT) AS rank FROM d QUALIFY rank <= 10"
)
def topk_blocks(spark, d):
    """The ten nearest rows of every twentieth vector among all, exactly, without reading the blocks that the triangle inequality rules out."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = BlockIndex.build(e, 64).search(e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query")), 10)
    return found.withColumn("distance", F.round("distance", 6))
