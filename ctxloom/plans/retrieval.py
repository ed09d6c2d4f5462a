"""Queries of vectors and texts over the driver tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxloom.functions import text as T
from ctxloom.functions import vector as X
from ctxloom.functions import vocabulary as V
from ctxloom.operators import retrieval as R
from ctxloom.plans.registry import query, read, values

_STOP = ", ".join(f"'{w}'" for w in V.COMMON_WORDS)
#: Portable words of ASCII letters between Unicode word boundaries, for DuckDB, whose own \b knows ASCII only.
TERMS_SQL = rf"list_filter(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{4,}}'))), lambda w: w NOT IN ({_STOP}))"
#: Capitalised phrases of ASCII words; signs are doubled first, so that one can end a phrase and another begin the next.
PHRASES_SQL = (
    r"list_transform(regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_\s])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)(?:$|[^\p{L}\p{N}_])', 1), lambda x: lower(x))"
)
ENTITIES_SQL = f"list_distinct(list_concat({PHRASES_SQL}, {TERMS_SQL}))"
_SIM = "list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[]))"
_QUERIES = "SELECT * FROM embeddings WHERE vec_id % 20 = 0"


def _vectors(spark, d):
    e = read(spark, d, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(f"SELECT q.vec_id AS query_id, d.vec_id AS id, round({_SIM}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, d.vec_id) AS rank FROM ({_QUERIES}) q, embeddings d QUALIFY rank <= 10")
def topk_similar(spark, d):
    return R.top_similar(*_vectors(spark, d), k=10).withColumn("score", F.round("score", 6))


@query(
    f"SELECT q.vec_id AS query_id, d.vec_id AS id, round({_SIM}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, d.vec_id) AS rank "
    f"FROM ({_QUERIES}) q, embeddings d WHERE d.label <> q.label QUALIFY rank <= 5"
)
def topk_excluding(spark, d):
    e = read(spark, d, "embeddings")
    c = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("group"))
    q = c.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"), "group")
    return R.top_similar(q, c, k=5, apart=True).withColumn("score", F.round("score", 6))


@query(f"SELECT q.vec_id AS query_id, round(greatest(0, max({_SIM})), 6) AS max_similarity FROM ({_QUERIES}) q, embeddings d WHERE q.vec_id <> d.vec_id GROUP BY q.vec_id")
def max_similarity_gate(spark, d):
    return R.max_similarity(*_vectors(spark, d)).withColumn("max_similarity", F.round("max_similarity", 6))


@query(
    "SELECT label, round(avg(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS mean_square, count(*) AS n FROM embeddings GROUP BY label"
)
def vector_norms(spark, d):
    v = X.double(F.col("embedding"))
    return read(spark, d, "embeddings").groupBy("label").agg(F.round(F.avg(X.dot(v, v)), 6).alias("mean_square"), F.count(F.lit(1)).alias("n"))


@query(
    f"WITH top AS (SELECT q.vec_id AS query_id, q.label AS ql, d.vec_id AS id, d.label AS dl FROM ({_QUERIES}) q, embeddings d WHERE q.vec_id <> d.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, d.vec_id) <= 10), "
    "r AS (SELECT q.vec_id AS query_id, count(*) AS n FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id GROUP BY q.vec_id) "
    "SELECT query_id, count(*) FILTER (WHERE ql = dl) / 10.0 AS precision, round(coalesce(count(*) FILTER (WHERE ql = dl) / min(n), 0), 6) AS recall FROM top LEFT JOIN r USING (query_id) GROUP BY query_id"
)
def retrieval_precision_recall(spark, d):
    e = read(spark, d, "embeddings")
    q, c = _vectors(spark, d)
    found = R.top_similar(q, c, k=10, own=False).select("query_id", "id")
    labels = e.select(F.col("vec_id").alias("id"), F.col("label").alias("group"))
    asked = labels.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    return R.group_quality(found, asked, labels).select("query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"WITH t AS (SELECT unnest({ENTITIES_SQL}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, round(ln(min(n) / count(*)), 6) AS idf FROM t, n GROUP BY term")
def doc_frequency_idf(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.document_frequency(docs).withColumn("idf", F.round("idf", 6))


@query(
    f"WITH t AS (SELECT doc_id, unnest({ENTITIES_SQL}) AS term FROM documents), f AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM documents) "
    "SELECT doc_id, term, round(ln(n / df), 6) AS idf, row_number() OVER (PARTITION BY doc_id ORDER BY df, term) AS rank FROM t JOIN f USING (term), n QUALIFY rank <= 3"
)
def distinctive_terms(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    from pyspark.sql import Window

    own = docs.select(F.col("id").alias("doc_id"), F.explode(T.entities(F.col("text"))).alias("term")).join(R.document_frequency(docs), "term")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "term"))
    return own.withColumn("rank", rank).where("rank <= 3").select("doc_id", "term", F.round("idf", 6).alias("idf"), "rank")


_BM25 = (
    "WITH tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9.]+') AS w FROM documents), tot AS (SELECT count(*) AS n, avg(len(w)) AS al FROM tok), "
    "tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    "raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, tot), m AS (SELECT avg(raw) AS mean FROM raw), idf AS (SELECT term, CASE WHEN raw < 0 THEN mean * 0.25 ELSE raw END AS idf FROM raw, m), "
    "q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9.]+')) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY ALL), "
    "s AS (SELECT item_id AS query_id, doc_id AS id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))) AS score FROM tf JOIN idf USING (term) JOIN q USING (term), tot GROUP BY ALL), "
    "b AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) "
)


def _asked(spark, d):
    return read(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


@query(_BM25 + "SELECT query_id, id, round(score, 5) AS score, rank FROM b WHERE rank <= 10")
def bm25_topk(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.bm25(docs, _asked(spark, d)).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


def _lexical_dense(spark, d):
    """A second ranking to fuse: token-set overlap of the same queries with documents, by Jaccard similarity."""
    from pyspark.sql import Window

    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), T.token_set(F.col("text")).alias("t"))
    asked = _asked(spark, d).select("query_id", T.token_set(F.col("text")).alias("q"))
    one = docs.select("id", F.size("t").alias("n"), F.explode("t").alias("w")).join(asked.select("query_id", F.size("q").alias("m"), F.explode("q").alias("w")), "w")
    s = one.groupBy("query_id", "id").agg((F.count(F.lit(1)) / (F.first("n") + F.first("m") - F.count(F.lit(1)))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
    return s.withColumn("rank", rank).where("rank <= 50")


_DENSE = (
    ", ds AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x))) AS t FROM documents), "
    "dq AS (SELECT item_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x))) AS q FROM benchmark WHERE item_id % 20 = 0), "
    "j AS (SELECT item_id AS query_id, doc_id AS id, len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q))) AS score FROM ds, dq WHERE len(list_intersect(t, q)) > 0), "
    "jr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM j) "
)


@query(_BM25 + _DENSE + "SELECT query_id, id, round(score, 6) AS score, rank FROM jr WHERE rank <= 10")
def jaccard_topk(spark, d):
    return _lexical_dense(spark, d).where("rank <= 10").withColumn("score", F.round("score", 6))


@query(
    _BM25 + _DENSE + ", fu AS (SELECT query_id, id, a.rank AS sr, c.rank AS dr, coalesce(0.5 / (59 + a.rank), 0) + coalesce(0.5 / (59 + c.rank), 0) AS rrf FROM (SELECT * FROM b WHERE rank <= 50) a "
    "FULL JOIN (SELECT * FROM jr WHERE rank <= 50) c USING (query_id, id)) SELECT query_id, id, sr AS sparse_rank, dr AS dense_rank, round(rrf, 6) AS rrf_score, "
    "row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, id) AS rank FROM fu QUALIFY rank <= 5"
)
def rrf_fuse(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    fused = R.fuse(R.bm25(docs, _asked(spark, d), k=50), _lexical_dense(spark, d))
    return fused.select("query_id", "id", "sparse_rank", "dense_rank", F.round("rrf_score", 6).alias("rrf_score"), "rank")


_ALPHA = ", al AS (SELECT unnest([0.0, 0.5, 1.0]) AS alpha), fa AS (SELECT CAST(alpha AS DOUBLE) AS alpha, query_id, id, coalesce((1 - alpha) / (59 + a.rank), 0) + coalesce(alpha / (59 + c.rank), 0) AS rrf FROM (SELECT * FROM b WHERE rank <= 50) a FULL JOIN (SELECT * FROM jr WHERE rank <= 50) c USING (query_id, id), al) "


@query(_BM25 + _DENSE + _ALPHA + "SELECT alpha, query_id, id, round(rrf, 6) AS rrf_score, row_number() OVER (PARTITION BY alpha, query_id ORDER BY round(rrf, 9) DESC, id) AS rank FROM fa QUALIFY rank <= 5")
def compare_alpha(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    out = R.compare_alphas(R.bm25(docs, _asked(spark, d), k=50), _lexical_dense(spark, d))
    return out.select("alpha", "query_id", "id", F.round("rrf_score", 6).alias("rrf_score"), "rank")


_CO = values("docs", ("id", "entities"), [(1, ["acme", "bolt", "crane"]), (2, ["acme", "bolt"]), (3, ["crane", "dock"]), (4, ["solo"]), (5, ["bolt", "acme", "dock"])])


@query("WITH " + _CO.sql + ", e AS (SELECT id, unnest(entities) AS e FROM docs) SELECT x.e AS a, y.e AS b, count(*) AS weight FROM e x JOIN e y ON x.id = y.id AND x.e < y.e GROUP BY ALL")
def cooccurrence_graph(spark, d):
    return R.cooccurrence(_CO.frame(spark))


@query("SELECT text, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return read(spark, d, "documents").groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
