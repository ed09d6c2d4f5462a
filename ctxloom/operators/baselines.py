"""Retrieval baselines and wrappers: dense retrieval, hybrid retrieval, a co-occurrence graph of entities, and TF-IDF vectors as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions import text as T
from ctxloom.functions import vector as X
from ctxloom.operators import retrieval as R
from ctxloom.operators.answering import Generator, template_generator
from ctxloom.sources.tables import written

#: From a text to its vector; another model is another function of a column.
Embedder = Callable[[Column], Column]


def embed_distinct(rows: DataFrame, embedder: Embedder = X.hashed_embedding, text: str = "text", vector: str = "embedding") -> DataFrame:
    """``rows`` with the vector of each text; equal texts are embedded once."""
    once = rows.select(F.col(text).alias("_t")).distinct().select("_t", embedder(F.col("_t")).alias(vector))
    return rows.join(once, F.col(text).eqNullSafe(F.col("_t")), "left").drop("_t")


def format_documents(hits: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """query_id and context: the texts of the hits (query_id, rank, text), in order of rank."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return hits.groupBy("query_id").agg(F.array_join(listed, separator).alias("context"))


def prompted(queries: DataFrame, context: DataFrame, model: Generator = template_generator) -> DataFrame:
    """query_id, context, prompt, prompt_length and answer; queries without hits have no context."""
    rows = queries.select("query_id", "text").join(context, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("No relevant context found.")))
    prompt = F.concat(F.lit("Use the following context to answer the question.\n\nContext:\n- "), F.regexp_replace("context", r"\s+", " "), F.lit("\n\nQuestion: "), F.col("text"), F.lit("\n\nAnswer:"))
    rows = rows.withColumn("prompt", prompt)
    return rows.select("query_id", "context", "prompt", F.length("prompt").alias("prompt_length"), model(F.col("prompt")).alias("answer"))


def dense_answers(queries: DataFrame, documents: DataFrame, k: int = 3, embedder: Embedder = X.hashed_embedding, model: Generator = template_generator) -> tuple[DataFrame, DataFrame]:
    """(hits, answers) of the plain baseline: the k nearest documents (id, text) of each query (query_id, text), and an answer from them."""
    vectors = embed_distinct(documents.select("id", "text"), embedder)
    asked = queries.select("query_id", embedder(F.col("text")).alias("query"))
    hits = R.top_similar(asked, vectors.select("id", F.col("embedding").alias("vector")), k).join(documents.select("id", "text"), "id")
    return hits.select("query_id", "id", "score", "rank", "text"), prompted(queries, format_documents(hits), model)


@dataclass(frozen=True)
class HybridRetriever:
    """BM25 and dense ranks, fused: alpha 0 is BM25 alone, 1 is dense alone."""

    top_k: int = 5
    alpha: float = 0.5
    depth: int = 50

    def retrieve(self, queries: DataFrame, documents: DataFrame, embedder: Embedder = X.hashed_embedding) -> DataFrame:
        """query_id, id, rrf_score and rank of the documents (id, text) for the queries (query_id, text)."""
        sparse = R.bm25(documents, queries, self.depth)
        vectors = embed_distinct(documents.select("id", "text"), embedder)
        dense = R.top_similar(queries.select("query_id", embedder(F.col("text")).alias("query")), vectors.select("id", F.col("embedding").alias("vector")), self.depth)
        return R.fuse(sparse, dense, self.alpha, k=self.top_k).select("query_id", "id", "rrf_score", "rank")


def by_area(hits: DataFrame, documents: DataFrame, area: str) -> DataFrame:
    """The hits whose document (id, area) is of an area."""
    return hits.join(documents.where(F.col("area") == area).select("id"), "id", "left_semi")


def neighbours(documents: DataFrame, query_entities: DataFrame, k: int = 5) -> DataFrame:
    """query_id, entity, neighbour, weight and rank: the k entities that share most documents with an entity of the query.

    ``documents`` are (id, entities), ``query_entities`` (query_id, entity). Only documents that hold an entity of a query are
    paired up, and only with these: the graph of all pairs is never built.
    """
    asked = query_entities.select("entity").distinct()
    each = documents.select("id", F.explode(F.array_distinct("entities")).alias("entity"))
    held = each.join(asked, "entity")
    beside = held.join(each.withColumnRenamed("entity", "neighbour"), "id").where("entity != neighbour")
    weights = beside.groupBy("entity", "neighbour").agg(F.count(F.lit(1)).alias("weight"))
    ranked = weights.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("weight"), "neighbour"))).where(F.col("rank") <= k)
    return query_entities.select("query_id", "entity").distinct().join(ranked, "entity").select("query_id", "entity", "neighbour", "weight", "rank")


def graph_documents(documents: DataFrame, query_entities: DataFrame, k: int = 5) -> DataFrame:
    """query_id, id and n: the documents that hold the query's entities or one of their neighbours, and how many of them."""
    near = neighbours(documents, query_entities, k).select("query_id", F.col("neighbour").alias("entity"))
    wanted = query_entities.select("query_id", "entity").unionByName(near).distinct()
    return documents.select("id", F.explode(F.array_distinct("entities")).alias("entity")).join(wanted, "entity").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), 0)


#: Terms that may be sent to all executors.
SENT_TERMS = 1_000_000


def _raw(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, term, raw) of all documents, and (term, idf). Texts are dealt by document once; counts are made where a document is, and the idf of
    terms is sent there, or joined where there are too many of them."""
    dealt = documents.select("id", "text").repartition("id")
    tf = dealt.select("id", F.explode(_words(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = documents.agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n), F.lit(True))  # n is one row
    idf = written(df.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))
    sent = F.broadcast(idf) if idf.limit(SENT_TERMS + 1).count() <= SENT_TERMS else idf
    return tf.join(sent, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("raw")), idf


def tfidf(documents: DataFrame) -> DataFrame:
    """id, term and weight of TF-IDF vectors of length 1, as rows: words of two signs or more, in lower case, idf ln((1 + N) / (1 + df)) + 1."""
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return _raw(documents)[0].select("id", "term", (F.col("raw") / length).alias("weight"))


#: Queries that may be sent to all executors, with at most SENT_TERMS weights in all; and what one task compares at a time beyond that.
SENT_QUERIES = 10_000
QUERY_BLOCK, ROW_BLOCK = 4_000, 50_000
#: Pairs of equal terms, and sums of queries and documents, that are held at once.
HELD = 4_000_000


def _scored_block(asked: pa.Table, docs: pa.Table | pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """query_id, id, score and place (the score in whole billionths): for each query of ``asked`` (query_id, number, q) the k best of ``docs``
    (id, numbers, weights) that share a term with it. Lists of equal terms meet, a few documents at a time, and their products are summed."""
    if not len(asked) or not len(docs):
        return
    names = asked["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    by = np.argsort(asked["number"].to_numpy(), kind="stable")
    query, q = names.indices.to_numpy()[by].astype(np.int64), asked["q"].to_numpy()[by]
    number, first, count = np.unique(asked["number"].to_numpy()[by], return_index=True, return_counts=True)
    flat = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (docs["id"], docs["numbers"], docs["weights"])]
    ids, sizes = flat[0], pc.list_value_length(flat[1]).to_numpy()
    terms, weights = (x.flatten().to_numpy() for x in flat[1:])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.minimum(np.searchsorted(number, terms), len(number) - 1)
    known = number[at] == terms
    owner, at, weights = owner[known], at[known], weights[known]
    pairs, n = np.concatenate([[0], np.cumsum(count[at])]), len(names.dictionary)
    begin = np.searchsorted(owner, np.arange(len(sizes) + 1))  # where each document's terms are
    order = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
    lo = 0
    while lo < len(sizes):
        most = np.searchsorted(pairs[begin], pairs[begin[lo]] + HELD, "right") - 1
        hi = int(min(len(sizes), max(lo + 1, min(most, lo + HELD // n))))
        part = slice(begin[lo], begin[hi])
        fan = count[at[part]]
        met = np.repeat(first[at[part]] - (np.cumsum(fan) - fan), fan) + np.arange(fan.sum())
        cell = query[met] * (hi - lo) + np.repeat(owner[part] - lo, fan)
        score = np.bincount(cell, np.repeat(weights[part], fan) * q[met], n * (hi - lo)).reshape(n, hi - lo).astype(float, copy=False)
        place = np.floor(score * 1e9 + 0.5)
        worst = np.partition(place, -k, axis=1)[:, -k] if hi - lo > k else np.zeros(n)
        one, doc = np.nonzero((score > 0) & (place >= worst[:, None]))
        found = np.lexsort([order[lo + doc], -place[one, doc], one])
        one, doc = one[found], doc[found]
        best = np.arange(len(one)) - np.searchsorted(one, one) < k
        one, doc = one[best], doc[best]
        yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(one)), ids.take(pa.array(lo + doc)), pa.array(score[one, doc]), pa.array(place[one, doc].astype(np.int64))], ["query_id", "id", "score", "place"])
        lo = hi


def tfidf_similar(documents: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, id, score and rank: the k documents nearest to each query (query_id, text) by the cosine of their TF-IDF vectors,
    among those that share a word with it. A query's words are weighted by the documents' idf; words that no document has do not count.
    Of a document only its length and the queries' words are kept, and of each block of documents the k best for a query.
    Few queries are sent to the documents; more of them are dealt into blocks, and each block meets each block of documents in a task."""
    raw, idf = _raw(documents)
    asked = queries.select("query_id", F.explode(_words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    known = asked.join(idf, "term").withColumn("q", F.col("qf") * F.col("idf"))
    known = written(known.select("query_id", "term", (F.col("q") / F.sqrt(F.sum(F.col("q") * F.col("q")).over(Window.partitionBy("query_id")))).alias("q")))
    terms = written(known.select("term").distinct().select("term", F.monotonically_increasing_id().alias("number")))
    sent = F.broadcast(terms) if terms.limit(SENT_TERMS + 1).count() <= SENT_TERMS else terms
    kept = F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "raw")))
    rows = raw.join(sent, "term", "left").groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"), kept.alias("kept")).where(F.size("kept") > 0)
    rows = rows.select("id", F.transform("kept", lambda x: x["number"]).alias("numbers"), F.transform("kept", lambda x: x["raw"] / F.col("length")).alias("weights"))
    known = known.join(sent, "term").select("query_id", "number", "q")
    schema = f"query_id {known.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double, place long"
    size = known.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("query_id")).alias("queries")).first()
    if size["n"] <= SENT_TERMS and size["queries"] <= SENT_QUERIES:
        few = known.sparkSession.sparkContext.broadcast(known.toArrow())  # counted above

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _scored_block(few.value, b, k)

        scored = rows.mapInArrow(best, schema)
    else:
        parts, blocks = max(1, -(-size["queries"] // QUERY_BLOCK)), max(1, -(-documents.count() // ROW_BLOCK))
        one = known.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(parts))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        other = rows.withColumn("_c", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

        def compare(q: pa.Table, c: pa.Table) -> pa.Table:
            found = list(_scored_block(q, c, k))
            return pa.Table.from_batches(found) if found else pa.table({"query_id": q["query_id"][:0], "id": c["id"][:0], "score": pa.array([], "float64"), "place": pa.array([], "int64")})

        scored = one.groupBy("_q", "_c").cogroup(other.groupBy("_q", "_c")).applyInArrow(compare, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("place"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("place")


def nouns(text: Column) -> Column:
    """The entities of the co-occurrence baseline: words that are no stop words, each once."""
    return T.query_nouns(text)
