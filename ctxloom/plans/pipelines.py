"""Queries of baselines, metrics, annotations and the learning loop over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ctxloom.functions import text as T
from ctxloom.functions import vector as X
from ctxloom.functions import vocabulary as V
from ctxloom.operators import baselines as B
from ctxloom.operators import evaluation as E
from ctxloom.operators import graph as G
from ctxloom.operators import learning as L
from ctxloom.plans.graphs import _EDGES, _NODES, _PAIRS, nodes
from ctxloom.plans.registry import ORACLE_SQL, QUERIES, query, read
from ctxloom.plans.retrieval import TERMS_SQL
from ctxloom.sources import corpus as C

_WORDS = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 2)"
_TFIDF = (
    f"tok AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM tok) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df, min(n) AS n FROM tf, n GROUP BY term), "
    "raw AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN df USING (term)), wt AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raw)"
)


def _documents(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _asked(spark, d):
    return read(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_TFIDF} SELECT id, term, round(weight, 6) AS weight FROM wt")
def tfidf_weights(spark, d):
    return B.tfidf(_documents(spark, d)).withColumn("weight", F.round("weight", 6))


@query(
    f"WITH {_TFIDF}, qt AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL), qr AS (SELECT query_id, term, qf * (ln((1 + n) / (1 + df)) + 1) AS q FROM qt JOIN df USING (term)), "
    "qw AS (SELECT query_id, term, q / sqrt(sum(q * q) OVER (PARTITION BY query_id)) AS q FROM qr), s AS (SELECT query_id, id, sum(weight * q) AS score FROM wt JOIN qw USING (term) GROUP BY ALL) "
    "SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 5"
)
def tfidf_topk(spark, d):
    """Every item of the benchmark is a query."""
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return B.tfidf_similar(_documents(spark, d), asked).withColumn("score", F.round("score", 6))


_RARE = (
    f"t AS (SELECT doc_id AS id, unnest({TERMS_SQL}) AS entity FROM documents), df AS (SELECT entity, count(*) AS df FROM t GROUP BY entity), qt AS (SELECT item_id AS query_id, unnest({TERMS_SQL}) AS entity FROM benchmark WHERE item_id % 20 = 0), "
    "qe AS (SELECT query_id, entity FROM qt JOIN df USING (entity) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY df, entity) <= 3), "
    "h AS (SELECT id, entity FROM t WHERE entity IN (SELECT entity FROM qe)), w AS (SELECT h.entity, t.entity AS neighbour, count(*) AS weight FROM h JOIN t USING (id) WHERE h.entity <> t.entity GROUP BY ALL), "
    "nb AS (SELECT DISTINCT query_id, entity, neighbour, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY weight DESC, neighbour) AS rank FROM w QUALIFY rank <= 5) JOIN qe USING (entity))"
)


def _entities(spark, d):
    """The documents' terms, and of each query the three that the fewest documents have."""
    docs = _documents(spark, d).select("id", T.terms(F.col("text")).alias("entities"))
    asked = _asked(spark, d).select("query_id", F.explode(T.terms(F.col("text"))).alias("entity"))
    df = docs.select(F.explode("entities").alias("entity")).join(asked.select("entity").distinct(), "entity").groupBy("entity").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "entity"))
    return docs, asked.join(df, "entity").withColumn("r", rank).where("r <= 3").select("query_id", "entity")


@query(f"WITH {_RARE} SELECT query_id, entity, neighbour, weight, rank FROM nb")
def entity_neighbours(spark, d):
    return B.neighbours(*_entities(spark, d))


@query(f"WITH {_RARE}, wanted AS (SELECT query_id, entity FROM qe UNION SELECT query_id, neighbour FROM nb) SELECT query_id, id, count(*) AS n FROM t JOIN wanted USING (entity) GROUP BY ALL")
def entity_documents(spark, d):
    return B.graph_documents(*_entities(spark, d))


@query()
def dense_answers(spark, d):
    """The plain baseline, over all documents; each distinct text is embedded once."""
    hits, answers = B.dense_answers(_asked(spark, d), _documents(spark, d))
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("hits")).join(answers, "query_id")


@query()
def hybrid_retrieve(spark, d):
    return B.HybridRetriever(top_k=5, alpha=0.5).retrieve(_asked(spark, d), _documents(spark, d))


_RESULTS = "r AS (SELECT o_orderpriority AS trap, CASE WHEN o_orderkey % 50 = 0 THEN 'timeout' END AS error, o_totalprice / 1000 AS a1, o_totalprice / 900 AS b1, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0 END AS b2 FROM orders)"


@query(
    f"WITH {_RESULTS}, l AS (SELECT trap, 'price' AS metric, a1 AS a, b1 AS b FROM r WHERE error IS NULL UNION ALL SELECT trap, 'even', 0, b2 FROM r WHERE error IS NULL), x AS (SELECT * FROM l UNION ALL SELECT 'all', metric, a, b FROM l) "
    "SELECT metric, trap AS trap_type, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a) - avg(b), 6) AS delta FROM x GROUP BY ALL"
)
def metric_means(spark, d):
    """Two systems' figures for the orders, those with an error left out; one system lacks a metric."""
    price = F.col("o_totalprice")
    rows = read(spark, d, "orders").select(
        F.col("o_orderpriority").alias("trap_type"), F.when(F.expr("o_orderkey % 50 = 0"), "timeout").alias("error"), F.create_map(F.lit("price"), price / 1000).alias("a"),
        F.create_map(F.lit("price"), price / 900, F.lit("even"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 1.0D ELSE 0.0D END")).alias("b"),
    )
    out = E.metric_means(rows, ["price", "even"])
    return out.select("metric", "trap_type", "n", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "delta")])


def _steps(table) -> str:
    return "CASE " + " ".join(f"WHEN n - 1 >= {k} THEN {t}" for k, t in table) + " END"


@query(
    "WITH p AS (SELECT o_orderpriority AS trap, (o_orderkey % 7 - 3)::DOUBLE AS d FROM orders), s AS (SELECT trap, count(*) AS n, avg(d) AS m, coalesce(stddev_samp(d), 0) AS sd FROM p GROUP BY trap), "
    f"c AS (SELECT *, unnest([95, 99]) AS level FROM s), h AS (SELECT *, (CASE WHEN level = 95 THEN {_steps(E.T_CRITICAL)} ELSE {_steps(E.T_CRITICAL_99)} END) * sd / sqrt(n) AS half FROM c) "
    "SELECT trap, CAST(level AS INT) AS level, n, round(m, 6) AS mean_diff, round(m - half, 6) AS ci_low, round(m + half, 6) AS ci_high FROM h"
)
def intervals(spark, d):
    pairs = read(spark, d, "orders").select(F.col("o_orderpriority").alias("trap"), (F.col("o_orderkey") % 7 - 3).cast("double").alias("a"), F.lit(0.0).alias("b"))
    both = E.interval(pairs, "trap").withColumn("level", F.lit(95)).unionByName(E.interval(pairs, "trap", confidence=0.99).withColumn("level", F.lit(99)))
    return both.select("trap", "level", "n", *[F.round(c, 6).alias(c) for c in ("mean_diff", "ci_low", "ci_high")])


@query()
def all_metrics(spark, d):
    """Each assistant turn as an answer to the user turn before it, in the context of the turns before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = read(spark, d, "conversations")
    rows = c.withColumns({
        "query": F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before), "context": F.array_join(F.collect_list("text").over(before), " "),
    }).where("role = 'assistant' AND query IS NOT NULL")
    rows = rows.select(F.concat_ws("#", "conv_id", "turn").alias("id"), "query", F.col("text").alias("answer"), "context", F.slice(F.split("query", r"[.?!]\s*"), 1, 2).alias("units"))
    return E.all_metrics(rows)


_LABELLED = "f AS (SELECT quality::DOUBLE AS target, least(1.0, n_chars / 5000) AS length, len(regexp_extract_all(text, '[a-z]')) / greatest(length(text), 1) AS lower, CASE WHEN lang = 'en' THEN 1.0 ELSE 0 END AS english FROM documents JOIN labels USING (doc_id))"


def _labelled(spark, d):
    share = F.regexp_count("text", F.lit("[a-z]")) / F.greatest(F.length("text"), F.lit(1))
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select(
        F.col("quality").cast("double").alias("target"), F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("length"), share.alias("lower"), (F.col("lang") == "en").cast("double").alias("english"),
    )


@query(
    f"WITH {_LABELLED}, a AS (SELECT 1 - avg(((length + lower + english) / 3 - target) ** 2) AS every, 1 - avg(((lower + english) / 2 - target) ** 2) AS length, 1 - avg(((length + english) / 2 - target) ** 2) AS lower, 1 - avg(((length + lower) / 2 - target) ** 2) AS english FROM f), "
    "u AS (UNPIVOT a ON length, lower, english INTO NAME feature VALUE reward) SELECT feature, round(reward, 6) AS reward, round(every - reward, 6) AS loss FROM u"
)
def ablation(spark, d):
    out = L.ablation(_labelled(spark, d), ["length", "lower", "english"])
    return out.select("feature", F.round("reward", 6).alias("reward"), F.round("loss", 6).alias("loss"))


_TRIALS = ({"same_source": 0.1, "semantic": 0.6}, {"semantic_threshold": 0.2}, {"adjacency": 0.9, "edge_threshold": 0.5})


@query(
    f"WITH {_NODES}, {_PAIRS}, tr(trial, ss, ad, se, cut, et) AS (VALUES (0, 0.1, 0.25, 0.6, 0.5, 0.15), (1, 0.2, 0.25, 0.3, 0.2, 0.15), (2, 0.2, 0.9, 0.3, 0.5, 0.5)), "
    "w AS (SELECT trial, graph_id, et, CASE WHEN same THEN ss ELSE 0 END + CASE WHEN same AND near THEN ad ELSE 0 END + CASE WHEN sim > cut THEN (sim - cut) / (1 - cut) * se ELSE 0 END AS raw FROM pairs, tr), "
    "g AS (SELECT trial, graph_id, n FROM tr, (SELECT graph_id, count(*) AS n FROM nodes GROUP BY ALL)), s AS (SELECT trial, graph_id, sum(least(raw, 1)) AS w FROM w WHERE raw >= et GROUP BY ALL), "
    "c AS (SELECT trial, CASE WHEN n <= 1 THEN 1 ELSE least(1, coalesce(w, 0) / (n * (n - 1) / 2)) END AS c FROM g LEFT JOIN s USING (trial, graph_id)) SELECT trial, round(1 - avg((c - 0.3) ** 2), 6) AS mean_reward FROM c GROUP BY trial"
)
def edge_search(spark, d):
    """Three settings of the edges' weights, rewarded by how near the graphs' connectivity comes to 0.3."""
    n = nodes(spark, d, texts=False)
    out = L.search_edges(n, n.select("graph_id").distinct().withColumn("target", F.lit(0.3)), list(_TRIALS))
    return out.select("trial", F.round("mean_reward", 6).alias("mean_reward"))


@query(
    "WITH t AS (SELECT o_orderpriority AS phase, o_orderkey AS trial, round(o_totalprice / 1000, 3) AS r FROM orders), b AS (SELECT phase, arg_max(trial, (r, -trial)) AS best_trial FROM t GROUP BY phase) "
    "SELECT phase, count(*) AS n, min(r) AS least, max(r) AS greatest, round(avg(r), 6) AS mean, min(best_trial) AS best_trial FROM t JOIN b USING (phase) GROUP BY phase"
)
def trial_summary(spark, d):
    trials = read(spark, d, "orders").select(F.col("o_orderpriority").alias("phase"), F.col("o_orderkey").alias("trial"), F.lit(None).cast("map<string,double>").alias("parameters"), F.round(F.col("o_totalprice") / 1000, 3).alias("mean_reward"))
    return L.trial_summary(trials).withColumn("mean", F.round("mean", 6))


@query()
def learning_loop(spark, d):
    """Every trial of one run: features, their weights, and the edges' parameters."""
    n = nodes(spark, d, texts=False)
    return L.learn(_labelled(spark, d), ["length", "lower", "english"], n, n.select("graph_id").distinct().withColumn("target", F.lit(0.3)), list(_TRIALS))[0]


@query(
    f"WITH {_NODES}, {_PAIRS}, {_EDGES} SELECT e.graph_id, e.source, e.target, length(a.text) AS source_chars, length(b.text) AS target_chars FROM edges e JOIN nodes a ON e.graph_id = a.graph_id AND e.source = a.id JOIN nodes b ON e.graph_id = b.graph_id AND e.target = b.id"
)
def edge_texts(spark, d):
    n = nodes(spark, d)
    rows = G.edge_texts(n, G.build_edges(nodes(spark, d, texts=False)))
    return rows.select("graph_id", "source", "target", F.length("source_text").cast("long").alias("source_chars"), F.length("target_text").cast("long").alias("target_chars"))


_TOKENS = "list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z]+'), lambda x: lower(x)))"


@query(
    f"WITH {_NODES}, {_PAIRS}, {_EDGES}, t AS (SELECT e.graph_id, e.weight, a.text AS x, b.text AS y, {_TOKENS.format('a.text')} AS p, {_TOKENS.format('b.text')} AS q FROM edges e JOIN nodes a ON e.graph_id = a.graph_id AND e.source = a.id JOIN nodes b ON e.graph_id = b.graph_id AND e.target = b.id), "
    "s AS (SELECT graph_id, avg(CASE WHEN x = '' OR y = '' THEN 0 WHEN len(p) + len(q) = 0 THEN weight ELSE weight * len(list_intersect(p, q)) / (len(p) + len(q) - len(list_intersect(p, q))) END) AS c FROM t GROUP BY graph_id) "
    "SELECT graph_id, round(coalesce(c, 0), 6) AS contradiction FROM (SELECT DISTINCT graph_id FROM nodes) LEFT JOIN s USING (graph_id)"
)
def contradiction_scores(spark, d):
    """With token similarity in place of a model."""
    n = nodes(spark, d)
    out = G.contradiction_score(n, G.build_edges(nodes(spark, d, texts=False)), lambda a, b: X.jaccard(T.token_set(a), T.token_set(b)))
    return out.withColumn("contradiction", F.round("contradiction", 6))


_STOP = ", ".join(f"'{w}'" for w in V.ENTAILMENT_STOPWORDS)


@query(
    f"WITH {_NODES}, g AS (SELECT graph_id, coalesce(string_agg(CASE WHEN text <> '' THEN text END, ' ' ORDER BY pos), '') AS premise FROM nodes GROUP BY graph_id), q AS (SELECT CAST(doc_id AS VARCHAR) AS graph_id, text AS query FROM documents WHERE CAST(doc_id AS VARCHAR) IN (SELECT graph_id FROM nodes)), "
    f"t AS (SELECT graph_id, premise, query, list_filter({_TOKENS.format('premise')}, lambda w: w NOT IN ({_STOP})) AS p, list_filter({_TOKENS.format('query')}, lambda w: w NOT IN ({_STOP})) AS h FROM q LEFT JOIN g USING (graph_id)) "
    "SELECT graph_id, CASE WHEN coalesce(premise, '') = '' OR coalesce(query, '') = '' THEN 0.5 WHEN len(p) > 0 AND len(h) > 0 AND len(list_intersect(p, h)) >= 0.3 * len(h) THEN 1.0 ELSE 0.2 END::DOUBLE AS semantic FROM t"
)
def semantic_scores(spark, d):
    """Whether the texts of graph g entail document g."""
    n = nodes(spark, d)
    asked = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("graph_id"), F.col("text").alias("query")).join(n.select("graph_id").distinct(), "graph_id", "left_semi")
    return G.semantic_score(n, asked)


_NOTES = "a AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS contract_file, lang AS trap_type, CASE WHEN toxic = 1 THEN 'hard' ELSE 'easy' END AS difficulty, lang AS category FROM documents JOIN labels USING (doc_id))"


def _notes(spark, d):
    both = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    return both.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("contract_file"), F.col("lang").alias("trap_type"), F.when(F.col("toxic") == 1, "hard").otherwise("easy").alias("difficulty"), F.col("lang").alias("category"))


@query(f"WITH {_NOTES} SELECT id, contract_file FROM a WHERE trap_type = 'en'")
def annotations_by_trap(spark, d):
    return C.by_trap(_notes(spark, d), "en").select("id", "contract_file")


@query(f"WITH {_NOTES} SELECT id, trap_type FROM a WHERE contract_file = (SELECT min(contract_file) FROM a)")
def annotations_by_contract(spark, d):
    rows = _notes(spark, d)
    return C.by_contract(rows, rows.agg(F.min("contract_file")).first()[0]).select("id", "trap_type")


@query(f"WITH {_NOTES} SELECT contract_file, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS ids FROM a GROUP BY contract_file")
def annotation_groups(spark, d):
    return C.grouped_by_contract(_notes(spark, d)).withColumn("ids", F.array_join("ids", ","))


@query(f"WITH {_NOTES} SELECT id FROM a WHERE difficulty = 'easy' AND category = 'en'")
def evaluation_queries(spark, d):
    return C.evaluation_queries(_notes(spark, d), "easy", "en").select("id")


@query(f"WITH {_NOTES} SELECT DISTINCT category FROM a")
def query_categories(spark, d):
    return C.categories(_notes(spark, d))


@query(f"SELECT query_id, id FROM ({ORACLE_SQL['bm25_topk']}) JOIN (SELECT doc_id AS id FROM documents WHERE lang = 'de') USING (id)")
def hits_by_area(spark, d):
    """Of each query's lexical hits in all documents, those of one area."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("area"))
    return B.by_area(QUERIES["bm25_topk"](spark, d).select("query_id", "id"), docs, "de")
