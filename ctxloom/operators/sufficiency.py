"""The context sufficiency score and its features, for many graphs at once; and the greedy policy that raises it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions import text as T
from ctxloom.functions import vector as X
from ctxloom.functions import vocabulary as V
from ctxloom.operators.graph import beside, connectivity, near_subqueries, node_pairs


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x))))


def capped_pairs(nodes: DataFrame) -> DataFrame:
    """graph_id and sim of the first 50 pairs, in order, of nodes less than ten places apart."""
    placed = nodes.withColumn("i", F.row_number().over(Window.partitionBy("graph_id").orderBy("pos")) - 1)
    # Only neighbours can be among them: bounded by the window, not by the square of a graph.
    light = "beside" in nodes.columns
    placed = placed.select("graph_id", "i", (F.struct("own", "beside") if light else F.col("embedding")).alias("embedding"))
    a = placed.where(F.col("i") < V.PAIR_CAP).select("graph_id", F.col("i").alias("ai"), F.col("embedding").alias("ae"), F.explode(F.sequence(F.col("i") + 1, F.col("i") + V.PAIR_WINDOW - 1)).alias("i"))
    pairs = a.join(placed, ["graph_id", "i"])
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("graph_id").orderBy("ai", "i"))).where(F.col("r") <= V.PAIR_CAP)
    sim = beside(F.col("ae"), F.col("embedding"))["sim"] if light else X.cosine(X.double(F.col("ae")), X.double(F.col("embedding")))
    return ranked.select("graph_id", sim.alias("sim"))


def subquery_coverage(nodes: DataFrame, subqueries: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """graph_id and subquery_coverage: 0.7 (0.6 mean best similarity + 0.4 share of distinct best nodes) + 0.3 share of entities found.

    ``subqueries`` are (graph_id, subquery_id, vector); ``entities`` (graph_id, entities array), 0.5 where there are none. A subquery
    to which no node is similar has no best node.
    """
    scored = near_subqueries(nodes, subqueries, "s")
    best = scored.groupBy("graph_id", "subquery_id").agg(F.greatest(F.lit(0.0), F.max("s")).alias("top"), F.when(F.max("s") > 0, F.max_by("id", F.struct("s", -F.col("pos")))).alias("best"))
    mean = best.groupBy("graph_id").agg((0.6 * F.avg("top") + 0.4 * F.count_distinct("best") / F.count(F.lit(1))).alias("part"))
    if entities is None:
        return mean.select("graph_id", (0.7 * F.col("part") + 0.15).alias("subquery_coverage"))
    texts = nodes.groupBy("graph_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])).alias("text"))
    share = entities.join(texts, "graph_id").select("graph_id", F.when(F.size("entities") == 0, 0.5).otherwise(T.keyword_share(F.col("text"), F.col("entities"))).alias("share"))
    return mean.join(share, "graph_id", "left").select("graph_id", (0.7 * F.col("part") + 0.3 * F.coalesce("share", F.lit(0.5))).alias("subquery_coverage"))


def features(nodes: DataFrame, edges: DataFrame, queries: DataFrame, subqueries: DataFrame | None = None, budget: int = V.TOKEN_BUDGET) -> DataFrame:
    """One row for each graph of ``queries`` (graph_id, query text, vector) with the features of the score; subquery_coverage is
    null where no subqueries are given. Graphs without nodes have relevance 0 and cohesion 1. Light nodes of the policy hold counts in place
    of texts, and their queries the number of words that they need."""
    light = "found" in nodes.columns
    rows = nodes.join(queries.select("graph_id", *(["needed"] if light else ["query", "vector"])), "graph_id")
    sim = F.col("relevance") if light else X.cosine(X.double(F.col("embedding")), X.double(F.col("vector")))
    one = rows.groupBy("graph_id").agg(
        F.avg(sim).alias("query_relevance"), F.avg((sim > 0.5).cast("double")).alias("answer_density"), F.sum("tokens" if light else T.token_count(F.col("text"))).alias("tokens"),
        *([F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n_found"), F.first("needed").alias("needed")] if light else
          [F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])).alias("all_text"), F.first("query").alias("q")]),
    )
    coverage = F.when(F.col("needed") == 0, 1.0).otherwise(F.col("n_found") / F.col("needed")) if light else T.query_coverage(F.col("all_text"), F.col("q"))
    pairs = capped_pairs(nodes).groupBy("graph_id").agg(F.avg("sim").alias("context_cohesion"), F.avg((F.col("sim") > V.NEAR_DUPLICATE).cast("double")).alias("redundancy"))
    out = queries.select("graph_id").join(one, "graph_id", "left").join(pairs, "graph_id", "left").join(connectivity(nodes, edges), "graph_id", "left")
    out = out.select(
        "graph_id", F.coalesce("query_relevance", F.lit(0.0)).alias("query_relevance"), F.coalesce("context_cohesion", F.lit(1.0)).alias("context_cohesion"),
        F.coalesce("redundancy", F.lit(0.0)).alias("redundancy"), F.coalesce("connectivity", F.lit(1.0)).alias("graph_connectivity"),
        F.coalesce(coverage, F.lit(0.0)).alias("coverage"),
        F.when(F.coalesce("tokens", F.lit(0)) == 0, 1.0).otherwise(F.least(F.lit(1.0), budget / F.col("tokens"))).alias("token_efficiency"),
        F.coalesce("answer_density", F.lit(0.0)).alias("answer_density"),
    )
    if subqueries is None:
        return out.withColumn("subquery_coverage", F.lit(None).cast("double"))
    return out.join(subquery_coverage(nodes, subqueries), "graph_id", "left")


def score(weights: dict[str, float | Column] | None = None) -> Column:
    """The sufficiency score of a row of features, with other weights where given, which may be columns. Where subquery coverage is
    known, plain coverage does not count."""
    w = V.CSS_WEIGHTS | (weights or {})
    known = F.col("subquery_coverage").isNotNull()
    use = {n: F.when(known, v).otherwise(0.0) if n == "subquery_coverage" else F.when(known, 0.0).otherwise(v) if n == "coverage" else F.lit(v) for n, v in w.items()}
    total = reduce(lambda a, b: a + b, [use[n] * F.coalesce(F.col(n), F.lit(0.0)) for n in w])
    top = F.greatest(reduce(lambda a, b: a + b, [F.greatest(use[n], F.lit(0.0)) for n in w]), F.lit(1.0))
    return sigmoid(3 * (total / top * 2 - 1))


def legal_features(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """graph_id and the domain features: entity density, clause coverage, cross-reference density, section diversity, specificity."""
    keywords = sorted({k for ks in V.CLAUSE_KEYWORDS.values() for k in ks})
    low = F.lower(F.col("all_text"))
    one = nodes.groupBy("graph_id").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])).alias("all_text"), F.count(F.lit(1)).alias("n"), F.count_distinct("base").alias("bases")
    )
    rows = queries.select("graph_id", "query").join(one, "graph_id", "left")
    share = lambda ks: sum((F.contains(low, F.lit(k)).cast("int") for k in ks), F.lit(0)) / len(ks)
    asked = {c: reduce(lambda a, b: a | b, [F.contains(F.lower("query"), F.lit(k)) for k in ks]) for c, ks in V.CLAUSE_KEYWORDS.items()}
    n_asked = sum((a.cast("int") for a in asked.values()), F.lit(0))
    covered = sum((F.when(a, share(V.CLAUSE_KEYWORDS[c])).otherwise(0.0) for c, a in asked.items()), F.lit(0.0))
    marked = nodes.withColumn("keys", F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower("text"), k))).select("graph_id", "pos", "keys")
    shared = node_pairs(marked).groupBy("graph_id").agg(F.avg(F.arrays_overlap("a.keys", "b.keys").cast("double")).alias("cross"))
    rows = rows.join(shared, "graph_id", "left")
    none = F.col("n").isNull()
    return rows.select(
        "graph_id", F.when(none, 0.0).otherwise(F.least(F.lit(1.0), share(keywords) * 3)).alias("legal_entity_density"),
        F.when(none, 0.0).when(n_asked == 0, 0.5).otherwise(F.least(F.lit(1.0), covered / n_asked)).alias("clause_coverage"), F.coalesce("cross", F.lit(0.5)).alias("cross_reference_density"),
        F.when(none | (F.col("n") < 2), 0.5).otherwise(F.col("bases") / F.col("n")).alias("section_diversity"), T.answer_specificity(F.coalesce("all_text", F.lit(""))).alias("answer_specificity"),
    )


def legacy_features(nodes: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """graph_id and the older features: token coverage, greatest relevance, novelty, and three densities of edges, diversity."""
    tokens = nodes.select("graph_id", F.explode(T.token_set(F.col("text"))).alias("t")).groupBy("graph_id").agg(F.collect_set("t").alias("own"))
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    m = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("m"))
    sim = nodes.join(queries.select("graph_id", "vector"), "graph_id").groupBy("graph_id").agg(F.max(X.cosine(X.double(F.col("embedding")), X.double(F.col("vector")))).alias("top"))
    pairs = node_pairs(nodes.select("graph_id", "pos", "embedding")).groupBy("graph_id").agg(F.avg(F.greatest(F.lit(0.0), X.cosine(X.double(F.col("a.embedding")), X.double(F.col("b.embedding"))))).alias("mean"))
    rows = queries.select("graph_id", T.token_set(F.col("query")).alias("asked")).join(tokens, "graph_id", "left").join(n, "graph_id", "left").join(m, "graph_id", "left").join(sim, "graph_id", "left").join(pairs, "graph_id", "left")
    own, count, edges_ = F.coalesce("own", F.array().cast("array<string>")), F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    ratio = lambda top, bottom, else_: F.when(count <= 1, else_).otherwise(F.least(F.lit(1.0), top / bottom))
    return rows.select(
        "graph_id", F.when(F.size("asked") == 0, 0.0).otherwise(F.size(F.array_intersect("asked", own)) / F.size("asked")).alias("token_coverage"), T.clamp(F.coalesce("top", F.lit(0.0))).alias("relevance"),
        F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_except(own, "asked")) / F.size(own)).alias("novelty"), ratio(edges_, count * (count - 1), 0.0).alias("density"),
        ratio(edges_, count * (count - 1) / 2, 0.5).alias("pair_connectivity"), ratio(edges_, count - 1, 0.5).alias("chain_connectivity"),
        F.when(count < 2, 0.5).otherwise(1 - F.coalesce("mean", F.lit(0.0))).alias("diversity"),
    )


def user_reuse(nodes: DataFrame, user_nodes: DataFrame) -> DataFrame:
    """graph_id and the share of its nodes that the user's graph holds."""
    marked = nodes.join(user_nodes.select("id").distinct().withColumn("known", F.lit(1.0)), "id", "left")
    return marked.groupBy("graph_id").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("user_reuse"))
