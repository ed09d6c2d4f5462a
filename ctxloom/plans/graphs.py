"""Queries of context graphs. A graph is GRAPH vectors of ``embeddings`` that follow each other, so pair joins stay linear in the
table; texts are the documents of the same numbers, empty where there is none."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxloom.operators import graph as G
from ctxloom.operators import policy as P
from ctxloom.operators import sufficiency as S
from ctxloom.functions import text as T
from ctxloom.functions import vocabulary as V
from ctxloom.plans.registry import query, read
from ctxloom.plans.retrieval import ENTITIES_SQL
from ctxloom.sources.tables import new_folder, written

#: Nodes of a graph.
GRAPH = 10
_NODES = (
    "nodes AS (SELECT CAST(vec_id // 10 AS VARCHAR) AS graph_id, CAST(vec_id % 10 AS INT) AS pos, 'doc_' || (vec_id // 5) || '_chunk_' || lpad(CAST(vec_id % 5 AS VARCHAR), 3, '0') AS id, "
    "CAST(vec_id // 5 AS VARCHAR) AS base, CAST(vec_id % 5 AS INT) AS chunk, label, CAST(embedding AS DOUBLE[]) AS v, coalesce(text, '') AS text FROM embeddings LEFT JOIN documents ON doc_id = vec_id)"
)
_COS = "list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v))"
_PAIRS = f"pairs AS (SELECT a.graph_id, a.id AS source, b.id AS target, a.pos AS i, b.pos AS j, {_COS} AS sim, a.base = b.base AS same, abs(a.chunk - b.chunk) = 1 AS near FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND a.pos < b.pos)"
_EDGES = (
    "w AS (SELECT *, CASE WHEN same THEN 0.2 ELSE 0 END + CASE WHEN sim > 0.5 THEN (sim - 0.5) / 0.5 * 0.3 ELSE 0 END + CASE WHEN same AND near THEN 0.25 ELSE 0 END AS raw FROM pairs), "
    "edges AS (SELECT graph_id, source, target, least(raw, 1) AS weight FROM w WHERE raw >= 0.15)"
)


def nodes(spark, d, texts: bool = True):
    e = read(spark, d, "embeddings").withColumn("vec", F.col("vec_id").cast("long"))
    t = read(spark, d, "documents").select(F.col("doc_id").alias("vec"), "text")
    g, five = F.floor(F.col("vec") / GRAPH), F.floor(F.col("vec") / 5)
    return e.join(t, "vec", "left").select(
        g.cast("string").alias("graph_id"), (F.col("vec") % GRAPH).cast("int").alias("pos"), F.format_string("doc_%d_chunk_%03d", five, F.col("vec") % 5).alias("id"), (F.coalesce("text", F.lit("")) if texts else F.lit("")).alias("text"),
        five.cast("string").alias("base"), (F.col("vec") % 5).cast("int").alias("chunk"), F.lit(None).cast("string").alias("section"), "embedding",
    )


def asked(n):
    """A query for each graph: its first node's text and vector."""
    return n.where("pos = 0").select("graph_id", F.col("text").alias("query"), F.col("embedding").alias("vector"))


def subqueries(n):
    """Three for each graph: the vectors of its first nodes."""
    return n.where("pos < 3").select("graph_id", F.col("pos").alias("subquery_id"), F.col("embedding").alias("vector"))


def references(n):
    """A reference from each graph's first node to the fifth chunk of its document."""
    return n.where("pos = 0").select(F.col("id").alias("a"), F.regexp_replace("id", "_000$", "_004").alias("b"))


@query(f"WITH {_NODES}, {_PAIRS}, {_EDGES} SELECT graph_id, source, target, round(weight, 6) AS weight FROM edges")
def edge_weights(spark, d):
    """Without texts: source, similarity and adjacency; entities are in ``edge_weights_full``."""
    return G.build_edges(nodes(spark, d, texts=False)).select("graph_id", "source", "target", F.round("weight", 6).alias("weight"))


#: The same with entities, weighted by how rare they are, and with references: all the parts of a weight.
_FULL = (
    f"terms AS (SELECT unnest({ENTITIES_SQL}) AS term FROM documents), idf AS (SELECT term, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM terms GROUP BY term HAVING idf >= 1.0), "
    f"ent AS (SELECT * FROM (SELECT graph_id, id, pos, unnest({ENTITIES_SQL}) AS term FROM nodes) JOIN idf USING (term)), "
    "ov AS (SELECT a.graph_id, a.id AS source, b.id AS target, least(1, sum(a.idf) / greatest(max(a.idf) * 3, 1)) AS ov FROM ent a JOIN ent b ON a.graph_id = b.graph_id AND a.term = b.term AND a.pos < b.pos GROUP BY ALL), "
    "refs AS (SELECT graph_id, id AS source, regexp_replace(id, '_000$', '_004') AS target, true AS xref FROM nodes WHERE pos = 0), "
    "wf AS (SELECT *, CASE WHEN xref THEN 0.4 ELSE 0 END + coalesce(ov, 0) * 0.35 + CASE WHEN same THEN 0.2 ELSE 0 END + CASE WHEN sim > 0.5 THEN (sim - 0.5) / 0.5 * 0.3 ELSE 0 END + CASE WHEN same AND near THEN 0.25 ELSE 0 END AS raw, "
    "concat_ws('|', CASE WHEN xref THEN 'cross_ref' END, CASE WHEN ov > 0 THEN 'entity_overlap' END, CASE WHEN same THEN 'same_source' END, CASE WHEN sim > 0.5 THEN 'semantic' END, CASE WHEN same AND near THEN 'adjacency' END) AS relation "
    "FROM pairs LEFT JOIN ov USING (graph_id, source, target) LEFT JOIN refs USING (graph_id, source, target)), "
    "edges AS (SELECT graph_id, source, target, relation, least(raw, 1) AS weight FROM wf WHERE raw >= 0.15)"
)
_ASKED = "q AS (SELECT graph_id, v AS qv, text AS qt FROM nodes WHERE pos = 0), subs AS (SELECT graph_id, pos AS sub, v AS qv FROM nodes WHERE pos < 3)"
_TO = "list_inner_product(n.v, qv) / sqrt(list_inner_product(n.v, n.v) * list_inner_product(qv, qv))"
_CRITICAL = (
    f"sc AS (SELECT n.graph_id, sub, n.id, n.pos, {_TO} AS s FROM nodes n JOIN subs USING (graph_id)), sr AS (SELECT *, row_number() OVER w AS r, first_value(s) OVER w AS best FROM sc WINDOW w AS (PARTITION BY graph_id, sub ORDER BY s DESC, pos)), "
    "crit AS (SELECT DISTINCT graph_id, id FROM sr WHERE r <= 2 AND s >= 0.35 AND (r = 1 OR s >= 0.8 * best))"
)
_COVERED = (
    "sb AS (SELECT graph_id, sub, greatest(0, max(s)) AS top, CASE WHEN max(s) > 0 THEN arg_max(id, (s, -pos)) END AS best FROM sc GROUP BY ALL), "
    "cov AS (SELECT graph_id, 0.7 * (0.6 * avg(top) + 0.4 * count(DISTINCT best) / count(*)) + 0.15 AS subquery_coverage FROM sb GROUP BY graph_id)"
)
_SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_FEATURES = (
    f"one AS (SELECT n.graph_id, avg({_TO}) AS rel, avg(CASE WHEN {_TO} > 0.5 THEN 1.0 ELSE 0 END) AS dense, sum(len(regexp_extract_all(text, '[A-Za-z]+'))) AS tokens, count(*) AS n, lower(string_agg(text, ' ' ORDER BY pos)) AS whole, min(qt) AS qt FROM nodes n JOIN q USING (graph_id) GROUP BY ALL), "
    "pr AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY i, j) AS k FROM pairs WHERE j - i < 10), pp AS (SELECT graph_id, avg(sim) AS coh, avg(CASE WHEN sim > 0.9 THEN 1.0 ELSE 0 END) AS red FROM pr WHERE k <= 50 GROUP BY ALL), "
    "ew AS (SELECT graph_id, sum(weight) AS w FROM edges GROUP BY ALL), "
    f"need AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(qt), '{_SPACES}'), lambda x: length(x) > 3)) AS words FROM one), "
    "f AS (SELECT graph_id, rel AS query_relevance, coalesce(coh, 1) AS context_cohesion, coalesce(red, 0) AS redundancy, CASE WHEN n <= 1 THEN 1 ELSE least(1, coalesce(w, 0) / (n * (n - 1) / 2)) END AS graph_connectivity, "
    "CASE WHEN len(words) = 0 THEN 1 ELSE len(list_filter(words, lambda x: contains(whole, x))) / len(words) END AS coverage, CASE WHEN tokens = 0 THEN 1 ELSE least(1, 2000 / tokens) END AS token_efficiency, dense AS answer_density "
    "FROM need LEFT JOIN pp USING (graph_id) LEFT JOIN ew USING (graph_id))"
)
_FEATURE_NAMES = ("query_relevance", "context_cohesion", "redundancy", "graph_connectivity", "coverage", "token_efficiency", "answer_density")


def _rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def full_edges(spark, d, n):
    from ctxloom.operators.retrieval import document_frequency

    idf = document_frequency(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return G.build_edges(n, references(n), idf=idf)


@query(f"WITH {_NODES}, {_PAIRS}, {_FULL} SELECT graph_id, source, target, relation, round(weight, 6) AS weight FROM edges")
def edge_weights_full(spark, d):
    return rounded(full_edges(spark, d, nodes(spark, d)), "weight")


@query(f"WITH {_NODES}, {_PAIRS}, {_FULL}, e AS (SELECT graph_id, source AS id FROM edges UNION ALL SELECT graph_id, target FROM edges) SELECT n.graph_id, n.id, count(e.id) AS degree FROM nodes n LEFT JOIN e ON n.graph_id = e.graph_id AND n.id = e.id GROUP BY ALL")
def node_degree_full(spark, d):
    n = nodes(spark, d)
    return G.degrees(n, full_edges(spark, d, n))


@query(f"WITH {_NODES}, {_PAIRS}, {_FULL}, {_ASKED}, {_FEATURES} SELECT graph_id, round(graph_connectivity, 6) AS connectivity FROM f")
def graph_connectivity_full(spark, d):
    n = nodes(spark, d)
    return rounded(G.connectivity(n, full_edges(spark, d, n)), "connectivity")


@query(f"WITH {_NODES}, {_PAIRS}, {_FULL} SELECT DISTINCT graph_id, source AS id, target AS neighbour FROM edges WHERE weight >= 0.3 UNION SELECT graph_id, target, source FROM edges WHERE weight >= 0.3")
def connected_nodes_full(spark, d):
    return G.connected_nodes(full_edges(spark, d, nodes(spark, d)))


@query(f"WITH {_NODES}, {_PAIRS}, {_FULL}, {_ASKED}, {_CRITICAL}, {_COVERED}, {_FEATURES} SELECT graph_id, {_rounded(*_FEATURE_NAMES, 'subquery_coverage')} FROM f JOIN cov USING (graph_id)")
def css_features_full(spark, d):
    n = nodes(spark, d)
    return rounded(S.features(n, full_edges(spark, d, n), asked(n), subqueries(n)), *_FEATURE_NAMES, "subquery_coverage")


@query(f"WITH {_NODES}, {_PAIRS}, {_EDGES}, e AS (SELECT graph_id, source AS id FROM edges UNION ALL SELECT graph_id, target FROM edges) SELECT n.graph_id, n.id, count(e.id) AS degree FROM nodes n LEFT JOIN e ON n.graph_id = e.graph_id AND n.id = e.id GROUP BY ALL")
def node_degree(spark, d):
    n = nodes(spark, d, texts=False)
    return G.degrees(n, G.build_edges(n))


@query(f"WITH {_NODES}, {_PAIRS}, {_EDGES}, c AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY ALL), s AS (SELECT graph_id, sum(weight) AS w FROM edges GROUP BY ALL) SELECT graph_id, round(CASE WHEN n <= 1 THEN 1 ELSE least(1, coalesce(w, 0) / (n * (n - 1) / 2)) END, 6) AS connectivity FROM c LEFT JOIN s USING (graph_id)")
def graph_connectivity(spark, d):
    n = nodes(spark, d, texts=False)
    return G.connectivity(n, G.build_edges(n)).withColumn("connectivity", F.round("connectivity", 6))


@query(f"WITH {_NODES}, {_PAIRS}, {_EDGES} SELECT DISTINCT graph_id, source AS id, target AS neighbour FROM edges WHERE weight >= 0.3 UNION SELECT graph_id, target, source FROM edges WHERE weight >= 0.3")
def connected_nodes(spark, d):
    return G.connected_nodes(G.build_edges(nodes(spark, d, texts=False)))


@query(f"WITH {_NODES}, {_PAIRS} SELECT graph_id, source, target FROM pairs WHERE same AND near")
def adjacent_chunks(spark, d):
    p = G.node_pairs(nodes(spark, d, texts=False).select("graph_id", "pos", "id", "base", "chunk"))
    return p.where("a.base = b.base AND abs(a.chunk - b.chunk) = 1").select("graph_id", F.col("a.id").alias("source"), F.col("b.id").alias("target"))


@query(
    f"WITH {_NODES}, {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY i, j) AS k FROM pairs WHERE j - i < 10) "
    "SELECT graph_id, round(avg(sim), 6) AS cohesion, round(avg(CASE WHEN sim > 0.9 THEN 1.0 ELSE 0 END), 6) AS redundancy FROM r WHERE k <= 50 GROUP BY graph_id"
)
def mean_pairwise_similarity(spark, d):
    p = S.capped_pairs(nodes(spark, d, texts=False)).groupBy("graph_id")
    return p.agg(F.round(F.avg("sim"), 6).alias("cohesion"), F.round(F.avg((F.col("sim") > 0.9).cast("double")), 6).alias("redundancy"))


@query(f"WITH {_NODES}, {_PAIRS} SELECT graph_id, source, target, round(sim, 6) AS sim FROM pairs WHERE sim > 0.9")
def near_duplicate_pairs(spark, d):
    from ctxloom.functions import vector as X

    p = G.node_pairs(nodes(spark, d, texts=False).select("graph_id", "pos", "id", "embedding"))
    p = p.select("graph_id", F.col("a.id").alias("source"), F.col("b.id").alias("target"), X.cosine(X.double(F.col("a.embedding")), X.double(F.col("b.embedding"))).alias("sim"))
    return p.where("sim > 0.9").withColumn("sim", F.round("sim", 6))


@query(
    f"WITH {_NODES}, {_PAIRS}, {_EDGES}, q AS (SELECT graph_id, v AS qv, text AS qt FROM nodes WHERE pos = 0), "
    "rel AS (SELECT n.graph_id, avg(list_inner_product(n.v, qv) / sqrt(list_inner_product(n.v, n.v) * list_inner_product(qv, qv))) AS rel, sum(len(regexp_extract_all(text, '[A-Za-z]+'))) AS tokens, count(*) AS n FROM nodes n JOIN q USING (graph_id) GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY i, j) AS k FROM pairs WHERE j - i < 10), p AS (SELECT graph_id, avg(sim) AS coh, avg(CASE WHEN sim > 0.9 THEN 1.0 ELSE 0 END) AS red FROM r WHERE k <= 50 GROUP BY ALL), "
    "c AS (SELECT graph_id, least(1, coalesce(sum(weight), 0)) AS w, sum(weight) AS sw FROM edges GROUP BY ALL) "
    "SELECT graph_id, round(rel, 6) AS query_relevance, round(coalesce(coh, 1), 6) AS context_cohesion, round(coalesce(red, 0), 6) AS redundancy, round(CASE WHEN n <= 1 THEN 1 ELSE least(1, coalesce(sw, 0) / (n * (n - 1) / 2)) END, 6) AS graph_connectivity, "
    "round(CASE WHEN tokens = 0 THEN 1 ELSE least(1, 2000 / tokens) END, 6) AS token_efficiency FROM rel LEFT JOIN p USING (graph_id) LEFT JOIN c USING (graph_id)"
)
def css_features(spark, d):
    n = nodes(spark, d)
    e = G.build_edges(nodes(spark, d, texts=False))
    f = S.features(n, e, asked(n))
    return f.select("graph_id", *[F.round(c, 6).alias(c) for c in ("query_relevance", "context_cohesion", "redundancy", "graph_connectivity", "token_efficiency")])


def _total(coverage: str) -> str:
    """The score's weighted sum over its greatest value, with one of the two coverages."""
    used = {n: w for n, w in V.CSS_WEIGHTS.items() if n not in {"coverage", "subquery_coverage"} - {coverage}}
    return "(" + " + ".join(f"{w} * {n}" for n, w in used.items()) + f") / {sum(w for w in used.values() if w > 0)}"


@query(f"WITH {_NODES}, {_PAIRS}, {_FULL}, {_ASKED}, {_CRITICAL}, {_COVERED}, {_FEATURES} SELECT graph_id, round(1 / (1 + exp(-3 * ({_total('coverage')} * 2 - 1))), 6) AS css, round(1 / (1 + exp(-3 * ({_total('subquery_coverage')} * 2 - 1))), 6) AS css_with_subqueries FROM f JOIN cov USING (graph_id)")
def css_score(spark, d):
    """Without subqueries, and with them."""
    n = nodes(spark, d)
    f = S.features(n, full_edges(spark, d, n), asked(n), subqueries(n))
    both = f.withColumn("css_with_subqueries", F.round(S.score(), 6)).withColumn("subquery_coverage", F.lit(None).cast("double"))
    return both.select("graph_id", "css_with_subqueries", F.round(S.score(), 6).alias("css"))


@query(f"WITH {_NODES}, {_ASKED}, {_CRITICAL}, {_COVERED} SELECT graph_id, {_rounded('subquery_coverage')} FROM cov")
def subquery_coverage(spark, d):
    n = nodes(spark, d, texts=False)
    return rounded(S.subquery_coverage(n, subqueries(n)), "subquery_coverage")


@query(f"WITH {_NODES}, {_ASKED}, {_CRITICAL} SELECT graph_id, id FROM crit")
def critical_nodes(spark, d):
    n = nodes(spark, d, texts=False)
    return G.critical_nodes(n, subqueries(n))


_LEGACY_NAMES = ("token_coverage", "relevance", "novelty", "density", "pair_connectivity", "chain_connectivity", "diversity")
_TOKENS = "list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z]+'), lambda x: lower(x)))"


@query(
    f"WITH {_NODES}, {_PAIRS}, {_FULL}, {_ASKED}, {_FEATURES}, top AS (SELECT n.graph_id, max({_TO}) AS top FROM nodes n JOIN q USING (graph_id) GROUP BY ALL), m AS (SELECT graph_id, count(*) AS m FROM edges GROUP BY ALL), "
    f"dv AS (SELECT graph_id, avg(greatest(0, sim)) AS mean FROM pairs GROUP BY ALL), t AS (SELECT graph_id, n, coalesce(m, 0) AS m, top, mean, {_TOKENS.format('qt')} AS a, {_TOKENS.format('whole')} AS o FROM one LEFT JOIN m USING (graph_id) LEFT JOIN top USING (graph_id) LEFT JOIN dv USING (graph_id)), "
    "l AS (SELECT graph_id, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, o)) / len(a) END AS token_coverage, greatest(0, least(1, top)) AS relevance, CASE WHEN len(o) = 0 THEN 0 ELSE (len(o) - len(list_intersect(a, o))) / len(o) END AS novelty, "
    "CASE WHEN n <= 1 THEN 0 ELSE least(1, m / (n * (n - 1))) END AS density, CASE WHEN n <= 1 THEN 0.5 ELSE least(1, m / (n * (n - 1) / 2)) END AS pair_connectivity, CASE WHEN n <= 1 THEN 0.5 ELSE least(1, m / (n - 1)) END AS chain_connectivity, CASE WHEN n < 2 THEN 0.5 ELSE 1 - coalesce(mean, 0) END AS diversity FROM t) "
    f"SELECT graph_id, {_rounded(*_LEGACY_NAMES)} FROM l"
)
def legacy_features(spark, d):
    n = nodes(spark, d)
    return rounded(S.legacy_features(n, full_edges(spark, d, n), asked(n)), *_LEGACY_NAMES)


_CLAUSES = sorted({k for ks in V.CLAUSE_KEYWORDS.values() for k in ks})
_LEGAL_NAMES = ("legal_entity_density", "clause_coverage", "cross_reference_density", "section_diversity")


def _share(keys) -> str:
    return f"len(list_filter([{', '.join(repr(k) for k in keys)}], lambda k: contains(whole, k))) / {len(keys)}"


@query(
    f"WITH {_NODES}, {_ASKED}, g AS (SELECT n.graph_id, count(*) AS n, count(DISTINCT base) AS bases, lower(string_agg(text, ' ' ORDER BY pos)) AS whole, lower(min(qt)) AS low FROM nodes n JOIN q USING (graph_id) GROUP BY ALL), "
    f"k AS (SELECT graph_id, pos, list_filter([{', '.join(repr(k) for k in _CLAUSES)}], lambda k: contains(lower(text), k)) AS keys FROM nodes), x AS (SELECT a.graph_id, avg(CASE WHEN len(list_intersect(a.keys, b.keys)) > 0 THEN 1.0 ELSE 0 END) AS cross_ FROM k a JOIN k b ON a.graph_id = b.graph_id AND a.pos < b.pos GROUP BY ALL), "
    "s AS (SELECT *, " + ", ".join(f"CASE WHEN {' OR '.join(f'contains(low, {k!r})' for k in ks)} THEN 1 ELSE 0 END AS a{i}, {_share(ks)} AS s{i}" for i, ks in enumerate(V.CLAUSE_KEYWORDS.values())) + f", {_share(_CLAUSES)} AS every FROM g LEFT JOIN x USING (graph_id)), "
    "l AS (SELECT graph_id, least(1, every * 3) AS legal_entity_density, CASE WHEN " + " + ".join(f"a{i}" for i in range(len(V.CLAUSE_KEYWORDS))) + " = 0 THEN 0.5 ELSE least(1, (" + " + ".join(f"a{i} * s{i}" for i in range(len(V.CLAUSE_KEYWORDS))) + ") / (" + " + ".join(f"a{i}" for i in range(len(V.CLAUSE_KEYWORDS))) + ")) END AS clause_coverage, coalesce(cross_, 0.5) AS cross_reference_density, CASE WHEN n < 2 THEN 0.5 ELSE bases / n END AS section_diversity FROM s) "
    f"SELECT graph_id, {_rounded(*_LEGAL_NAMES)} FROM l"
)
def legal_features(spark, d):
    n = nodes(spark, d)
    return rounded(S.legal_features(n, asked(n)).drop("answer_specificity"), *_LEGAL_NAMES)


@query(f"WITH {_NODES} SELECT graph_id, round(avg(CASE WHEN pos % 2 = 0 THEN 1.0 ELSE 0 END), 6) AS user_reuse FROM nodes GROUP BY graph_id")
def user_reuse(spark, d):
    n = nodes(spark, d, texts=False)
    return rounded(S.user_reuse(n, n.where("pos % 2 = 0")), "user_reuse")


@query(f"WITH {_NODES}, q AS (SELECT graph_id, v AS qv FROM nodes WHERE pos = 0), s AS (SELECT n.graph_id, n.id, n.pos, list_inner_product(n.v, qv) / sqrt(list_inner_product(n.v, n.v) * list_inner_product(qv, qv)) AS w, count(*) OVER (PARTITION BY n.graph_id) AS c FROM nodes n JOIN q USING (graph_id)), m AS (SELECT graph_id, id FROM s WHERE c > 3 QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY w, pos) = 1) SELECT graph_id, id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.graph_id = n.graph_id AND m.id = n.id)")
def prune_graph(spark, d):
    n = nodes(spark, d, texts=False)
    none = G.build_edges(n).where("false")
    return G.prune(n, none, asked(n).select("graph_id", F.col("vector").alias("query"))).select("graph_id", "id")


@query(
    f"WITH {_NODES}, {_PAIRS}, {_FULL}, {_ASKED}, {_CRITICAL}, ends AS (SELECT graph_id, id, count(*) AS degree, max(CASE WHEN contains(relation, 'cross_ref') THEN 1 ELSE 0 END) AS x FROM (SELECT graph_id, source AS id, relation FROM edges UNION ALL SELECT graph_id, target, relation FROM edges) GROUP BY ALL), "
    f"pw AS (SELECT n.graph_id, n.id, n.pos, {_TO} + CASE WHEN x = 1 THEN 0.5 ELSE 0 END + CASE WHEN x = 1 AND degree >= 3 THEN 0.3 ELSE 0 END + CASE WHEN c.id IS NOT NULL THEN 0.4 ELSE 0 END AS worth FROM nodes n JOIN q USING (graph_id) LEFT JOIN ends USING (graph_id, id) LEFT JOIN crit c ON n.graph_id = c.graph_id AND n.id = c.id) "
    "SELECT graph_id, id FROM pw QUALIFY count(*) OVER (PARTITION BY graph_id) <= 3 OR row_number() OVER (PARTITION BY graph_id ORDER BY worth, pos) > 1"
)
def prune_graph_full(spark, d):
    """With the graphs' edges and the nodes that subqueries need."""
    n = nodes(spark, d)
    return G.prune(n, full_edges(spark, d, n), asked(n).select("graph_id", F.col("vector").alias("query")), G.critical_nodes(n, subqueries(n))).select("graph_id", "id")


@query(
    f"WITH {_NODES}, {_ASKED}, referred AS (SELECT DISTINCT graph_id, b AS id FROM (SELECT graph_id, 'doc_' || (CAST(base AS INT) + 2) || '_chunk_001' AS b FROM nodes WHERE pos = 0 AND CAST(graph_id AS INT) % 3 = 0 "
    "UNION ALL SELECT m.graph_id, n.id FROM nodes n JOIN nodes m ON m.id = 'doc_' || (CAST(n.base AS INT) + 2) || '_chunk_001' WHERE n.pos = 0 AND CAST(n.graph_id AS INT) % 3 = 0) WHERE b IN (SELECT id FROM nodes)), "
    f"cand AS (SELECT graph_id, id, 0 AS priority, -0.85 AS minus FROM referred UNION ALL SELECT q.graph_id, n.id, 1, -0.9 * {_TO} FROM nodes n, q WHERE n.graph_id <> q.graph_id), "
    "best AS (SELECT graph_id, id, min((priority, minus)) AS s FROM cand c WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.graph_id = c.graph_id AND n.id = c.id) GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY s, id) AS r FROM best QUALIFY r <= 2), last AS (SELECT graph_id, max(pos) AS last FROM nodes GROUP BY ALL) "
    "SELECT graph_id, pos, id FROM nodes UNION ALL SELECT graph_id, CAST(last + r AS INT), id FROM r JOIN last USING (graph_id)"
)
def expand_graph(spark, d):
    """Whole graphs, each with two more nodes; every third refers to a chunk of the next."""
    n = nodes(spark, d, texts=False)
    elsewhere = n.where("pos = 0 AND CAST(graph_id AS INT) % 3 = 0").select(F.col("id").alias("a"), F.format_string("doc_%d_chunk_001", F.col("base").cast("int") + 2).alias("b"))
    none = G.build_edges(n).where("false")
    return G.expand(n, none, n.drop("graph_id", "pos"), elsewhere, asked(n).select("graph_id", F.col("vector").alias("query"))).select("graph_id", "pos", "id")


@query()
def compress_groups(spark, d):
    return G.compress(nodes(spark, d)).select("graph_id", "id", F.length("text").alias("n_chars"))


@query()
def greedy_policy(spark, d):
    """The whole search over whole graphs: what each graph does in each step."""
    n = written(nodes(spark, d))
    return P.optimise(n, n.drop("graph_id", "pos"), references(n), asked(n), P.Policy(), written, subqueries(n))[1]


def arrivals(spark, d):
    """Nodes with the batch that they come in: a third of each graph comes late, and some of these again."""
    n = nodes(spark, d)
    return n.withColumn("batch", F.when(F.col("pos") % 3 != 2, 0).when(F.col("pos") < 6, 1).otherwise(2))


@query(f"WITH {_NODES}, {_PAIRS}, {_FULL} SELECT graph_id, source, target, relation, round(weight, 6) AS weight FROM edges")
def incremental_edges(spark, d):
    """The edges of ``edge_weights_full``, from graphs that grow in three batches: a stored table of edges gets those of new nodes only."""
    from ctxloom.operators.retrieval import document_frequency

    n = arrivals(spark, d)
    idf = written(document_frequency(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")))
    refs, table = written(references(n)), G.EdgeTable(spark, new_folder(spark, "edges"))
    for k in range(3):
        came = n.where(F.col("batch") == k) if k < 2 else n.where("batch = 2 OR pos = 2")  # one node comes twice
        table.add(came.drop("batch"), k, refs, idf)
    return rounded(table.edges(), "weight")


def benchmark_queries(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("graph_id"), "text")


@query()
def initial_graph(spark, d):
    """The first graph of each item of the benchmark, searched for in all documents."""
    from ctxloom.functions import vector as X

    corpus = read(spark, d, "documents").select(F.col("doc_id").alias("id"), X.hashed_embedding(F.coalesce("text", F.lit(""))).alias("vector"))
    out = G.initial_graph(benchmark_queries(spark, d), written(corpus), X.hashed_embedding, terms=T.terms(F.col("text")))
    return out.select("graph_id", "pos", "id", F.round("confidence", 6).alias("confidence"), "route")


@query()
def policy_trials(spark, d):
    """Two steps of the policy over all graphs under three settings of the score and of the edges."""
    from ctxloom.operators import learning as L

    n = written(nodes(spark, d))
    trials = [{}, {"redundancy": -6.0, "token_efficiency": 4.0}, {"cross_ref": 0.1, "entity_overlap": 0.6, "same_source": 0.05, "semantic": 0.6, "adjacency": 0.05, "shared_entities": 1.0, "semantic_from": 0.3, "least": 0.05}]
    out = L.policy_trials(trials, n, n.drop("graph_id", "pos"), references(n), asked(n), P.Policy(steps=2), subqueries(n))[0]
    return out.select("trial", F.to_json("parameters").alias("parameters"), F.round("mean_reward", 6).alias("mean_reward"), "graphs", "errors")
