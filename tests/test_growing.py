"""Graphs that grow, stored references, and the first graph of a query: against whole builds and a fold in Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.functions import text as T
from ctxloom.functions import vector as X
from ctxloom.operators import graph as G
from ctxloom.plans import contracts, graphs
from tests.conftest import SF
from tests.test_pipelines import NODE, _embed


def _edges(df):
    return sorted((r.graph_id, r.source, r.target, r.relation, round(r.weight, 9)) for r in df.collect())


def _nodes(spark, n=3, per=6):
    r = np.random.default_rng(3)
    rows = [(f"g{g}", p, f"doc_{g}_chunk_{p:03d}", f"Northern Harbor {'rent' if p % 2 else 'lease'} agreement number{p}", f"doc_{g}", p, str(p // 2) if p % 3 else None, r.random(8).tolist()) for g in range(n) for p in range(per)]
    return spark.createDataFrame(rows, NODE)


def test_new_pairs_only(spark):
    nodes = _nodes(spark)
    old, new = nodes.where("pos % 3 != 1"), nodes.where("pos % 3 = 1")
    pairs = G.delta_pairs(old, new).select("graph_id", "a.pos", F.col("b.pos").alias("other")).collect()
    want = {(f"g{g}", a, b) for g in range(3) for a in range(6) for b in range(a + 1, 6) if a % 3 == 1 or b % 3 == 1}
    assert len(pairs) == len(want) and {tuple(r) for r in pairs} == want
    refs = spark.createDataFrame([("doc_0_chunk_004", "doc_0_chunk_000"), ("doc_1_chunk_001", "doc_1_chunk_005")], "a string, b string")
    for idf in (None, spark.createDataFrame([("northern harbor", 2.0), ("rent", 1.5), ("lease", 0.5)], "term string, idf double")):
        both, edges = G.add_node(old, G.build_edges(old, refs, idf=idf), new.unionByName(old.limit(2)), refs, idf)
        assert both.count() == nodes.count() and _edges(edges) == _edges(G.build_edges(nodes, refs, idf=idf))


def test_a_growing_table_goes_on_and_takes_a_batch_once(spark, tmp_path):
    nodes, path = _nodes(spark), str(tmp_path)
    table = G.EdgeTable(spark, path)
    table.add(nodes.where("pos < 2"), 0)
    table.add(nodes.where("pos IN (2, 3)"), 1)
    table.add(nodes.where("pos IN (2, 3)"), 1)  # once more
    again = G.EdgeTable(spark, path)
    again.add(nodes.where("pos > 2"), 2)  # one node is there already
    assert again.batch == 2 and again.nodes().count() == nodes.count() and _edges(again.edges()) == _edges(G.build_edges(nodes))
    with pytest.raises(ValueError):
        again.add(nodes, 9)
    # A batch whose commit is missing is written anew.
    third = G.EdgeTable(spark, path)
    third.batch = 1
    third.add(nodes.where("pos > 2"), 2)
    assert _edges(third.edges()) == _edges(G.build_edges(nodes))


def test_known_nodes_do_not_meet(spark):
    """The number of pairs that a batch looks at: those of the late third, in every graph of the table."""
    n = graphs.arrivals(spark, SF)
    first, late = n.where("batch = 0").drop("batch"), n.where("batch > 0").drop("batch")
    whole, rest = G.node_pairs(n.select("graph_id", "pos", "id")).count(), G.node_pairs(first.select("graph_id", "pos", "id")).count()
    assert G.delta_pairs(first, late).count() == whole - rest < whole


def test_stored_references_are_not_moved(spark):
    index = contracts.index(spark, SF)
    n = contracts.contract_nodes(spark, SF)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = G.build_edges(n, index)
        edges.collect()
        plan = edges._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        scan = next(x for x in plan.split("Final Plan")[-1].splitlines() if "Bucketed: true" in x)
        at = plan.splitlines().index(next(x for x in plan.splitlines() if x == scan))
        above = "\n".join(plan.splitlines()[max(0, at - 4) : at])
        assert "Exchange" not in above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert index.groupBy("_a", "_b").count().where("count > 1").count() == 0


def test_references_stay_within_their_source(spark):
    rows = [("a", "s1", "As said in Section 2.", "1"), ("b", "s1", 'Fine. "Service Fee" means a price.', "2"), ("c", "s2", "The service fee, see Section 1.", "2"), ("d", "s2", "Nothing.", "1"), ("e", None, "Section 1 and the service fee.", "1")]
    chunks = spark.createDataFrame(rows, "id string, source string, text string, section string")
    assert {tuple(r) for r in G.cross_references(chunks, "source").collect()} == {("a", "b", "section_ref"), ("c", "d", "section_ref")}
    assert {("c", "b", "defined_term"), ("e", "b", "defined_term"), ("c", "a", "section_ref")} <= {tuple(r) for r in G.cross_references(chunks).collect()}


def _fold(query, terms, corpus, k):
    """The first graph by a loop over searches that leave out what is there."""
    quota = k if not terms else max(2, k // (len(terms) + 1))
    seen, out = set(), []

    def search(text, most):
        v = _embed(text)
        ranked = sorted(((i, float(v @ c)) for i, c in corpus.items() if i not in seen), key=lambda x: (-round(x[1], 12), x[0]))
        return ranked[:most]

    for i, s in search(query, quota):
        out.append((i, s, "query_match"))
        seen.add(i)
    for t in terms[:6]:
        for i, s in search(t, quota):
            if len(out) >= k:
                return out
            out.append((i, s * 0.9, f"entity:{t}"))
            seen.add(i)
    return out


def test_first_graph_of_a_query(spark):
    """Over all items of the benchmark and all documents, with quotas by the number of terms; and with no terms at all."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    corpus = {i: _embed(t or "") for i, t in docs}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text", T.terms(F.col("text")).alias("terms")).collect()
    got = {}
    for r in graphs.initial_graph(spark, SF).collect():
        got.setdefault(r.graph_id, []).append((r.pos, r.id, r.confidence, r.route))
    assert len(got) == len(items) and any(len(x.terms) > 1 for x in items)
    for x in items:
        want = _fold(x.text, list(dict.fromkeys(x.terms)), corpus, 10)
        have = sorted(got[x.item_id])
        assert [i for _, i, _, _ in have] == [i for i, _, _ in want] and [r for *_, r in have] == [r for *_, r in want]
        assert [c for _, _, c, _ in have] == pytest.approx([s for _, s, _ in want], abs=2e-6)
    plain = G.initial_graph(spark.createDataFrame([(1, "zzz")], "graph_id long, text string"), spark.createDataFrame([(i, v.tolist()) for i, v in list(corpus.items())[:30]], "id long, vector array<double>"), X.hashed_embedding, k=7, terms=F.array().cast("array<string>"))
    assert plain.count() == 7 and {r.route for r in plain.collect()} == {"query_match"}


def test_a_growing_table_searches_a_text_once_and_leaves_no_scratch(spark, tmp_path, monkeypatch):
    nodes, path, seen = _nodes(spark), str(tmp_path), []
    search = G._searched
    monkeypatch.setattr(G, "_searched", lambda df: seen.append(df.count()) or search(df))
    idf = spark.createDataFrame([("northern harbor", 2.0), ("rent", 1.5), ("lease", 0.5)], "term string, idf double")
    table = G.EdgeTable(spark, path)
    for k in range(3):
        table.add(nodes.where(f"pos % 3 = {k}"), k, idf=idf)
    assert sum(seen) == nodes.count() and not (tmp_path / "scratch").exists()
    monkeypatch.setattr(G, "_searched", search)
    assert _edges(table.edges()) == _edges(G.build_edges(nodes, idf=idf))


def test_terms_of_one_node_alone_do_not_meet_the_idf(spark):
    rows = [("g", k, f"n{k}", t, "b", k, None, [1.0]) for k, t in enumerate(("alpha beta once", "beta gamma", "gamma delta beta", None))] + [("h", 0, "n0", "alpha gamma", "b", 0, None, [1.0])]
    idf = spark.createDataFrame([(t, 2.0) for t in ("alpha", "beta", "gamma", "delta", "once")], "term string, idf double")
    got = {(r.graph_id, r.id): {t.split("\u0001")[0] for t in r.entities} for r in G._with_terms(spark.createDataFrame(rows, NODE), idf).collect()}
    assert got == {("g", "n0"): {"beta"}, ("g", "n1"): {"beta", "gamma"}, ("g", "n2"): {"beta", "gamma"}, ("g", "n3"): set(), ("h", "n0"): set()}
