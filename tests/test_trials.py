"""Trials with the policy in the loop: parameters change actions and edges, errors are left out, and the usual ones change nothing."""

import pytest
from pyspark.sql import functions as F

from ctxloom.operators import graph as G
from ctxloom.operators import learning as L
from ctxloom.operators import policy as P
from ctxloom.operators import sufficiency as S
from ctxloom.plans import graphs
from tests.conftest import SF
from tests.test_growing import _edges, _nodes


def test_parameters_of_edges(spark):
    nodes = _nodes(spark)
    usual = nodes.withColumn("parameters", F.lit(None).cast("map<string,double>"))
    assert _edges(G.build_edges(usual)) == _edges(G.build_edges(nodes))
    for name in G.EDGE_PARAMETERS:
        other = nodes.withColumn("parameters", F.create_map(F.lit(name), F.lit({"least": 0.95, "semantic_from": 0.9, "shared_entities": 30.0}.get(name, 0.0))))
        refs = spark.createDataFrame([("doc_0_chunk_004", "doc_0_chunk_000")], "a string, b string")
        assert _edges(G.build_edges(other, refs)) != _edges(G.build_edges(nodes, refs)), name


def test_trials_run_the_policy(spark):
    """The trial without parameters does what the policy does by itself; another weight of the score changes an action; a graph without a query is an error row."""
    n = graphs.written(graphs.nodes(spark, SF).where("CAST(graph_id AS INT) < 6"))
    asked = graphs.asked(n)
    broken = asked.withColumn("vector", F.when(F.col("graph_id") != "3", F.col("vector")))
    policy = P.Policy(steps=2)
    trials, trace = L.policy_trials([{}, {"query_relevance": -3.0, "subquery_coverage": 0.0, "graph_connectivity": 0.0, "context_cohesion": 0.0, "redundancy": 0.0, "coverage": 0.0}], n, n.drop("graph_id", "pos"), graphs.references(n), broken, policy, graphs.subqueries(n))
    rows = {r.trial: r for r in trials.collect()}
    assert {(r.graphs, r.errors) for r in rows.values()} == {(5, 1)} and all(0 <= r.mean_reward <= 1 for r in rows.values())
    alone = P.optimise(n.where("graph_id != '3'"), n.drop("graph_id", "pos"), graphs.references(n), asked.where("graph_id != '3'"), policy, None, graphs.subqueries(n))[1]
    want = {(r.graph_id, r.step): (r.action, round(r.css, 9)) for r in alone.collect()}
    got = {}
    for r in trace.collect():
        got.setdefault(r.trial, {})[r.graph_id, r.step] = (r.action, round(r.css, 9))
    assert got[0] == want
    assert {k: a for k, (a, _) in got[1].items()} != {k: a for k, (a, _) in got[0].items()}


def test_no_graph_at_all(spark):
    n = graphs.nodes(spark, SF).limit(0)
    rows = L.policy_trials([{}], n, n.drop("graph_id", "pos"), graphs.references(n), graphs.asked(n), P.Policy(steps=1))[0].collect()
    assert [(r.trial, r.mean_reward, r.graphs, r.errors) for r in rows] == [(0, None, 0, 0)]


def test_texts_are_read_once(spark, monkeypatch):
    """However many steps there are, a text is searched once, unless nodes come in or merge; the steps' scores are those of the whole texts."""
    calls, entities = [], P.T.entities
    monkeypatch.setattr(P.T, "entities", lambda text: calls.append(1) or entities(text))
    n = graphs.written(graphs.nodes(spark, SF).where("CAST(graph_id AS INT) < 4"))
    nodes, trace = P.optimise(n, n.drop("graph_id", "pos"), graphs.references(n), graphs.asked(n), P.Policy(steps=2), None, graphs.subqueries(n))
    assert trace.count() == 8 and len(calls) == 1
    assert nodes.columns == n.columns
    want = S.features(nodes, G.build_edges(nodes, graphs.references(n)), graphs.asked(n), graphs.subqueries(n)).withColumn("css", S.score())
    got = {r.graph_id: r.css for r in trace.where("step = 1").collect()}
    assert {r.graph_id: round(r.css, 9) for r in want.collect()} == {k: round(v, 9) for k, v in got.items()}


def test_merged_nodes_are_whole_again(spark):
    rows = [("g", 0, "a", "One two three Big Lake", "x", 0, None, [1.0, 0.0]), ("g", 1, "b", "one two three big lake four", "x", 1, None, [0.0, 1.0]), ("g", 2, "c", "other words", "y", 0, None, [1.0, 1.0])]
    n = spark.createDataFrame(rows, "graph_id string, pos int, id string, text string, base string, chunk int, section string, embedding array<double>")
    q = spark.createDataFrame([("g", "three four", [1.0, 0.0])], "graph_id string, query string, vector array<double>")
    texts = P.Texts(n, n.drop("graph_id", "pos"), q, 0.6)
    merged = texts.filled(texts.compressed(texts.light(n)))
    assert {r.id: (r.text, r.embedding) for r in texts.whole(merged).collect()} == {"a": ("One two three Big Lake one two three big lake four", [1.0, 0.0]), "c": ("other words", [1.0, 1.0])}
    row = {r.id: r for r in merged.collect()}["a"]
    assert row.tokens == 11 and set(row.found) == {"three", "four"} and row.beside["c"].n == 0
