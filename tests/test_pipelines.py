"""Baselines, metrics, annotations, settings, chunks, quotas and the learning loop against values worked out by hand or in Python."""

import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom import plans
from ctxloom.functions import chunk as C
from ctxloom.functions import text as T
from ctxloom.operators import answering as A
from ctxloom.operators import baselines as B
from ctxloom.operators import evaluation as E
from ctxloom.operators import graph as G
from ctxloom.operators import learning as L
from ctxloom.operators import retrieval as R
from ctxloom.operators import sufficiency as S
from ctxloom.sources import corpus
from tests.conftest import SF

NODE = "graph_id string, pos int, id string, text string, base string, chunk int, section string, embedding array<double>"


def _embed(text, dims=256):
    v = np.zeros(dims)
    for token, n in Counter(re.findall("[a-z0-9.]+", text.lower())).items():
        h = zlib.crc32(token.encode())
        v[h % dims] += n if h >> 31 else -n
    return v / (np.sqrt((v * v).sum()) or 1)


DOCS = [(1, "the rent is due on the first day"), (2, "tulips grow in the garden"), (3, "rent and fees are due in march"), (4, "nothing to see"), (5, "rent and fees are due in march")]


def test_dense_baseline(spark):
    docs, asked = spark.createDataFrame(DOCS, "id long, text string"), spark.createDataFrame([(1, "when is rent due"), (2, "tulips")], "query_id long, text string")
    hits, answers = B.dense_answers(asked, docs, 2)
    for q, text in ((1, "when is rent due"), (2, "tulips")):
        want = sorted(DOCS, key=lambda d: (-round(float(_embed(d[1]) @ _embed(text)), 12), d[0]))[:2]
        got = sorted((r["rank"], r.id, r.score) for r in hits.where(f"query_id = {q}").collect())
        assert [i for _, i, _ in got] == [i for i, _ in want] and math.isclose(got[0][2], float(_embed(want[0][1]) @ _embed(text)))
    answer = {r.query_id: r for r in answers.collect()}
    assert "when is rent due" in answer[1].prompt and answer[1].prompt_length == len(answer[1].prompt) and answer[1].answer.startswith("Based on the context: the rent is due")


def test_embeddings_of_equal_texts_are_made_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def counted(texts):
        calls.add(len(texts))
        return texts.map(lambda t: [float(len(t or ""))])

    got = B.embed_distinct(spark.createDataFrame([*DOCS, (6, None)], "id long, text string"), counted).collect()
    assert {r.id: r.embedding[0] for r in got} == {i: float(len(t)) for i, t in DOCS} | {6: 0.0} and calls.value == 5


def test_hybrid_is_one_ranking_at_the_ends(spark):
    docs, asked = spark.createDataFrame(DOCS, "id long, text string"), spark.createDataFrame([(1, "rent due in march")], "query_id long, text string")
    sparse = [r.id for r in R.bm25(docs, asked, 2).orderBy("rank").collect()]
    assert [r.id for r in B.HybridRetriever(2, 0.0).retrieve(asked, docs).orderBy("rank").collect()] == sparse == [3, 5]


def test_similarity_paths_agree(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(k, r.normal(size=6).round(2).tolist()) for k in range(60)] + [(60, [0.1] * 6), (61, [0.1] * 6), (62, None), (63, [1.0, 2.0])]
    corpus_, asked = spark.createDataFrame(rows, "id long, vector array<double>"), spark.createDataFrame(rows[::7] + [(62, None)], "query_id long, query array<double>")
    take = lambda df: sorted((x.query_id, x["rank"], x.id, round(x.score, 9)) for x in df.collect())
    fast, most = take(R.top_similar(asked, corpus_, 5)), sorted((x.query_id, round(x.max_similarity, 9)) for x in R.max_similarity(asked.where("query IS NOT NULL"), corpus_.where("vector IS NOT NULL")).collect())
    monkeypatch.setattr(R, "SENT_NUMBERS", -1)
    assert take(R.top_similar(asked, corpus_, 5)) == fast
    assert sorted((x.query_id, round(x.max_similarity, 9)) for x in R.max_similarity(asked.where("query IS NOT NULL"), corpus_.where("vector IS NOT NULL")).collect()) == most
    monkeypatch.setattr(R, "SENT_ROWS", 2)
    assert take(R.top_similar(asked, corpus_, 5)) == fast


def test_neighbours_and_their_documents(spark):
    docs = spark.createDataFrame([(1, ["acme", "bolt", "crane"]), (2, ["acme", "bolt"]), (3, ["crane", "dock"]), (4, ["solo"])], "id long, entities array<string>")
    asked = spark.createDataFrame([(1, "acme"), (2, "dock")], "query_id long, entity string")
    assert {(r.query_id, r.neighbour, r.weight) for r in B.neighbours(docs, asked, 1).collect()} == {(1, "bolt", 2), (2, "crane", 1)}
    assert {(r.query_id, r.id, r.n) for r in B.graph_documents(docs, asked, 1).collect()} == {(1, 1, 2), (1, 2, 2), (2, 3, 2), (2, 1, 1)}


def test_all_metrics(spark):
    rows = [("a", "what is due", "Rent is due on the first day of march. Yes.", "Rent is due in march", ["rent is due march", "tulips grow here"]), ("b", "q", None, None, None), ("c", "", "Some answer here", "x", [])]
    got = {r.id: r for r in E.all_metrics(spark.createDataFrame(rows, "id string, query string, answer string, context string, units array<string>")).collect()}
    a = got["a"]
    assert math.isclose(a.relevance, max(0, float(_embed(rows[0][1]) @ _embed(rows[0][2])))) and math.isclose(a.context_relevance, max(0, float(_embed(rows[0][1]) @ _embed(rows[0][3]))))
    assert math.isclose(a.faithfulness, float(_embed("Rent is due on the first day of march") @ _embed(rows[0][3])))
    assert a.unit_coverage == 0.5 and a.token_use == 2.0 and a.answer_tokens == 10 and math.isclose(a.lexical_relevance, 2 / 3) and a.completeness == 0.5
    assert got["b"].relevance == got["b"].faithfulness == 0 and got["b"].unit_coverage == 1 and got["c"].relevance == 0


def test_reports(spark):
    pairs = spark.createDataFrame([("m_1", 1.0 + k / 10, 0.5) for k in range(8)], "metric string, a double, b double")
    low = {c: E.interval(pairs, "metric", confidence=c).first() for c in (0.95, 0.99)}
    d = np.array([0.5 + k / 10 for k in range(8)])
    half = d.std(ddof=1) / math.sqrt(8)
    assert math.isclose(low[0.95].ci_low, d.mean() - 2.571 * half) and math.isclose(low[0.99].ci_high, d.mean() + 3.25 * half)
    tests = E.bonferroni(E.paired_t_test(pairs, "metric")).join(pairs.groupBy("metric").agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b")), "metric")
    table = E.latex_table(tests)
    assert r"m\_1 & 1.350 & 0.500 & +0.850" in table and r"\textbf{" in table and table.count(r"\\") == 2
    ledger = spark.createDataFrame([("v3", "gpt-4", "initial", 1000), ("v3", "gpt-4", "run", 300), ("rag", "local", "run", 90)], "system string, model string, phase string, tokens long")
    assert [(r.system, round(r.times_least, 2)) for r in E.cost_comparison(ledger, 10).collect()] == [("rag", 1.0), ("v3", 4.44)]


def test_learning(spark):
    rows = [(x / 10, x / 10 + 0.01, (x % 3) / 3, 0.5) for x in range(11)]
    features = spark.createDataFrame(rows, "target double, good double, noise double, flat double")
    losses = {r.feature: r.loss for r in L.ablation(features, ["good", "noise", "flat"]).collect()}
    assert losses["good"] > 0 > losses["noise"]
    nodes = spark.createDataFrame([("g", k, f"d_chunk_00{k}", "t", "d", k, None, [1.0, float(k)]) for k in range(3)], NODE)
    targets = spark.createDataFrame([("g", 1.0)], "graph_id string, target double")
    trials, config = L.learn(features, ["noise", "good", "flat"], nodes, targets, [{"same_source": 0.0, "adjacency": 0.0}, {"same_source": 1.0}], weight_trials=3)
    assert config["features"][0] == "good" and config["edges"] == {"same_source": 1.0}
    assert {r.phase: r.n for r in L.trial_summary(trials).collect()} == {"features": 1, "weights": 3, "edges": 2}


def test_scores_of_graphs(spark):
    nodes = spark.createDataFrame([("g", 0, "a", "alpha beta", "a", None, None, [1.0]), ("g", 1, "b", "beta gamma", "b", None, None, [1.0]), ("h", 0, "c", "", "c", None, None, [1.0])], NODE)
    edges = spark.createDataFrame([("g", "a", "b", "x", 0.5), ("g", "a", "lost", "x", 1.0)], "graph_id string, source string, target string, relation string, weight double")
    same = lambda x, y: F.when(x.contains("alpha") & y.contains("gamma"), 1.0).otherwise(0.0)
    assert {r.graph_id: r.contradiction for r in G.contradiction_score(nodes, edges, same).collect()} == {"g": 0.25, "h": 0.0}
    asked = spark.createDataFrame([("g", "gamma beta"), ("h", "x")], "graph_id string, query string")
    assert {r.graph_id: r.semantic for r in G.semantic_score(nodes, asked).collect()} == {"g": 1.0, "h": 0.5}


def test_overlap_counts_shared_terms_only(spark):
    nodes = spark.createDataFrame([("g", 0, "a", "zebra quagga unicorn", "a", None, None, [1.0, 0.0]), ("g", 1, "b", "zebra walrus", "b", None, None, [0.0, 1.0])], NODE)
    idf = spark.createDataFrame([("zebra", 2.0), ("quagga", 9.0), ("unicorn", 9.0), ("walrus", 3.0)], "term string, idf double")
    assert math.isclose(G.build_edges(nodes, idf=idf, least=0.0).first().weight, 0.35 * 2 / 6)
    chunks = [("g", k, f"d_chunk_00{k}", "", "d", k, s, [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k, s in enumerate(("1", None, "2", "3"))]
    weights = {(r.source[-1], r.target[-1]): round(r.weight, 3) for r in G.build_edges(spark.createDataFrame(chunks, NODE)).collect()}
    assert weights["0", "1"] == weights["1", "2"] == 0.45 and weights["2", "3"] == 0.325  # half only where both sections are known and differ


def test_a_subquery_without_a_like_node_has_no_best(spark):
    nodes = spark.createDataFrame([("g", 0, "a", "", "a", None, None, [1.0, 0.0]), ("g", 1, "b", "", "b", None, None, [0.0, 1.0])], NODE)
    subs = spark.createDataFrame([("g", 0, [1.0, 0.0]), ("g", 1, [-1.0, -1.0])], "graph_id string, subquery_id int, vector array<double>")
    assert math.isclose(S.subquery_coverage(nodes, subs).first().subquery_coverage, 0.7 * (0.6 * 0.5 + 0.4 * 0.5) + 0.15)


def test_relation_questions(spark):
    got = spark.createDataFrame([("How is royalty linked with payment",), ("  ",)], "q string").select(T.subqueries(F.col("q")).alias("s")).collect()
    assert "How is royalty linked to payment?" in got[0].s and got[0].s[-1] == "How is royalty linked with payment" and got[1].s == []


def test_quotas_and_content(spark):
    rows = [(f"c{k}", 10 - k, k % 4, 12 - k, 0.0) for k in range(9)]
    ranked = spark.createDataFrame(rows, "name string, trap_a_count int, trap_b_count int, trap_c_sections int, total_score double")
    got = {}
    for r in A.choose_by_quota(ranked, spark.createDataFrame([("c0",)], "name string"), 2, 1, 6).collect():
        got.setdefault(r.trap_type, set()).add(r.name)
    assert got == {"A": {"c1", "c2"}, "B": {"c3", "c7"}, "C": {"c4", "c5"}}
    text = 'First words. The fee, subject to Section 4.2(a), is due.\nMore. "Net Fee" means the fee\nless tax. Section 1 and Article 2 and Section 3.1.'
    row = spark.createDataFrame([(text,), ("Nothing",)], "t string").select(A.override_clause(F.col("t")).alias("a"), A.definition_clause(F.col("t")).alias("b"), A.scattered_sections(F.col("t")).alias("c")).collect()
    assert row[0].a.snippet == "The fee, subject to Section 4." and row[0].a.section == "Section 4" and tuple(row[0].b) == ("Net Fee", "the fee less tax.") and row[0].c == ["4.2(a)", "1", "2", "3.1"]
    assert row[1].a is None and row[1].b is None and row[1].c is None


def test_chunks_of_repeated_rows(spark):
    body = "".join(f"\nARTICLE {n}. Heading of the part\n" + "Words that fill the part of the text well. " * k for n, k in (("I", 2), ("II", 40), ("III", 3)))
    docs = spark.createDataFrame([("x", "Title", body), ("x", "Title", body), ("y", None, "plain " * 300), ("z", "T", None)], "id string, title string, text string")
    rows = C.chunk_documents(docs).collect()
    once = [r for r in rows if r.source_doc_id == "x"]
    assert len(once) % 2 == 0 and Counter(Counter(r.id for r in once).values()) == {2: len(once) // 2}
    first = {r.chunk_index: r for r in once}
    assert sorted(first) == list(range(len(first))) and {r.section_id for r in once} >= {"I", "II", "III"}
    assert all(r.text.startswith("[ARTICLE II") for r in once if r.section_id == "II") and all(len(r.text) <= 560 for r in rows)
    assert [r.text for r in rows if r.source_doc_id == "z"] == ["T"]


def test_settings_and_files(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("# a comment\nmodel: 'small one'\nlimit: 12 # at most\n\nurl: http://x.y\n")
    assert {r.key: r.value for r in corpus.read_settings(spark, str(tmp_path / "s.yaml")).collect()} == {"model": "small one", "limit": "12", "url": "http://x.y"}
    rows = spark.createDataFrame([("weights", "a", 1.5), ("weights", "b", 2.0), ("edges", "c", 0.1)], "section string, name string, value double")
    corpus.write_parameters(rows, str(tmp_path / "p"))
    assert sorted(corpus.read_parameters(spark, str(tmp_path / "p")).collect()) == sorted(rows.collect())
    scan = spark.createDataFrame([(f"c{k}", "p", k, 0, 0, 0, float(k)) for k in range(5)], "name string, path string, trap_a_count int, trap_b_count int, trap_c_count int, trap_c_sections int, total_score double")
    corpus.write_trap_scan(scan, str(tmp_path / "scan"), 3)
    assert {r.name for r in spark.read.json(str(tmp_path / "scan")).collect()} == {"c4", "c3", "c2"}
    (tmp_path / "scan.json").write_text(json.dumps([{"name": "c", "trap_a_count": 2, "total_score": 4.0}]))
    assert corpus.read_trap_scan(spark, str(tmp_path / "scan.json")).first().trap_a_count == 2
    with pytest.raises(ValueError):
        corpus.active(spark)
    corpus.set_active(scan)
    assert corpus.active(spark).count() == 5
    corpus.clear_active(spark)
    assert corpus.active(spark, rows).count() == 3
    (tmp_path / "t").mkdir()
    for k in range(3):
        (tmp_path / "t" / f"f{k}.txt").write_text("\n\n".join("Some words of a paragraph that is long enough. " * 8 for _ in range(4)))
    chunks = corpus.read_text_corpus(spark, str(tmp_path / "t"), most_files=2)
    assert {r.source for r in chunks.collect()} == {"f0", "f1"} and chunks.where("id = 'f0_chunk_000'").count() == 1
    corpus.write_chunks(chunks, str(tmp_path / "chunks"))
    assert corpus.read_chunks(spark, str(tmp_path / "chunks")).count() == chunks.count()
    graph = {"nodes": [{"id": "n", "text": "one"}, {"id": "n", "text": "two"}], "edges": [{"source": "n", "target": "m", "relation": "r", "weight": 0.5}]}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    nodes, edges = corpus.read_graph(spark, str(tmp_path / "g.json"))
    assert [r.text for r in nodes.collect()] == ["one"] and edges.first().weight == 0.5


def test_added_nodes_and_reranking(spark):
    nodes = spark.createDataFrame([("g", k, f"d_chunk_00{k}", "t", "d", k, None, [1.0, 0.0]) for k in range(2)], NODE)
    new = spark.createDataFrame([("g", 2, "d_chunk_002", "t", "d", 2, None, [1.0, 0.0]), ("g", 9, "d_chunk_000", "again", "d", 0, None, [1.0, 0.0])], NODE)
    every, edges = G.add_node(nodes, G.build_edges(nodes), new)
    assert every.count() == 3 and {(r.source, r.target) for r in edges.collect()} == {("d_chunk_000", "d_chunk_001"), ("d_chunk_000", "d_chunk_002"), ("d_chunk_001", "d_chunk_002")}
    hits = spark.createDataFrame([(1, "a", "garden flowers", "flowers grow"), (1, "b", "garden flowers", "garden flowers grow"), (1, "c", "garden flowers", "stones")], "query_id long, id string, query string, text string")
    assert [r.id for r in A.rerank(hits, k=2).orderBy("rank").collect()] == ["b", "a"]


def test_greedy_policy_never_lowers_the_score(spark):
    from ctxloom import plans

    rows = plans.QUERIES["greedy_policy"](spark, SF).collect()
    assert rows and all(r.gain >= -1e-9 and 0 <= r.step < 5 for r in rows) and {r.action for r in rows} <= {"expand", "prune", "compress", "stop"}
    last = {}
    for r in sorted(rows, key=lambda r: r.step):
        assert r.css >= last.get(r.graph_id, 0) - 1e-9
        last[r.graph_id] = r.css


def test_every_item_of_the_benchmark_is_searched_for(spark):
    items = {r.item_id for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert {r.query_id for r in plans.QUERIES["tfidf_topk"](spark, SF).collect()} == items and any(i % 20 for i in items)


@pytest.mark.parametrize("sent, held", [(10_000, 4_000_000), (10_000, 1), (0, 50)])
def test_nearest_of_many_queries_by_blocks(spark, monkeypatch, sent, held):
    """Queries sent and dealt out, documents taken a few at a time, copies that tie, and rows without an id."""
    for name, n in (("SENT_QUERIES", sent), ("HELD", held), ("QUERY_BLOCK", 2), ("ROW_BLOCK", 8)):
        monkeypatch.setattr(B, name, n)
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(30)]
    said = lambda n: " ".join(rng.choice(words, n))
    docs = [(k, said(rng.integers(1, 12))) for k in range(40)] + [(k, "w1 w2 w3") for k in range(100, 108)] + [(None, "w4 w4 w9"), (900, None), (901, "")]
    asked = [(k, said(4)) for k in range(7)] + [(50, "w1 w2"), (None, "w4"), (51, "unseen"), (52, None)]
    tf = {i: Counter((t or "").split()) for i, t in docs}
    df = Counter(w for d in tf.values() for w in d)
    vector = lambda c: {w: n * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, n in c.items() if w in df}
    unit = lambda v: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}
    want = {}
    for q, t in asked:
        v = unit(vector(Counter((t or "").split())))
        scores = [(round(sum(x * v.get(w, 0) for w, x in unit(vector(d)).items()), 9), i) for i, d in tf.items() if v.keys() & d.keys()]
        want |= {(q, r + 1): (i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], -1 if x[1] is None else x[1]))[:5])}
    got = B.tfidf_similar(spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, text string"))
    assert {(r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in got.collect()} == want
