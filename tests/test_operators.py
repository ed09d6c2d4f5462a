"""Operators on small literal inputs, against plain Python."""

import json
import math

from pyspark.sql import functions as F

from ctxloom.functions import chunk as C
from ctxloom.functions import text as T
from ctxloom.functions import vector as X
from ctxloom.operators import evaluation as E
from ctxloom.operators import graph as G
from ctxloom.operators import policy as P
from ctxloom.operators import sufficiency as S
from ctxloom.sources import corpus
from ctxloom.streaming import ingest as I

NODE = "graph_id string, pos int, id string, text string, base string, chunk int, section string, embedding array<double>"


def _one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()[0]


def _graph(spark, n=4):
    return spark.createDataFrame([("g", k, f"d_chunk_{k:03d}", f"alpha beta {'abcdefgh'[k] * 4}", "d", k, None, [1.0, float(k), 0.0]) for k in range(n)], NODE)


def test_cosine_guards(spark):
    v = lambda x: F.array(*map(F.lit, x)).cast("array<double>")
    for a, b, want in (([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0], [1.0, 1.0], 0.0)):
        assert spark.range(1).select(X.cosine(v(a), v(b))).first()[0] == want


def test_specificity_and_bands(spark):
    assert _one(spark, T.specificity(F.col("t")), t="Thanks!") == 0
    assert _one(spark, T.specificity(F.col("t")), t="We paid $40.00 on 01/02/2024 for 3 days") > 0.9
    assert [_one(spark, T.length_band(F.col("t")), t="w " * n) for n in (4, 5, 15, 30)] == [0.0, 0.3, 0.6, 1.0]


def test_chunk_ids(spark):
    assert _one(spark, T.chunk_index(F.col("i")), i="x_chunk_001_chunk_007") == 7
    assert _one(spark, T.base_document(F.col("i")), i="contract_chunk_003") == "contract"
    assert _one(spark, T.base_document(F.col("i")), i="plain") == "plain"


def test_contradictions(spark):
    got = spark.createDataFrame([("Fees are due, unless otherwise agreed, in no event shall they exceed 5.",)], ["t"]).select(F.inline(T.contradiction_flags(F.col("t")))).collect()
    assert {r.indicator for r in got} == {"unless otherwise agreed", "in no event shall"}


def test_recursive_split_keeps_all_words():
    text = " ".join(f"word{k}." for k in range(400))
    parts = C.recursive_split(text, 200, 40)
    assert all(len(p) <= 200 for p in parts) and {w for p in parts for w in p.replace(".", " ").split()} == {f"word{k}" for k in range(400)}
    assert C.recursive_split("x" * 1000, 300, 50)[0] == "x" * 300 and C.recursive_split("", 10, 2) == []


def test_sections(spark):
    body = "".join(f"\nARTICLE {r}. Heading of it\n" + "Some words that make the section long enough to stay. " * 3 for r in ("I", "II", "III"))
    out = C.chunk_documents(spark.createDataFrame([("d", "Title", body), ("e", "Note", "short")], ["id", "title", "text"])).orderBy("id").collect()
    assert [r.id for r in out if r.source_doc_id == "d"] == [f"d_chunk_{k:03d}" for k in range(3)] and [r.section_id for r in out if r.section_id] == ["I", "II", "III"]


def test_edges_and_connectivity(spark):
    n = _graph(spark, 3)
    edges = G.build_edges(n)
    assert edges.count() == 3 and edges.where("weight > 1 OR weight < 0.15").count() == 0
    single = n.where("pos = 0")
    assert G.connectivity(single, edges.limit(0)).first().connectivity == 1.0
    three = spark.createDataFrame([("g", "d_chunk_000", "d_chunk_001", "x", 1.0)], "graph_id string, source string, target string, relation string, weight double")
    assert math.isclose(G.connectivity(n, three).first().connectivity, 1 / 3)


def test_edges_do_not_depend_on_partitions(spark):
    n = _graph(spark, 6)
    a, b = ({tuple(r) for r in G.build_edges(x).collect()} for x in (n, n.repartition(7)))
    assert a == b


def test_prune_and_compress(spark):
    n = _graph(spark, 4)
    q = spark.createDataFrame([("g", [1.0, 3.0, 0.0])], "graph_id string, query array<double>")
    assert {r.id for r in G.prune(n, G.build_edges(n).where("false"), q).collect()} == {f"d_chunk_{k:03d}" for k in (1, 2, 3)}
    assert G.prune(n.where("pos < 3"), G.build_edges(n), q).count() == 3
    assert G.compress(n, 0.5).count() == 2 and G.compress(n, 0.9).count() == 4


def test_score_is_monotone_in_relevance(spark):
    rows = [(x, 0.5, 0.1, 0.4, 0.6, 0.9, None) for x in (0.1, 0.5, 0.9)]
    f = spark.createDataFrame(rows, "query_relevance double, context_cohesion double, redundancy double, graph_connectivity double, coverage double, token_efficiency double, subquery_coverage double")
    got = [r[0] for r in f.select(S.score()).collect()]
    assert got == sorted(got) and all(0 < x < 1 for x in got)


def test_policy_ends_on_least_gain_and_passes_subqueries(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    n = _graph(spark, 4)
    q = spark.createDataFrame([("g", "alpha beta", [1.0, 1.0, 0.0])], "graph_id string, query string, vector array<double>")
    sub = spark.createDataFrame([("g", 0, [1.0, 0.0, 0.0])], "graph_id string, subquery_id int, vector array<double>")
    refs = spark.createDataFrame([], "a string, b string")
    args = n, n.drop("graph_id", "pos"), refs, q
    plain, given = (P.step(*args, P.Policy(), s)[1].first().css for s in (None, sub))
    assert plain != given
    seen = []

    def always_moves(nodes, *rest):
        seen.append(nodes.count())
        return nodes, spark.createDataFrame([("g", "prune", 0.5, 0.04 if len(seen) < 2 else 0.01)], "graph_id string, action string, css double, gain double")

    monkeypatch.setattr(P, "step", always_moves)
    nodes, trace = P.optimise(*args, subqueries=sub)
    assert len(seen) == 4 and trace.count() == 4 and nodes.count() == 4


def test_policy_stops(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    n = _graph(spark, 4)
    q = spark.createDataFrame([("g", "alpha beta", [1.0, 1.0, 0.0])], "graph_id string, query string, vector array<double>")
    refs = spark.createDataFrame([], "a string, b string")
    nodes, trace = P.optimise(n, n.drop("graph_id", "pos"), refs, q, P.Policy(steps=1))
    row = trace.first()
    assert row.action in P.ACTIONS and 0 < row.css < 1 and nodes.count() >= 1


def test_statistics(spark):
    a, b = [0.9, 0.8, 0.7, 0.95, 0.6, 0.85], [0.5, 0.6, 0.65, 0.7, 0.6, 0.4]
    p = spark.createDataFrame(list(zip(a, b, strict=True)), ["a", "b"])
    d = [x - y for x, y in zip(a, b, strict=True)]
    mean = sum(d) / 6
    sd = math.sqrt(sum((x - mean) ** 2 for x in d) / 5)
    row = E.paired_t_test(p).first()
    assert math.isclose(row.t, mean / (sd / math.sqrt(6))) and 0 < row.p_value < 0.05 and row.effect_size == "large"
    w = E.wilcoxon_test(p).first()
    assert (w.n, w.w_minus, w.w_plus) == (5, 0.0, 15.0) and 0 < w.p_value < 0.06
    same = E.paired_t_test(p.select("a", F.col("a").alias("b"))).first()
    assert same.t == 0 and same.p_value == 1


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"documents": [{"id": "1", "title": "t", "text": "x", "source": "s"}]}))
    assert corpus.read_json_corpus(spark, str(tmp_path / "c.json")).first().text == "x"
    (tmp_path / "c.csv").write_text("id,title,content\na,T,one\na,,two\n,,\nb,B,three\n")
    got = corpus.read_csv_corpus(spark, str(tmp_path / "c.csv")).orderBy("id").collect()
    assert [(r.id, r.text) for r in got] == [("a", "one"), ("a_1", "two"), ("b", "three")]
    note = {"id": "1", "contract_file": "c", "query": "q", "trap_type": "A", "ground_truth_answer": "yes", "information_units": ["u"], "relevant_sections": []}
    (tmp_path / "g.json").write_text(json.dumps({"annotations": [note, note | {"query": "REPLACE me"}]}))
    rows = corpus.read_annotations(spark, str(tmp_path / "g.json"))
    assert rows.count() == 1 and {r.issue: r.n for r in corpus.validate_annotations(rows).collect()}["no_sections"] == 1


def test_ingestion_versions(spark, tmp_path):
    index = I.Index(spark, str(tmp_path / "index"))
    long = "The first version of this text is long enough to be of use to anyone who reads it, with 3 numbers and 40 days."
    for k, (op, text) in enumerate((("create", long), ("create", long), ("update", long + " Changed."), ("delete", None), ("create", long))):
        index.ingest(spark.createDataFrame([(k, op, "d", text)], I.EVENT), k)
    assert [r.action for r in index.results().orderBy("seq").collect()] == ["added", "unchanged", "updated", "deleted", "added" if False else "updated"]
    assert index.active().first().version == 3 and index.history("d").count() == 4


def test_gate_rejects_copies(spark, tmp_path):
    index = I.Index(spark, str(tmp_path / "index"), gated=True)
    text = "Invoice 4471 for $1,250.00 is 30 days late and the account will be closed after 45 days unless payment arrives by 03/01/2024."
    index.ingest(spark.createDataFrame([(1, "create", "a", text), (2, "create", "b", "Thanks!")], I.EVENT), 0)
    index.ingest(spark.createDataFrame([(3, "create", "c", text), (4, "update", "a", text + " Reminder sent.")], I.EVENT), 1)
    got = {(r.doc_id, r.action) for r in index.results().collect()}
    assert got == {("a", "added"), ("b", "rejected"), ("c", "rejected"), ("a", "updated")}


def test_index_goes_on_after_a_restart(spark, tmp_path):
    path = str(tmp_path / "index")
    for k in range(13):  # each time a new Index on the same folder, over a compaction
        index = I.Index(spark, path)
        index.ingest(spark.createDataFrame([(k, "create", f"d{k}", f"text of document number {k}"), (100 + k, "update", "d0", f"version {k} of the first")], I.EVENT), k)
        index.ingest(spark.createDataFrame([(k, "create", "never", "the same batch again")], I.EVENT), k)
    index = I.Index(spark, path)
    rows = {r.doc_id: (r.version, r.text) for r in index.active().collect()}
    assert index.batch == 12 and len(rows) == 13 and rows["d0"] == (14, "version 12 of the first") and rows["d12"][0] == 1
    assert index.history("d0").count() == 14 and {r.action: r.n for r in index.stats().collect()} == {"added": 13, "updated": 13}


def test_queries_of_the_index(spark, tmp_path):
    index = I.Index(spark, str(tmp_path / "index"), gated=True, threshold=0.38)
    index.load(spark.createDataFrame([("a", "rent is due on the first of the month"), ("b", "the garden has roses and tulips"), ("c", "when rent rises by 3% a year")], "doc_id string, text string"))
    hits = index.query("when is the rent due", 2).collect()
    assert [r.id for r in hits] == ["a", "c"] and 0 < hits[0].css < 1 and hits[0].score > hits[1].score
    for k in range(25):
        index.spark.createDataFrame([(2 + k, "when is the rent due")], "n long, text string").write.mode("append").parquet(f"{index.path}/queries")
    assert index.recent_queries().count() == 20
    # What recent queries ask for passes the gate, and what is beside it does not.
    events = [(1, "create", "x", "when is the rent due in this year of ours for us"), (2, "create", "y", "some plain words on quite another matter, nothing to see here")]
    index.ingest(spark.createDataFrame(events, I.EVENT), 1)
    assert {r.doc_id: r.action for r in index.results().where("doc_id in ('x', 'y')").collect()} == {"x": "added", "y": "rejected"}


def test_streaming_query(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"seq": k, "op": "create", "doc_id": f"d{k}", "text": f"text number {k}"} for k in range(3)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    index = I.Index(spark, str(tmp_path / "index"))
    index.start(spark.readStream.schema(I.EVENT).json(str(tmp_path / "in")), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert index.active().count() == 3


def test_parse_of_model_output(spark):
    from ctxloom.operators.answering import parse_response

    rows = [('{"entities": ["a"], "intent": "definition"}',), ('Sure:\n```json\n{"subqueries": ["q"]}\n```',), ('x {"entities": []} y',), ("nothing",), (None,)]
    got = [r.p for r in spark.createDataFrame(rows, "t string").select(parse_response(F.col("t")).alias("p")).collect()]
    assert (got[0].entities, got[0].intent) == (["a"], "definition") and got[1].subqueries == ["q"] and got[2].intent == "factual" and got[3] is None and got[4] is None


def test_retries_stop(spark):
    from ctxloom.operators.answering import retrieve_with_retries

    q = spark.createDataFrame([(1, "good"), (2, "bad")], "query_id long, text string")
    retrieve = lambda df: df.select("query_id", F.lit(7).alias("id"), F.when(F.col("text").contains("good"), 0.9).otherwise(0.1).alias("score"), F.lit(1).alias("rank"))
    got = {(r.query_id, r.attempt) for r in retrieve_with_retries(q, retrieve, lambda t: F.concat(t, F.lit("x"))).collect()}
    assert got == {(1, 0), (2, 2)}


def test_relations_and_prompts(spark):
    from ctxloom.operators import answering as A

    r = _one(spark, A.relations(F.col("q")), q="How is royalty linked with payment")
    assert {(x.e1, x.relation, x.e2) for x in r} >= {("royalty", "linked", "payment")}
    assert _one(spark, F.size(A.relations(F.col("q"))), q="Plain words") == 0
