"""What is moved and made anew does not grow faster than the tables."""

import math
import os
import random
import re
import tempfile
import uuid

from pyspark.sql import functions as F

from ctxloom.functions import chunk as C
from ctxloom.functions import text as T
from ctxloom.functions import vocabulary as V
from ctxloom.operators import answering as A
from ctxloom.operators import baselines as B
from ctxloom.operators import graph as G
from ctxloom.plans import contracts
from ctxloom.sources import tables
from tests.conftest import SF


def _chunks(spark):
    rows = [("c", "x1", '"Lot 1" means part 1. See Section 2.', "1"), ("c", "x2", "Returns of lot 12 are excluded; ſection 1 holds.", "2"), ("d", "y1", "Lot 1 is unknown here, as is the pilot 1.", "1"), ("c", "x3", "The pilot 1 has no lots.", None), ("c", "x4", None, "4")]
    return spark.createDataFrame(rows, "within string, id string, text string, section string")


def test_each_bucket_of_references_is_one_file(spark):
    refs = spark.range(400).select(F.concat(F.lit("a"), "id").alias("a"), F.concat(F.lit("b"), F.col("id") % 7).alias("b"), F.lit("section_ref").alias("type")).repartition(8)
    path = tempfile.mkdtemp() + "/index"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = G.write_reference_index(refs, f"sizes_{uuid.uuid4().hex}", path, 3)
        assert table.count() == 400 and len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_references_by_few_and_by_many_terms_are_the_same(spark, monkeypatch):
    want = {("x1", "x2", "section_ref"), ("x2", "x1", "section_ref"), ("x2", "x1", "defined_term")}
    assert {tuple(r) for r in G.cross_references(_chunks(spark), "within").collect()} == want
    monkeypatch.setattr(G, "SENT_DEFINED", 0)
    assert {tuple(r) for r in G.cross_references(_chunks(spark), "within").collect()} == want


def test_pairs_meet_references_without_what_the_nodes_hold(spark):
    rows = [("g", k, f"n{9 - k}", "Some Longer Words", "b", k, None, [1.0, float(k)]) for k in range(3)]
    nodes = spark.createDataFrame(rows, "graph_id string, pos int, id string, text string, base string, chunk int, section string, embedding array<double>")
    assert "text" not in G._with_terms(nodes, None).columns
    refs = spark.createDataFrame([("n9", "n7")], "a string, b string")
    edges = G.build_edges(nodes, refs)
    got = {(r.source, r.target): r.relation for r in edges.collect()}
    assert got[("n9", "n7")].startswith("cross_ref|") and not got[("n9", "n8")].startswith("cross_ref")
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    after = plan[plan.index(join):].splitlines()[1]
    assert "Project" in after and "embedding" not in after and "entities" not in after.split("AS")[0]


def test_a_value_is_made_once(spark):
    row = spark.sql("SELECT 'Ab ab' AS t").select(T.once(F.lower("t"), lambda x: F.concat(x, x)).alias("x"), T.query_coverage(F.col("t"), F.lit("word")).alias("c")).first()
    assert row.x == "ab abab ab" and row.c == 0.0


def test_search_in_blocks_and_apart(spark, monkeypatch):
    import numpy as np

    from ctxloom.operators import retrieval as R

    r = np.random.default_rng(3)
    x = r.normal(size=(90, 5))
    x[10] = x[11] = x[31]  # ties go to the smaller id
    groups = [k % 3 if k != 7 else None for k in range(90)]
    corpus = spark.createDataFrame([(k, v.tolist(), g) for k, (v, g) in enumerate(zip(x, groups, strict=True))], "id long, vector array<double>, group int").repartition(3)
    queries = corpus.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"), "group")
    want = {}
    for q in range(0, 90, 5):
        can = [k for k in range(90) if groups[k] is not None and groups[k] != groups[q]]
        want[q] = sorted(can, key=lambda k: (-float(x[q] @ x[k]), k))[:4]

    def check():
        got = {}
        for row in R.top_similar(queries, corpus, 4, apart=True).orderBy("query_id", "rank").collect():
            got.setdefault(row.query_id, []).append(row.id)
        assert got == want

    check()
    for name, value in (("SENT_ROWS", 2), ("QUERY_BLOCK", 5), ("ROW_BLOCK", 20)):
        monkeypatch.setattr(R, name, value)
    check()
    plan = R.top_similar(queries, corpus, 4, apart=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "zip_with" not in plan


def test_quality_by_group_is_that_of_listed_pairs(spark):
    from ctxloom.operators import retrieval as R

    corpus = spark.createDataFrame([(k, k % 3) for k in range(12)] + [(50, 9)], "id long, group int")
    asked = corpus.where("id IN (0, 4, 50)").withColumnRenamed("id", "query_id")
    found = spark.createDataFrame([(0, 3), (0, 4), (4, 7)], "query_id long, id long")
    relevant = asked.join(corpus, "group").where("id != query_id").select("query_id", "id")
    assert sorted(map(tuple, R.group_quality(found, asked, corpus).collect())) == sorted(map(tuple, R.retrieval_quality(found, relevant).collect()))


def test_cosine_candidates_by_matrix_products(spark, monkeypatch):
    from ctxloom.operators import retrieval as R

    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [-1.0, 0.1]), (5, [5.0, 5.0]), (6, [1.0]), (7, [1.0, None])]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0], 7), (2, [0.0, 3.0], 2)], "query_id long, query array<double>, most int")
    for _ in range(2):
        got = {(r.query_id, r.id): round(r.score, 6) for r in R.cosine_candidates(queries, corpus).collect()}
        assert {i: got[1, i] for i in range(1, 8)} == {1: 1.0, 2: 0.0, 3: 0.0, 4: -0.995037, 5: 0.707107, 6: 0.0, 7: 0.0}
        assert (2, 5) in got and got[2, 5] == 0.707107
        monkeypatch.setattr(R, "SENT_ROWS", 1)


def test_a_qualifier_is_tried_only_where_its_word_stands(spark, monkeypatch):
    monkeypatch.setattr(V, "QUALIFIERS", {r"\bfees\b": "due", r"\bdue\b": "due"})
    rows = spark.createDataFrame([(1, "No fees."), (2, "Fees are due."), (3, "feeſ, if ıt be"), (4, None)], "id int, t string")
    got = [(r[0], r[1]) for r in rows.select("id", F.inline(T.contradiction_flags(F.col("t")))).collect()]
    assert got == [(2, "Fees"), (2, "due"), (3, "feeſ")]


def test_places_of_single_matches_among_their_like(spark):
    texts = ["resubject to x subject to y", "\U0001d400ä subject to \U0001d400", "a\u0001subject to", "subject to and Subject to", "none", "subject tot subject to subject tot", ""]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r[0]: [tuple(p) for p in r[1]] for r in rows.select("k", T.places(F.col("t"), r"(?iU)\bsubject\s+to\b")).collect()}
    assert got == {k: [(*m.span(), m.group()) for m in re.finditer(r"(?i)\bsubject\s+to\b", t)] for k, t in enumerate(texts)}


def test_sentences_without_an_override_phrase_are_not_searched(spark, monkeypatch):
    rng = random.Random(3)
    words = ["subject to", "Notwithstanding", "except as", "a", ".", " ", "\n", "x" * 40, "ä\U0001d400" * 30, "y" * 150, "Section 4.2(b)"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    wanted = F.nullif(F.substring(F.regexp_replace(F.regexp_replace(F.regexp_extract("t", V.OVERRIDE_SENTENCE, 1), "\n", " "), r"(?U)^\s+|\s+$", ""), 1, 400), F.lit(""))
    got = rows.select(wanted.alias("a"), A.override_clause(F.col("t"))["snippet"].alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and sum(r["a"] is not None for r in got) > 50
    monkeypatch.setattr(V, "OVERRIDE_SENTENCE", r"(.*\.)")
    assert spark.createDataFrame([("Nothing. At all.",)], "t string").select(A.override_clause(F.col("t"))["snippet"]).first()[0] is None


def test_only_texts_that_are_split_again_reach_python(spark, monkeypatch):
    def marked(*_):
        return F.pandas_udf(lambda bodies: bodies.map(lambda b: None if b is None else [["seen"] for _ in b]), "array<array<string>>")

    text = "".join(f"\nSection {k}. Goods are delivered where the buyer has a warehouse of their own. \n" for k in range(3))
    rows = spark.createDataFrame([("1", "T", text), ("2", "T", "short \n"), ("3", "T", "long " * 200), ("4", "T", text.replace("own.", "own. " + "more " * 250))], "id string, title string, text string")
    before = {r["id"]: r["text"] for r in C.chunk_documents(rows).collect()}
    assert before["2_chunk_000"] == "T\nshort" and before["1_chunk_002"].endswith("their own.") and len(before) > 12
    monkeypatch.setattr(C, "splitter", marked)
    got = C.chunk_documents(rows).groupBy("source_doc_id").agg(F.max(F.contains("text", F.lit("seen"))).alias("seen")).collect()
    assert {r[0]: r[1] for r in got} == {"1": False, "2": False, "3": True, "4": True}


def test_weights_of_terms_move_texts_but_once(spark, monkeypatch):
    rows = [(1, "The cat, the dog_2 a"), (1, "cats é x"), (2, "Über über ΣΑΣ the"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "id int, text string")
    found = B.tfidf(docs)
    assert "hashpartitioning(term" not in found._jdf.queryExecution().executedPlan().toString()
    tf = {1: {"the": 2, "cat": 1, "dog_2": 1, "cats": 1}, 2: {"über": 2, "σας": 1, "the": 1}}
    df = {t: sum(t in d for d in tf.values()) for d in tf.values() for t in d}
    raw = {(k, t): c * (math.log(6 / (1 + df[t])) + 1) for k, d in tf.items() for t, c in d.items()}
    want = {(k, t): v / math.sqrt(sum(w * w for (j, _), w in raw.items() if j == k)) for (k, t), v in raw.items()}
    asked = spark.createDataFrame([(7, "the cat cat unseen"), (8, "unseen")], "query_id int, text string")
    q = {"the": math.log(6 / 3) + 1, "cat": 2 * (math.log(6 / 2) + 1)}
    score = {k: sum(want.get((k, t), 0) * v for t, v in q.items()) / math.hypot(*q.values()) for k in (1, 2)}
    for most in (B.SENT_TERMS, 0):  # with terms sent, and joined
        monkeypatch.setattr(B, "SENT_TERMS", most)
        got = {(r["id"], r["term"]): r["weight"] for r in B.tfidf(docs).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        top = {(r["query_id"], r["id"]): r["score"] for r in B.tfidf_similar(docs, asked).collect()}
        assert top.keys() == {(7, 1), (7, 2)} and all(abs(top[7, k] - score[k]) < 1e-12 for k in score)


def test_shared_terms_are_weighed_without_maps(spark):
    rows = [("g", k, f"n{k}", t, f"b{k}", 0, None, [1.0, 0.0] if k else [0.0, 1.0]) for k, t in enumerate(("alpha beta gamma common", "gamma beta delta common"))]
    nodes = spark.createDataFrame(rows, "graph_id string, pos int, id string, text string, base string, chunk int, section string, embedding array<double>")
    idf = spark.createDataFrame([("alpha", 9.0), ("beta", 1.25), ("gamma", 1.0 / 3 + 1), ("delta", 2.0), ("common", 0.5)], "term string, idf double")
    assert "map<" not in G._with_terms(nodes, idf).schema.simpleString()
    weight = G.build_edges(nodes, idf=idf).first()["weight"]
    assert abs(weight - 0.35 * (1.25 + 4 / 3) / (4 / 3 * 3)) < 1e-15


def test_lines_of_contracts_are_moved_once(spark):
    """For references, and for edges: what is made of the lines meets by contract, where the lines were dealt to."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n, index = contracts.contract_nodes(spark, SF), contracts.index(spark, SF)
        for df, sides in ((contracts.referred(spark, SF), 1), (G.build_edges(n, index), 2)):
            moved = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in x]
            assert len(moved) == sides and all("hashpartitioning(l_orderkey" in x for x in moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_references_in_groups_are_those_of_the_join(spark, monkeypatch):
    rows = _chunks(spark).unionByName(spark.createDataFrame([(None, "z1", "See Section 1.", "1"), (None, "z2", "Lot 1", "2"), ("c", "x1", 'Section 2, "Lot 12" means Lot 1.', "1"), ("c", None, "Section 1", "2")], "within string, id string, text string, section string"))
    want = sorted(tuple(r) for r in G.cross_references(rows, "within").collect())
    got = G.cross_references(rows, "within", keep=True)
    assert sorted(tuple(r) for r in got.select("a", "b", "type").collect()) == want and {r[0] for r in got.select("within").collect()} == {"c"}
    monkeypatch.setattr(G, "SENT_DEFINED", 0)
    many = G.cross_references(rows, "within", keep=True)
    assert sorted(tuple(r) for r in many.select("a", "b", "type").collect()) == want and {r[0] for r in many.select("within").collect()} == {"c"}


def test_linked_nodes_have_the_edges_of_references(spark):
    n, index = contracts.contract_nodes(spark, SF), contracts.index(spark, SF)
    rows = lambda e: sorted(tuple(r) for r in e.collect())
    assert rows(G.build_edges(n, index)) == rows(G.build_edges(n, index.select("_a", "_b"))) != rows(G.build_edges(n))


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    held = lambda: sum(len(names) for d, _, names in os.walk(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()[0].getPath()) if "blockmgr" in d)
    before = held()
    assert tables.written(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count()).count() == 10
    assert held() <= before + 3  # of the count
