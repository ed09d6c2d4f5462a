"""Every query with SQL against DuckDB on the smallest tables, and the rest for a stable schema."""

import glob
import os

import duckdb
import pytest

from ctxloom import plans
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None or v != v if not hasattr(v, "__len__") else False:
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)


def _rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(str(_cell(v)) for v in r) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert _rows(plans.QUERIES[name](spark, SF).toPandas()) == _rows(duck.execute(plans.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_fills_its_columns(spark, name):
    """Without SQL (values are checked in test_operators and test_pipelines): rows, and every column filled somewhere."""
    names, first = _rows(plans.QUERIES[name](spark, SF).toPandas())
    assert first and all(any(r[k] not in ("None", "nan", "") for r in first) for k in range(len(names)))


def test_sql_has_a_query():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES)


def test_top_k_plan_is_limited_by_group(spark):
    plan = plans.QUERIES["topk_similar"](spark, SF)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_scan_reads_only_what_it_needs(spark):
    plan = plans.QUERIES["pricing_summary"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_orderkey" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_answer_metrics_pairs_every_answer(spark, tmp_path):
    rows = [(1, 0, "system", "rules"), (1, 1, "user", "alpha?"), (1, 2, "assistant", "alpha"), (1, 3, "user", "beta?"), (1, 4, "assistant", "beta"), (2, 0, "assistant", "hello"), (2, 1, "user", "gamma?"), (2, 2, "assistant", "nothing")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.lexical_relevance for r in plans.QUERIES["answer_metrics"](spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 2), (1, 4), (2, 2)} and got[1, 2] == got[1, 4] > got[2, 2]


def test_full_graph_queries_count_all_edges(spark):
    edges = plans.QUERIES["edge_weights_full"](spark, SF).collect()
    run = lambda name: plans.QUERIES[name](spark, SF).collect()
    assert any("entity_overlap" in r.relation for r in edges)
    degree, linked, weight = {}, set(), {}
    for r in edges:
        weight[r.graph_id] = weight.get(r.graph_id, 0) + r.weight
        for a, b in ((r.source, r.target), (r.target, r.source)):
            degree[r.graph_id, a] = degree.get((r.graph_id, a), 0) + 1
            linked |= {(r.graph_id, a, b)} if r.weight >= 0.3 else set()
    got = run("node_degree_full")
    size = {g: sum(r.graph_id == g for r in got) for g in {r.graph_id for r in got}}
    want = {g: min(1, weight.get(g, 0) / (n * (n - 1) / 2)) if n > 1 else 1 for g, n in size.items()}
    assert {(r.graph_id, r.id): r.degree for r in got if r.degree} == degree
    assert {tuple(r) for r in run("connected_nodes_full")} == linked
    assert {r.graph_id: r.connectivity for r in run("graph_connectivity_full")} == pytest.approx(want, abs=2e-6)
    assert {r.graph_id: r.graph_connectivity for r in run("css_features_full")} == pytest.approx(want, abs=2e-6)
    assert len(run("prune_graph_full")) == sum(n - (n > 3) for n in size.values())
