"""Queries of evaluation and statistics, and of ingestion over events as a log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ctxloom.operators import evaluation as E
from ctxloom.operators import learning as L
from ctxloom.sources.tables import written
from ctxloom.plans.registry import query, read, values

_PAIRS_SQL = "p AS (SELECT o_orderpriority AS trap, o_totalprice / 1000 AS a, o_totalprice / 1000 - (o_orderkey % 7 - 3) AS b FROM orders)"


def _pairs(spark, d):
    price = F.col("o_totalprice") / 1000
    return read(spark, d, "orders").select(F.col("o_orderpriority").alias("trap"), price.alias("a"), (price - (F.col("o_orderkey") % 7 - 3)).alias("b"))


@query(f"WITH {_PAIRS_SQL} SELECT trap, count(*) AS n, round(avg(a - b), 6) AS mean_diff, round(stddev_samp(a - b), 6) AS sd_diff, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 5) AS t, round(avg(a - b) / stddev_samp(a - b), 6) AS cohens_d FROM p GROUP BY trap")
def paired_stats(spark, d):
    out = E.paired_statistics(_pairs(spark, d), "trap")
    return out.select("trap", "n", F.round("mean_diff", 6).alias("mean_diff"), F.round("sd_diff", 6).alias("sd_diff"), F.round("t", 5).alias("t"), F.round("cohens_d", 6).alias("cohens_d"))


@query()
def paired_tests(spark, d):
    return E.bonferroni(E.paired_t_test(_pairs(spark, d), "trap"))


@query(
    f"WITH {_PAIRS_SQL}, x AS (SELECT trap, a - b AS d, round(abs(a - b), 10) AS s FROM p WHERE abs(a - b) > 1e-10), r AS (SELECT *, rank() OVER (PARTITION BY trap ORDER BY s) + (count(*) OVER (PARTITION BY trap, s) - 1) / 2 AS rk FROM x) "
    "SELECT trap, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS w_minus FROM r GROUP BY trap"
)
def wilcoxon_ranks(spark, d):
    return E.wilcoxon(_pairs(spark, d), "trap").select("trap", "n", "w_plus", "w_minus")


@query()
def wilcoxon_tests(spark, d):
    return E.wilcoxon_test(_pairs(spark, d), "trap")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def label_groups(spark, d):
    return read(spark, d, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_type AS action FROM events")
def version_history(spark, d):
    v = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, d, "events").select("user_id", "event_id", v.alias("version"), F.col("event_type").alias("action"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_active(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT event_type AS action, count(*) AS n, count(DISTINCT user_id) AS documents FROM events GROUP BY event_type")
def ingest_counters(spark, d):
    return read(spark, d, "events").groupBy(F.col("event_type").alias("action")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("documents"))


_LEDGER = values("l", ("system", "model", "phase", "tokens"), [("v3", "gpt-4", "initial", 1000), ("v3", "gpt-4", "run", 250), ("v3", "gpt-4", "run", 351), ("rag", "local", "run", 90)])


@query(f"WITH {_LEDGER.sql} SELECT system, model, sum(tokens) FILTER (WHERE phase = 'run') AS run_tokens, floor(coalesce(sum(tokens) FILTER (WHERE phase = 'initial'), 0) + avg(tokens) FILTER (WHERE phase = 'run') * 48) AS projected_tokens FROM l GROUP BY ALL")
def cost_projection(spark, d):
    return E.cost_report(_LEDGER.frame(spark), 48).select("system", "model", "run_tokens", F.col("projected_tokens").cast("double").alias("projected_tokens"))


_UNITS = values("u", ("id", "answer", "units"), [(1, "The fee is due within thirty days of the invoice", ["fee is due within thirty days", "governed by foreign statutes"]), (2, "No", ["a an it"])])


@query(f"WITH {_UNITS.sql}, x AS (SELECT id, lower(answer) AS a, unnest(list_transform(units, lambda u: list_filter(string_split(lower(u), ' '), lambda w: length(w) > 3))) AS w FROM u) SELECT id, CAST(count(*) FILTER (WHERE len(w) = 0 OR len(list_filter(w, lambda y: contains(a, y))) >= 0.6 * len(w)) AS INT) AS covered, CAST(count(*) AS INT) AS total FROM x GROUP BY id")
def information_units(spark, d):
    return E.unit_coverage(_UNITS.frame(spark)).select("id", "covered", "total")


def labelled_features(spark, d):
    """Two features of every labelled document, and its label."""
    f = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    return f.select(F.col("quality").cast("double").alias("target"), F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("length"), (F.regexp_count("text", F.lit("[a-z]")) / F.greatest(F.length("text"), F.lit(1))).alias("lower"))


@query()
def weight_search(spark, d):
    return E.search_weights(labelled_features(spark, d), {"length": (0.0, 2.0), "lower": (0.0, 4.0)}, trials=8)


@query()
def parzen_search(spark, d):
    """Forty trials in five batches: the later ones are drawn where the earlier ones did well."""
    return L.parzen_weights(written(labelled_features(spark, d)), {"length": (0.0, 2.0), "lower": (0.0, 4.0)})


_TOKENS = "list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z]+'), lambda x: lower(x)))"


@query(
    "WITH t AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM conversations), "
    f"a AS (SELECT *, {_TOKENS.format('q')} AS asked, {_TOKENS.format('text')} AS own FROM t WHERE role = 'assistant' AND q IS NOT NULL) "
    "SELECT conv_id, turn, round(least(1, len(regexp_extract_all(text, '[A-Za-z]+')) / greatest(len(regexp_extract_all(q, '[A-Za-z]+')) * 3, 20)), 6) AS completeness, round(CASE WHEN len(asked) = 0 THEN 0 ELSE len(list_intersect(asked, own)) / len(asked) END, 6) AS lexical_relevance FROM a"
)
def answer_metrics(spark, d):
    """Each assistant turn with the user turn that it follows; a system turn between them, or further assistant turns, change nothing."""
    c = read(spark, d, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    both = c.withColumn("q", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)).where("role = 'assistant' AND q IS NOT NULL")
    return both.select("conv_id", "turn", F.round(E.answer_completeness(F.col("text"), F.col("q")), 6).alias("completeness"), F.round(E.lexical_relevance(F.col("text"), F.col("q")), 6).alias("lexical_relevance"))
