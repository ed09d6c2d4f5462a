"""Evaluation of retrieval systems: answer metrics, paired statistics, costs, weight search."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions import text as T
from ctxloom.functions import vector as X

#: Ranges of sizes that are ranked apart from each other.
RANK_RANGES = 64
# Two-sided 95% t criticals, by the least degrees of freedom that they hold for.
T_CRITICAL = ((120, 1.96), (60, 2.00), (30, 2.04), (20, 2.086), (10, 2.228), (5, 2.571), (0, 2.776))
# Two-sided 99% t criticals, likewise.
T_CRITICAL_99 = ((120, 2.576), (30, 2.750), (0, 3.250))
# Prices in dollars for a thousand tokens, by model.
PRICES = {"gpt-4": 0.03, "gpt-4-turbo": 0.01, "gpt-3.5-turbo": 0.0015, "gemini-1.5-flash": 0.000075, "gemini-1.5-pro": 0.00125, "gemini-2.0-flash": 0.0001, "local": 0.0}


def answer_completeness(answer: Column, query: Column) -> Column:
    """Tokens of the answer over three times those of the query, twenty at least; 1 at most."""
    return F.least(F.lit(1.0), T.token_count(answer) / F.greatest(T.token_count(query) * 3, F.lit(20)))


def lexical_relevance(answer: Column, query: Column) -> Column:
    """The share of the query's tokens that the answer has; 0 without any."""
    asked = T.token_set(query)
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, T.token_set(answer))) / F.size(asked))


def faithfulness(answers: DataFrame, dims: int = 256) -> DataFrame:
    """id and the mean similarity, 0 at least, of the answer's sentences of over ten characters to the context (id, answer, context)."""
    sentences = answers.select("id", X.hashed_embedding(F.col("context"), dims).alias("c"), F.explode(F.split("answer", r"[.!?]+")).alias("s")).where(F.length(T.strip(F.col("s"))) > 10)
    return sentences.groupBy("id").agg(F.avg(F.greatest(F.lit(0.0), X.dot(X.hashed_embedding(F.col("s"), dims), F.col("c")))).alias("faithfulness"))


def relevance(a: Column, b: Column, dims: int = 256) -> Column:
    """Similarity of two texts, between 0 and 1: of a query and its answer, or its context; 0 where one is empty."""
    both = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(both, T.clamp(X.cosine(X.hashed_embedding(a, dims), X.hashed_embedding(b, dims)))).otherwise(0.0)


def token_use(context: Column, answer: Column) -> Column:
    """Tokens of the answer over those of the context; 0 without context."""
    n = T.token_count(context)
    return F.when(n == 0, 0.0).otherwise(T.token_count(answer) / n)


def all_metrics(results: DataFrame, dims: int = 256) -> DataFrame:
    """Every offline metric of (id, query, answer, context, units), as one row for each: relevance, context_relevance, completeness,
    lexical_relevance, token_use, answer_tokens, context_tokens, unit coverage, and faithfulness (0 without sentences)."""
    q, a, c = F.col("query"), F.coalesce("answer", F.lit("")), F.coalesce("context", F.lit(""))
    own = results.select(
        "id", relevance(q, a, dims).alias("relevance"), relevance(q, c, dims).alias("context_relevance"), answer_completeness(a, q).alias("completeness"), lexical_relevance(a, q).alias("lexical_relevance"),
        token_use(c, a).alias("token_use"), T.token_count(a).cast("double").alias("answer_tokens"), T.token_count(c).cast("double").alias("context_tokens"),
    )
    units = unit_coverage(results.select("id", a.alias("answer"), F.coalesce("units", F.array().cast("array<string>")).alias("units")))
    grounded = faithfulness(results.select("id", a.alias("answer"), c.alias("context")), dims)
    rows = own.join(units.select("id", F.col("coverage").alias("unit_coverage")), "id").join(grounded, "id", "left")
    return rows.withColumn("faithfulness", F.coalesce("faithfulness", F.lit(0.0)))


def metric_means(results: DataFrame, metrics: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """metric, trap_type ("all" for the whole), n, mean_a, mean_b and delta over rows without an error: ``results`` are (trap_type,
    error, and two maps of metrics); a metric that a map lacks is 0."""
    rows = results.where("error IS NULL").select("trap_type", F.explode(F.array(*map(F.lit, metrics))).alias("metric"), a, b)
    value = lambda m: F.coalesce(F.try_element_at(F.col(m), F.col("metric")), F.lit(0.0))
    long = rows.select("metric", F.explode(F.array(F.lit("all"), F.col("trap_type"))).alias("trap_type"), value(a).alias("a"), value(b).alias("b")).where("trap_type IS NOT NULL")
    return long.groupBy("metric", "trap_type").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), (F.avg("a") - F.avg("b")).alias("delta"))


def interval(pairs: DataFrame, *by: str, confidence: float = 0.95) -> DataFrame:
    """mean_diff, ci_low and ci_high of the differences of (a, b) in each group, at 0.95 or 0.99, by the step tables."""
    table = T_CRITICAL if confidence == 0.95 else T_CRITICAL_99
    d = F.col("a") - F.col("b")
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"))
    critical = reduce(lambda acc, x: acc.when(F.col("n") - 1 >= x[0], x[1]), table[1:], F.when(F.col("n") - 1 >= table[0][0], table[0][1]))
    half = critical * F.col("sd") / F.sqrt("n")
    return out.select(*by, "n", "mean_diff", (F.col("mean_diff") - half).alias("ci_low"), (F.col("mean_diff") + half).alias("ci_high"))


def latex_table(tests: DataFrame) -> str:
    """A LaTeX table of (metric, mean_a, mean_b, t, p_value, cohens_d, significant): one row a metric, significant p in bold."""
    def line(r) -> str:
        p = "--" if r["p_value"] is None else f"{r['p_value']:.4f}"
        p = rf"\textbf{{{p}}}" if r["significant"] else p
        t, d = ("--" if r[c] is None else f"{r[c]:.3f}" for c in ("t", "cohens_d"))
        name = r["metric"].replace("_", r"\_")
        return rf"{name} & {r['mean_a']:.3f} & {r['mean_b']:.3f} & {r['mean_a'] - r['mean_b']:+.3f} & {t} & {p} & {d} \\"

    rows = sorted(tests.collect(), key=lambda r: r["metric"])  # a row for each metric
    head = [r"\begin{table}[h]", r"\centering", r"\begin{tabular}{lcccccc}", r"\toprule", r"Metric & A & B & $\Delta$ & $t$ & $p$ & Cohen's $d$ \\", r"\midrule"]
    return "\n".join([*head, *map(line, rows), r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def unit_coverage(annotations: DataFrame) -> DataFrame:
    """id, covered, total and coverage of the information units (id, answer, units array) that the answer holds; 1 without units."""
    hit = F.size(F.filter("units", lambda u: T.unit_covered(F.col("answer"), u)))
    return annotations.select("id", hit.alias("covered"), F.size("units").alias("total"), F.when(F.size("units") == 0, 1.0).otherwise(hit / F.size("units")).alias("coverage"))


# Published: the continued fraction of the incomplete beta function, evaluated by Lentz's method (Numerical Recipes, 6.4).
def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-30, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return out


def regularised_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p_value(t: Column, df: Column) -> Column:
    """Two-tailed. The JVM side has no gamma function, and there is a row for each test only."""

    @F.pandas_udf("double")
    def p(ts: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(n) or n < 1 else regularised_beta(n / 2, 0.5, n / (n + x * x)) for x, n in zip(ts, ns, strict=True)], dtype="float64")

    return p(t, df)


def normal_p_value(z: Column) -> Column:
    """Two-tailed, of a standard normal."""

    @F.pandas_udf("double")
    def p(zs: pd.Series) -> pd.Series:
        return zs.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2))).astype("float64")

    return p(z)


def paired_statistics(pairs: DataFrame, *by: str) -> DataFrame:
    """Of (a, b) in each group: n, mean and sample deviation of the differences, t, df, Cohen's d, its size, and a 95% interval.

    Without spread t is 0 for equal systems and null for others. The interval uses the step table of t criticals.
    """
    d = F.col("a") - F.col("b")
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd_diff"))
    n, m, s = F.col("n"), F.col("mean_diff"), F.col("sd_diff")
    flat = s < 1e-12
    critical = reduce(lambda acc, x: acc.when(n - 1 >= x[0], x[1]), T_CRITICAL[1:], F.when(n - 1 >= T_CRITICAL[0][0], T_CRITICAL[0][1]))
    effect = F.when(flat, 0.0).otherwise(m / s)
    out = out.withColumns({"t": F.when(flat, F.when(F.abs(m) < 1e-12, 0.0)).otherwise(m / (s / F.sqrt("n"))), "df": n - 1, "cohens_d": effect, "half": critical * s / F.sqrt("n")})
    size = F.abs("cohens_d")
    bands = F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")
    return out.withColumns({"effect_size": bands, "ci_low": m - F.col("half"), "ci_high": m + F.col("half")}).drop("half")


def paired_t_test(pairs: DataFrame, *by: str) -> DataFrame:
    """``paired_statistics`` with the two-tailed p; for differences without spread, 1 if they are 0 and else 0."""
    out = paired_statistics(pairs, *by)
    p = F.when(F.col("sd_diff") < 1e-12, F.when(F.abs("mean_diff") < 1e-12, 1.0).otherwise(0.0)).otherwise(t_p_value(F.col("t"), F.col("df").cast("double")))
    return out.withColumn("p_value", F.when(F.col("n") < 2, F.lit(None)).otherwise(p))


def wilcoxon(pairs: DataFrame, *by: str) -> DataFrame:
    """Signed-rank statistic of (a, b) in each group: n of differences other than 0, W+ and W-, w (the lesser), z by the normal
    approximation without corrections. Ties share their mean rank."""
    d = pairs.select(*by, (F.col("a") - F.col("b")).alias("d")).where(F.abs("d") > 1e-10).withColumn("size", F.round(F.abs("d"), 10))
    cuts = d.agg(F.percentile_approx("size", [k / RANK_RANGES for k in range(1, RANK_RANGES)], 20 * RANK_RANGES)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col("size"))) if cuts else F.lit(0)
    d = d.select(F.lit(0).alias("_g"), *map(F.col, by), "d", "size", part.alias("_part"))
    names = ["_g", *by]
    # Equal sizes share a rank, so sizes are counted first. Ranks are running sums of these counts within ranges of sizes, on top of
    # how many lie in the ranges below: no group is ranked by one task, and ties are one row.
    positive = F.sum((F.col("d") > 0).cast("long"))
    sizes = d.groupBy(*names, "_part", "size").agg(F.count(F.lit(1)).alias("n"), positive.alias("plus"))
    below = sizes.groupBy(*names, "_part").agg(F.sum("n").alias("n")).withColumn("below", F.sum("n").over(Window.partitionBy(*names).orderBy("_part")) - F.col("n"))
    within = F.sum("n").over(Window.partitionBy(*names, "_part").orderBy("size")) - F.col("n")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_own_{c}")) for c in (*names, "_part")])
    ranked = sizes.withColumn("within", within).join(below.select(*[F.col(c).alias(f"_own_{c}") for c in (*names, "_part")], "below"), same)
    ranked = ranked.withColumn("rank", F.col("below") + F.col("within") + (F.col("n") + 1) / 2)
    out = ranked.groupBy(*names).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("plus"))).alias("w_minus"))
    n = F.col("n")
    out = out.withColumn("w", F.least("w_plus", "w_minus"))
    return out.withColumn("z", (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).drop("_g")


def wilcoxon_test(pairs: DataFrame, *by: str) -> DataFrame:
    """``wilcoxon`` with a two-tailed p, for five pairs and three differences at least."""
    total = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"))
    out = wilcoxon(pairs, *by)
    out = out.join(total, list(by)) if by else out.join(F.broadcast(total), F.lit(True))
    return out.withColumn("p_value", F.when((F.col("n_pairs") >= 5) & (F.col("n") >= 3), normal_p_value(F.col("z"))))


def bonferroni(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """p times the number of tests, 1 at most, and whether it stays under ``alpha``."""
    m = tests.where("p_value IS NOT NULL").agg(F.count(F.lit(1)).alias("m"))
    out = tests.join(F.broadcast(m), F.lit(True))  # one row
    return out.withColumn("p_corrected", F.least(F.lit(1.0), F.col("p_value") * F.col("m"))).withColumn("significant", F.col("p_corrected") < alpha).drop("m")


def analyse(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Tests of two systems for each metric, overall and by trap: ``results`` are (trap_type, error, and for each metric a struct of a and b).

    Rows with an error are left out, as are metrics that are 0 or -1 throughout, and traps of under three rows.
    """
    rows = results.where("error IS NULL")
    long = rows.select("trap_type", F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.struct(F.col(m)["a"].cast("double").alias("a"), F.col(m)["b"].cast("double").alias("b")))])).alias("metric", "v"))
    long = long.select("metric", "trap_type", "v.a", "v.b")
    known = long.groupBy("metric").agg(F.max((~F.col("a").isin(0.0, -1.0) | ~F.col("b").isin(0.0, -1.0))).alias("known")).where("known").select("metric")
    long = long.join(F.broadcast(known), "metric")  # one row for each metric
    overall = bonferroni(paired_t_test(long, "metric")).withColumn("trap_type", F.lit("all"))
    by_trap = bonferroni(paired_t_test(long, "metric", "trap_type").where("n >= 3"))
    return overall.unionByName(by_trap)


def cost_report(ledger: DataFrame, queries: int) -> DataFrame:
    """Of (system, model, phase, tokens): initial and run tokens, their mean by query, and tokens and dollars for ``queries``."""
    price = F.create_map(*[F.lit(x) for kv in PRICES.items() for x in kv])
    out = ledger.groupBy("system", "model").agg(
        F.sum(F.when(F.col("phase") == "initial", F.col("tokens")).otherwise(0)).alias("initial_tokens"), F.sum(F.when(F.col("phase") == "run", F.col("tokens")).otherwise(0)).alias("run_tokens"),
        F.count_if(F.col("phase") == "run").alias("n_queries"),
    )
    mean = F.when(F.col("n_queries") == 0, 0.0).otherwise(F.col("run_tokens") / F.col("n_queries"))
    total = F.floor(F.col("initial_tokens") + mean * queries)
    return out.withColumns({"mean_run_tokens": mean, "projected_tokens": total, "projected_cost": total / 1000 * F.try_element_at(price, F.col("model"))})


def cost_comparison(ledger: DataFrame, queries: int = 10) -> DataFrame:
    """The cost report of each system, the cheapest first, and how many times the cheapest one's projected tokens it needs."""
    out = cost_report(ledger, queries)
    least = out.agg(F.min("projected_tokens").alias("least"))
    return out.join(F.broadcast(least), F.lit(True)).withColumn("times_least", F.col("projected_tokens") / F.col("least")).drop("least").orderBy("projected_tokens", "system")  # least is one row


def reward_weights(features: DataFrame, drawn: DataFrame, names: list[str]) -> DataFrame:
    """trial, its weights (w_ and each name) and the mean reward over rows of (target, features), for trials ``drawn``: one job.

    A trial's reward is 1 less the mean squared error of its score, so the weights do bear on it; rows without a target are left out.
    """
    scored = features.where("target IS NOT NULL").join(F.broadcast(drawn), F.lit(True))  # a bounded number of trials
    total = reduce(lambda a, b: a + b, [F.col(f"w_{n}") * F.col(n) for n in names])
    top = reduce(lambda a, b: a + b, [F.abs(f"w_{n}") for n in names])
    score = 1 / (1 + F.exp(-3 * (total / F.greatest(top, F.lit(1e-9)) * 2 - 1)))
    keys = ["trial", *[f"w_{n}" for n in sorted(names)]]
    return scored.groupBy(*keys).agg((1 - F.avg((score - F.col("target")) ** 2)).alias("reward"))


def search_weights(features: DataFrame, ranges: dict[str, tuple[float, float]], trials: int = 20, seed: int = 7) -> DataFrame:
    """``reward_weights`` of random trials. ``features`` has a column target and one for each range. Trials are a bounded table."""
    spark = features.sparkSession
    drawn = spark.range(trials).select(F.col("id").alias("trial"), *[(F.lit(lo) + F.rand(seed + k) * (hi - lo)).alias(f"w_{n}") for k, (n, (lo, hi)) in enumerate(sorted(ranges.items()))])
    return reward_weights(features, spark.createDataFrame(drawn.collect(), drawn.schema), list(ranges))


def forward_selection(features: DataFrame, names: list[str], epsilon: float = 0.005) -> list[str]:
    """Features added one at a time while the best addition raises the reward by ``epsilon``. All candidates of a round are
    rewarded in one job, and only their figures come to the driver."""
    chosen: list[str] = []
    best = float("-inf")
    while rest := [n for n in names if n not in chosen]:
        mean = lambda ns: reduce(lambda a, b: a + b, [F.col(n) for n in ns]) / len(ns)
        row = features.agg(*[(1 - F.avg((mean([*chosen, n]) - F.col("target")) ** 2)).alias(n) for n in rest]).first().asDict()
        name = max(rest, key=lambda n: (row[n], -names.index(n)))
        if row[name] < best + epsilon:
            break
        chosen.append(name)
        best = row[name]
    return chosen
