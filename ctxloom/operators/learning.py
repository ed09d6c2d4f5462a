"""The learning loop: features are chosen, then weights of the score, then weights of the edges, and every trial is logged.

Trials are bounded tables; all trials of a phase are scored in one job over all rows, and only their figures come to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.functions import vector as X
from ctxloom.functions import vocabulary as V
from ctxloom.operators import evaluation as E
from ctxloom.operators import graph as G
from ctxloom.operators import policy as P
from ctxloom.operators import sufficiency as S
from ctxloom.operators.search import search
from ctxloom.operators.sufficiency import connectivity
from ctxloom.sources.tables import written

TRIAL = "phase string, trial int, parameters map<string,double>, mean_reward double"


def _mean(names: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(n) for n in names]) / len(names)


def reward(prediction: Column, target: Column) -> Column:
    """1 less the mean squared error; rows without a target are left out."""
    return 1 - F.avg((prediction - target) ** 2)


def ablation(features: DataFrame, names: list[str]) -> DataFrame:
    """feature, reward (of all features but this one) and loss against all of them, for each of ``names``: one job, one row a feature."""
    spark = features.sparkSession
    target = F.col("target")
    parts = [reward(_mean(names), target).alias("all"), *[reward(_mean([m for m in names if m != n]), target).alias(n) for n in names if len(names) > 1]]
    row = features.where("target IS NOT NULL").agg(*parts).first().asDict()
    return spark.createDataFrame([(n, row[n], row["all"] - row[n]) for n in names if n in row], "feature string, reward double, loss double")


def search_edges(nodes: DataFrame, targets: DataFrame, trials: list[dict[str, float]]) -> DataFrame:
    """trial, its parameters and mean_reward: edges are scored once in parts, and each trial weighs the parts anew.

    A trial's reward is 1 less the mean squared error of the graphs' connectivity against ``targets`` (graph_id, target).
    """
    spark = nodes.sparkSession
    pairs = G.node_pairs(nodes)
    a, b = F.col("a"), F.col("b")
    same = (a["base"] == b["base"]).cast("double")
    sim = X.cosine(X.double(a["embedding"]), X.double(b["embedding"]))
    near = ((a["base"] == b["base"]) & (F.abs(a["chunk"] - b["chunk"]) == 1)).cast("double")
    parts = pairs.select("graph_id", a["id"].alias("source"), b["id"].alias("target_id"), same.alias("same_source"), near.alias("adjacency"), sim.alias("sim"))
    drawn = spark.createDataFrame([(k, {n: float(v) for n, v in t.items()}) for k, t in enumerate(trials)], "trial int, parameters map<string,double>")
    get = lambda n, default: F.coalesce(F.try_element_at("parameters", F.lit(n)), F.lit(default))
    cut = get("semantic_threshold", V.SEMANTIC_FROM)
    semantic = F.when(F.col("sim") > cut, (F.col("sim") - cut) / F.greatest(1 - cut, F.lit(1e-9))).otherwise(0.0)
    raw = F.col("same_source") * get("same_source", V.EDGE_WEIGHTS["same_source"]) + F.col("adjacency") * get("adjacency", V.EDGE_WEIGHTS["adjacency"]) + semantic * get("semantic", V.EDGE_WEIGHTS["semantic"])
    weighed = parts.join(F.broadcast(drawn), F.lit(True)).withColumn("raw", raw)  # a bounded number of trials
    kept = weighed.where(F.col("raw") >= get("edge_threshold", V.EDGE_LEAST)).withColumn("weight", F.least("raw", F.lit(1.0)))
    keyed = F.concat_ws("#", "trial", "graph_id")
    numbered = nodes.select("graph_id").join(F.broadcast(drawn.select("trial")), F.lit(True)).select(keyed.alias("graph_id"))
    scored = connectivity(numbered, kept.select(keyed.alias("graph_id"), "weight"))
    scored = scored.select(F.substring_index("graph_id", "#", 1).cast("int").alias("trial"), F.expr("substring(graph_id, instr(graph_id, '#') + 1)").alias("graph_id"), "connectivity")
    rewards = scored.join(targets.select("graph_id", "target"), "graph_id").groupBy("trial").agg(reward(F.col("connectivity"), F.col("target")).alias("mean_reward"))
    return drawn.join(rewards, "trial", "left").select("trial", "parameters", "mean_reward")


def best_trials(trials: DataFrame) -> DataFrame:
    """phase, trial, parameters and mean_reward of the best trial of each phase; of equal ones the first."""
    best = trials.where("mean_reward IS NOT NULL").groupBy("phase").agg(F.max_by(F.struct("trial", "parameters", "mean_reward"), F.struct("mean_reward", -F.col("trial"))).alias("b"))
    return best.select("phase", "b.*")


def trial_summary(trials: DataFrame) -> DataFrame:
    """phase, n, least, greatest and mean reward, and the best trial."""
    out = trials.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.min("mean_reward").alias("least"), F.max("mean_reward").alias("greatest"), F.avg("mean_reward").alias("mean"))
    return out.join(best_trials(trials).select("phase", F.col("trial").alias("best_trial")), "phase", "left")


def learn(features: DataFrame, names: list[str], nodes: DataFrame, targets: DataFrame, edge_trials: list[dict[str, float]], weight_trials: int = 12, seed: int = 7) -> tuple[DataFrame, dict]:
    """(trials, configuration): forward selection of ``names``, a search of their weights, a search of edge parameters.

    ``features`` have a column target and one for each name; ``nodes`` and ``targets`` are as in ``search_edges``.
    """
    spark: SparkSession = features.sparkSession
    chosen = E.forward_selection(features, names) or names[:1]
    picked = features.agg(reward(_mean(chosen), F.col("target")).alias("r")).first()["r"]
    rows = [("features", 0, dict.fromkeys(chosen, 1.0), picked)]
    drawn = E.search_weights(features, {n: (0.0, 4.0) for n in chosen}, weight_trials, seed)
    rows += [("weights", int(r["trial"]), {n: r[f"w_{n}"] for n in chosen}, r["reward"]) for r in drawn.collect()]  # a bounded number of trials
    rows += [("edges", r["trial"], r["parameters"], r["mean_reward"]) for r in search_edges(nodes, targets, edge_trials).collect()]
    trials = spark.createDataFrame(rows, TRIAL)
    best = {r["phase"]: r["parameters"] for r in best_trials(trials).collect()}
    return trials, {"features": chosen, "weights": best.get("weights", {}), "edges": best.get("edges", {})}


def parzen_weights(features: DataFrame, ranges: dict[str, tuple[float, float]], rounds: int = 5, per_round: int = 8, seed: int = 7, method: str = "parzen") -> DataFrame:
    """trial, its weights and reward: batches of trials, each drawn from what the ones before have shown, and rewarded by one job over all rows."""
    spark, names = features.sparkSession, sorted(ranges)
    kind = "trial long, " + ", ".join(f"w_{n} double" for n in names)

    def rewards(batch: list[dict[str, float]]) -> list[float | None]:
        drawn = spark.createDataFrame([(k, *(t[n] for n in names)) for k, t in enumerate(batch)], kind)
        got = {r["trial"]: r["reward"] for r in E.reward_weights(features, drawn, names).collect()}
        return [got.get(k) for k in range(len(batch))]

    done = search(rewards, ranges, rounds, per_round, seed, method)
    return spark.createDataFrame([(k, *(t[n] for n in names), r) for k, (t, r) in enumerate(done)], f"{kind}, reward double")


def policy_trials(
    trials: list[dict[str, float]], nodes: DataFrame, corpus: DataFrame, references: DataFrame, queries: DataFrame, policy: P.Policy | None = None, subqueries: DataFrame | None = None, write=written
) -> tuple[DataFrame, DataFrame]:
    """(trials, trace): the greedy policy over all graphs under each trial's parameters, all of them in the jobs of one run.

    A trial sets weights of the score (by the features' names) and parameters of edges (EDGE_PARAMETERS); what it leaves out is as
    usual. Its reward is the mean, over graphs, of how relevant the final graph is to the query and how far it covers its words; a graph
    without a query vector or nodes is an error row, counted and left out. trials are (trial, parameters, mean_reward, graphs,
    errors), trace is (trial, graph_id, step, action, css, gain).
    """
    spark = nodes.sparkSession
    drawn = spark.createDataFrame([(k, {n: float(v) for n, v in t.items()}) for k, t in enumerate(trials)], "trial int, parameters map<string,double>")
    trial_of = lambda c: F.substring_index(c, "~", 1).cast("int")
    graph_of = lambda c: F.expr(f"substring({c}, instr({c}, '~') + 1)")

    def each(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(drawn.select("trial")), F.lit(True)).withColumn("graph_id", F.concat_ws("~", "trial", F.col("graph_id").cast("string"))).drop("trial")

    def known(df: DataFrame) -> DataFrame:
        """With the parameters of each row's trial; there is a bounded number of them."""
        return df.withColumn("trial", trial_of(F.col("graph_id"))).join(F.broadcast(drawn), "trial").drop("trial")

    def edges(n: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        return G.build_edges(known(n), refs)

    def scored(features: DataFrame) -> DataFrame:
        weights = {n: F.coalesce(F.try_element_at("parameters", F.lit(n)), F.lit(float(v))) for n, v in V.CSS_WEIGHTS.items()}
        return known(features).withColumn("css", S.score(weights)).drop("parameters")

    whole = queries.where("vector IS NOT NULL").join(nodes.select("graph_id").distinct(), "graph_id", "left_semi")
    failed = queries.join(whole.select("graph_id"), "graph_id", "left_anti").count()
    asked = write(each(whole))
    started = each(nodes.join(whole.select("graph_id"), "graph_id", "left_semi"))
    final, trace = P.optimise(write(started), corpus, references, asked, policy, write, None if subqueries is None else each(subqueries), P.Rules(edges, scored))
    # Neither relevance nor coverage looks at edges.
    reached = S.features(final, spark.createDataFrame([], "graph_id string, weight double"), asked)
    rewards = reached.select(trial_of(F.col("graph_id")).alias("trial"), ((F.col("query_relevance") + F.col("coverage")) / 2).alias("reward"))
    means = rewards.groupBy("trial").agg(F.avg("reward").alias("mean_reward"), F.count(F.lit(1)).alias("graphs"))
    out = drawn.join(means, "trial", "left").select("trial", "parameters", "mean_reward", F.coalesce("graphs", F.lit(0)).alias("graphs"), F.lit(failed).cast("long").alias("errors"))
    return out, trace.select(trial_of(F.col("graph_id")).alias("trial"), graph_of("graph_id").alias("graph_id"), "step", "action", "css", "gain")
