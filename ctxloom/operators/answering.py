"""From retrieved context to an answer: parsing of model output, relations, prompts, reranking, the retry loop, and the choice
of annotated questions. Models are functions of columns; the default one is a template and works offline."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions import text as T
from ctxloom.functions import vocabulary as V
from ctxloom.functions.text import relations

PARSED = "entities array<string>, domain_terms array<string>, subqueries array<string>, intent string, clause_types array<string>"

#: A model: from a prompt to a text.
Generator = Callable[[Column], Column]


def template_generator(prompt: Column) -> Column:
    """The default model: it answers with the first line of context it was given."""
    return F.concat(F.lit("Based on the context: "), F.regexp_extract(prompt, r"(?m)^- (.*)$", 1))


def parse_response(response: Column) -> Column:
    """A struct of PARSED from a model's JSON: as it is, else what stands between code fences, else the outermost braces; null without any."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    parsed = [F.from_json(F.nullif(T.strip(x), F.lit("")), PARSED, {"mode": "PERMISSIVE"}) for x in (response, fenced, braces)]
    filled = lambda p: p["entities"].isNotNull() | p["subqueries"].isNotNull() | p["intent"].isNotNull()
    found = F.coalesce(*[F.when(filled(p), p) for p in parsed])
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(found[c], empty).alias(c) for c in ("entities", "domain_terms", "subqueries")]
    return F.when(found.isNotNull(), F.struct(*lists, F.coalesce(found["intent"], F.lit("factual")).alias("intent"), F.coalesce(found["clause_types"], empty).alias("clause_types")))


def fallback_parse(query: Column) -> Column:
    """The same struct by rules."""
    e = T.query_entities(query)
    return F.struct(F.slice(e, 1, 6).alias("entities"), F.slice(F.filter(e, lambda x: x.contains(" ")), 1, 4).alias("domain_terms"), F.slice(T.subqueries(query), 1, 5).alias("subqueries"), T.intent(query).alias("intent"), T.clause_types(query).alias("clause_types"))


def preprocess(queries: DataFrame, model: Generator | None = None) -> DataFrame:
    """``queries`` (with a column query) and their parse: a model's where it gives one, else that by rules. Each distinct query, in lower case and stripped, is parsed once."""
    keyed = queries.withColumn("_key", F.lower(T.strip(F.col("query"))))
    once = keyed.groupBy("_key").agg(F.min("query").alias("_query"))
    parsed = fallback_parse(F.col("_query"))
    if model is not None:
        parsed = F.coalesce(parse_response(model(F.col("_query"))), parsed)
    return keyed.join(once.select("_key", parsed.alias("parsed")), "_key").drop("_key")


def query_graph(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (query_id, id, text) named query_<entity>, and edges (query_id, source, target, relation) of (query_id, query)."""
    name = lambda e: F.concat(F.lit("query_"), F.regexp_replace(F.lower(e), " ", "_"))
    nodes = queries.select("query_id", F.explode(T.query_entities(F.col("query"))).alias("text")).select("query_id", name(F.col("text")).alias("id"), "text")
    edges = queries.select("query_id", F.inline(relations(F.col("query")))).select("query_id", name(F.col("e1")).alias("source"), name(F.col("e2")).alias("target"), "relation")
    return nodes.dropDuplicates(["query_id", "id"]), edges


def annotation(nodes: DataFrame, most: int = 5) -> DataFrame:
    """graph_id and a warning block: the first ``most`` qualifying phrases of its nodes, each once, with their surroundings."""
    flags = nodes.select("graph_id", "pos", "id", F.posexplode(T.contradiction_flags(F.col("text"))).alias("k", "f")).select("graph_id", "pos", "id", "k", "f.*")
    once = flags.withColumn("r", F.row_number().over(Window.partitionBy("graph_id", F.lower("indicator")).orderBy("pos", "k"))).where("r = 1")
    few = once.withColumn("r", F.row_number().over(Window.partitionBy("graph_id").orderBy("pos", "k"))).where(F.col("r") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("r", "id", "indicator", "snippet"))), lambda x: F.concat(F.lit("- ["), x["id"], F.lit("] "), x["indicator"], F.lit(": ..."), x["snippet"], F.lit("...")))
    return few.groupBy("graph_id").agg(F.concat(F.lit("NOTE: the context holds qualifying language:\n"), F.array_join(lines, "\n")).alias("annotation"))


def prompts(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """graph_id, query and prompt: the query, a bulleted line for each node in order, and the warning block if there is one."""
    bullets = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.concat(F.lit("- "), F.regexp_replace(x["text"], r"\s+", " ")))
    context = nodes.groupBy("graph_id").agg(F.array_join(bullets, "\n").alias("context"))
    rows = queries.select("graph_id", "query").join(context, "graph_id", "left").join(annotation(nodes), "graph_id", "left")
    return rows.select("graph_id", "query", F.concat_ws("\n\n", F.concat(F.lit("Question: "), F.col("query")), F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit(""))), "annotation").alias("prompt"))


def answer(nodes: DataFrame, queries: DataFrame, model: Generator = template_generator) -> DataFrame:
    return prompts(nodes, queries).withColumn("answer", model(F.col("prompt")))


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column] | None = None, k: int = 3) -> DataFrame:
    """The k best of (query_id, id, query, text) by a scorer of query and text; by default the share of the query's words that the text has."""
    score = (scorer or (lambda q, t: T.query_coverage(t, q)))(F.col("query"), F.col("text"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "id")
    return hits.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieve_with_retries(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], rewrite: Callable[[Column], Column], least: float = 0.35, retries: int = 2) -> DataFrame:
    """Hits (query_id, id, score, rank, attempt): queries whose five best hits score ``least`` or less on average are rewritten and asked again, ``retries`` times at most.

    A round is one job over all queries that are left, and only their number comes to the driver.
    """
    asked, out = queries.select("query_id", "text"), None
    for attempt in range(retries + 1):
        hits = retrieve(asked).withColumn("attempt", F.lit(attempt))
        mean = hits.where("rank <= 5").groupBy("query_id").agg(F.avg("score").alias("mean"))
        weak = asked.join(mean, "query_id", "left").where(F.coalesce("mean", F.lit(0.0)) <= least)
        if attempt == retries or not weak.limit(1).count():
            return hits if out is None else out.unionByName(hits)
        done = hits.join(weak.select("query_id"), "query_id", "left_anti")
        out = done if out is None else out.unionByName(done)
        asked = weak.select("query_id", rewrite(F.col("text")).alias("text"))
    return out


def trap_contracts(contracts: DataFrame, first: int = 1, last: int = 200) -> DataFrame:
    """(name, scores, rank): contracts (name, text) by their total score, from one rank to another."""
    scored = contracts.select("name", *[c.alias(n) for n, c in T.trap_scores(F.col("text")).items()])
    top = scored.orderBy(F.desc("total_score"), "name").limit(last)  # the feature is a ranking: a bounded top
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total_score"), "name"))).where(F.col("rank").between(first, last))


#: By what the contracts of each trap are ranked.
TRAP_RANKS = (("A", "trap_a_count"), ("B", "trap_b_count"), ("C", "trap_c_sections"))


def choose_by_quota(ranked: DataFrame, used: DataFrame, quota: int = 16, first: int = 1, last: int = 50) -> DataFrame:
    """(name, trap_type): trap by trap, of the contracts ranked from ``first`` to ``last`` by how much they have of it, the ``quota``
    best that are neither used nor chosen for a trap before."""
    taken, out = used.select("name"), None
    for trap, count in TRAP_RANKS:
        best = ranked.orderBy(F.desc(count), "name").limit(last).withColumn("r", F.row_number().over(Window.orderBy(F.desc(count), "name")))
        free = best.where(F.col("r") >= first).join(taken, "name", "left_anti").orderBy("r").limit(quota).select("name", F.lit(trap).alias("trap_type"))
        out = free if out is None else out.unionByName(free)
        taken = taken.unionByName(free.select("name"))
    return out


def override_clause(text: Column) -> Column:
    """The first sentence with an override phrase: a struct of snippet and section; null without one.

    A match stands before a full stop and reaches back so far at most: only the ends of sentences that hold a phrase are searched.
    """
    holds = lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in V.OVERRIDE_PHRASES])

    def first(sentences: Column) -> Column:
        ends = F.transform(F.slice(sentences, 1, F.size(sentences) - 1), lambda s: F.concat(F.right(s, F.lit(V.OVERRIDE_REACH)), F.lit(".")))
        found = F.transform(F.filter(ends, lambda s: holds(F.lower(s))), lambda s: F.regexp_extract(s, V.OVERRIDE_SENTENCE, 1))
        return F.get(F.filter(found, lambda s: s != ""), F.lit(0))

    def clause(found: Column) -> Column:
        snippet = F.substring(T.strip(F.regexp_replace(found, "\n", " ")), 1, 400)
        section = F.regexp_extract(snippet, V.CLAUSE_SECTION, 0)
        return F.when(found.isNotNull(), F.struct(snippet.alias("snippet"), F.when(section == "", "relevant section").otherwise(section).alias("section")))

    return F.when(holds(F.lower(text)), T.once(T.once(F.split(text, r"\.", -1), first), clause))


def definition_clause(text: Column) -> Column:
    """The first defined term that is no placeholder (of the first two): a struct of term and definition; null without one."""
    terms = F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)" + V.LOOSE_DEFINITION_PATTERN), 1))
    one, two = F.get(terms, F.lit(0)), F.get(terms, F.lit(1))
    term = F.when(one.isin(*V.PLACEHOLDER_TERMS), two).otherwise(one)
    quoted = F.concat(F.lit(r"\Q"), term, F.lit(r"\E"))
    says = [F.call_function("regexp_extract", text, F.concat(F.lit(a), quoted, F.lit(b)), F.lit(1)) for a, b in V.DEFINITION_SENTENCES]
    found = F.coalesce(*[F.nullif(F.substring(T.strip(F.regexp_replace(s, "\n", " ")), 1, 350), F.lit("")) for s in says], F.lit("Defined in the Agreement."))
    return F.when(term.isNotNull(), F.struct(term.alias("term"), found.alias("definition")))


def scattered_sections(text: Column) -> Column:
    """The first five section numbers, each once; null for fewer than three."""
    found = F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(V.SCATTERED_SECTION), 1)), 1, 5)
    return F.when(T.may_hold(text, F.lower(text), ("section", "article")), T.once(found, lambda f: F.when(F.size(f) >= 3, f)))


def _evidence(text: Column, trap: Column) -> Column:
    a, b, c = override_clause(text), definition_clause(text), scattered_sections(text)
    return F.when(trap == "A", F.concat(a["snippet"], F.lit(" ["), a["section"], F.lit("]"))).when(trap == "B", F.concat(b["term"], F.lit(": "), b["definition"])).otherwise(F.array_join(c, ", "))


def annotation_entries(chosen: DataFrame) -> DataFrame:
    """Annotation rows from (name, trap_type), with placeholders for what a person has to fill in; with a column ``text``, also what the contract says."""
    asks = F.create_map(*[F.lit(x) for x in ("A", "Which exception overrides the general rule?", "B", "What does the defined term cover?", "C", "List all sections that bear on this obligation.")])
    return chosen.select(
        F.concat_ws("_", F.lower("trap_type"), T.short_id(F.col("name"))).alias("id"), F.col("name").alias("contract_file"), asks[F.col("trap_type")].alias("query"), "trap_type",
        F.when(F.col("trap_type") == "C", "hard").otherwise("medium").alias("difficulty"), F.lit("REPLACE with the answer").alias("ground_truth_answer"),
        *([_evidence(F.col("text"), F.col("trap_type")).alias("evidence")] if "text" in chosen.columns else []),
    )
