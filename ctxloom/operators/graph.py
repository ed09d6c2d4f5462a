"""Context graphs as two tables: nodes (graph_id, pos, id, text, base, chunk, section, embedding) and edges (graph_id, source,
target, relation, weight). All pair joins have the graph as their equi key."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxloom.functions import text as T
from ctxloom.functions import vector as X
from ctxloom.functions import vocabulary as V
from ctxloom.operators.retrieval import cosine_candidates, top_similar
from ctxloom.sources.tables import cleaned_up, written

#: Terms of a corpus that may be sent to all executors, and defined terms that every text is searched for.
SENT_TERMS, SENT_DEFINED = 100_000, 200
_BETWEEN_WORDS = r"[^\p{L}\p{N}]+"
#: What stands between an entity and its idf; entities hold words and white space only.
_IDF = "\u0001"


def node_pairs(nodes: DataFrame, block: str = "graph_id") -> DataFrame:
    """a and b, structs of the columns of two nodes of a graph, a before b in order; with ``block`` another equi key."""
    columns = [c for c in nodes.columns if c != block]
    a, b = (nodes.select(block, F.struct(*columns).alias(n)) for n in "ab")
    return a.join(b, block).where("a.pos < b.pos")


def beside(a: Column, b: Column) -> Column:
    """What is known of two light nodes of a graph: n entities in common, and their similarity sim. It stands with one of them."""
    return F.coalesce(F.try_element_at(a["beside"], b["own"]), F.try_element_at(b["beside"], a["own"]))


def shared_entity_part(a: Column, b: Column, weighed: bool = False, full: Column | float = V.EDGE_SHARED_ENTITIES) -> Column:
    """The shared entities' share of the greatest expected overlap: by idf sums where entities are ``weighed`` (``full`` times the
    greatest idf of a shared one is a full overlap), else by count."""
    shared = F.array_intersect(a, b)
    if not weighed:
        return F.least(F.size(shared) / full, F.lit(1.0))

    def part(values: Column) -> Column:
        top = F.greatest(F.coalesce(F.array_max(values), F.lit(0.0)) * full, F.lit(1.0))
        return F.least(F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / top, F.lit(1.0))

    return T.once(F.transform(shared, lambda e: F.substring_index(e, _IDF, -1).cast("double")), part)


def _searched(nodes: DataFrame) -> DataFrame:
    """Nodes with their entities in place of their texts, and the length of their vectors."""
    if "beside" in nodes.columns:  # light nodes of the policy: what stands between them is known
        return nodes.drop("parts", "tokens", "found", "alike", "relevance", "near")
    vector = X.double(F.col("embedding"))
    return nodes.withColumns({"entities": T.entities(F.col("text")), "embedding": vector, "length": X.norm(vector)}).drop("text")


def _weighed(known: DataFrame, idf: DataFrame, write: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Searched nodes, which are read twice, with only those entities that several nodes of their graph have and that are rare enough by
    ``idf`` (term, idf). Each has its idf behind it, so that what two nodes share is found and weighed without a look into a map. What a
    graph's nodes have in common is found in its row, so that terms of one node alone are not moved to the idf."""
    used = write(idf.select("term", "idf").where(F.col("idf") >= V.ENTITY_IDF))
    used = F.broadcast(used) if used.limit(SENT_TERMS + 1).count() <= SENT_TERMS else used
    repeated = lambda w: F.array_distinct(F.filter(w, lambda x, i: x == F.get(w, i - 1)))
    graphs = known.groupBy("graph_id").agg(F.sort_array(F.flatten(F.collect_list("entities"))).alias("w"))
    each = graphs.select("graph_id", F.explode(T.once(F.col("w"), repeated)).alias("term")).join(used, "term")
    said = F.concat("term", F.lit(_IDF), F.col("idf").cast("string")).alias("said")
    rare = each.groupBy("graph_id").agg(F.collect_list(F.struct("term", said)).alias("rare"))
    own = F.array_intersect("entities", F.transform("rare", lambda x: x["term"]))
    kept = T.once(own, lambda o: F.transform(F.filter("rare", lambda x: F.array_contains(o, x["term"])), lambda x: x["said"]))
    columns = [c for c in known.columns if c != "entities"]
    return known.join(rare, "graph_id", "left").select(*columns, F.coalesce(kept, F.array().cast("array<string>")).alias("entities"))


def _with_terms(nodes: DataFrame, idf: DataFrame | None) -> DataFrame:
    """Searched nodes, weighed where there is an ``idf``; texts are searched once."""
    if idf is None or "beside" in nodes.columns:
        return _searched(nodes)
    return _weighed(written(_searched(nodes)), idf)


def linked(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """Nodes with ``linked``: the ids that references within their graph, from a stored index with graph_id, lead to and come from. Nodes and
    index meet by graph, so that neither is moved where both are dealt by it; a graph's references are one row on the way."""
    known = index.groupBy("graph_id").agg(F.collect_list(F.struct("_a", "_b")).alias("refs"))
    met = F.filter("refs", lambda r: (r["_a"] == F.col("id")) | (r["_b"] == F.col("id")))
    others = F.transform(met, lambda r: F.when(r["_a"] == F.col("id"), r["_b"]).otherwise(r["_a"]))
    return nodes.join(known, "graph_id", "left").select(*nodes.columns, F.coalesce(others, F.array().cast("array<string>")).alias("linked"))


def canonical(references: DataFrame) -> DataFrame:
    """(_a, _b): the pairs (a, b) of ``references`` in one direction, each once. A stored index has these columns already."""
    if {"_a", "_b"} <= set(references.columns):
        return references.select("_a", "_b")
    return references.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).distinct()


#: The parameters of edges that trials may set, with what holds otherwise.
EDGE_PARAMETERS = {**V.EDGE_WEIGHTS, "shared_entities": float(V.EDGE_SHARED_ENTITIES), "semantic_from": V.SEMANTIC_FROM, "least": V.EDGE_LEAST}


def score_pairs(pairs: DataFrame, references: DataFrame | None, least: float, weighed: bool) -> DataFrame:
    """The edges of pairs (graph_id, a, b) of nodes with their entities. Nodes with a column ``parameters`` (a map of EDGE_PARAMETERS)
    are scored by it. Nodes that are ``linked`` need no references beside them."""
    a, b = F.col("a"), F.col("b")
    own = "parameters" in pairs.schema["a"].dataType.names
    usual = EDGE_PARAMETERS | {"least": least}
    p = {n: F.coalesce(F.try_element_at(a["parameters"], F.lit(n)), F.lit(float(v))) if own else F.lit(float(v)) for n, v in usual.items()}
    same = a["base"] == b["base"]
    near = same & (F.abs(a["chunk"] - b["chunk"]) == 1)
    sections = F.coalesce(F.nullif(a["section"], F.lit("")) == F.nullif(b["section"], F.lit("")), F.lit(True))
    if "beside" in pairs.schema["a"].dataType.names:
        known = beside(a, b)
        overlap, sim = F.least(known["n"] / p["shared_entities"], F.lit(1.0)), known["sim"]
    else:
        sim = X.cosine(a["embedding"], b["embedding"], a["length"], b["length"])
        overlap = shared_entity_part(a["entities"], b["entities"], weighed, p["shared_entities"])
    xref = F.array_contains(a["linked"], b["id"]) if "linked" in pairs.schema["a"].dataType.names else F.lit(False)
    made = F.struct(overlap.alias("overlap"), sim.alias("sim"), same.alias("same"), near.alias("near"), sections.alias("sections"), xref.alias("xref"))

    def scored(x: Column) -> Column:
        parts = {
            "entity_overlap": F.when(x["overlap"] > 0, x["overlap"] * p["entity_overlap"]),
            "same_source": F.when(x["same"], p["same_source"]),
            "semantic": F.when(x["sim"] > p["semantic_from"], (x["sim"] - p["semantic_from"]) / F.greatest(1 - p["semantic_from"], F.lit(1e-9)) * p["semantic"]),
            "adjacency": F.when(x["near"], F.when(x["sections"], p["adjacency"]).otherwise(p["adjacency"] / 2)),
        }
        label = F.concat_ws("|", F.when(x["xref"], F.lit("cross_ref")), *[F.when(c.isNotNull(), n) for n, c in parts.items()])
        raw = sum((F.coalesce(c, F.lit(0.0)) for c in parts.values()), F.lit(0.0))
        return F.struct(label.alias("relation"), F.when(x["xref"], raw + p["cross_ref"]).otherwise(raw).alias("raw"))

    # A row of one: filters on what comes out of it do not make it anew.
    # What two nodes hold is looked at before references are: only names and weights of pairs that can be edges are moved to these.
    out = pairs.select("graph_id", a["id"].alias("source"), b["id"].alias("target"), p["least"].alias("_least"), p["cross_ref"].alias("_cross"), F.inline(F.array(T.once(made, scored))))
    if references is not None:
        raw, turned = F.col("raw"), F.col("_turned")
        out = out.where(F.greatest(raw, raw + F.col("_cross")) >= F.col("_least")).select("graph_id", F.least("source", "target").alias("_a"), F.greatest("source", "target").alias("_b"), (F.col("source") > F.col("target")).alias("_turned"), "relation", "raw", *(["_least", "_cross"] if own else []))
        out = out.join(canonical(references).withColumn("xref", F.lit(True)), ["_a", "_b"], "left")
        x = F.coalesce("xref", F.lit(False))
        out = out.select(
            "graph_id", F.when(turned, F.col("_b")).otherwise(F.col("_a")).alias("source"), F.when(turned, F.col("_a")).otherwise(F.col("_b")).alias("target"),
            F.concat_ws("|", F.when(x, F.lit("cross_ref")), F.nullif("relation", F.lit(""))).alias("relation"), F.when(x, raw + (F.col("_cross") if own else p["cross_ref"])).otherwise(raw).alias("raw"), (F.col("_least") if own else p["least"]).alias("_least"),
        )
    return out.where("raw >= _least").select("graph_id", "source", "target", "relation", F.least("raw", F.lit(1.0)).alias("weight"))


def build_edges(nodes: DataFrame, references: DataFrame | None = None, least: float = V.EDGE_LEAST, idf: DataFrame | None = None) -> DataFrame:
    """Weighted edges between the nodes of each graph.

    A weight sums cross-reference (pairs (a, b) of ids in ``references``, in either direction, or a stored index of them), shared
    entities, same base document, similarity above a threshold, and adjacency of chunks, half of it where both sections are known
    and differ. Edges under ``least`` are dropped, weights are cut at 1. Of ``idf`` (term, idf) each node gets its own terms.
    """
    rows = _with_terms(nodes, idf)
    if references is not None and {"graph_id", "_a", "_b"} <= set(references.columns):
        rows, references = linked(rows, references), None
    return score_pairs(node_pairs(rows), references, least, idf is not None)


def new_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` whose ids their graphs do not have yet, each id once (the first by place)."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy("graph_id", "id").orderBy("pos"))).where("_r = 1").drop("_r")
    return first.join(nodes.select("graph_id", "id"), ["graph_id", "id"], "left_anti").select(*new.columns)


def delta_pairs(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """The pairs (graph_id, a, b) that ``fresh`` nodes make with the known ones and with each other; two known nodes never meet."""
    columns = [c for c in known.columns if c != "graph_id"]
    old, new = (df.select("graph_id", F.struct(*columns).alias(n)) for df, n in ((known, "old"), (fresh, "new")))
    ahead = F.col("old.pos") < F.col("new.pos")
    across = old.join(new, "graph_id").select("graph_id", F.when(ahead, F.col("old")).otherwise(F.col("new")).alias("a"), F.when(ahead, F.col("new")).otherwise(F.col("old")).alias("b"))
    return across.unionByName(node_pairs(fresh.select("graph_id", *columns)))


def delta_edges(nodes: DataFrame, new: DataFrame, references: DataFrame | None = None, least: float = V.EDGE_LEAST, idf: DataFrame | None = None) -> DataFrame:
    """The edges that ``new`` nodes add to the graphs of ``nodes``: new by existing and new by new. Ids that are there add nothing.

    Only the graphs that get nodes are read beyond their keys.
    """
    return _edges_of_new(_searched(nodes), _searched(new_nodes(nodes, new)), references, least, idf)


def _edges_of_new(known: DataFrame, fresh: DataFrame, references: DataFrame | None, least: float, idf: DataFrame | None, write: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """The edges that ``fresh`` nodes make with known ones and with each other; both are searched, and weighed together, as what they share
    is what counts."""
    touched = known.join(fresh.select("graph_id").distinct(), "graph_id", "left_semi")
    if idf is None:
        return score_pairs(delta_pairs(touched, fresh), references, least, False)
    both = write(touched.withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.lit(True))))
    both = write(_weighed(both, idf, write))
    return score_pairs(delta_pairs(both.where("NOT _new").drop("_new"), both.where("_new").drop("_new")), references, least, True)


def add_node(nodes: DataFrame, edges: DataFrame, new: DataFrame, references: DataFrame | None = None, idf: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with ``new`` nodes added: ids that the graph has already change nothing; only pairs with new nodes are scored."""
    return nodes.unionByName(new_nodes(nodes, new).select(*nodes.columns)), edges.unionByName(delta_edges(nodes, new, references, idf=idf))


class EdgeTable:
    """Graphs that grow: nodes, what was found in their texts, and edges in one folder, a part for each batch, and its commit. A batch that
    comes again changes nothing."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.batch = -1
        if self._exists("commits"):
            self.batch = self.spark.read.schema("batch int").parquet(f"{self.path}/commits").agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    def _exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _parts(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{name}/{k}" for k in range(self.batch + 1)))

    def _write(self, name: str, batch: int | str, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{name}/{batch}"
        with cleaned_up(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def nodes(self) -> DataFrame:
        return self._parts("nodes")

    def edges(self) -> DataFrame:
        return self._parts("edges")

    def add(self, new: DataFrame, batch: int, references: DataFrame | None = None, idf: DataFrame | None = None, least: float = V.EDGE_LEAST) -> None:
        """Append the nodes of a batch, and the edges that they bring."""
        if batch <= self.batch:
            return
        if batch != self.batch + 1:
            raise ValueError(f"batch {self.batch + 1} comes next, not {batch}")
        known = self.nodes() if self.batch >= 0 else new.limit(0)
        fresh = self._write("nodes", batch, new_nodes(known, new))
        searched = self._write("searched", batch, _searched(fresh))
        before = self._parts("searched") if self.batch >= 0 else searched.limit(0)
        number = count()
        scratch = lambda df: self._write("scratch", f"{batch}-{next(number)}", df)
        self._write("edges", batch, _edges_of_new(before, searched, references, least, idf, scratch))
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/scratch")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.spark.createDataFrame([(batch,)], "batch int").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self.batch = batch


def cross_references(chunks: DataFrame, within: str | None = None, keep: bool = False) -> DataFrame:
    """(a, b, type) of chunks (id, text, section): a refers to b's section by its whole number, or uses a term that b defines.

    A number is compared as a whole, so that section 1 is not found in section 12. With ``within`` (a column, such as the source)
    only chunks that share its value refer to each other; the joins have it in their keys. With ``keep`` it stays with the
    references, and where few terms are defined they are found in its groups: chunks that are dealt by it are not moved again. What a
    group's texts name is one row then, so groups must be small, as the sections of a contract are.
    """
    key = [] if within is None else [within]
    own = key if keep else []
    text, low = F.col("text"), F.lower("text")
    kind = lambda ref: F.regexp_extract(ref, r"((?:\d+(?:\.\d+)*)|[ivxlc]+)$", 1)
    typed = lambda values, name: F.transform(values, lambda v: F.struct(F.lit(name).alias("type"), v.alias("value")))
    first = lambda term: F.element_at(F.split(term, _BETWEEN_WORDS), 1)
    numbers = F.filter(F.array_distinct(F.transform(T.section_references(text), kind)), lambda n: n != "")
    terms = T.defined_terms(text)
    refs, targets = typed(numbers, "section_ref"), typed(F.filter(F.array(F.lower("section")), lambda n: n.isNotNull()), "section_ref")
    found = [r[0] for r in chunks.select(F.explode(terms).alias("term")).distinct().limit(SENT_DEFINED + 1).collect()]
    few = len(found) <= SENT_DEFINED
    if few and found:  # few terms: each text is searched for them where it is read, and only names are moved
        known = F.array(*map(F.lit, sorted(found)))
        both = F.struct(low.alias("low"), F.split(low, _BETWEEN_WORDS).alias("words"))
        used = T.once(both, lambda x: F.filter(known, lambda t: F.contains(x["low"], t) & F.array_contains(x["words"], first(t))))
        refs, targets = F.concat(refs, typed(used, "defined_term")), F.concat(targets, typed(F.coalesce(terms, F.array().cast("array<string>")), "defined_term"))
    if own and few:
        each = F.struct("id", refs.alias("refs"), F.transform(targets, lambda t: F.struct(t["type"].alias("type"), t["value"].alias("value"), F.col("id").alias("b"))).alias("targets"))
        groups = chunks.where(F.col(within).isNotNull()).groupBy(within).agg(F.collect_list(each).alias("g"))
        rows = groups.select(within, F.flatten(F.transform("g", lambda c: c["targets"])).alias("t"), F.explode("g").alias("c"))
        met = F.filter("t", lambda t: (t["b"] != F.col("c.id")) & F.array_contains("c.refs", F.struct(t["type"].alias("type"), t["value"].alias("value"))))
        return rows.select(within, F.col("c.id").alias("a"), F.inline(F.transform(met, lambda t: F.struct(t["b"].alias("b"), t["type"].alias("type"))))).distinct()
    said = chunks.select(*key, F.col("id").alias("a"), F.inline(refs))
    named = chunks.select(*key, F.col("id").alias("b"), F.inline(targets))
    out = said.join(named, [*key, "type", "value"]).where("a != b").select(*own, "a", "b", "type")
    if few:
        return out.distinct()
    # A use is found through its first word, so the join has an equi key; texts come back only for those that have it.
    defined = chunks.select(*key, F.col("id").alias("b"), F.explode(terms).alias("term"))
    uses = chunks.select(*key, "id", F.explode(F.array_distinct(F.split(low, _BETWEEN_WORDS))).alias("word"))
    likely = uses.join(defined.withColumn("word", first(F.col("term"))), [*key, "word"]).where("id != b").select(*own, "id", "b", "term").distinct()
    by_term = likely.join(chunks.select(*own, "id", low.alias("low")), [*own, "id"]).where("contains(low, term)").select(*own, F.col("id").alias("a"), "b", F.lit("defined_term").alias("type"))
    return out.unionByName(by_term).distinct()


def write_reference_index(references: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Store references as a table bucketed and sorted by their canonical pair (_a, _b), with the types of each: a lookup by pairs then
    moves the pairs, not the index. Pairs are dealt out by bucket, so that each bucket is one file. References with a graph_id, which stay
    within their graph, are bucketed by it: pairs of nodes that are dealt by graph are not moved either."""
    own = ["graph_id"] if "graph_id" in references.columns else []
    by = own or ["_a", "_b"]
    pairs = references.select(*own, F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"), "type").repartition(buckets, *by)
    pairs = pairs.groupBy(*own, "_a", "_b").agg(F.array_sort(F.collect_set("type")).alias("types"))
    with cleaned_up(references.sparkSession):
        pairs.write.bucketBy(buckets, *by).sortBy(*own, "_a", "_b").option("path", path).mode("overwrite").saveAsTable(table)
    return references.sparkSession.table(table)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, id and degree: incident edges, parallel ones each."""
    ends = edges.select("graph_id", F.explode(F.array("source", "target")).alias("id")).groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("graph_id", "id").join(ends, ["graph_id", "id"], "left").select("graph_id", "id", F.coalesce("degree", F.lit(0)).alias("degree"))


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id and connectivity: the edges' weights over the number of pairs, 1 at most; 1 for a single node."""
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    w = edges.groupBy("graph_id").agg(F.sum("weight").alias("w"))
    score = F.when(F.col("n") <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("w", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1) / 2)))
    return n.join(w, "graph_id", "left").select("graph_id", score.alias("connectivity"))


def connected_nodes(edges: DataFrame, least: float = 0.3) -> DataFrame:
    """graph_id, id and neighbour of the edges of weight ``least`` or more, in both directions."""
    kept = edges.where(F.col("weight") >= least)
    one = kept.select("graph_id", F.col("source").alias("id"), F.col("target").alias("neighbour"))
    return one.unionByName(kept.select("graph_id", F.col("target").alias("id"), F.col("source").alias("neighbour"))).distinct()


def expand(nodes: DataFrame, edges: DataFrame, corpus: DataFrame, references: DataFrame, queries: DataFrame, k: int = 2) -> DataFrame:
    """Nodes with up to k of the corpus added to each graph: those referred to, then those nearest to the query.

    ``corpus`` has the nodes' columns without graph_id and pos; ``queries`` are (graph_id, query). Referred nodes have
    confidence 0.85, others 0.9 of their similarity. Edges of the graph that are cross-references lead to the same ids as
    ``references`` do.
    """
    linked = edges.where(F.col("relation").contains("cross_ref")).select(F.col("source").alias("a"), F.col("target").alias("b"))
    references = references.select("a", "b").unionByName(linked)
    both = references.select("a", "b").unionByName(references.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    there = nodes.select("graph_id", "id")
    referred = nodes.select("graph_id", F.col("id").alias("a")).join(both, "a").select("graph_id", F.col("b").alias("id")).distinct()
    referred = referred.join(corpus.select("id"), "id", "left_semi").join(there, ["graph_id", "id"], "left_anti").select("graph_id", "id", F.lit(0).alias("priority"), F.lit(0.85).alias("score"))
    # Only graphs that references do not fill are compared with the corpus.
    full = referred.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    lacking = queries.select("graph_id", "query").join(full, "graph_id", "left_anti")
    # As many rows are found for a graph as its own nodes and referred ones may take away, and k more.
    size = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    asked = lacking.join(size, "graph_id", "left").select(F.col("graph_id").alias("query_id"), "query", (F.coalesce("n", F.lit(0)) + 2 * k).alias("most"))
    scored = cosine_candidates(asked, corpus.select("id", F.col("embedding").alias("vector"))).select(F.col("query_id").alias("graph_id"), "id", F.lit(1).alias("priority"), (F.col("score") * 0.9).alias("score"))
    found = referred.unionByName(scored.join(there, ["graph_id", "id"], "left_anti"))
    best = found.groupBy("graph_id", "id").agg(F.min(F.struct("priority", (-F.col("score")).alias("minus"))).alias("s"))
    w = Window.partitionBy("graph_id").orderBy("s", "id")
    best = best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    last = nodes.groupBy("graph_id").agg(F.max("pos").alias("last"))
    added = best.join(corpus, "id").join(last, "graph_id").withColumn("pos", (F.col("last") + F.col("r")).cast("int"))
    return nodes.unionByName(added.select(*nodes.columns))


def prune(nodes: DataFrame, edges: DataFrame, queries: DataFrame, critical: DataFrame | None = None) -> DataFrame:
    """Nodes without the one of least worth in each graph of more than three: relevance to the query, 0.5 for cross-references,
    0.3 for three edges or more with one, 0.4 for what a subquery needs (``critical``: graph_id, id). Of equals the first goes."""
    ends = edges.select("graph_id", F.explode(F.array("source", "target")).alias("id"), F.col("relation").contains("cross_ref").alias("x"))
    ends = ends.groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("degree"), F.max("x").alias("x"))
    rows = nodes.join(queries, "graph_id").join(ends, ["graph_id", "id"], "left")
    needed = (critical if critical is not None else nodes.select("graph_id", "id").limit(0)).distinct().withColumn("needed", F.lit(True))
    rows = rows.join(needed, ["graph_id", "id"], "left")
    x = F.coalesce("x", F.lit(False))
    worth = (
        (F.col("relevance") if "relevance" in nodes.columns else X.cosine(X.double(F.col("embedding")), X.double(F.col("query")))) + F.when(x, 0.5).otherwise(0.0)
        + F.when(x & (F.col("degree") >= 3), 0.3).otherwise(0.0) + F.when(F.coalesce("needed", F.lit(False)), 0.4).otherwise(0.0)
    )
    ranked = rows.select("graph_id", "id", F.row_number().over(Window.partitionBy("graph_id").orderBy(worth, "pos")).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("graph_id")).alias("n"))
    return nodes.join(ranked.where("r = 1 AND n > 3").select("graph_id", "id"), ["graph_id", "id"], "left_anti").select(*nodes.columns)


def edge_texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with the texts of their two ends, empty where an end has no node."""
    named = lambda end: nodes.select("graph_id", F.col("id").alias(end), F.col("text").alias(f"{end}_text"))
    rows = edges.join(named("source"), ["graph_id", "source"], "left").join(named("target"), ["graph_id", "target"], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("source_text", "target_text")})


def contradiction_score(nodes: DataFrame, edges: DataFrame, scorer=X.contradiction) -> DataFrame:
    """graph_id and the mean over its edges of their weight times what ``scorer`` says of the two texts; 0 without edges."""
    rows = edge_texts(nodes, edges)
    both = (F.col("source_text") != "") & (F.col("target_text") != "")
    each = rows.groupBy("graph_id").agg(F.avg(F.when(both, scorer(F.col("source_text"), F.col("target_text")) * F.col("weight")).otherwise(0.0)).alias("score"))
    return nodes.select("graph_id").distinct().join(each, "graph_id", "left").select("graph_id", F.coalesce("score", F.lit(0.0)).alias("contradiction"))


def semantic_score(nodes: DataFrame, queries: DataFrame, scorer=X.entailment) -> DataFrame:
    """graph_id and how far the graph's texts, in order, entail the query (graph_id, query); 0.5 where there is no text or query."""
    texts = nodes.where("text != ''").groupBy("graph_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])).alias("premise"))
    rows = queries.select("graph_id", "query").join(texts, "graph_id", "left")
    known = (F.coalesce("premise", F.lit("")) != "") & (F.coalesce("query", F.lit("")) != "")
    return rows.select("graph_id", F.when(known, scorer(F.col("premise"), F.col("query"))).otherwise(0.5).alias("semantic"))


def near_subqueries(nodes: DataFrame, subqueries: DataFrame, name: str) -> DataFrame:
    """graph_id, subquery_id, id, pos and the similarity of each node to each subquery; light nodes of the policy know it."""
    if "near" in nodes.columns:
        return nodes.select("graph_id", "id", "pos", F.explode("near").alias("x")).select("graph_id", "x.subquery_id", "id", "pos", F.col("x.s").alias(name))
    return nodes.join(subqueries, "graph_id").select("graph_id", "subquery_id", "id", "pos", X.cosine(X.double(F.col("embedding")), X.double(F.col("vector"))).alias(name))


def critical_nodes(nodes: DataFrame, subqueries: DataFrame, least: float = 0.35) -> DataFrame:
    """graph_id and id of the best node of each subquery (graph_id, subquery_id, vector) from ``least`` on, and of its second best if that reaches 0.8 of the best."""
    scored = near_subqueries(nodes, subqueries, "score")
    w = Window.partitionBy("graph_id", "subquery_id").orderBy(F.desc("score"), "pos")
    ranked = scored.withColumns({"r": F.row_number().over(w), "best": F.first("score").over(w)})
    return ranked.where((F.col("r") <= 2) & (F.col("score") >= least) & ((F.col("r") == 1) | (F.col("score") >= 0.8 * F.col("best")))).select("graph_id", "id").distinct()


def compress(nodes: DataFrame, threshold: float = 0.5, members: bool = False) -> DataFrame:
    """(graph_id, id, text) after merging, in order of ids, each node into the first kept one of token similarity ``threshold`` or more;
    with ``members`` also the ids that went into a node, in their order.

    The text that a node has grown to counts for the next comparison, so the nodes of a graph are folded one by one; graphs
    hold some ten nodes, and run apart from each other.
    """

    def fold(group):
        import re

        kept: list[list] = []
        ordered = group.sort_values("id")
        for name, text in zip(ordered["id"], ordered["text"], strict=True):
            own = {w.lower() for w in re.findall("[A-Za-z]+", text or "")}
            for k in kept:
                union = own | k[2]
                if not union or len(own & k[2]) / len(union) >= threshold:
                    k[1], k[2] = f"{k[1]} {text}", union
                    k[3].append(name)
                    break
            else:
                kept.append([name, text, own, [name]])
        out = group.iloc[: len(kept)].assign(id=[k[0] for k in kept], text=[k[1] for k in kept], members=[k[3] for k in kept])
        return out[["graph_id", "id", "text", *(["members"] if members else [])]]

    kind = nodes.schema
    schema = f"graph_id {kind['graph_id'].dataType.simpleString()}, id {kind['id'].dataType.simpleString()}, text string" + (f", members array<{kind['id'].dataType.simpleString()}>" if members else "")
    return nodes.select("graph_id", "id", "text").groupBy("graph_id").applyInPandas(fold, schema)


def initial_graph(queries: DataFrame, corpus: DataFrame, embed: Callable[[Column], Column], k: int = 10, terms: Column | None = None, most_terms: int = 6) -> DataFrame:
    """graph_id, pos, id, confidence and route: the first graph of each query (graph_id, text), found by search in ``corpus`` (id, vector).

    The query and then each of its first ``most_terms`` terms bring their nearest rows that are not there yet, at most
    max(2, k // (terms + 1)) each, until there are k; what terms bring has 0.9 of its similarity as confidence. A list of k and a
    quota more holds enough, whatever was there before. The lists of a query, at most ``most_terms`` + 1 of them, are folded in order.
    """
    found = F.coalesce(terms if terms is not None else T.query_entities(F.col("text")), F.array().cast("array<string>"))
    asked = queries.select("graph_id", "text", F.array_distinct(found).alias("all_terms"))
    quota = F.greatest(F.lit(2), F.floor(F.lit(k) / (F.size("all_terms") + 1)).cast("int"))
    asked = asked.select("graph_id", F.when(F.size("all_terms") == 0, k).otherwise(quota).alias("quota"), F.posexplode(F.concat(F.array("text"), F.slice("all_terms", 1, most_terms))).alias("step", "term"))
    steps = asked.select("graph_id", "quota", "step", "term", F.concat_ws("#", "step", "graph_id").alias("query_id"))
    hits = top_similar(steps.select("query_id", embed(F.col("term")).alias("query")), corpus, 2 * k)
    lists = hits.join(steps, "query_id").groupBy("graph_id", "quota", "step", "term").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("hits"))
    whole = lists.groupBy("graph_id", "quota").agg(F.array_sort(F.collect_list(F.struct("step", "term", "hits"))).alias("lists"))
    kind = corpus.schema["id"].dataType.simpleString()
    none = F.array().cast(f"array<struct<id:{kind},confidence:double,route:string>>")

    def step(taken: Column, x: Column) -> Column:
        fresh = F.filter(x["hits"], lambda h: ~F.exists(taken, lambda t: t["id"] == h["id"]))
        room = F.when(x["step"] == 0, F.col("quota")).otherwise(F.least(F.col("quota"), F.greatest(k - F.size(taken), F.lit(0))))
        share, route = F.when(x["step"] == 0, 1.0).otherwise(0.9), F.when(x["step"] == 0, F.lit("query_match")).otherwise(F.concat(F.lit("entity:"), x["term"]))
        return F.concat(taken, F.transform(F.slice(fresh, 1, room), lambda h: F.struct(h["id"].alias("id"), (h["score"] * share).alias("confidence"), route.alias("route"))))

    nodes = whole.select("graph_id", F.posexplode(F.aggregate("lists", none, step)).alias("pos", "node"))
    return nodes.select("graph_id", "pos", "node.id", "node.confidence", "node.route")
