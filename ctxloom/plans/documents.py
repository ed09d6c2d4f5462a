"""Queries of text functions over documents, benchmark items and literal contracts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ctxloom.functions import chunk as C
from ctxloom.functions import text as T
from ctxloom.functions import vector as X
from ctxloom.functions import vocabulary as V
from ctxloom.operators.retrieval import pairs_of
from ctxloom.plans.registry import query, read, values

_WORDS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> ''))"


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+')) AS tokens FROM documents")
def token_count(spark, d):
    return read(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, CAST({_WORDS} AS INT) AS n_words, CASE WHEN n_words < 5 THEN 0.0::DOUBLE WHEN n_words < 15 THEN 0.3 WHEN n_words < 30 THEN 0.6 ELSE 1.0 END AS band FROM documents")
def gate_token_band(spark, d):
    return read(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"), T.length_band(F.col("text")).alias("band"))


@query("SELECT doc_id, substring(sha256(text), 1, 16) AS fingerprint FROM documents")
def doc_fingerprint(spark, d):
    return read(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


@query(r"SELECT doc_id, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2000 / n) END AS efficiency FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+')) AS n FROM documents)")
def token_efficiency(spark, d):
    n = T.token_count(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2000 / n)).alias("efficiency"))


@query(
    r"WITH q AS (SELECT list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x))) AS q, item_id FROM benchmark WHERE item_id % 20 = 0), t AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x))) AS t FROM documents) "
    "SELECT item_id, doc_id, round(len(list_intersect(q, t)) / len(q), 6) AS coverage, round(CASE WHEN len(t) = 0 THEN 0 ELSE (len(t) - len(list_intersect(q, t))) / len(t) END, 6) AS novelty FROM t, q"
)
def coverage_novelty(spark, d):
    q = read(spark, d, "benchmark").where("item_id % 20 = 0").select("item_id", T.token_set(F.col("text")).alias("q"))
    t = pairs_of(q, read(spark, d, "documents").select("doc_id", T.token_set(F.col("text")).alias("t")))
    hit = F.size(F.array_intersect("q", "t"))
    return t.select("item_id", "doc_id", F.round(hit / F.size("q"), 6).alias("coverage"), F.round(F.when(F.size("t") == 0, 0.0).otherwise((F.size("t") - hit) / F.size("t")), 6).alias("novelty"))


@query(
    r"SELECT turn, count(*) AS n, sum(len(regexp_extract_all(text, '[A-Za-z]+'))) AS tokens, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY turn"
)
def conversation_tokens(spark, d):
    return read(spark, d, "conversations").groupBy("turn").agg(F.count(F.lit(1)).alias("n"), F.sum(T.token_count(F.col("text"))).alias("tokens"), F.count_distinct("conv_id").alias("conversations"))


@query("SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def last_turns(spark, d):
    c = read(spark, d, "conversations").withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return c.where("r <= 2").select("conv_id", "turn", "text")


_TEXTS = values("lit", ("id", "text"), [
    (1, 'Subject to Section 4.1, the Supplier shall pay $5,000.00 within 45 days. "Net Revenue" means gross sales less returns, excluding taxes.'),
    (2, "The lease runs 3 years from 12/31/2020, unless otherwise agreed. See Exhibit B and Article IV; the Tenant Company pays 4.5% more each year."),
    (3, "Thanks!"), (4, "Plain words only, with nothing that is specific at all in them, twenty words long or more so that the bonus counts here too."),
])


#: The literal texts, which have what contracts have, and all documents.
_T_SQL = f"{_TEXTS.sql}, t AS (SELECT * FROM lit UNION ALL SELECT doc_id + 1000, text FROM documents)"


def _texts(spark, d):
    return _TEXTS.frame(spark).unionByName(read(spark, d, "documents").select((F.col("doc_id") + 1000).alias("id"), "text"))


def _count(pattern: str, most: int, weight: int) -> str:
    return f"least({most}, len(regexp_extract_all(text, '{pattern}'))) * {weight}"


_SIGNALS = " + ".join([_count(r"\b\d+(?:\.\d+)?%?\b", 5, 1), _count(r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\w+ \d{1,2},? \d{4})\b", 3, 2), _count(r"\$[\d,]+(?:\.\d{2})?", 3, 2), _count(r"(?i)\b\d+\s*(?:days?|months?|years?|weeks?|hours?)\b", 3, 2)])


@query(f"WITH {_T_SQL}, n AS (SELECT *, len(string_split_regex(trim(text), '\\s+')) AS w FROM t) SELECT id, CASE WHEN length(text) < 10 THEN 0.0 ELSE least(1.0, ({_SIGNALS} + CASE WHEN w >= 20 THEN 2 WHEN w >= 10 THEN 1 ELSE 0 END) / 8) END AS specificity FROM n")
def specificity(spark, d):
    return _texts(spark, d).select("id", T.specificity(F.col("text")).alias("specificity"))


_REFS = " || ".join(f"regexp_extract_all(text, '(?i){p}')" for p in V.REFERENCE_PATTERNS)


@query(f"WITH {_T_SQL}, r AS (SELECT id, lower(unnest({_REFS})) AS ref FROM t) SELECT DISTINCT id, ref FROM r")
def section_references(spark, d):
    return _texts(spark, d).select("id", F.explode(T.section_references(F.col("text"))).alias("ref"))


@query(f"WITH {_T_SQL} SELECT id, unnest(list_transform(regexp_extract_all(text, '\"([^\"]{{3,50}})\"\\s+(?:means|shall mean)', 1), lambda x: lower(x))) AS term FROM t")
def defined_terms(spark, d):
    return _texts(spark, d).select("id", F.explode(T.defined_terms(F.col("text"))).alias("term"))


@query()
def contradiction_flags(spark, d):
    return _texts(spark, d).select("id", F.inline(T.contradiction_flags(F.col("text"))))


@query(rf"WITH {_T_SQL} SELECT id, CAST(len(regexp_extract_all(lower(text), '\b(?:subject\s+to|unless\s+otherwise|notwithstanding|except\s+as|provided\s+however)\b')) AS INT) AS trap_a_count FROM t")
def override_counts(spark, d):
    return _texts(spark, d).select("id", T.trap_scores(F.col("text"))["trap_a_count"].alias("trap_a_count"))


_SCAN = (
    f"WITH {_T_SQL}, a AS (SELECT id, text, lower(text) AS low, " + " + ".join(f"len(regexp_extract_all(lower(text), '{p}'))" for p in V.OVERRIDE_PATTERNS) + " AS a, "
    + r"""least(len(list_distinct(regexp_extract_all(text, '(?i)"([^"]+)"\s+(?:means|shall\s+mean)', 1))), 15) AS defined, len(regexp_extract_all(lower(text), '\b(?:article\s+1|section\s+1\.\d+)')) AS openings, """
    r"len(list_distinct(regexp_extract_all(lower(text), '\bsection\s+\d+(?:\.\d+)*(?:\([a-z]\))?'))) AS sections FROM t), "
    "b AS (SELECT *, CASE WHEN openings > 5 AND defined < openings THEN greatest(defined, least(openings, 30)) ELSE defined END AS b, least(sections // 3, 20) AS c FROM a) "
    "SELECT id, CAST(a AS INT) AS trap_a_count, CAST(b AS INT) AS trap_b_count, CAST(c AS INT) AS trap_c_count, CAST(sections AS INT) AS trap_c_sections, CAST(a * 2 + b * 1.5 + c AS DOUBLE) AS total_score FROM b"
)


@query(_SCAN)
def trap_scan(spark, d):
    return _texts(spark, d).select("id", *[c.alias(n) for n, c in T.trap_scores(F.col("text")).items()])


@query(
    rf"WITH {_T_SQL}, c AS (SELECT id, substring(trim(replace(regexp_extract(text, '(?is)([^.]{{0,80}}(?:notwithstanding|except as|subject to)[^.]{{0,200}}\.)', 1), chr(10), ' ')), 1, 400) AS snippet, "
    r"list_distinct(regexp_extract_all(text, '(?i)\b(?:Section|Article)\s+(\d+(?:\.\d+)*(?:\([a-z]\))?)', 1)) AS numbers FROM t) "
    r"SELECT id, nullif(snippet, '') AS snippet, CASE WHEN snippet <> '' THEN coalesce(nullif(regexp_extract(snippet, '[Ss]ection\s+\d+(?:\.\d+)*(?:\([a-z]\))?'), ''), 'relevant section') END AS section, len(numbers) >= 3 AS scattered FROM c"
)
def trap_content(spark, d):
    """What each text says that overrides something, and whether it refers to three sections or more."""
    from ctxloom.operators import answering as A

    rows = _texts(spark, d).select("id", A.override_clause(F.col("text")).alias("c"), A.scattered_sections(F.col("text")).isNotNull().alias("scattered"))
    return rows.select("id", F.col("c.snippet").alias("snippet"), F.col("c.section").alias("section"), "scattered")


@query()
def document_chunks(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text")
    return C.chunk_documents(docs).select("id", "source_doc_id", "chunk_index", F.length("text").alias("n_chars"))


_ASKED = "t AS (SELECT conv_id * 1000 + turn AS id, text AS query FROM conversations WHERE role = 'user')"


def _questions(spark, d):
    """What users ask: their turns in all conversations."""
    c = read(spark, d, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("query"))


@query(
    f"WITH {_ASKED} SELECT id, CASE WHEN regexp_matches(lower(query), '^(does|is|are|can|will) ') THEN 'yes_no' WHEN lower(query) LIKE '% and %' OR lower(query) LIKE '% or %' THEN 'multi_hop_factual' "
    "WHEN contains(lower(query), 'what is') OR contains(lower(query), 'define') THEN 'definition' WHEN contains(lower(query), 'compare') OR contains(lower(query), 'difference') THEN 'comparison' ELSE 'factual' END AS intent FROM t"
)
def query_intent(spark, d):
    return _questions(spark, d).select("id", T.intent(F.col("query")).alias("intent"))


@query()
def query_parse(spark, d):
    q = F.col("query")
    return _questions(spark, d).select("id", T.query_entities(q).alias("entities"), T.subqueries(q).alias("subqueries"), T.clause_types(q).alias("clause_types"))


@query("WITH a AS (SELECT doc_id, substring(sha256(text), 1, 16) AS h, doc_id % 5 AS m FROM documents) SELECT CASE WHEN m = 0 THEN 'added' WHEN m = 1 THEN 'updated' ELSE 'unchanged' END AS action, count(*) AS n FROM a GROUP BY ALL")
def change_detect(spark, d):
    """Two snapshots: in the new one a fifth of the documents is new, and a fifth has another text."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 5 != 0").select("doc_id", T.fingerprint(F.when(F.expr("doc_id % 5 = 1"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("old"))
    rows = docs.select("doc_id", T.fingerprint(F.col("text")).alias("new")).join(old, "doc_id", "left")
    action = F.when(F.col("old").isNull(), "added").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    return rows.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"WITH s AS (SELECT item_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x))) AS t FROM benchmark) "
    "SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS jaccard FROM s a JOIN s b ON a.item_id < b.item_id WHERE len(list_intersect(a.t, b.t)) > 0"
)
def jaccard_pairs(spark, d):
    """Pairs that share a token, found through the tokens."""
    s = read(spark, d, "benchmark").select("item_id", T.token_set(F.col("text")).alias("t"))
    w = s.select("item_id", F.size("t").alias("n"), F.explode("t").alias("w"))
    a, b = w.select(F.col("item_id").alias("a"), F.col("n").alias("na"), "w"), w.select(F.col("item_id").alias("b"), F.col("n").alias("nb"), "w")
    both = a.join(b, "w").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("m"))
    return both.select("a", "b", F.round(F.col("m") / (F.col("na") + F.col("nb") - F.col("m")), 6).alias("jaccard"))


@query()
def hashed_embeddings(spark, d):
    return read(spark, d, "benchmark").select("item_id", X.hashed_embedding(F.col("text"), 64).alias("embedding"))


@query()
def query_preprocess(spark, d):
    from ctxloom.operators.answering import preprocess

    return preprocess(_questions(spark, d)).select("id", "parsed.*")


@query()
def query_graph(spark, d):
    from ctxloom.operators.answering import query_graph as build

    # Users' turns link nothing; what links nations to regions is asked besides.
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    linked = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select((-1 - F.col("n_nationkey").cast("long")).alias("id"), F.concat(F.lit("How is "), "n_name", F.lit(" linked with "), "r_name", F.lit("?")).alias("query"))
    nodes, edges = build(_questions(spark, d).unionByName(linked).withColumnRenamed("id", "query_id"))
    return nodes.join(edges.withColumnRenamed("source", "id"), ["query_id", "id"], "left")


@query()
def answer_prompts(spark, d):
    from ctxloom.operators.answering import answer

    t = _TEXTS.frame(spark)
    nodes = t.select(F.lit("g").alias("graph_id"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), "text")
    return answer(nodes, spark.createDataFrame([("g", "What is due?")], ["graph_id", "query"]))


@query()
def trap_quota(spark, d):
    from ctxloom.operators import answering as A

    contracts = _TEXTS.frame(spark).select(F.concat(F.lit("contract_"), F.col("id").cast("string")).alias("name"), "text")
    return A.annotation_entries(A.choose_by_quota(A.trap_contracts(contracts), contracts.where("false").select("name")))
