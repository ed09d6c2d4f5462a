"""Personal data: patterns, and information-theoretic sanitisation, in DataFrame operations only.

Emails, IP addresses, card and phone numbers are found by pattern, with their places. They are the protected entities, each
under three names: its own, that of its group (the domain, or the number without its last part), and that of its kind; groups and
kinds recur where single entities do not. Over the corpus, a word discloses an entity to the degree of their pointwise mutual
information, log2(p(entity | word) / p(entity)), with probabilities from counts of different texts, so that copies count once;
p(entity | word) is smoothed towards p(entity), as a word of few texts says less. A text's words are all that stand outside entities.
A word that occurs with the same entity in ``min_support`` texts at least is generalised wherever it stands if that probability
reaches ``generalise_at`` and the information ``min_bits``; from ``remove_at`` on it is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.llm._common import bound, materialize, put_back, set_aside, table

#: The patterns, with possessive repeats and a lookbehind that skip starts which cannot match any more. Runs of
#: digits are whole runs: those of under 13 or over 19 digits are no cards, and are passed over here.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_MATCHES = "array<struct<start:int,end:int,match:string>>"
#: Matches whose places are summed at once.
BLOCK = 64
#: Disclosing words (and signs of theirs) that are sent to all tasks; more of them are joined by a shuffle.
SENT_TERMS, SENT_SIGNS = 100_000, 4_000_000
MIN_SUPPORT = 2
#: Smoothed shares of a word's texts that hold the entity; the least information in bits; texts that the smoothing weighs.
GENERALISE_AT, REMOVE_AT, MIN_BITS, PRIOR = 0.5, 0.8, 3.0, 0.5


def matches(text: Column, pattern: str | Column) -> Column:
    """Array of (start, end, match) of all matches, leftmost and not overlapping; in code points, ends exclusive.

    Between the pieces that ``split`` leaves stand the matches that ``regexp_extract_all`` gives, so places are sums of lengths.
    They are summed in blocks of BLOCK matches, and then over the blocks: a growing array is copied at each step of a fold.
    """
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_MATCHES).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match")))).alias("out"))

    def add(acc: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda x: F.struct((acc["at"] + x["start"]).alias("start"), (acc["at"] + x["end"]).alias("end"), x["match"].alias("match")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def placed(pairs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda k: F.aggregate(F.slice(pairs, k * BLOCK + 1, BLOCK), zero, step))
        every = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_MATCHES}>").alias("out")), add)
        return F.when(F.size(pairs) > 0, F.flatten(every["out"])).otherwise(F.array().cast(_MATCHES))

    def gaps(found: Column) -> Column:
        pieces = F.slice(F.split(text, F.lit(pattern), -1), 1, F.size(found))
        return F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))

    return bound(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: bound(gaps(found), placed))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """From the right, every second digit doubled (less 9 above 9); the sum ends in 0."""
    one = lambda ch: F.ascii(ch) - 48
    parts = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(parts, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, one(c)).otherwise(one(c) * 2 - F.when(one(c) > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """What a match must fulfil beyond its pattern."""
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        n = F.length(_digits(match))
        return n.between(13, 19) & _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def entities(text: Column, kind: str) -> Column:
    """Array of (start, end, match) of one kind; empty for null and for texts without the sign it needs."""
    needs = text.contains({"email": "@", "phone": "+"}[kind]) if kind in ("email", "phone") else text.rlike("[0-9]")
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(F.coalesce(needs, F.lit(False)), F.filter(matches(text, PATTERNS[kind]), lambda m: valid(kind, m["match"]))).otherwise(none)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and an array of (start, end, match) for each of email, ip, card and phone; documents without any are left out.

    A row for each row of the input, read once and written to the shared folder.
    """
    text = F.col("text")
    likely = text.contains("@") | text.rlike("[0-9]")
    found = docs.where(likely).select("doc_id", "text", *[entities(text, k).alias(k) for k in KINDS])
    return found.where(" OR ".join(f"size({k}) > 0" for k in KINDS))


def _names(kind: str, match: Column) -> Column:
    """An entity's own name, that of its group, and that of its kind."""
    if kind == "email":
        own = F.lower(match)
        group = F.substring_index(own, "@", -1)
    elif kind == "ip":
        own = F.regexp_replace(match, r"(?<![0-9])0+(?=[0-9])", "")
        group = F.substring_index(own, ".", 3)
    else:
        own = _digits(match)
        group = F.substring(own, 1, 6) if kind == "card" else F.substring(own, F.lit(1), F.length(own) - 4)
    return F.array(F.concat(F.lit(f"{kind}:"), own), F.concat(F.lit(f"{kind} group:"), group), F.lit(f"{kind} kind"))


def _words(text: Column) -> Column:
    """The distinct words of a text, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))


def _outside(text: Column) -> Column:
    """The text with a space in place of each entity."""
    spans = F.array_sort(F.concat(*[F.transform(k, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))) for k in KINDS]))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    piece = lambda acc, p: F.substring(text, acc["at"] + 1, F.greatest(p["start"] - acc["at"], F.lit(0)))
    done = F.aggregate(spans, zero, lambda acc, p: F.struct(F.greatest(acc["at"], p["end"]).alias("at"), F.concat(acc["out"], F.array(piece(acc, p))).alias("out")))
    return F.concat(F.array_join(done["out"], " "), F.lit(" "), F.substring(text, done["at"] + 1, F.length(text)))


def _different(docs: DataFrame) -> DataFrame:
    """One row for each different text, by 128 bits of hashes."""
    return docs.where("text IS NOT NULL").withColumns({"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(7), F.col("text"))}).dropDuplicates(["_h1", "_h2"]).drop("_h1", "_h2")


def disclosures(docs: DataFrame, found: DataFrame, min_support: int = MIN_SUPPORT, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, min_bits: float = MIN_BITS) -> DataFrame:
    """(term, bits, action): the words that disclose an entity beyond the thresholds, with the most that they disclose.

    Counts are of different texts, over the whole corpus: those of the entity, of the word, and of both together.
    """
    named = lambda kind: lambda m: _names(kind, m["match"])
    names = F.array_distinct(F.flatten(F.concat(*[F.transform(k, named(k)) for k in KINDS])))
    words = materialize(_different(found).select(F.monotonically_increasing_id().alias("k"), names.alias("names"), _words(_outside(F.col("text"))).alias("words"), _words(F.col("text")).alias("every")))
    named = words.select("k", F.explode("names").alias("entity"))
    seen = named.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= min_support)
    named = materialize(named.join(seen, "entity"))
    # The words of all texts, less those that stand in entities only; the empty word stands for the text itself.
    counted = _different(docs.select("text")).select(F.explode(F.concat(F.array(F.lit("")), _words(F.col("text")))).alias("term"), F.lit(1).cast("long").alias("n"))
    counted = counted.unionByName(words.select(F.explode(F.array_except("every", "words")).alias("term"), F.lit(-1).cast("long").alias("n")))
    counts = materialize(counted.groupBy("term").agg(F.sum("n").alias("n_term")).where((F.col("n_term") >= min_support) | (F.col("term") == "")))
    texts = counts.where("term = ''").agg(F.coalesce(F.max("n_term"), F.lit(0))).first()[0]
    share = lambda both: (both + PRIOR * F.col("n_entity") / max(texts, 1)) / (F.col("n_term") + PRIOR)
    # What a word could reach if the entity stood in as many of its texts as it can: a word that falls short is not paired.
    within = share(F.least("n_term", "n_entity")) >= generalise_at - 1e-9
    most = named.groupBy("k").agg(F.max("n_entity").alias("n_entity"))
    own = words.select("k", "words").join(most, "k").select("k", "n_entity", F.explode("words").alias("term")).join(counts.where("term != ''"), "term").where(within).select("k", "term", "n_term")
    pairs = own.join(named, "k").where(within).groupBy("entity", "n_entity", "term", "n_term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= min_support)
    return (
        pairs.withColumn("share", share(F.col("both"))).withColumn("bits", F.log2(F.col("share") * texts / F.col("n_entity")))
        .where((F.col("share") >= generalise_at) & (F.col("bits") >= min_bits))
        .groupBy("term").agg(F.max("bits").alias("bits"), F.max(F.when(F.col("share") >= remove_at, "remove").otherwise("generalise")).alias("action"))
    )


def _places(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """(doc_id, hash, terms): every place of the words ``judged``, in all documents that hold any.

    Few words go to the texts, where they stand. Where there are more, the words of the texts go to them, and what is found back to the texts.
    """
    terms, signs = judged.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    bounded = lambda word: F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), word, F.lit(r")(?!\p{L})"))
    worded = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text", F.explode(_words(F.col("text"))).alias("term"))
    if terms <= SENT_TERMS and signs <= SENT_SIGNS:
        placed = worded.join(F.broadcast(judged), "term").select("doc_id", "hash", "bits", "action", F.explode(matches(F.col("text"), bounded(F.col("term")))).alias("m"))
    else:
        held = worded.drop("text").join(judged, "term").groupBy("doc_id", "hash").agg(F.collect_set(F.struct("term", F.struct("bits", "action").alias("judged"))).alias("held"))
        held = held.withColumnsRenamed({"doc_id": "id", "hash": "own"})
        texts = docs.join(held, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("own"))).select("doc_id", F.col("own").alias("hash"), "text", F.map_from_entries("held").alias("held"))
        found = texts.select("doc_id", "hash", "held", F.explode(matches(F.col("text"), bounded(F.array_join(F.map_keys("held"), "|")))).alias("m")).withColumn("judged", F.col("held")[F.lower("m.match")])
        placed = found.where("judged IS NOT NULL").select("doc_id", "hash", "judged.bits", "judged.action", "m")
    # Rows that share id and text have the same places.
    return placed.groupBy("doc_id", "hash").agg(F.array_sort(F.collect_set(F.struct("m.start", "m.end", F.lower("m.match").alias("term"), "bits", "action"))).alias("terms"))


def _all_spans(docs: DataFrame, **thresholds) -> DataFrame:
    """(id, hash, email, ip, card, phone, terms) of the documents (doc_id, text) that hold any; one row for an id and text."""
    found = materialize(find(docs))
    judged = materialize(disclosures(docs, found, **thresholds))
    placed = _places(docs, judged).withColumnsRenamed({"doc_id": "id", "hash": "own"})
    own = found.select("doc_id", F.xxhash64("text").alias("hash"), *KINDS).dropDuplicates(["doc_id", "hash"])
    both = own.join(placed, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("own")), "full")
    entities = [F.coalesce(k, F.array().cast(_MATCHES)).alias(k) for k in KINDS]
    terms = F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,term:string,bits:double,action:string>>")).alias("terms")
    both = both.select(F.when(F.col("hash").isNull(), F.col("id")).otherwise(F.col("doc_id")).alias("id"), F.coalesce("hash", "own").alias("hash"), *entities, terms)
    inside = lambda t: F.exists(F.concat(*KINDS), lambda m: (m["start"] < t["end"]) & (t["start"] < m["end"]))
    return materialize(both.withColumn("terms", F.filter("terms", lambda t: ~inside(t))))


def _with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (doc_id, hash and more) with the spans of each row."""
    joined = docs.join(found.withColumnRenamed("hash", "own"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("own")), "left")
    return joined.select(*docs.columns, *[F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in (*KINDS, "terms")])


def spans(docs: DataFrame, **thresholds) -> DataFrame:
    """One row for each row of ``docs``: its columns but text, the entities of each kind, and ``terms``, an array of
    (start, end, term, bits, action) of disclosing words outside entities.

    Null text is empty and holds nothing, as do empty texts; texts of any length are searched whole; repeated rows each
    give a row, and each count; of an empty table there are none. Columns called email, ip, card, phone or terms are
    replaced; all others, whatever their names, pass through.
    """
    columns = [c for c in docs.columns if c not in ("text", *KINDS, "terms")]
    found = _all_spans(docs.select("doc_id", "text"), **thresholds)
    own = set_aside(docs.withColumn("text", F.xxhash64("text")), "doc_id", "text").withColumnRenamed("text", "hash")
    return _with_spans(own, found).select(*put_back(columns, doc_id=F.col("doc_id")), *KINDS, "terms")


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with entities replaced by their kind in brackets, removed words by nothing and generalised ones by [TERM].

    Of overlapping spans the first one, and of those the longest, is replaced. Nulls, empty and long texts and repeated rows
    are as in ``spans``; rows of one id and different texts each lose what their own text holds; all columns pass through.
    """
    found = _all_spans(docs.select("doc_id", "text"), **thresholds)
    bracketed = lambda kind: lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("minus_end"), F.lit(f"[{kind.upper()}]").alias("by"))
    parts = F.concat(
        *[F.transform(k, bracketed(k)) for k in KINDS],
        F.transform("terms", lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("minus_end"), F.when(m["action"] == "remove", "").otherwise("[TERM]").alias("by"))),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, p: F.when(p["start"] < acc["at"], acc).otherwise(
        F.struct((-p["minus_end"]).alias("at"), F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, p["start"] - acc["at"]), p["by"])).alias("out"))
    )
    joined = _with_spans(set_aside(docs, "doc_id", "text").withColumn("hash", F.xxhash64("text")), found)
    done = F.aggregate(F.array_sort(parts), zero, step)
    text = F.when(F.size(parts) > 0, F.concat(F.array_join(done["out"], ""), F.substring(F.col("text"), done["at"] + 1, F.length("text")))).otherwise(F.col("text"))
    return joined.select(*put_back(docs.columns, doc_id=F.col("doc_id"), text=text))


def _listed(kind: str, array: Column) -> Column:
    return F.transform(array, lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))


def query(spark, sf_dir):
    """op6_pii."""
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[_listed(k, F.col(k)) for k in KINDS])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _listed("term", F.col("terms"))), ",").alias("spans"), F.size("terms").cast("long").alias("n_terms"),
    )
