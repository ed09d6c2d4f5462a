"""Text functions as column expressions: tokens, entities, references, signals of specificity, clause vocabulary.

Python's word boundaries and classes know Unicode; Java's need ``(?U)``, so patterns with ``\\b`` or ``\\w`` carry it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxloom.functions import vocabulary as V


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def once(value: Column, use) -> Column:
    """``use`` of a value that is made once, however often it is looked at: a lambda's other expressions are made anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: White space of any kind; Python's strip takes four control signs for it besides.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: A sign that hardly any text holds.
_MARK = "\u0001"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.trim(text, F.lit(SPACES))


def python_strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES + "\x1c\x1d\x1e\x1f"))


def split(text: Column, pattern: str) -> Column:
    """What stands between the matches of a pattern, of a sign at least. A split compiles its pattern for each row, a replacement but once: so
    matches become a mark first, where the text has none."""
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, F.lit(pattern), -1)).otherwise(F.split(F.regexp_replace(text, F.lit(pattern), F.lit(_MARK)), F.lit(_MARK), -1))


def may_hold(text: Column, low: Column, words: tuple[str, ...]) -> Column:
    """Whether a text, in lower case ``low``, may match a pattern for which it needs one of some ASCII words: by ``contains``, and true where it
    holds a letter that only matches i or s without regard to case."""
    return reduce(lambda a, b: a | b, [*[F.contains(low, F.lit(w)) for w in words], *[F.contains(text, F.lit(c)) for c in "\u017f\u0131\u0130"]])


def padded(n: Column, width: int) -> Column:
    """A whole number with zeros before it, whole where it is longer."""
    return F.when(n.between(0, 10 ** (width - 1) - 1), F.lpad(n.cast("string"), width, "0")).otherwise(F.format_string(f"%0{width}d", n))


def clamp(value: Column) -> Column:
    """Between 0 and 1; NaN, which Spark holds to be greatest, is 0."""
    return F.when(F.isnan(value), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def token_set(text: Column) -> Column:
    """Distinct runs of ASCII letters, lower-cased, in order of first occurrence."""
    return F.array_distinct(F.transform(_all(text, "[A-Za-z]+"), F.lower))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[A-Za-z]+")), F.lit(0))


def approximate_tokens(text: Column) -> Column:
    """Words times 1.3, cut to an integer."""
    return F.floor(F.regexp_count(text, F.lit(r"(?U)\b\w+\b")) * F.lit(1.3)).cast("int")


def search_tokens(text: Column) -> Column:
    """The tokens of lexical search, repeated ones too."""
    return _all(F.lower(text), V.SEARCH_TOKEN)


def terms(text: Column) -> Column:
    """Distinct words of four ASCII letters or more that are no stop words: what document frequencies are taken over."""
    return F.array_except(F.array_distinct(_all(F.lower(text), r"(?U)\b[a-z]{4,}\b")), F.array(*map(F.lit, V.COMMON_WORDS)))


def entities(text: Column) -> Column:
    """Candidate entities: capitalised phrases of several words, lower-cased, and the terms."""
    phrases = F.transform(_all(text, r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"), F.lower)
    return F.array_union(F.array_distinct(phrases), terms(text))


def section_references(text: Column) -> Column:
    """References of all kinds, lower-cased, each once. A pattern is tried only where a word stands that it cannot do without."""
    none = F.array().cast("array<string>")

    def found(x: Column) -> Column:
        may = [reduce(lambda a, b: a | b, [F.contains(x["low"], F.lit(w)) for w in ws]) for ws in V.REFERENCE_WORDS]
        every = [F.when(m, _all(x["text"], "(?iU)" + p)).otherwise(none) for m, p in zip(may, V.REFERENCE_PATTERNS, strict=True)]
        return F.array_distinct(F.transform(F.flatten(F.array(*every)), F.lower))

    # The letters that match i and s in any case are folded.
    both = F.struct(text.alias("text"), F.lower(F.translate(text, "\u017f\u0131\u0130", "sii")).alias("low"))
    return F.when(text.isNotNull(), once(both, found))


def defined_terms(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, "(?i)" + V.DEFINITION_PATTERN, 1), F.lower))


def section_id(text: Column) -> Column:
    """The first of three forms of section number; null without one."""
    return reduce(lambda a, b: F.coalesce(a, b), [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in V.SECTION_ID_PATTERNS])


def chunk_index(chunk_id: Column) -> Column:
    """The number after the last ``chunk_``; null without one."""
    return F.nullif(F.regexp_extract(chunk_id, r"^.*chunk_(\d+)", 1), F.lit("")).cast("int")


def base_document(chunk_id: Column, source: Column | None = None) -> Column:
    """What stands before the last ``_chunk_``; else the source, else the id."""
    found = F.nullif(F.regexp_extract(chunk_id, r"^(.*)_chunk_", 1), F.lit(""))
    return F.coalesce(found, source, chunk_id) if source is not None else F.coalesce(found, chunk_id)


def fingerprint(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def _capped(text: Column, pattern: str, most: int, weight: int) -> Column:
    return F.least(F.lit(most), F.regexp_count(text, F.lit(pattern))) * weight


def _signals(text: Column, hours: bool) -> Column:
    units = "days?|months?|years?|weeks?" + ("|hours?" if hours else "")
    return (
        _capped(text, r"(?U)\b\d+(?:\.\d+)?%?\b", 5, 1) + _capped(text, r"(?U)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\w+ \d{1,2},? \d{4})\b", 3, 2)
        + _capped(text, r"\$[\d,]+(?:\.\d{2})?", 3, 2) + _capped(text, rf"(?iU)\b\d+\s*(?:{units})\b", 3, 2)
    )


def specificity(text: Column) -> Column:
    """Numbers, dates, amounts and periods, each up to a bound, and length, over 8; 0 for fewer than ten characters."""
    n = word_count(text)
    bonus = F.when(n >= 20, 2).when(n >= 10, 1).otherwise(0)
    score = F.least(F.lit(1.0), (_signals(text, True) + bonus) / 8.0)
    return F.when(text.isNull() | (F.length(strip(text)) < 10), 0.0).otherwise(score)


def answer_specificity(text: Column) -> Column:
    """The same signals without hours and length, over 10."""
    return F.coalesce(F.least(F.lit(1.0), _signals(text, False) / 10.0), F.lit(0.0))


def length_band(text: Column) -> Column:
    """How far a text is long enough to be of use: bands at 5, 15 and 30 words."""
    n = word_count(text)
    return F.when(n < 5, 0.0).when(n < 15, 0.3).when(n < 30, 0.6).otherwise(1.0)


def keyword_share(text: Column, keywords: Column) -> Column:
    """The share of keywords that the text contains, in any case; 1 without keywords."""
    found = once(F.lower(text), lambda low: F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k)))))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(found / F.size(keywords))


def unit_covered(answer: Column, unit: Column) -> Column:
    """True if at least 60% of the unit's words of over three characters stand in the answer; also if it has none."""
    needed = F.filter(words(F.lower(unit)), lambda w: F.length(w) > 3)
    both = F.struct(F.lower(answer).alias("low"), needed.alias("needed"))
    return once(both, lambda x: (F.size(x["needed"]) == 0) | (F.size(F.filter(x["needed"], lambda w: F.contains(x["low"], w))) >= 0.6 * F.size(x["needed"])))


def needed_words(query: Column) -> Column:
    """The query's words of over three characters, punctuation and all, each once. They hold no white space, so what stands in texts that a
    space joins stands in one of these."""
    return F.array_distinct(F.filter(words(F.lower(query)), lambda w: F.length(w) > 3))


def query_coverage(text: Column, query: Column) -> Column:
    """The share of the query's words of over three characters, punctuation and all, that stand in the text; 1 without any."""
    both = F.struct(F.lower(text).alias("low"), needed_words(query).alias("needed"))
    return once(both, lambda x: F.when(F.size(x["needed"]) == 0, 1.0).otherwise(F.size(F.filter(x["needed"], lambda w: F.contains(x["low"], w))) / F.size(x["needed"])))


def clause_types(text: Column, vocabulary: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Names of the clause types of which the text has a keyword, in the vocabulary's order."""
    low = F.lower(text)
    named = [F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keys]), F.lit(name)) for name, keys in (vocabulary or V.QUERY_CLAUSES).items()]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def intent(query: Column) -> Column:
    low = F.lower(query)
    starts = reduce(lambda a, b: a | b, [low.startswith(s) for s in V.YES_NO_STARTS])
    return (
        F.when(starts, "yes_no").when(low.contains(" and ") | low.contains(" or "), "multi_hop_factual").when(low.contains("what is") | low.contains("define"), "definition")
        .when(low.contains("compare") | low.contains("difference"), "comparison").otherwise("factual")
    )


def query_nouns(query: Column) -> Column:
    """Words of over two letters, hyphens kept, that are no stop words; in order, each once."""
    found = F.transform(_all(query, "[A-Za-z]+(?:-[A-Za-z]+)*"), F.lower)
    return F.array_distinct(F.filter(F.array_except(found, F.array(*map(F.lit, V.QUERY_STOPWORDS))), lambda w: F.length(w) > 2))


def query_entities(query: Column) -> Column:
    """Section references, compound terms (sorted) and nouns, each once."""
    low = F.lower(query)
    compounds = F.filter(F.array(*[F.lit(c) for c in sorted(V.COMPOUND_TERMS)]), lambda c: F.contains(low, c))
    references = F.flatten(F.array(*[_all(query, "(?i)" + p) for p in V.QUERY_REFERENCE_PATTERNS]))
    return F.array_distinct(F.concat(references, compounds, query_nouns(query)))


def relations(query: Column) -> Column:
    """Array of (e1, relation, e2): for each pair of the query's first six entities the first relation word of the query, in the order of the word list."""
    low = F.lower(query)
    word = F.get(F.filter(F.array(*map(F.lit, sorted(V.RELATION_WORDS))), lambda w: F.contains(low, w)), F.lit(0))
    e = F.filter(F.slice(query_entities(query), 1, 6), lambda x: F.contains(low, F.lower(x)))
    pairs = F.flatten(F.transform(e, lambda x, i: F.transform(F.slice(e, i + 2, 6), lambda y: F.struct(x.alias("e1"), word.alias("relation"), y.alias("e2")))))
    return F.when(word.isNotNull(), pairs).otherwise(F.array().cast("array<struct<e1:string,relation:string,e2:string>>"))


def subqueries(query: Column) -> Column:
    """A question for each of the first five entities and of the first three relations, and the query itself."""
    named = F.transform(F.slice(query_entities(query), 1, 5), lambda e: F.concat(F.lit("What is "), e, F.lit("?")))
    linked = F.transform(F.slice(relations(query), 1, 3), lambda r: F.concat(F.lit("How is "), r["e1"], F.lit(" "), r["relation"], F.lit(" to "), r["e2"], F.lit("?")))
    return F.concat(named, linked, F.when(strip(query) != "", F.array(strip(query))).otherwise(F.array().cast("array<string>")))


#: Matches whose places are summed at once: a growing array is copied at each step of a fold.
_AT_ONCE = 64


def places(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all matches of a pattern, leftmost and not overlapping; in code points, ends exclusive.

    Between the pieces that a split leaves stand the matches, so places are sums of lengths: within groups of matches first, then
    over the groups.
    """
    kind = "array<struct<start:int,end:int,match:string>>"
    moved = lambda m, by: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["match"].alias("match"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        one = F.struct(start.alias("start"), (start + F.length(x["match"])).alias("end"), x["match"].alias("match"))
        return F.struct(one["end"].alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def join(acc: Column, group: Column) -> Column:
        return F.struct((acc["at"] + group["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(group["out"], lambda m: moved(m, acc["at"])))).alias("out"))

    def placed(pairs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _AT_ONCE).cast("int")), lambda k: F.aggregate(F.slice(pairs, k * _AT_ONCE + 1, _AT_ONCE), zero, add))
        every = F.aggregate(groups, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), join)
        return F.when(F.size(pairs) > 0, F.flatten(every["out"])).otherwise(F.array().cast(kind))

    def paired(found: Column) -> Column:
        def one(start: Column) -> Column:
            match = F.get(found, F.lit(0))
            return F.array(F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match")))

        # Most texts have one match, if any. It begins where its like stands, if nothing else is like it, or where the first piece ends.
        like = lambda at: F.when(F.position(F.get(found, F.lit(0)), text, at + 1) == 0, at - 1).otherwise(F.length(F.get(split(text, pattern), F.lit(0))))
        single = once(once(F.position(F.get(found, F.lit(0)), text, F.lit(1)), like), one)
        pieces = F.slice(split(text, pattern), 1, F.size(found))
        many = once(F.zip_with(pieces, found, lambda p, m: F.struct(p.alias("piece"), m.alias("match"))), placed)
        return F.when(F.size(found) == 0, F.array().cast(kind)).when(F.size(found) == 1, single).otherwise(many)

    return once(_all(text, pattern), paired)


def contexts(text: Column, pattern: str, before: int, after: int) -> Column:
    """Array of (match, context): all matches, with so many code points before and after each, whatever else stands there."""

    def around(m: Column) -> Column:
        start = F.greatest(m["start"] - before, F.lit(0))
        return F.struct(m["match"].alias("match"), F.substring(text, start + 1, m["end"] + after - start).alias("context"))

    return F.transform(places(text, pattern), around)


def contradiction_flags(text: Column) -> Column:
    """Array of (indicator, snippet): qualifying phrases with up to 30 characters before and 50 after them."""
    none = F.array().cast("array<struct<match:string,context:string>>")

    def found(x: Column) -> Column:
        # A pattern is tried only where a word stands that it cannot do without.
        every = [F.when(x["odd"] | F.contains(x["low"], F.lit(w)), contexts(x["text"], f"(?iU){p}", 30, 50)).otherwise(none) for p, w in V.QUALIFIERS.items()]
        return F.transform(F.flatten(F.array(*every)), lambda f: F.struct(f["match"].alias("indicator"), strip(f["context"]).alias("snippet")))

    return F.when(text.isNotNull(), once(F.struct(text.alias("text"), F.lower(text).alias("low"), may_hold(text, F.lower(text), ()).alias("odd")), found))


def trap_scores(text: Column) -> dict[str, Column]:
    """Counts of override phrases (a), definitions (b) and section references (c), and their weighted total."""
    low = F.lower(text)
    a = reduce(lambda x, y: x + y, [F.regexp_count(low, F.lit("(?U)" + p)) for p in V.OVERRIDE_PATTERNS])
    defined = F.least(F.size(F.array_distinct(_all(text, "(?i)" + V.LOOSE_DEFINITION_PATTERN, 1))), F.lit(15))
    openings = F.regexp_count(low, F.lit(r"(?U)\b(?:article\s+1|section\s+1\.\d+)"))
    b = F.when((openings > 5) & (defined < openings), F.greatest(defined, F.least(openings, F.lit(30)))).otherwise(defined)
    sections = F.size(F.array_distinct(_all(low, r"(?U)\bsection\s+\d+(?:\.\d+)*(?:\([a-z]\))?")))
    c = F.least(F.floor(sections / 3).cast("int"), F.lit(20))
    return {"trap_a_count": a, "trap_b_count": b, "trap_c_count": c, "trap_c_sections": sections, "total_score": a * 2 + b * F.lit(1.5) + c}


def short_id(name: Column, width: int = 15) -> Column:
    return F.substring(F.lower(F.regexp_replace(F.substring(name, 1, 40), "[^A-Za-z0-9]", "_")), 1, width)
