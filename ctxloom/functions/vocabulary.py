"""Word lists, patterns and constants that results depend on, in plain form."""

# A token of lexical search, in lower-cased text.
SEARCH_TOKEN = "[a-z0-9.]+"

# Words too common to be entities.
COMMON_WORDS = (
    "the", "and", "for", "that", "this", "with", "from", "have", "been", "shall", "will", "would", "could", "should", "such", "each", "upon",
    "into", "under", "between", "through", "during", "before", "after", "other", "more", "most", "some", "only", "also", "than", "very",
)

# Words that the overlap test for entailment ignores.
ENTAILMENT_STOPWORDS = ("the", "and", "or", "of", "to", "a", "an", "in", "is", "are", "for", "on", "with", "by", "from")

# Cross-references.
REFERENCE_PATTERNS = (
    r"(?:subject to|pursuant to|as (?:defined|described|set forth) in|see|under|per|notwithstanding|except as (?:provided|set forth|described) in|without limiting"
    r"|provided,? however,? (?:that )?(?:pursuant to|under)|in accordance with|as set forth in|as specified in|in addition to)\s+(?:Section|Article|Exhibit|Schedule|Appendix)\s+[\dIVXLCA-Z]+(?:\.\d+)*",
    r"Section\s+\d+(?:\.\d+)*",
    r"Article\s+[IVXLC]+",
    r"Exhibit\s+[A-Z]",
    r"Schedule\s+\d+",
    r"Appendix\s+[A-Z]",
    r"\bherein\b|\bhereinafter\b|\bhereunder\b",
)
#: For each of them words of which a match has one.
REFERENCE_WORDS = (("section", "article", "exhibit", "schedule", "appendix"), ("section",), ("article",), ("exhibit",), ("schedule",), ("appendix",), ("herein", "hereunder"))
QUERY_REFERENCE_PATTERNS = (r"Section\s+\d+(?:\.\d+)*", r"Article\s+[IVXLC]+", r"Exhibit\s+[A-Z]", r"Schedule\s+\d+", r"Appendix\s+[A-Z]")
DEFINITION_PATTERN = r'"([^"]{3,50})"\s+(?:means|shall mean|refers to|is defined as)'
LOOSE_DEFINITION_PATTERN = r'"([^"]+)"\s+(?:means|shall\s+mean)'
SECTION_ID_PATTERNS = (r"(?i)ARTICLE\s+([IVXLC]+)", r"(?i)Section\s+(\d+(?:\.\d+)*)", r"(?m)^(\d+(?:\.\d+)*)\.\s")

# Where sections begin, in order of priority, for chunks of general and of contract texts.
SECTION_BREAKS = (
    r"\n(?=ARTICLE\s+[IVXLC]+\.?\s)", r"\n(?=Section\s+\d+(?:\.\d+)*\.?\s)", r"\n(?=\d+\.\d+\.?\s+[A-Z])", r"\n(?=\d+\.\s+[A-Z][A-Z\s]+)", r"\n(?=[A-Z][A-Z\s]{10,}(?:\n|\.))",
)
CONTRACT_BREAKS = (r"\n(?=ARTICLE\s+[IVXLC]+\.?)", r"\n(?=Section\s+\d+\.)", r"\n(?=\d+\.\s+[A-Z][A-Z\s]+)", r"\n(?=[A-Z][A-Z\s]{10,}(?:\n|\.))")

# Phrases that qualify or override, each with a word that it has.
QUALIFIERS = {
    r"\bnotwithstanding\s+(?:the\s+)?(?:foregoing|above|anything)": "notwithstanding", r"\bsubject\s+to\b": "subject", r"\bexcept\s+as\s+(?:provided|set forth|described|otherwise)": "except",
    r"\bunless\s+otherwise\s+(?:specified|agreed|provided|stated)": "unless", r"\bprovided,?\s+however\b": "however", r"\bnotwithstanding\b": "notwithstanding", r"\bexcluding\b": "excluding",
    r"\bin\s+no\s+event\s+shall\b": "event", r"\bto\s+the\s+extent\s+(?:that|permitted)\b": "extent",
}
OVERRIDE_PATTERNS = (r"\bnotwithstanding\b", r"\bexcept\s+as\b", r"\bsubject\s+to\b", r"\bprovided\s+however\b", r"\bunless\s+otherwise\b")

# What a contract says on each trap.
OVERRIDE_SENTENCE = r"(?is)([^.]{0,80}(?:notwithstanding|except as|subject to)[^.]{0,200}\.)"
#: The phrases of such a sentence, and how many of the signs before its end it can hold at most: 80, a phrase and 200.
OVERRIDE_PHRASES, OVERRIDE_REACH = ("notwithstanding", "except as", "subject to"), 300
CLAUSE_SECTION = r"[Ss]ection\s+\d+(?:\.\d+)*(?:\([a-z]\))?"
PLACEHOLDER_TERMS = ("[***]", "including", "1", "to the extent")
DEFINITION_SENTENCES = (('"', r'"\s+(?:means|shall\s+mean)\s+([^.]{0,300}\.)'), (r"(?iU)\b", r"\b\s+(?:means|shall\s+mean)\s+([^.]{0,300}\.)"))
SCATTERED_SECTION = r"(?iU)\b(?:Section|Article)\s+(\d+(?:\.\d+)*(?:\([a-z]\))?)"

# The vocabulary of queries.
YES_NO_STARTS = ("does ", "is ", "are ", "can ", "will ")
COMPOUND_TERMS = (
    "non-compete", "non-disclosure", "non-solicitation", "non-exclusive", "intellectual property", "good faith", "best efforts", "force majeure", "governing law",
    "confidentiality agreement", "material breach", "termination rights", "indemnification clause", "liability cap",
)
QUERY_STOPWORDS = (
    "the", "and", "or", "of", "to", "a", "an", "in", "is", "are", "for", "on", "with", "by", "from", "this", "that", "these", "those", "it", "its", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "not", "no", "yes", "what", "which", "who",
    "whom", "how", "when", "where", "why", "if", "then", "so", "than", "too", "very", "just", "also", "more", "most", "some", "any", "all", "each", "every", "both",
    "few", "many", "much", "such", "own", "same", "other", "explain", "describe", "tell", "show", "give", "provide", "list", "define", "discuss", "analyze", "compare",
    "contrast", "identify", "find", "get", "make", "help", "need", "want", "know", "understand", "connection", "relationship", "thing", "things", "way", "ways", "type",
    "types", "kind", "kinds", "form", "forms", "part", "parts", "example", "examples", "case", "cases", "use", "uses", "time", "times", "information", "details", "data",
    "stuff", "item", "items", "common", "main", "major", "minor", "different", "various", "certain", "specific", "general", "overall", "key", "important", "relevant",
    "their", "your", "our", "my", "his", "her", "them", "us", "outlined", "stated", "described", "mentioned", "specified",
)
RELATION_WORDS = (
    "associated", "linked", "related", "connected", "correlated", "affects", "causes", "leads", "influences", "impacts", "higher", "lower", "increased", "decreased", "between",
)
QUERY_CLAUSES = {
    "termination": ("termination", "terminate", "expiration"),
    "indemnification": ("indemnification", "indemnify", "indemnity"),
    "liability": ("liability", "damages", "cap"),
    "confidentiality": ("confidential", "confidentiality", "secret"),
    "ip_rights": ("intellectual property", "patent", "copyright", "trademark"),
    "non_compete": ("non-compete", "non-solicitation", "restrictive"),
    "warranty": ("warranty", "warranties", "representation"),
    "survival": ("survival", "survive", "surviving"),
    "payment": ("payment", "compensation", "fee", "royalty"),
}
CLAUSE_KEYWORDS = {
    "termination": ("termination", "terminate", "expiration", "expire", "renewal"),
    "indemnification": ("indemnification", "indemnify", "hold harmless", "indemnities"),
    "liability": ("liability", "liable", "damages", "consequential", "limitation of liability"),
    "confidentiality": ("confidential", "confidentiality", "proprietary", "non-disclosure", "nda"),
    "ip_rights": ("intellectual property", "patent", "copyright", "trademark", "trade secret"),
    "payment": ("payment", "fee", "royalty", "compensation", "invoice", "remittance"),
    "governing_law": ("governing law", "jurisdiction", "venue", "applicable law"),
    "assignment": ("assignment", "assign", "sublicense", "transfer"),
    "non_compete": ("non-compete", "non compete", "exclusivity", "exclusive", "restrictive covenant"),
    "dispute_resolution": ("arbitration", "mediation", "dispute", "resolution", "litigation"),
    "warranty": ("warranty", "warranties", "warrant", "representation"),
    "force_majeure": ("force majeure", "act of god", "unforeseeable"),
    "insurance": ("insurance", "insure", "coverage", "policy"),
}

# Weights of an edge, and of the parts of the sufficiency score.
EDGE_WEIGHTS = {"cross_ref": 0.4, "entity_overlap": 0.35, "same_source": 0.2, "semantic": 0.3, "adjacency": 0.25}
EDGE_SHARED_ENTITIES, SEMANTIC_FROM, EDGE_LEAST, ENTITY_IDF = 3, 0.5, 0.15, 1.0
CSS_WEIGHTS = {"query_relevance": 3.0, "subquery_coverage": 3.0, "context_cohesion": 1.5, "graph_connectivity": 1.0, "coverage": 0.5, "token_efficiency": 0.5, "redundancy": -1.5}
TOKEN_BUDGET, PAIR_WINDOW, PAIR_CAP, NEAR_DUPLICATE = 2000, 10, 50, 0.9
GATE_WEIGHTS = {"token_efficiency": 0.20, "specificity": 0.25, "non_redundancy": 0.30, "query_relevance": 0.25}
