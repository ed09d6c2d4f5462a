"""Line dedup by winnowing over line hashes, in DataFrame operations only.

The lines of a document that are not blank are hashed. In each window of ``min_lines`` consecutive lines the least hash is
selected as a fingerprint, so two equal runs of that many lines always share one; a line of ``min_words`` words or more is a
window by itself. A selected line is one row, however many windows chose it. Fingerprints found in one place only are dropped;
those of the others are extended both ways, to the windows around them, and each window is joined with the first place where
the same lines stand. As neighbouring windows overlap, a match reaches as far as the lines agree, and all but the first of the
repeated runs are deleted. Lines are compared by 128 bits of hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.llm._common import discard, materialize, once, put_back, set_aside, table

MIN_LINES = 2
MIN_WORDS = 5
#: What parts words: all Unicode white space.
_SPACE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _selected(lines: Column, h1: Column, h2: Column, min_lines: int, min_words: int) -> Column:
    """Array of (fp: fingerprint, n: the number of its line, start: the number of the first window that selected it, keys: 128 bits
    of each of these windows, own: 128 bits of the line if it is long enough to be a window). Numbers count lines that are not blank."""
    n = F.size(h1)
    key = lambda k, width: F.array(F.xxhash64(F.slice(h1, k + 1, width)), F.xxhash64(F.slice(h2, k + 1, width)))
    least = lambda k: k + F.array_position(F.slice(h1, k + 1, min_lines), F.array_min(F.slice(h1, k + 1, min_lines))) - 1
    worded = f"^[{_SPACE}]*+[^{_SPACE}]++(?:[{_SPACE}]++[^{_SPACE}]++){{{max(min_words - 1, 0)}}}"

    def select(line: Column, k: Column) -> Column:
        lo, hi = F.greatest(k - (min_lines - 1), F.lit(0)), F.least(k, n - min_lines)
        around = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        mine = F.filter(around, lambda w: least(w) == k)  # they follow each other
        long = line.rlike(worded)
        return F.struct(F.get(h1, k).alias("fp"), k.alias("n"), F.get(mine, F.lit(0)).alias("start"), F.flatten(F.transform(mine, lambda w: key(w, min_lines))).alias("keys"), F.when(long, key(k, 1)).alias("own"))

    return F.filter(F.transform(lines, select), lambda x: (F.size(x["keys"]) > 0) | x["own"].isNotNull())


def _lines(text: Column) -> Column:
    """The lines that are not blank."""
    return F.filter(F.split(text, "\n", -1), lambda line: F.trim(line) != "")


def removed_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, hash, removed): for each document with any, the numbers of its deleted lines among those that are not blank; hash is that of its text."""
    lined = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("hash"), "text")
    hashed = once(once(lined, lines=_lines(F.col("text"))).drop("text"), h1=F.transform("lines", lambda x: F.xxhash64(x)), h2=F.transform("lines", lambda x: F.xxhash64(F.lit(7), x)))
    prints = materialize(hashed.select("doc_id", "hash", F.inline(_selected(F.col("lines"), F.col("h1"), F.col("h2"), min_lines, min_words))))
    # What is joined back is written first: then both sides are shuffled for the join, and a frequent key can be split among tasks.
    # The joins are alike at every size: a side that is small enough to be sent today grows with the input.
    place = F.struct("doc_id", "hash", "n")
    shared = materialize(prints.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("fp"))
    kept = prints.join(shared.hint("merge"), "fp", "left_semi")
    # The match extends from the fingerprint to the windows around it.
    both = F.transform(F.sequence(F.lit(0), (F.size("keys") / 2 - 1).cast("int")), lambda k: F.struct((F.col("start") + k).cast("int").alias("start"), F.lit(min_lines).alias("width"), F.get("keys", (2 * k).cast("int")).alias("k1"), F.get("keys", (2 * k + 1).cast("int")).alias("k2")))
    own = F.array(F.struct(F.col("n").alias("start"), F.lit(1).alias("width"), F.get("own", F.lit(0)).alias("k1"), F.get("own", F.lit(1)).alias("k2")))
    none = F.array().cast("array<struct<start:int,width:int,k1:bigint,k2:bigint>>")
    windows = F.concat(F.when(F.size("keys") > 0, both).otherwise(none), F.when(F.col("own").isNotNull(), own).otherwise(none))
    found = materialize(kept.select("doc_id", "hash", F.inline(windows)))
    here = F.struct("doc_id", "hash", "start")
    first = materialize(found.groupBy("k1", "k2").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    later = found.join(first.hint("merge"), ["k1", "k2"]).where(here != F.col("first"))
    # A second row of the same id and text stands in the same place: such rows are one document, and all of them stay.
    gone = later.select("doc_id", "hash", F.explode(F.sequence("start", F.col("start") + F.col("width") - 1)).alias("line"))
    out = materialize(gone.groupBy("doc_id", "hash").agg(F.collect_set("line").alias("removed")))
    discard(prints, shared, found, first)
    return out


def _cut(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """doc_id, text (without its repeated runs), rest (all other columns), lines and removed (their numbers before, and deleted)."""
    gone = removed_lines(docs.select("doc_id", "text"), min_lines, min_words).withColumnRenamed("doc_id", "id")
    own = set_aside(docs, "doc_id", "text")
    joined = own.join(gone.hint("merge"), F.xxhash64("text").eqNullSafe(F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    # Arrays that are looked into line by line are made once.
    cut = once(joined.select("doc_id", "text", "rest", "removed"), parts=F.split("text", "\n", -1))
    numbers = F.when(F.col("removed").isNotNull(), F.sequence(F.lit(0), F.size("parts") - 1))
    cut = once(cut, at=F.filter(numbers, lambda i: F.trim(F.get("parts", i)) != ""))
    cut = once(cut, left=F.array_except(numbers, F.transform("removed", lambda k: F.get("at", k))))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform("left", lambda i: F.get("parts", i)), "\n"))
    counts = F.when(F.col("text").isNull(), 0).otherwise(F.size("parts")).cast("long"), F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    return cut.select("doc_id", text.alias("text"), "rest", counts[0].alias("lines"), counts[1].alias("removed"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated runs deleted from ``text``; adds ``_lines`` and ``_removed``, the numbers of lines before and deleted.

    A line is deleted if it lies in a run of at least ``min_lines`` lines, or is a line of ``min_words`` words or more (by any white space), that
    stands earlier: in a document of smaller id, or further up. Blank lines (empty or of spaces) are no part of runs and always
    stay. Null text stays null with 0 lines; an empty text is one blank line; very long texts are taken whole; rows that share
    id and text count as one document; rows with null ids come first; an empty table stays empty. Other columns, whatever their
    names, pass through, but for ``_lines`` and ``_removed``, which are replaced.
    """
    columns = [c for c in docs.columns if c not in ("_lines", "_removed")]
    out = _cut(docs, min_lines, min_words)
    return out.select(*put_back(columns, doc_id=F.col("doc_id"), text=F.col("text")), F.col("lines").alias("_lines"), F.col("removed").alias("_removed"))


def without_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated runs deleted, as ``dedup_lines`` does; all columns are kept, and there are no more.

    Documents that lose all their lines go; a column ``n_chars`` is set to the new length where the text has changed.
    """
    out = _cut(docs, min_lines, min_words).where(F.col("removed").eqNullSafe(0) | F.col("text").rlike(r"\S"))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        own["n_chars"] = F.when(F.col("removed") > 0, F.length("text").cast(kind)).otherwise(F.col("rest").getField("n_chars"))
    return out.select(*put_back(docs.columns, **own))


def query(spark, sf_dir):
    """op5_line_dedup."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: DuckDB over whole tables, with the windows' texts in place of hashes (ids of documents are unique there).
ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, pos, line, lead(pos) OVER o AS pos2, lead(line) OVER o AS line2 FROM l WHERE trim(line, ' ') <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
w AS (SELECT doc_id, pos, line || chr(10) || line2 AS k, [pos, pos2] AS covers FROM s WHERE pos2 IS NOT NULL
UNION ALL SELECT doc_id, pos, line, [pos] FROM s WHERE regexp_matches(line, '^[SPACE]*[^SPACE]+([SPACE]+[^SPACE]+){4}')),
f AS (SELECT k, min((doc_id, pos)) AS first FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT DISTINCT doc_id, unnest(covers) AS pos FROM w JOIN f USING (k) WHERE (doc_id, pos) <> first),
g AS (SELECT doc_id, count(*) AS n_lines, count(r.pos) AS n_removed, string_agg(CASE WHEN r.pos IS NULL THEN line END, chr(10) ORDER BY pos) AS kept FROM l LEFT JOIN r USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN g USING (doc_id)
""".replace("SPACE", _SPACE)
