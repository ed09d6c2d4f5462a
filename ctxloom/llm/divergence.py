"""Source divergence audit: how far the terms of each source lie from those of every other source of its language, by integer-dictionary encoding.

Each task numbers the words of its documents and counts them as integers, by group and by document; only these counts are shuffled.
The terms of a language that enough documents hold are then dealt by range and numbered in their order; the numbers are cut into
chunks, slices of the sorted dictionary of so many terms that a dense vector for each source fits. In a chunk, the ids of terms are
their places in its sorted array, found by binary search, and a source's vector is a bincount of ids. As ids keep the UTF-8 order,
vectors of all sources line up, absent terms are zeros, and ties go by id. Sums over a chunk are added up by pair; of terms, a chunk
gives its best by source, and these are ranked. All arithmetic is in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.llm._common import input_parts, materialize, table

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Words that a task counts at once, and rows that it hands on at once.
COUNTED, HANDED = 1_000_000, 50_000
#: Numbers of the dense vectors of a chunk, over all sources of the language.
DENSE = 250_000

#: Letters and all bytes beyond ASCII stay, A-Z in lower case; all others become spaces.
_FOLD = bytearray(b" " * 256)
for _lo, _hi in ((0x61, 0x7B), (0x80, 0x100)):
    _FOLD[_lo:_hi] = bytes(range(_lo, _hi))
_FOLD[0x41:0x5B] = bytes(range(0x61, 0x7B))
_FOLD = bytes(_FOLD)


class Numbers(dict):
    """Numbers from 0, in the order of first sight."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _count_words(size: int):
    """(lang, source, term, n, docs) of a task's documents, ``size`` words at a time, and a row with an empty term for every group seen."""

    def counted(words: Numbers, groups: Numbers, ids: list[np.ndarray], owner: list[int]) -> pa.RecordBatch:
        word = np.concatenate([*ids, np.empty(0, np.int64)])
        lengths, by_doc, width = np.array([len(x) for x in ids], np.int64), np.array(owner, np.int64), len(words)
        doc = np.repeat(np.arange(len(ids)), lengths)
        pairs, n = np.unique(by_doc[doc] * width + word, return_counts=True)
        once = np.unique(doc * width + word)
        # The same pairs of group and word, now with a document each.
        docs = np.unique(by_doc[once // max(width, 1)] * width + once % max(width, 1), return_counts=True)[1]
        spelt, names = pa.array([*words, b""], pa.binary()).cast(pa.string()), list(groups)
        group, which = np.concatenate([pairs // max(width, 1), np.arange(len(names))]), np.concatenate([pairs % max(width, 1), np.full(len(names), width)])
        none = np.zeros(len(names), np.int64)
        langs, sources = (pa.array([g[k] for g in names], pa.string()).take(pa.array(group)) for k in (0, 1))
        return pa.RecordBatch.from_arrays([langs, sources, spelt.take(pa.array(which)), pa.array(np.concatenate([n, none])), pa.array(np.concatenate([docs, none]))], names=["lang", "source", "term", "n", "docs"])

    def handed(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield from (rows.slice(k, HANDED) for k in range(0, len(rows), HANDED))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, groups, ids, owner, held = Numbers(), Numbers(), [], [], 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
                found = terms(text.as_py())
                ids.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                owner.append(groups[lang, source])
                held += len(found)
                if held >= size:
                    yield from handed(counted(words, groups, ids, owner))
                    words, groups, ids, owner, held = Numbers(), Numbers(), [], [], 0
        if ids:
            yield from handed(counted(words, groups, ids, owner))

    return count


def _dictionary(min_docs: int):
    """Over rows sorted by language and term: those of kept terms, with the partition and the number of the term in it; ``first`` marks a row a term."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, numbered, rest = TaskContext.get().partitionId(), 0, None

        def kept(rows: pa.Table) -> pa.RecordBatch:
            nonlocal numbered
            begins = np.flatnonzero(_changes(rows))
            docs = np.add.reduceat(rows["docs"].to_numpy(), begins)
            sizes = np.diff(np.append(begins, len(rows)))
            keep = docs >= min_docs
            place = numbered + np.cumsum(keep) - 1
            numbered += int(keep.sum())
            first = np.zeros(len(rows), bool)
            first[begins] = True
            stay = pa.array(np.flatnonzero(np.repeat(keep, sizes)))
            out = rows.select(["lang", "source", "term", "n"]).append_column("part", pa.array(np.full(len(rows), part))).append_column("place", pa.array(np.repeat(place, sizes)))
            return out.append_column("first", pa.array(first)).take(stay)

        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if len(rows):
                last = int(np.flatnonzero(_changes(rows))[-1])  # the last term may go on in the next batch
                rest = rows.slice(last)
                if last:
                    yield from kept(rows.slice(0, last)).to_batches()
        if rest is not None and len(rest):
            yield from kept(rest).to_batches()

    return cut


def _changes(rows: pa.Table) -> np.ndarray:
    """Where another language or term begins."""
    out = np.ones(len(rows), bool)
    if len(rows) > 1:
        differs = [pa.compute.not_equal(c.slice(1), c.slice(0, len(rows) - 1)) for c in (rows["lang"].combine_chunks(), rows["term"].combine_chunks())]
        out[1:] = pa.compute.or_(*differs).to_numpy(zero_copy_only=False)
    return out


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * n / total), by long division in steps of 1,000: exact while total stays under 9 * 10 ** 15."""
    out, rest = n // total, n % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return 1 + out


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _compare(top: int):
    """What a chunk adds to each pair of sources, and its best terms by source."""

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        own = group["term"].is_null()
        totals, rows = group.filter(own), group.filter(pa.compute.invert(own))
        order = sorted(range(len(totals)), key=(names := [s.encode() for s in totals["source"].to_pylist()]).__getitem__)
        sources = np.array([names[k] for k in order], dtype=object)
        n, v = totals["n"].to_numpy()[order], totals["v"].to_numpy()[0]
        spelt = rows["term"].cast(pa.binary()).to_pylist()
        kept = np.empty(len(found := sorted(set(spelt))), dtype=object)
        kept[:] = found
        ids = np.searchsorted(kept, np.array(spelt, dtype=object))
        owner = np.searchsorted(sources, np.array([s.encode() for s in rows["source"].to_pylist()], dtype=object))
        # A cell is filled by one row: counts under 2 ** 53 come through as they are.
        count = np.bincount(owner * len(kept) + ids, weights=rows["n"].to_numpy(), minlength=len(sources) * len(kept)).astype(np.int64).reshape(len(sources), len(kept))
        p, every = share(count + 1, (n + v)[:, None]), share(count.sum(0) + 1, n.sum() + v)
        out = {"source": [], "part": [], "item": [], "value": []}
        for s, name in enumerate(sources):
            value = apart(p[s], p).sum(1)
            others = [t for t in range(len(sources)) if t != s]
            above = np.flatnonzero((count[s] > 0) & (p[s] > every))
            far = apart(p[s][above], every[above])
            best = np.lexsort((above, -far))[:top]
            out["source"] += [name] * (len(others) + len(best))
            out["part"] += ["pair"] * len(others) + ["term"] * len(best)
            out["item"] += [*sources[others], *kept[above[best]]]
            out["value"] += [*value[others].tolist(), *far[best].tolist()]
        text = lambda c: pa.array(out[c], pa.binary()).cast(pa.string())
        return pa.table([pa.array([key[0].as_py()] * len(out["value"]), pa.string()), text("source"), pa.array(out["part"], pa.string()), text("item"), pa.array(out["value"], pa.int64())], names=["lang", "source", "part", "item", "value"])

    return compare


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, counted: int = COUNTED) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: how far each other source of the language lies from the source, over
    all kept terms; part ``term``: the ``top`` terms by which the source exceeds its language.

    Null texts, languages and sources count as empty; an empty text has no terms, and its group counts all the same; texts of any
    length are read whole, and a term may be as long as a text; repeated rows count each; ties go by UTF-8 order of the item; a
    language without kept terms has pairs of value 0; a source that is alone in its language has no pairs; of an empty table there
    are no rows. Other columns, whatever their names, play no part.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    seen = read.mapInArrow(_count_words(counted), "lang string, source string, term string, n long, docs long")
    counts = materialize(seen.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    groups = counts.where("term = ''").select("lang", "source")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    dealt = counts.where("term != ''").repartitionByRange(input_parts(counts), "lang", "term").sortWithinPartitions("lang", "term")
    placed = materialize(dealt.mapInArrow(_dictionary(min_docs), "lang string, source string, term string, n long, part long, place long, first boolean"))
    # The id of a term in its language: its number in the partition, after all terms of the partitions before.
    slices = placed.where("first").groupBy("lang", "part").agg(F.count(F.lit(1)).alias("terms"), F.min("place").alias("least"))
    before = F.coalesce(F.sum("terms").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.select("lang", "part", (before - F.col("least")).alias("shift"))
    chunk = F.floor((F.col("place") + F.col("shift")) / max(1, DENSE // most))
    kept = materialize(placed.join(slices, ["lang", "part"]).select("lang", "source", "term", "n", chunk.alias("chunk"), "first"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = kept.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = materialize(groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["n", "v"]))
    # Each chunk also takes the totals of all sources of its language.
    heads = kept.select("lang", "chunk").distinct().join(totals, "lang").select("lang", "source", F.lit(None).cast("string").alias("term"), "n", "chunk", "v")
    rows = kept.select("lang", "source", "term", "n", "chunk", F.lit(None).cast("long").alias("v")).unionByName(heads)
    found = materialize(rows.groupBy("lang", "chunk").applyInArrow(_compare(top), "lang string, source string, part string, item string, value long"))
    none = totals.where("v = 0")
    idle = none.join(none.select("lang", F.col("source").alias("item")), "lang").where("source != item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(idle)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(found.where("part = 'term'"), "term").where(F.col("rank") <= top))


def query(spark, sf_dir):
    """op11_divergence."""
    return audit(table(spark, sf_dir, "documents"))


#: DuckDB over whole tables.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
t AS (SELECT lang, source, coalesce(s.n, 0) AS n, coalesce(v.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source) LEFT JOIN v USING (lang)),
x AS (SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (t.n + t.v) AS p FROM t JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, 1 + (1000000000 * (sum(c.n) + 1)) // (any_value(a.n) + any_value(v.v)) AS q FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS n FROM c GROUP BY lang) a USING (lang) GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
p AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM t a JOIN t b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
e AS (SELECT x.lang, x.source, 'term' AS part, x.term AS item, (p - q) * (p - q) // q AS value FROM x JOIN l USING (lang, term) WHERE x.n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM p UNION ALL SELECT * FROM e))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
