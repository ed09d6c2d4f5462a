"""Benchmark decontamination with suffix arrays over shards of the training documents.

Each task tokenises its documents, shard by shard, into word numbers of the benchmark's vocabulary, sorts the suffixes of
the shard that begin like a test suffix (by their first two words) into a suffix array, and finds every test suffix, as far as
its first ten words, in it by binary search. From there a match is followed word by word through the sorted suffixes of the test
items, whose interval narrows until no item goes on: that gives the longest verbatim match, its item and both places. Documents are
never shuffled; what is sent to the tasks is the benchmark, in blocks of a bounded number of words: one block at a time, with a
pass over the documents for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.llm._common import map_in_pandas, materialize, utf8

WINDOW = 10
#: Words of a shard, beyond which it is searched; a document is never split.
SHARD_WORDS = 400_000
#: Words of the benchmark sent to the tasks at once.
BLOCK_WORDS = 400_000

#: Bytes of words stay, A-Z in lower case; all others become spaces.
_FOLD = bytearray(b" " * 256)
for _lo, _hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _FOLD[_lo:_hi] = bytes(range(_lo, _hi))
_FOLD[0x41:0x5B] = bytes(range(0x61, 0x7B))
_FOLD = bytes(_FOLD)


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8."""
    return utf8(text).translate(_FOLD).split()


@dataclass
class TestSet:
    """A block of benchmark items: vocabulary (numbers from 1), and the windows as rows of word numbers, padded with -1."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray  # (distinct windows, WINDOW), sorted by rows
    lengths: np.ndarray
    owners: list[list[str]]  # of each window: the items that have it
    pairs: np.ndarray  # sorted codes of the windows' first two words; a one-word window's word, with 0
    stream: np.ndarray  # all items' words, a -1 after each
    order: np.ndarray  # the places of the stream by the suffixes that begin there
    bounds: np.ndarray  # (windows, 2): the suffixes in that order that begin with the window
    names: list[str]  # of the items, sorted
    origin: np.ndarray  # (stream, 2): of each place the number of its item, and its offset there
    __test__ = False


def test_set(items: list[tuple[object, str | None]], width: int = WINDOW) -> TestSet:
    """Windows of ``width`` consecutive words of each item; a shorter item, but not an empty one, is one window."""
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item_id, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        for at in range(max(1, len(ids) - width + 1)) if ids else ():
            owners.setdefault(tuple(ids[at : at + width]), set()).add(str(item_id))
    rows = sorted(owners)
    stream, origin, names = _stream(items, vocabulary)
    order = suffix_order(stream)
    windows = np.full((len(rows), width), -1, np.int64)
    for k, row in enumerate(rows):
        windows[k, : len(row)] = row
    lengths = np.array([len(r) for r in rows], np.int64)
    pairs = np.unique(np.array([(r[0] << 32) | (r[1] if len(r) > 1 else 0) for r in rows], np.int64))
    padded = np.concatenate([stream, np.full(width, -1, np.int64)])
    bounds = np.stack([_bound(padded, order, windows, lengths, upper) for upper in (False, True)], 1)
    return TestSet(vocabulary, windows, lengths, [sorted(owners[r]) for r in rows], pairs, stream, order, bounds, names, origin)


def _stream(items: list[tuple[object, str | None]], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    names = sorted({str(i) for i, _ in items})
    number = {n: k for k, n in enumerate(names)}
    parts, origin = [], []
    for item_id, text in items:
        ids = [vocabulary[w] for w in words(text)]
        parts.append(np.array([*ids, -1], np.int64))
        origin.append(np.stack([np.full(len(ids) + 1, number[str(item_id)]), np.arange(len(ids) + 1)], 1))
    return np.concatenate([*parts, np.empty(0, np.int64)]), np.concatenate([*origin, np.empty((0, 2), np.int64)]), names


def suffix_order(tokens: np.ndarray) -> np.ndarray:
    """All suffixes of ``tokens``, sorted: by ranks of prefixes that double in length until all differ."""
    n, k = len(tokens), 1
    rank = np.unique(tokens, return_inverse=True)[1] if n else np.empty(0, np.int64)
    while n and k < n and rank.max() < n - 1:
        after = np.concatenate([rank[k:] + 1, np.zeros(min(k, n), np.int64)])
        rank, k = np.unique(rank * (n + 1) + after, return_inverse=True)[1], 2 * k
    return np.argsort(rank, kind="stable")


def suffix_array(tokens: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the ``depth`` tokens that follow each. ``tokens`` ends with ``depth`` zeros."""
    return starts[np.lexsort([tokens[starts + k] for k in reversed(range(depth))])]


def _bound(tokens: np.ndarray, array: np.ndarray, windows: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
    """By binary search, for each window: how many suffixes are below it, or, with ``upper``, not above it; prefixes count as equal."""
    width = windows.shape[1]
    lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(array), np.int64)
    inside = np.arange(width) < lengths[:, None]
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) // 2
        got = tokens[array[mid][:, None] + np.arange(width)]
        differs = (got != windows[live]) & inside[live]
        at = differs.argmax(1)
        rows = np.arange(len(live))
        less, same = got[rows, at] < windows[live][rows, at], ~differs.any(1)
        right = same | less if upper else less & ~same
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]
    return lo


def search_shard(tokens: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """(positions, windows): every place in the shard where a test window begins. 0 stands for any word that no item has."""
    width = tests.windows.shape[1]
    tokens = np.concatenate([tokens, np.zeros(width, np.int64)])
    first = tokens[: len(tokens) - width]
    known = lambda codes: tests.pairs[np.minimum(np.searchsorted(tests.pairs, codes), len(tests.pairs) - 1)] == codes
    keep = first > 0
    if (tests.lengths == 1).any():
        keep &= known((first << 32) | tokens[1 : len(first) + 1]) | known(first << 32)
    else:
        keep &= known((first << 32) | tokens[1 : len(first) + 1])
    array = suffix_array(tokens, np.flatnonzero(keep), width)
    lo = _bound(tokens, array, tests.windows, tests.lengths, upper=False)
    n = _bound(tokens, array, tests.windows, tests.lengths, upper=True) - lo
    which = np.repeat(np.arange(len(n)), n)
    at = array[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(n) else which
    return at, which


def follow(tokens: np.ndarray, at: np.ndarray, bounds: np.ndarray, depth: int, tests: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, bounds): how many words from each place ``at`` on stand so in an item, and the suffixes that have them all. The first
    ``depth`` words and their ``bounds`` are known. A word further at each turn, for all places that still match."""
    length, bounds = np.full(len(at), depth), bounds.copy()
    live = np.arange(len(at))
    while len(live):
        want = tokens[at[live] + depth]
        narrowed = []
        for upper in (False, True):
            lo, hi = bounds[live].T.copy()
            while (open_ := lo < hi).any():
                middle = (lo + hi) >> 1
                place = tests.order[np.minimum(middle, len(tests.order) - 1)] + depth
                got = tests.stream[np.minimum(place, len(tests.stream) - 1)]
                right = open_ & ((got <= want) if upper else (got < want))
                lo, hi = np.where(right, middle + 1, lo), np.where(open_ & ~right, middle, hi)
            narrowed.append(lo)
        on = narrowed[0] < narrowed[1]
        live, depth = live[on], depth + 1
        bounds[live], length[live] = np.stack(narrowed, 1)[on], depth
    return length, bounds


#: Of a document: words hit, items, longest match in words, where it begins, its item and the word it begins at there, and the hit runs (start, end).
Found = tuple[int, list[str], int, int, str | None, int, list[tuple[int, int]]]


def _found(shard: list[np.ndarray], tests: TestSet) -> list[Found]:
    """What each document of a shard holds of the items."""
    sizes = np.array([len(x) for x in shard], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + WINDOW)[:-1]])
    tokens = np.zeros(int((sizes + WINDOW).sum()), np.int64)
    for b, ids in zip(begins, shard, strict=True):
        tokens[b : b + len(ids)] = ids
    at, which = search_shard(tokens, tests) if len(tests.windows) else (np.empty(0, np.int64),) * 2
    out: list[Found] = [(0, [], 0, -1, None, -1, [])] * len(shard)
    order = np.lexsort([which, at])
    at, which = at[order], which[order]
    doc = np.searchsorted(begins, at, side="right") - 1
    # A whole window may go on; an item of fewer words is over.
    length, bounds = tests.lengths[which].copy(), tests.bounds[which]
    whole = np.flatnonzero(length == WINDOW)
    length[whole], bounds[whole] = follow(tokens, at[whole], bounds[whole], WINDOW, tests)
    for lo, hi in zip(*_groups(doc), strict=True):
        d, runs = int(doc[lo]), []
        items: set[str] = set()
        for w in np.unique(which[lo:hi]):
            items.update(tests.owners[w])
        starts = at[lo:hi] - begins[d]
        ends = starts + tests.lengths[which[lo:hi]]
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        best = lo + int(np.lexsort([starts, -length[lo:hi]])[0])
        if length[best] < WINDOW:
            item, offset = tests.owners[which[best]][0], 0
        else:
            item, offset = min(map(tuple, tests.origin[tests.order[bounds[best, 0] : bounds[best, 1]]].tolist()))
            item = tests.names[item]
        out[d] = (sum(e - s for s, e in runs), sorted(items), int(length[best]), int(at[best] - begins[d]), item, offset, [(s, e) for s, e in runs])
    return out


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of the runs of equal keys."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    return (np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])) if len(keys) else (edges, edges)


_SCHEMA = "n_words long, n_hit long, items array<string>, longest_match long, longest_at long, longest_item string, longest_item_at long, runs array<struct<start:long,end:long>>"


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark's items in blocks of about ``block_words`` words; an item is never split. Streams: a block is held at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(words(row[1]))
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(docs: DataFrame, sent: Broadcast) -> DataFrame:
    keep = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tests = test_set(sent.value)
        number = tests.vocabulary.get
        for b in batches:
            done, shard, size, totals = [], [], 0, []
            for text in b["text"]:
                got = words(text)
                totals.append(len(got))
                shard.append(np.fromiter((number(w, 0) for w in got), np.int64, len(got)))
                size += len(got)
                if size >= SHARD_WORDS:
                    done += _found(shard, tests)
                    shard, size = [], 0
            done += _found(shard, tests) if shard else []
            out = b[[f.name for f in keep]].copy()
            out["n_words"] = totals
            for k, name in enumerate(("n_hit", "items", "longest_match", "longest_at", "longest_item", "longest_item_at", "runs")):
                out[name] = [x[k] for x in done]
            yield out

    return docs.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), _SCHEMA]))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: its id, n_words, n_hit, items (ids as strings, sorted), longest_match (words of the
    longest run that stands so in one item, from a window on), longest_at (the word it begins at; -1 without one), longest_item and
    longest_item_at (the item, and the word there), and runs (all runs of hit words, of whatever items, as word offsets). Of matches
    of one length the first in the document counts, and of its items the least id as a string, then the first place.

    A word is hit if it lies in any occurrence of a window of 10 consecutive words of an item; an item of fewer words, but
    not of none, is one window. Null or empty text has no words; very long texts are searched whole; null items, and items
    without words, match nothing; repeated rows each give a row; an empty benchmark hits nothing; further columns, whatever
    their names, are not read.
    """
    docs = docs.select(doc_id, "text")
    send = docs.sparkSession.sparkContext.broadcast
    todo = blocks(benchmark)
    block, following = next(todo, []), next(todo, None)
    if following is None:
        return _search(docs, send(block))
    # Several blocks: what each finds is written before the next is sent; a row number keeps repeated rows apart.
    numbered = materialize(docs.select(doc_id, "text", F.monotonically_increasing_id().alias("row")))
    union = None
    while block:
        sent = send(block)
        found = materialize(_search(numbered, sent))
        sent.destroy()
        union = found if union is None else union.unionByName(found)
        block, following = following, next(todo, None)
    so_far = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    runs = union.select("row", F.inline("runs")).withColumn("apart", (F.col("start") > F.coalesce(F.max("end").over(so_far), F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("apart").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    merged = union.groupBy("row").agg(
        F.first(doc_id).alias(doc_id), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.min(F.when(F.col("longest_match") > 0, F.struct((-F.col("longest_match")).alias("n"), F.col("longest_at").alias("at"), F.col("longest_item").alias("item"), F.col("longest_item_at").alias("item_at")))).alias("best"),
    ).join(runs, "row", "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    length = F.transform("runs", lambda r: r["end"] - r["start"])
    best = F.col("best")
    return merged.select(
        doc_id, "n_words", F.aggregate(length, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"), "items",
        F.coalesce(-best["n"], F.lit(0)).alias("longest_match"), F.coalesce(best["at"], F.lit(-1)).alias("longest_at"), best["item"].alias("longest_item"), F.coalesce(best["item_at"], F.lit(-1)).alias("longest_item_at"), "runs",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a word hit, all columns as they were, whatever their names.

    Nulls, empty and very long texts, repeated rows and empty tables are as in ``contamination``. The search runs as part of the
    same map as the filter, so no join back to the documents is needed; of several benchmark blocks, each sees what the ones
    before have left.
    """
    send = docs.sparkSession.sparkContext.broadcast
    todo = blocks(benchmark)
    block, following = next(todo, []), next(todo, None)
    while following is not None:
        sent = send(block)
        docs = materialize(_clean(docs, sent))
        sent.destroy()
        block, following = following, next(todo, None)
    return _clean(docs, send(block))


def _clean(docs: DataFrame, sent: Broadcast) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tests = test_set(sent.value)
        number = tests.vocabulary.get
        for b in batches:
            keep, shard, size = [], [], 0
            for text in b["text"]:
                got = words(text)
                shard.append(np.fromiter((number(w, 0) for w in got), np.int64, len(got)))
                size += len(got)
                if size >= SHARD_WORDS:
                    keep += [x[0] == 0 for x in _found(shard, tests)]
                    shard, size = [], 0
            keep += [x[0] == 0 for x in _found(shard, tests)] if shard else []
            yield b[np.array(keep, bool)]

    return map_in_pandas(docs, run, docs.schema)


def query(spark, sf_dir):
    """op1_decontamination."""
    from ctxloom.llm._common import table

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest_match", "longest_at", "longest_item", "longest_item_at",
    )


#: DuckDB over whole tables: windows of the items join the windows of the documents; windows of one item that follow each other in both are one match.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item_id, k AS j, least(10, len(w)) AS n, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM i),
p AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, n WHERE len(w) >= n),
g AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM p),
h AS (SELECT g.r, g.n, g.k, i.item_id, i.j FROM g JOIN i ON g.n = i.n AND g.g = i.g),
x AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS q FROM (SELECT DISTINCT r, n, k FROM h)) GROUP BY r),
run AS (SELECT r, CAST(item_id AS VARCHAR) AS item, n, k, j, k - row_number() OVER (PARTITION BY r, item_id, n, k - j ORDER BY k) AS grp FROM h),
m AS (SELECT r, item, count(*) + n - 1 AS m, min(k) - 1 AS place, min(j) - 1 AS item_at FROM run GROUP BY r, item, n, k - j, grp),
y AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY r ORDER BY m DESC, place, item, item_at) = 1),
z AS (SELECT r, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(x.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(z.n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(z.items, '')) AS items_sha256, coalesce(x.n_hit, 0) > 0 AS contaminated, CAST(coalesce(y.m, 0) AS BIGINT) AS longest_match, CAST(coalesce(y.place, -1) AS BIGINT) AS longest_at,
y.item AS longest_item, CAST(coalesce(y.item_at, -1) AS BIGINT) AS longest_item_at
FROM d LEFT JOIN x USING (r) LEFT JOIN y USING (r) LEFT JOIN z USING (r)
"""
