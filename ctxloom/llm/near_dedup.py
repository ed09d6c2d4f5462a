"""MinHash near-dedup with DartMinHash signatures.

A document is a weighted set: its shingles of five words, weighted by how often each occurs. Over each unit of weight of
an element lies a line of ranks; darts hit it at hashed, exponentially spaced ranks and carry a hashed coordinate. Of
the darts below a rank limit that is set by the total weight, so that about K ln K + 2K of them fall in any document, the
earliest of each coordinate is kept. Two documents agree in a coordinate with the probability of their weighted Jaccard
similarity. Bands of coordinates join documents; candidate pairs are verified exactly on whole texts; verified links are
closed to classes by alternating star contraction. All of it is distributed: only row counts come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.llm._common import input_parts, materialize, put_back, set_aside, table, utf8

SHINGLE = 5
SIMILARITY = 0.8
#: 25 bands of 5 coordinates find a pair of similarity 0.8 with probability 0.99995.
BANDS, ROWS = 25, 5
K = BANDS * ROWS
#: Buckets of up to so many texts are compared pair by pair, larger ones with a leader.
SMALL_BUCKET = 8
#: Leaders that the texts of a large bucket are verified against in turn; and counters by which cells are ordered for the prefix join.
LEADERS, ORDER = 2, 1 << 20
#: Bits of a text's marks in the prefix join.
MARKS = 512
#: Members that a leader is compared with in one task.
GROUP = 1000
#: Bytes of text taken at once.
CHUNK = 1 << 20

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
np.seterr(over="ignore")  # hashes wrap
_P = 0xD6E8FEB86659FD93
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def cells(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, cell) of each unit of weight: the n-th occurrence of a shingle in a document is a cell of its own.

    Sorted by document, then cell. Words are runs of letters, digits and non-ASCII signs, A-Z lower-cased; a document of
    fewer than five words, but not of none, is one shingle.
    """
    raw = [utf8(t) + b" " for t in texts]
    data = _LOWER[np.frombuffer(b" " + b"".join(raw), np.uint8)]
    word = _WORD[data]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first separator after a word stays, and stands for all
    at = np.cumsum(keep) - 1
    ends_of_docs = np.cumsum([len(r) for r in raw])
    starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    doc = np.searchsorted(ends_of_docs, starts)
    n = np.bincount(doc, minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    width = np.minimum(n, SHINGLE)[doc]
    first = np.flatnonzero(np.arange(len(doc)) - begin[doc] + width <= n[doc])
    last = first + width[first] - 1
    flat = np.where(word, data, 32)[keep].astype(np.uint64) + np.uint64(1)
    size = len(flat) + 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(flat * _powers(size, _P)[: size - 1])])
    lo, hi = at[starts[first]], at[ends[last] - 1] + 1
    shingle = mix((sums[hi] - sums[lo]) * _powers(size, pow(_P, -1, 1 << 64))[lo] + (hi - lo).astype(np.uint64))
    owner = doc[first]
    order = np.lexsort([shingle, owner])
    owner, shingle = owner[order], shingle[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    copy = np.arange(len(owner)) - np.maximum.accumulate(np.where(fresh, np.arange(len(owner)), 0))
    cell = mix(shingle + copy.astype(np.uint64) * _STEP)
    order = np.lexsort([cell, owner])
    return owner[order], cell[order]


def dart_minhash(owner: np.ndarray, cell: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """(n, k) signatures of 32 bits; rows of documents without cells are 0."""
    out = np.zeros((n, k), np.uint32)
    weight = np.bincount(owner, minlength=n).astype(np.float64)
    open_, darts = np.flatnonzero(weight), k * np.log(k) + 2 * k
    while len(open_):
        place = np.full(n, -1)
        place[open_] = np.arange(len(open_))
        mine = place[owner] >= 0
        doc, seed = place[owner[mine]], cell[mine]
        limit = (darts / weight[open_])[doc]
        rank = np.zeros(len(doc))
        best = np.full(len(open_) * k, np.uint64(0xFFFFFFFFFFFFFFFF))
        step = np.uint64(0)
        while len(doc):
            step += _STEP
            h = mix(seed ^ step)
            rank = rank - np.log1p(-(h >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            hit = rank <= limit
            doc, seed, rank, limit, h = doc[hit], seed[hit], rank[hit], limit[hit], h[hit]
            name = mix(h + _M1)
            early = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
            np.minimum.at(best, doc * k + (name % np.uint64(k)).astype(np.int64), early | (name >> np.uint64(32)))
        best = best.reshape(-1, k)
        full = (best != np.uint64(0xFFFFFFFFFFFFFFFF)).all(1)
        out[open_[full]] = (best[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        open_, darts = open_[~full], darts * 2
    return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), content (128 bits of the weighted set; null for texts without words) and bands (hashes, each with its number)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["text"])
            for lo, hi in _chunks(texts):
                n = hi - lo
                owner, cell = cells(texts[lo:hi])
                sig = dart_minhash(owner, cell, n).astype(np.uint64).reshape(n, BANDS, ROWS)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, (n, BANDS)).copy()
                for r in range(ROWS):
                    key = mix(key ^ sig[:, :, r])
                weight = np.bincount(owner, minlength=n)
                filled = weight > 0
                sums = np.zeros((n, 2), np.uint64)
                edges = np.concatenate([[0], np.cumsum(weight)[:-1]])[filled]
                if len(edges):
                    sums[filled, 0] = np.add.reduceat(mix(cell + _M2), edges)
                    sums[filled, 1] = np.add.reduceat(mix(cell ^ _M1), edges)
                content = [s.tobytes() if f else None for s, f in zip(sums, filled, strict=True)]
                bands = [list(r) if f else [] for r, f in zip(key.view(np.int64), filled, strict=True)]
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[lo:hi].array, "hash": b["hash"].iloc[lo:hi].array, "content": content, "bands": bands})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInPandas(run, f"doc_id {kind}, hash long, content binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose texts are similar enough. Each a with up to GROUP of its b's goes to one place."""
    groups = materialize(pairs.groupBy("a").agg((F.floor((F.count(F.lit(1)) - 1) / GROUP) + 1).alias("n")))
    member = (
        pairs.join(groups, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("n")))
        .join(texts.withColumnRenamed("content", "b"), "b").select("a", "salt", "b", "text")
    )
    leader = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).join(texts.withColumnRenamed("content", "a"), "a")
    rows = leader.select("a", "salt", F.lit(None).cast("binary").alias("b"), "text").unionByName(member)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own = None, np.empty(0, np.uint64)
        for b in batches:
            a, other, texts = [None if x is None else bytes(x) for x in b["a"]], list(b["b"]), list(b["text"])
            found = []
            for lo, hi in _chunks(texts):
                owner, cell = cells(texts[lo:hi])
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                for i in range(lo, hi):
                    mine = cell[cut[i - lo] : cut[i - lo + 1]]
                    if other[i] is None:
                        key, own = a[i], mine
                        continue
                    assert key == a[i], "a leader's text comes first"
                    both = len(np.intersect1d(own, mine, assume_unique=True))
                    if both >= SIMILARITY * (len(own) + len(mine) - both) - 1e-9:
                        found.append((a[i], bytes(other[i])))
            yield pd.DataFrame(found, columns=["a", "b"])

    return rows.repartition(input_parts(texts), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInPandas(run, "a binary, b binary")


def links(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): verified links between different texts, by content, that join all similar texts which share a band.

    In small buckets all pairs are verified. In larger ones each text is verified against one that leads, and what fails,
    LEADERS times in all, against the next leader. Two texts that passed the first leader are connected through it; so what failed it
    goes through an exact join by prefixes, with all texts of its buckets, those that passed too.
    """
    reps = signed.where("content IS NOT NULL").groupBy("content").agg(F.min(F.struct("doc_id", "hash")).alias("own"), F.first("bands").alias("bands"))
    members = materialize(_buckets(reps.select("content", F.explode("bands").alias("k"))))
    # A content stands for one row's id and text, so rows of one id with different texts are told apart.
    wanted = members.select("content").distinct().join(reps.select("content", F.col("own.doc_id").alias("id"), F.col("own.hash").alias("own")), "content")
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("own"))).select("content", "text")
    texts = materialize(texts.dropDuplicates(["content"]))
    small, large = members.where(F.col("n") <= SMALL_BUCKET), members.where(F.col("n") > SMALL_BUCKET)
    met, found, pairs, failed = large, [], _all_pairs(small), None
    for k in range(LEADERS):
        if large.isEmpty():
            break
        # The text that shares its buckets with most others leads: of copies of one text, which may differ more from each other, mostly that text.
        shares = large.groupBy("content").agg(F.sum("n").alias("shares"))
        ranked = large.select("k", "content").join(shares, "content")
        first = materialize(ranked.groupBy("k").agg(F.max(F.struct("shares", "content")).alias("top")).select("k", F.col("top.content").alias("a")))
        led = materialize(large.select("k", "content").join(first, "k").where("content != a"))
        asked = led.select(F.least("a", "content").alias("a"), F.greatest("a", "content").alias("b"))
        found.append(materialize(_verified(materialize((asked if k else pairs.unionByName(asked)).distinct()), texts)))
        alike = found[-1].unionByName(found[-1].select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnRenamed("b", "content")
        if k + 1 == LEADERS:
            break
        rest = materialize(led.join(alike, ["a", "content"], "left_anti").select("k", "content"))
        failed = failed or rest
        large = materialize(_buckets(rest))
    if not found:  # no large bucket
        return _verified(materialize(pairs.distinct()), texts)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    if failed.isEmpty():
        return out.distinct()
    # Only texts that no chain of links connects yet are paired.
    roots = components(out).withColumnRenamed("node", "content")
    asking = failed.select("content").distinct().withColumn("asks", F.lit(True))
    beside = met.join(failed.select("k").distinct(), "k", "left_semi").select("content").distinct()
    rest = texts.join(beside, "content", "left_semi").join(roots, "content", "left").join(asking, "content", "left")
    rest = materialize(rest.select("content", "text", F.coalesce("root", "content").alias("root"), F.coalesce("asks", F.lit(False)).alias("asks")))
    return out.unionByName(_verified(materialize(_prefix_pairs(rest)), texts)).distinct()


def _prefix_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): a superset of the pairs of texts of similarity SIMILARITY or more that have different roots and of which one asks
    at least (content, text, root, asks).

    Cells are put in one order for all texts, rare ones first. Of two similar texts, of n and m >= n cells, the shorter has
    one of its first (n - ceil(2s/(1+s) n) + 1) cells among the first (m - ceil(s m) + 1) of the longer, for they share
    s/(1+s) (n + m) at least. So they differ in (1-s)/(1+s) (n + m) cells at most; as many bits, at least, as differ between
    two texts' marks, the parities of their cells in MARKS classes, do their cells. Rareness is by counts in a table of ORDER counters: whatever it is, the join loses no pair.
    """
    spark = texts.sparkSession
    step = ORDER // 64

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(ORDER, np.int64)
        for b in batches:
            t = list(b["text"])
            for lo, hi in _chunks(t):
                total += np.bincount((cells(t[lo:hi])[1] >> np.uint64(20)).astype(np.int64) % ORDER, minlength=ORDER)
        if total.any():
            yield pd.DataFrame({"part": range(64), "counts": [total[k : k + step].tobytes() for k in range(0, ORDER, step)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, np.int64) for c in group["counts"]], axis=0)
        return pd.DataFrame({"part": group["part"].iloc[:1], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    counted = texts.select("text").mapInPandas(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary")
    parts = {r["part"]: np.frombuffer(r["counts"], np.int32) for r in counted.collect()}  # 64 rows of a fixed size
    sent = spark.sparkContext.broadcast(np.concatenate([parts.get(k, np.zeros(step, np.int32)) for k in range(64)]))
    overlap = 2 * SIMILARITY / (1 + SIMILARITY)

    def prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = sent.value
        for b in batches:
            t, names = list(b["text"]), list(zip(b["content"], b["root"], b["asks"], strict=True))
            for lo, hi in _chunks(t):
                owner, cell = cells(t[lo:hi])
                order = np.lexsort([cell, counts[(cell >> np.uint64(20)).astype(np.int64) % ORDER], owner])
                owner, cell = owner[order], cell[order]
                n = np.bincount(owner, minlength=hi - lo)
                place = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
                m = n[owner]
                keep = place <= m - np.ceil(SIMILARITY * m - 1e-9)
                first = place <= m - np.ceil(overlap * m - 1e-9)
                odd = np.bincount(owner * MARKS + (cell % np.uint64(MARKS)).astype(np.int64), minlength=(hi - lo) * MARKS).astype(np.uint8) & 1
                marks = np.packbits(odd.reshape(hi - lo, MARKS), axis=1).view(np.int64)[owner[keep]]
                mine = [names[lo + k] for k in owner[keep].tolist()]
                yield pd.DataFrame({"cell": cell[keep].view(np.int64), "content": [x for x, _, _ in mine], "root": [x for _, x, _ in mine], "asks": [x for _, _, x in mine], "n": m[keep].astype(np.int32), "first": first[keep], **{f"m{k}": marks[:, k] for k in range(MARKS // 64)}})

    rows = materialize(texts.mapInPandas(prefix, "cell long, content binary, root binary, asks boolean, n int, first boolean, " + ", ".join(f"m{k} long" for k in range(MARKS // 64))))
    asker = rows.where("asks").select("cell", F.col("content").alias("s"), F.col("root").alias("sr"), F.col("n").alias("sn"), F.col("first").alias("sfirst"), *[F.col(f"m{k}").alias(f"s{k}") for k in range(MARKS // 64)])
    apart = sum((F.bit_count(F.col(f"m{k}").bitwiseXOR(F.col(f"s{k}"))) for k in range(MARKS // 64)), F.lit(0))
    near = apart <= (1 - SIMILARITY) / (1 + SIMILARITY) * (F.col("sn") + F.col("n")) + 1e-9
    once = ~F.col("asks") | (F.col("s") < F.col("content"))
    shorter = (F.col("sfirst") & (F.col("sn") <= F.col("n"))) | (F.col("first") & (F.col("n") <= F.col("sn")))
    sized = F.least("sn", "n") >= SIMILARITY * F.greatest("sn", "n") - 1e-9
    pairs = asker.join(rows, "cell").where(near & once & shorter & sized & (F.col("sr") != F.col("root")))
    return pairs.select(F.least("s", "content").alias("a"), F.greatest("s", "content").alias("b")).distinct()


def _buckets(rows: DataFrame) -> DataFrame:
    """The rows of buckets of two texts at least, with the bucket's size n."""
    shared = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(shared, "k")


def _all_pairs(small: DataFrame) -> DataFrame:
    """(a, b), a before b, of buckets of at most SMALL_BUCKET texts."""
    listed = small.groupBy("k").agg(F.array_sort(F.collect_list("content")).alias("c"))
    pairs = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, SMALL_BUCKET), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return listed.select(F.explode(pairs).alias("p")).select("p.*")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of (a, b), by alternating large and small stars; the root is the least node."""
    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while not edges.isEmpty():
        # Large star: a node's greater neighbours are linked to the least of its neighbourhood. What is joined back is written
        # first, so that a node of very many edges can be split among tasks.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its lesser neighbours are linked to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.distinct())
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, hash, root (null for texts without words) and least, the first (doc_id, hash) of the class."""
    signed = materialize(signatures(docs))
    roots = components(materialize(links(signed, docs)))
    known = materialize(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "content"))
    rows = signed.select("doc_id", "hash", "content").join(known, "content", "left")
    rows = materialize(rows.select("doc_id", "hash", F.coalesce("root", "content").alias("root")))
    # Written, so that a class of very many members can be split among tasks when it is joined back.
    least = materialize(rows.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("least")))
    return rows.join(least, "root", "left")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class), for each row of ``docs``.

    Documents are in a class if verified links, of weighted Jaccard similarity 0.8 or more over five-word shingles, or equal
    weighted sets (told by 128 bits), connect them. Texts without words, null ones too, are classes of their own; very long
    texts are taken whole; repeated rows share a class; rows of one id and different texts are different documents; null ids
    are allowed and count as least; an empty table gives no rows; further columns, whatever their names, are not read.
    """
    rows = _classes(docs)
    return rows.select("doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, that of the least id (of equal ids: of the least hash of the text; of equal rows one of them).

    Rows whose texts have no words all stay. Nulls, empty and long texts, repeated rows and empty tables are as in ``classes``; columns
    of any name pass through.
    """
    own = F.struct("doc_id", "hash")
    judged = _classes(docs).groupBy("doc_id", "hash").agg(F.max(F.col("root").isNotNull()).alias("worded"), F.max(F.coalesce(F.col("least").eqNullSafe(own), F.lit(True)) | F.col("root").isNull()).alias("stays"))
    judged = materialize(judged.where("stays").select(F.col("doc_id").alias("id"), F.col("hash").alias("own"), "worded"))
    rows = set_aside(docs, "doc_id", "text").withColumn("hash", F.xxhash64("text"))
    kept = rows.join(judged, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("own")))
    nth = F.row_number().over(Window.partitionBy("id", "own").orderBy("own"))
    kept = kept.withColumn("nth", nth).where((F.col("nth") == 1) | ~F.col("worded"))
    return kept.select(*put_back(docs.columns, doc_id=F.col("doc_id"), text=F.col("text")))


def query(spark, sf_dir):
    """op7_near_dedup."""
    return classes(table(spark, sf_dir, "documents"))
