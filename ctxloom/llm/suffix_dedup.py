"""Exact substring dedup with a sparse suffix array over all documents, at byte level.

Every match of 50 bytes holds a common anchor: the 16-byte string with the least hash in it (of equals the first). So the
suffixes that start at anchors are enough, one in about eighteen, and each 50-byte window belongs to one anchor.

1. Anchors are counted by hash; those that occur in one document only can start no match and are dropped. The most
   frequent anchors are known from a sample, and need no counting.
2. Splitters are sampled from the anchors' leading bytes, and range-partition their suffixes, with the bytes around them.
   Where one leading string fills several ranges, its anchors are dealt out among these by hash.
3. A task sorts the windows of its bucket by multikey quicksort, eight bytes a key, and compares neighbours; what is equal
   to the window before belongs to one string, whose first document keeps it. A window's copies share its anchor, so they
   meet in one bucket, and the comparison across a bucket's boundary can find nothing. The windows of frequent anchors go
   another way: equal runs are packed before the shuffle, and the first document of each window is joined back. Whole
   copies of a text are told by its SHA-256.
4. The covered bytes of each document are united and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm._common import count_rows, discard, input_parts, materialize, table, utf8

LENGTH = 50
ANCHOR = 16
SPREAD = LENGTH - ANCHOR + 1
_NULL = -(1 << 63)
#: Bytes of text taken at once.
CHUNK = 1 << 18
#: Bytes of text whose anchors are packed together for the count.
PACK = 8 << 20
#: Documents sampled for the splitters and the frequent anchors, about; an anchor is frequent in FREQUENT of them, and MANY at least.
SAMPLE_DOCS, FREQUENT, MANY = 2_000, 0.004, 8

#: Whole copies that may be sent to all executors, to be left out where texts are read.
SENT_COPIES = 500_000
#: Bytes of text whose suffixes are on disk at once: beyond it the buckets are settled in rounds.
ROUND_BYTES = 6 << 30

_TOP = np.uint64(1 << 63)
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
np.seterr(over="ignore")  # hashes wrap


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def anchor_runs(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, number of windows, anchor's place, anchor's hash) of the runs of windows with one anchor.

    ``data`` holds the documents one after the other; places are in ``data``.
    """
    none = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none
    # Hashes of 16 bytes at every place, from those of 1, 2, 4 and 8.
    grams, power = data.astype(np.uint64), _P
    for width in (1, 2, 4, 8):
        grams = grams[:-width] * power + grams[width:]
        power = power * power
    grams *= _M1  # high bits decide, and every byte reaches them
    # The least in each window; places in the low bits make the first of equals win. Their number is fixed, so that what
    # counts as equal, and with it a window's anchor, depends on nothing but the window's bytes.
    mask = np.uint64(0xFFFFFFFF)
    low = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    for width in (1, 2, 4, 8, 16):
        low = np.minimum(low[:-width], low[width:])
    low = np.minimum(low[: len(low) - (SPREAD - 32)], low[SPREAD - 32 :])[:n] & mask
    # Runs of one anchor, broken where documents end: windows that would cross an end are none.
    ends = np.cumsum(sizes)
    inside = np.ones(n + LENGTH, bool)
    for e in ends.tolist():
        inside[max(0, e - LENGTH + 1) : e] = False
    inside = inside[:n]
    breaks = np.empty(n + 1, bool)
    breaks[0] = breaks[n] = True
    np.not_equal(low[1:], low[:-1], out=breaks[1:n])
    breaks[ends[ends < n]] = True
    start = np.flatnonzero(breaks[:n] & inside)
    stop = np.flatnonzero(inside & (breaks[1:] | ~np.append(inside[1:], False)))
    place = low[start].astype(np.int64)
    return np.searchsorted(ends, start, side="right"), start, stop - start + 1, place, _mix(grams[place])


def _chunked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Rows by about a megabyte of text."""
    for b in batches:
        raw = [utf8(t) for t in b["text"]]
        lo, size = 0, 0
        for k, r in enumerate(raw):
            size += len(r)
            if size >= CHUNK or k == len(raw) - 1:
                yield b.iloc[lo : k + 1], raw[lo : k + 1]
                lo, size = k + 1, 0


def _arrays(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)


def _prepare(docs: DataFrame) -> DataFrame:
    """doc (the id, as long; the least for null), copy (a hash of the text) and text: rows of one id and text are one document."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), F.hash("text").alias("copy"), "text")


def _packs(batches: Iterator[pd.DataFrame], take) -> Iterator[pd.DataFrame]:
    """``take(chunk, rows, texts)`` for every PACK bytes of text or so; the chunk's number holds the task's."""
    chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
    for b, raw in _chunked(batches):
        held.append((b, raw))
        size += sum(map(len, raw))
        if size >= PACK:
            yield take(chunk, held)
            chunk, held, size = chunk + 1, [], 0
    if held:
        yield take(chunk, held)


def _cat(values: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind)


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows begin to differ from the row before."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))


def _shared_anchors(rows: DataFrame, parts: int, frequent: np.ndarray) -> DataFrame:
    """(doc, copy, anchors): for each document the hashes, in 32 bits, of its anchors that other documents may have too.

    Hashes go to buckets as packed arrays, a row for each bucket and chunk of documents, and come back to their chunk the
    same way: an anchor costs a few bytes, and rows are not made for each document and bucket.
    """

    def pack(chunk: int, held: list) -> pd.DataFrame:
        """A row for each bucket: its documents, how many anchors each has, and these."""
        doc, h, base = [], [], 0
        for b, raw in held:
            d, _, _, _, x = anchor_runs(*_arrays(raw))
            rare = ~_in(x, frequent)
            doc, h, base = [*doc, d[rare] + base], [*h, x[rare]], base + len(b)
        doc, h = np.concatenate(doc), np.concatenate(h)
        ids, copies = (np.concatenate([b[c].to_numpy(t) for b, _ in held]) for c, t in (("doc", np.int64), ("copy", np.int32)))
        bucket = (h >> np.uint64(32)).astype(np.int64) % parts
        order = np.lexsort([h, doc, bucket])
        doc, h, bucket = doc[order], (h[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), bucket[order]
        fresh = _edges(h, doc, bucket)
        doc, h, bucket = doc[fresh], h[fresh], bucket[fresh]
        cut = _edges(bucket)
        found = []
        for lo, hi in zip(cut, [*cut[1:], len(h)][: len(cut)], strict=True):
            used, counts = np.unique(doc[lo:hi], return_counts=True)
            found.append((int(bucket[lo]), chunk, ids[used].tobytes(), copies[used].tobytes(), counts.astype(np.uint32).tobytes(), h[lo:hi].tobytes()))
        return pd.DataFrame(found, columns=["bucket", "chunk", "ids", "copies", "counts", "hashes"])

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        """Of a bucket, chunk by chunk, the anchors that stand in several documents."""
        counts = _cat(group["counts"], np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        h, ids, copies = _cat(group["hashes"], np.uint32), _cat(group["ids"], np.int64), _cat(group["copies"], np.int32)
        order = np.argsort(h, kind="stable")
        s, who = h[order], owner[order]
        heads = _edges(s)
        group_of = np.repeat(np.arange(len(heads)), np.diff([*heads, len(s)]))
        head = who[heads][group_of]
        several = np.zeros(len(heads), bool)
        several[group_of[(ids[who] != ids[head]) | (copies[who] != copies[head])]] = True
        hit = np.sort(order[several[group_of]])
        found, lo = [], 0
        for chunk, n in zip(group["chunk"], np.cumsum([len(x) // 4 for x in group["hashes"]]), strict=True):
            hi = int(np.searchsorted(hit, n))
            if hi > lo:
                used, left = np.unique(owner[hit[lo:hi]], return_counts=True)
                found.append((chunk, ids[used].tobytes(), copies[used].tobytes(), left.astype(np.uint32).tobytes(), h[hit[lo:hi]].tobytes()))
            lo = hi
        return pd.DataFrame(found, columns=["chunk", "ids", "copies", "counts", "hashes"])

    def unite(group: pd.DataFrame) -> pd.DataFrame:
        """A row for each document of a chunk."""
        counts = _cat(group["counts"], np.uint32).astype(np.int64)
        ids, copies = (np.repeat(_cat(group[c], t), counts) for c, t in (("ids", np.int64), ("copies", np.int32)))
        order = np.lexsort([copies, ids])
        ids, copies, h = ids[order], copies[order], _cat(group["hashes"], np.uint32)[order]
        at = _edges(ids, copies)
        return pd.DataFrame({"doc": ids[at], "copy": copies[at], "anchors": [x.tobytes() for x in np.split(h, at[1:])] if len(at) else []})

    sent = "ids binary, copies binary, counts binary, hashes binary"
    packed = rows.mapInPandas(lambda batches: _packs(batches, pack), f"bucket int, chunk long, {sent}")
    kept = packed.repartition(parts, "bucket").groupBy("bucket").applyInPandas(keep, f"chunk long, {sent}")
    united = kept.repartition(parts, "chunk").groupBy("chunk").applyInPandas(unite, "doc long, copy int, anchors binary")
    return united.groupBy("doc", "copy").agg(F.collect_list("anchors").alias("anchors"))  # rows of one id and text may be in several chunks


def _in(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)] == h if len(ordered) else np.zeros(len(h), bool)


def _lead(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number of the same order."""
    lead = data[place[:, None] + np.arange(8)].astype(np.uint64)
    return (lead << (np.uint64(8) * np.arange(7, -1, -1, dtype=np.uint64))).sum(1, dtype=np.uint64)


def _sample(rows: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(splitters, frequent): leading strings that part the anchors evenly, repeated where one fills several ranges; and the
    hashes of anchors in many documents, sorted. Both from a sample of documents, whose anchors stay with the executors:
    only the quantiles and the frequent anchors come to the driver, which are SAMPLE_DOCS / MANY times a document's at most."""

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, raw in _chunked(batches):
            data, sizes = _arrays(raw)
            doc, _, _, place, h = anchor_runs(data, sizes)
            lead = _lead(data, place) ^ _TOP if len(doc) else np.empty(0, np.uint64)  # of the same order as signed numbers
            yield pd.DataFrame({"doc": doc, "h": h.view(np.int64), "lead": lead.view(np.int64)}).drop_duplicates(["doc", "h"])[["h", "lead"]]

    n = count_rows(rows)
    share = min(1.0, SAMPLE_DOCS / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64("doc", "copy"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    got = materialize(picked.mapInPandas(anchors, "h long, lead long"))
    often = got.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(MANY, FREQUENT * share * n)).select("h")
    often = np.sort(np.array([r["h"] for r in often.collect()], np.int64).view(np.uint64))
    rare = got.mapInPandas(lambda batches: (b[~_in(b["h"].to_numpy(np.int64).view(np.uint64), often)][["lead"]] for b in batches), "lead long")
    cuts = rare.agg(F.percentile_approx("lead", [k / parts for k in range(1, parts)], max(10_000, 20 * parts))).first()[0] if parts > 1 else []
    discard(got)
    return np.array(cuts or [], np.int64).view(np.uint64) ^ _TOP, often


def _suffixes(joined: DataFrame, splitters: np.ndarray, nth: int = 0, rounds: int = 1) -> DataFrame:
    """(bucket, back, doc, copy, start, bytes): the runs of windows of shared anchors, with their bytes, and where in these the anchor is;
    those of every ``rounds``-th bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, raw in _chunked(batches):
            wanted = [np.frombuffer(b"".join(a), np.uint32) for a in b["anchors"]]
            data, sizes = _arrays(raw)
            doc, start, n, place, h = anchor_runs(data, sizes)
            number = np.repeat(np.arange(len(wanted), dtype=np.uint64), [len(w) for w in wanted])
            keys = np.unique((number << np.uint64(32)) | np.concatenate(wanted).astype(np.uint64))
            hit = _in((doc.astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)), keys)
            doc, start, n, place, h = doc[hit], start[hit], n[hit], place[hit], h[hit]
            if not len(doc):
                continue
            lead = _lead(data, place)
            low, high = np.searchsorted(splitters, lead, "left"), np.searchsorted(splitters, lead, "right")
            bucket = np.where(high > low, low + 1 + (h % np.maximum(high - low, 1).astype(np.uint64)).astype(np.int64), high)
            if rounds > 1:
                now = bucket % rounds == nth
                doc, start, n, place, bucket = doc[now], start[now], n[now], place[now], bucket[now]
            whole, begins = data.tobytes(), np.cumsum(sizes) - sizes
            yield pd.DataFrame({
                "bucket": bucket.astype(np.int32), "back": (place - start).astype(np.int16),
                "doc": b["doc"].to_numpy(np.int64)[doc], "copy": b["copy"].to_numpy(np.int32)[doc], "start": (start - begins[doc]).astype(np.int32),
                "bytes": [whole[s : s + k + LENGTH - 1] for s, k in zip(start.tolist(), n.tolist(), strict=True)],
            })

    return joined.mapInPandas(run, "bucket int, back short, doc long, copy int, start int, bytes binary")


_PLACE = np.dtype([("doc", "<i8"), ("copy", "<i4"), ("start", "<i8")])
_HIT = np.dtype([*_PLACE.descr, ("mask", "<i8")])


def _frequent(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(doc, copy, spans) of the runs of windows of frequent anchors.

    Runs with equal bytes are one row for each chunk of documents, with all their places there; only the distinct ones are
    taken apart into windows. Each chunk's run then learns, by its bytes, the first document of each of its windows, and
    goes back to its chunk. So rows count distinct runs and chunks, not places.
    """

    def cut(chunk: int, held: list) -> pd.DataFrame:
        found: dict[bytes, list[tuple[int, int, int]]] = {}
        for b, raw in held:
            data, sizes = _arrays(raw)
            doc, start, n, _, h = anchor_runs(data, sizes)
            hit = _in(h, frequent)
            doc, start, n = doc[hit], start[hit], n[hit]
            whole, inside = data.tobytes(), start - (np.cumsum(sizes) - sizes)[doc]
            ids, copies = b["doc"].to_numpy(np.int64)[doc], b["copy"].to_numpy(np.int32)[doc]
            for s, k, *place in zip(start.tolist(), n.tolist(), ids.tolist(), copies.tolist(), inside.tolist(), strict=True):
                found.setdefault(whole[s : s + k + LENGTH - 1], []).append(tuple(place))
        places = [np.array(p, _PLACE) for p in found.values()]
        return pd.DataFrame({"bytes": list(found), "chunk": chunk, "first": [int(p["doc"].min()) for p in places], "places": [p.tobytes() for p in places]})

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.int64(1) << np.arange(SPREAD, dtype=np.int64)
        for b in batches:
            hits = []
            for chunk, places, firsts in zip(b["chunk"], b["places"], b["firsts"], strict=True):
                p, least = np.frombuffer(places, _PLACE), np.asarray(firsts, np.int64)
                mask = ((least[None, :] < p["doc"][:, None]) * bits[: len(least)]).sum(1)
                out = np.empty(int((mask != 0).sum()), _HIT)
                for c in _PLACE.names:
                    out[c] = p[c][mask != 0]
                out["mask"] = mask[mask != 0]
                if len(out):
                    hits.append((chunk, out.tobytes()))
            yield pd.DataFrame(hits, columns=["chunk", "hits"])

    def unite(group: pd.DataFrame) -> pd.DataFrame:
        hit = _cat(group["hits"], _HIT)
        at, inner = np.nonzero((hit["mask"][:, None] >> np.arange(SPREAD, dtype=np.int64)) & 1)
        return _spans(hit["doc"][at], hit["copy"][at], hit["start"][at] + inner)

    parts = input_parts(rows)
    runs = materialize(rows.mapInPandas(lambda batches: _packs(batches, cut), "bytes binary, chunk long, first long, places binary"))
    distinct = materialize(runs.groupBy("bytes").agg(F.min("first").alias("first")))
    window = distinct.select("bytes", "first", F.explode(F.sequence(F.lit(1), F.length("bytes") - LENGTH + 1)).alias("k")).withColumn("window", F.substring("bytes", F.col("k"), F.lit(LENGTH)))
    # Written tables, so that both sides of the joins are shuffled for them and a frequent key can be split among tasks.
    least = materialize(window.groupBy("window").agg(F.min("first").alias("least")))
    each = window.select("bytes", "k", "window").join(least, "window").groupBy("bytes").agg(F.array_sort(F.collect_list(F.struct("k", "least"))).alias("w"))
    firsts = materialize(each.select("bytes", F.transform("w", lambda x: x["least"]).alias("firsts")))
    hits = runs.join(firsts, "bytes").select("chunk", "places", "firsts").mapInPandas(match, "chunk long, hits binary")
    out = materialize(hits.repartition(parts, "chunk").groupBy("chunk").applyInPandas(unite, _SPANS))
    discard(runs, distinct, least, firsts)
    return out


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, equal): the order of byte rows, and whether a row equals the one before it.

    Multikey quicksort with eight bytes as a sign: rows are sorted by the first sign, and only runs of equal signs by the next.
    Runs whose rows are equal to their ends need no more sorting.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    keys = padded.view(">u8").astype(np.uint64)
    order = np.argsort(keys[:, 0], kind="stable")
    first = keys[order, 0]
    equal = np.concatenate([[False], first[1:] == first[:-1]]) if n else np.empty(0, bool)
    at = np.arange(n)  # places in runs that are still to be sorted
    for k in range(1, keys.shape[1]):
        tied = equal[at]
        tied[:-1] |= equal[at[1:]] & (at[1:] == at[:-1] + 1)
        at = at[tied]
        head = ~equal[at]
        heads = np.flatnonzero(head)
        rest = keys[order[at], k:]
        differs = np.zeros(len(at), bool)
        differs[1:] = (rest[1:] != rest[:-1]).any(1) & ~head[1:]
        if not differs.any():
            break
        run = np.cumsum(head) - 1
        mixed = np.logical_or.reduceat(differs, heads)[run]
        at, run, rest = at[mixed], run[mixed], rest[mixed, 0]
        by = np.lexsort([rest, run])
        order[at] = order[at][by]
        rest = rest[by]
        equal[at] = np.concatenate([[False], (run[1:] == run[:-1]) & (rest[1:] == rest[:-1])])
    return order, equal


def _spans(doc: np.ndarray, copy: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Hit windows as one row for each document, with packed (start, end) pairs of their union."""
    order = np.lexsort([start, copy, doc])
    doc, copy, start = doc[order], copy[order], start[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (start[1:] > start[:-1] + LENGTH)
    at = np.flatnonzero(fresh)
    ends = np.concatenate([at[1:], [len(doc)]]) - 1 if len(at) else at
    pairs = np.stack([start[at], start[ends] + LENGTH], 1) if len(at) else np.empty((0, 2), np.int64)
    d, c = doc[at], copy[at]
    edge = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])])) if len(d) else at
    return pd.DataFrame({"doc": d[edge], "copy": c[edge], "spans": [x.astype(np.int64).tobytes() for x in np.split(pairs, edge[1:])] if len(d) else []})


_SPANS = "doc long, copy int, spans binary"
#: Windows that a bucket sorts at once: groups of one anchor are never parted.
SORT_WINDOWS = 400_000


def _padded(raw: pd.Series, back: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs as byte rows: their anchor, their bytes, filled up with zeros, and their size (for bytes that are zero themselves)."""
    flat, begins = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes
    width = -(-int(sizes.max()) // 8) * 8
    rows = np.zeros((len(sizes), ANCHOR + width + 8), np.uint8)
    inside = np.arange(width) < sizes[:, None]
    rows[:, ANCHOR : ANCHOR + width][inside] = flat
    rows[:, :ANCHOR] = flat[(begins + back)[:, None] + np.arange(ANCHOR)]
    rows[:, -1] = sizes
    return rows


def _resolve(group: pd.DataFrame) -> pd.DataFrame:
    """The windows of a bucket that stand in a document before. Runs with equal bytes are settled as one."""
    if not len(group):
        return _spans(*(np.empty(0, np.int64),) * 3)
    sizes = np.fromiter(map(len, group["bytes"]), np.int64, len(group))
    rows = _padded(group["bytes"], group["back"].to_numpy(np.int64), sizes)
    order, equal = multikey_sort(rows)  # by the anchor, then the run
    doc, copy, start = (group[c].to_numpy(np.int64)[order] for c in ("doc", "copy", "start"))
    n = sizes[order] - LENGTH + 1
    text, heads = np.cumsum(~equal) - 1, np.flatnonzero(~equal)
    least, texts, counts = np.minimum.reduceat(doc, heads), rows[order[heads]], n[heads]
    begin = np.cumsum(counts) - counts
    first = np.repeat(least, counts)  # of each window of each text
    edges = np.append(_edges(*texts[:, :ANCHOR].copy().view(np.uint64).T), len(heads))
    several = np.flatnonzero(np.diff(edges) > 1)  # anchors of several texts: only there windows of different runs can be equal
    windows = np.add.reduceat(counts, edges[:-1])[several]
    flat = np.lib.stride_tricks.sliding_window_view(texts.reshape(-1), LENGTH)
    lo = 0
    while lo < len(several):  # several anchors at once, as many as fit
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(windows[lo:]), SORT_WINDOWS, "right")) + lo)
        runs = np.concatenate([np.arange(edges[k], edges[k + 1]) for k in several[lo:hi]])
        owner = np.repeat(runs, counts[runs])
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts[runs]) - counts[runs], counts[runs])
        by, same = multikey_sort(flat[owner * texts.shape[1] + ANCHOR + inner])
        best = np.minimum.reduceat(least[owner[by]], np.flatnonzero(~same))
        first[(begin[owner] + inner)[by]] = best[np.cumsum(~same) - 1]
        lo = hi
    out = []
    for lo in range(0, len(doc), 50_000):
        part = np.arange(lo, min(lo + 50_000, len(doc)))
        owner = np.repeat(part, n[part])
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        hit = doc[owner] > first[begin[text[owner]] + inner]
        out.append((doc[owner[hit]], copy[owner[hit]], (start[owner] + inner)[hit]))
    return _spans(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _whole_copies(rows: DataFrame) -> DataFrame:
    """(doc, copy, n) of documents whose whole text, of n bytes, is that of a document of smaller id, and long enough to go.

    Texts are told apart by SHA-256. The first documents are a written table: the join shuffles both sides for itself, and a
    text with very many copies can be split among tasks.
    """
    keyed = rows.select("doc", "copy", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n")).where(F.col("n") >= LENGTH)
    first = materialize(keyed.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last"))
    return keyed.join(first, "digest").where("doc > first").select("doc", "copy", "n").distinct()


def covered(rows: DataFrame) -> DataFrame:
    """(doc, copy, spans): packed pairs of the byte ranges, of each document that has any, that stand in a document before."""
    parts = input_parts(rows, 6)  # buckets follow the input, so that one stays within a task's memory
    splitters, frequent = _sample(rows, parts)
    copies = materialize(_whole_copies(rows))
    # Copies of whole documents are covered from end to end; what the others share with them stands in the first one too, so they
    # are left out: where texts are read, if they can be sent there, or of what is joined.
    few = copies.limit(SENT_COPIES + 1).count() <= SENT_COPIES
    left = rows.join(F.broadcast(copies.select("doc", "copy")), ["doc", "copy"], "left_anti") if few else rows
    shared = materialize(_shared_anchors(left, input_parts(rows), frequent))
    joined = left.join(shared if few else shared.join(copies, ["doc", "copy"], "left_anti"), ["doc", "copy"])
    # A round moves the texts, and the suffixes of its buckets only; what it moved is deleted at its end.
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rounds = min(parts, max(1, -(-size // ROUND_BYTES)))
    settled = [materialize(_suffixes(joined, splitters, k, rounds).repartition(parts, "bucket").groupBy("bucket").applyInPandas(_resolve, _SPANS)) for k in range(rounds)]
    discard(shared)
    resolved = reduce(DataFrame.unionByName, settled)
    if len(frequent):
        resolved = resolved.unionByName(_frequent(left, frequent))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["doc", "copy"]].assign(spans=[np.array([0, n], np.int64).tobytes() for n in b["n"]])

    resolved = resolved.unionByName(copies.mapInPandas(whole, _SPANS))
    return resolved.groupBy("doc", "copy").agg(F.collect_list("spans").alias("spans"))


def _union(spans: list[bytes]) -> np.ndarray:
    pairs = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    at = np.flatnonzero(new)
    return np.stack([pairs[at, 0], np.concatenate([reach[at[1:] - 1], reach[-1:]])], 1)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, removed (array of byte ranges start, end) and kept (the remaining bytes).

    A byte goes if a 50-byte string that covers it also starts in a document of smaller doc_id. Null text is empty; texts
    under 50 bytes lose nothing; very long ones are taken whole; documents with one id keep what only they share; null
    ids count as least; an empty table gives no rows; further columns, whatever their names, are not read.
    """
    rows = _prepare(docs)
    joined = rows.join(covered(rows), ["doc", "copy"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes, removed, kept = [], [], []
            for text, spans in zip(b["text"], b["spans"], strict=True):
                raw = utf8(text)
                ranges = _union(list(spans)).tolist() if spans is not None and len(spans) else []
                at, parts = 0, []
                for s, e in ranges:
                    parts.append(raw[at:s])
                    at = e
                sizes.append(len(raw))
                removed.append([{"start": s, "end": e} for s, e in ranges])
                kept.append(b"".join([*parts, raw[at:]]))
            ids = b["doc"].astype("Int64").mask(b["doc"] == _NULL)
            yield pd.DataFrame({"doc_id": ids, "n_bytes": sizes, "removed": removed, "kept": kept})

    return joined.mapInPandas(run, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def query(spark, sf_dir):
    """op3_suffix_dedup."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
