"""Language-model scores: an interpolated trigram model with modified Kneser-Ney discounts, counted by Spark and kept as sorted hash arrays.

Rounds of counting, each a shuffle of packed integer arrays by hash shard, where a shard holds what follows from a bounded number of
tokens: words; trigrams; and of the distinct trigrams of a shard, by pair, the words that stand before it, and what it has as a
context. So no key is whole in one place before it was counted in many. Last, what each word has as an ending and as a context is
added up in groups of FAN shards. Words are numbered by the order of magnitude of their counts, which keeps packed numbers short.

Each shard writes its part of the model to the shared folder: sorted arrays of hashes, and beside them codes of the counts that belong
to them. A hash goes by its shard, its bucket in it (from the upper bits) and 32 further bits, which are what is stored. Workers map
these files into memory and look up the grams of many documents at once, in the order of the hashes. Every count is kept, so the
model grows with the corpus.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.llm._common import discard, input_parts, materialize, shared_dir, table

#: Training tokens of a shard; words of a block; tokens that a task counts, or scores, at once.
SHARD_TOKENS, BLOCK, COUNTED, SCORED = 2_000_000, 250_000, 1_500_000, 500_000
#: Packed parts that are added up at once; bits of a shard's hashes that name a bucket; orders of magnitude of counts.
FAN, BUCKET, MAGNITUDES = 256, 16, 48
#: Texts that are split at once.
ROWS_AT_ONCE = 128
#: A token of its own: no word holds white space.
END = b"\n"
#: Discounts for counts of 1, 2 and more, where the counts of counts give none.
DISCOUNTS = (0.5, 1.0, 1.5)

_WORD = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BLOBS = "shard long, kind string, blob binary, counts array<long>"


def tokens(text: bytes) -> list[bytes]:
    """Words between white space, A-Z lower-cased, and one end."""
    return [*text.lower().split(), END]


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits, well mixed; different for different x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a hash, ascending with it: what h * shards has beyond 64 bits."""
    n = np.uint64(shards)
    return (((h >> _WORD) * n + (((h & _LOW) * n) >> _WORD)) >> _WORD).astype(np.int64)


def gram(pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(pair) + (word.astype(np.uint64) + np.uint64(1)) * _GOLDEN)


def cells(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes in one shard, their bucket and the 32 bits that follow: both together ascend with the hash."""
    within = h * np.uint64(shards)  # the 64 bits below the shard
    return (within >> np.uint64(64 - BUCKET)).astype(np.int64), ((within >> np.uint64(32 - BUCKET)) & _LOW).astype(np.uint32)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, the first of them ascending: by byte planes, compressed."""
    n = len(columns[0])
    wide = [c.astype("<u8") for c in columns]
    wide[0] = np.diff(wide[0], prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.int64(n).tobytes() + b"".join(c.view(np.uint8).reshape(n, 8).T.tobytes() for c in wide))


def unpack(blob: bytes, k: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(k, 8, n)
    out = [np.ascontiguousarray(p.T).view("<u8").reshape(n) for p in planes]
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def merged(blobs: list[bytes], k: int) -> list[np.ndarray]:
    parts = [unpack(b, k) for b in blobs]
    return [np.concatenate([np.empty(0, np.uint64), *(p[j] for p in parts)]) for j in range(k)]


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal keys."""
    differs = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        differs |= k[1:] != k[:-1]
    cuts = [0, *(np.flatnonzero(differs) + 1).tolist(), len(keys[0])]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if len(keys[0]) else []


def summed(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of each column."""
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key)
        key, columns = key[order], [c[order] for c in columns]
    if not len(key):
        return key, *(np.empty(0, np.int64) for _ in columns)
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[begins], *(np.add.reduceat(c.astype(np.int64), begins) for c in columns)


def encode(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, table): of each row the number of its values in a table of the distinct rows. Most rows are of small numbers, and go by a table of those."""
    small = np.logical_and.reduce([c < 8 for c in columns])
    packed = sum(np.where(small, c, 0).astype(np.int64) << 3 * k for k, c in enumerate(columns))
    there = np.flatnonzero(np.bincount(packed[small], minlength=1))
    number = np.zeros(int(there[-1]) + 1 if len(there) else 1, np.int64)
    number[there] = np.arange(len(there))
    large = np.flatnonzero(~small)
    more, which = np.unique(np.stack([np.asarray(c, np.int64)[large] for c in columns], 1), axis=0, return_inverse=True)
    code = number[packed]
    code[large] = len(there) + which.reshape(-1)
    values = np.concatenate([np.stack([there >> 3 * k & 7 for k in range(len(columns))], 1), more])
    return code.astype(np.min_scalar_type(max(len(values) - 1, 0))), values


def _write(path: str, array: np.ndarray) -> None:
    """A task that runs twice writes the same file twice; it shows only when whole."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def _mapped(path: str) -> np.ndarray | None:
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


def _store(folder: str, level: str, shard: int, shards: int, h: np.ndarray, *columns: np.ndarray) -> None:
    if (h[1:] < h[:-1]).any():
        order = np.argsort(h)
        h, columns = h[order], [c[order] for c in columns]
    bucket, keys = cells(h, shards)
    codes, values = encode(*columns)
    begins = np.searchsorted(bucket, np.arange(2**BUCKET + 1)).astype(np.uint32)
    for part, array in (("begins", begins), ("keys", keys), ("codes", codes), ("table", values)):
        _write(f"{folder}/{level}-{shard}.{part}.npy", array)


def ascending(h: np.ndarray) -> np.ndarray:
    """The places of hashes in their order, by as many of the upper bits as leave room for a place: enough for shards and for near reads."""
    bits = np.uint64(max(1, (len(h) - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    return (np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)


def look_up(folder: str, level: str, shards: int, h: np.ndarray, width: int) -> np.ndarray:
    """(hashes, width): the counts of each hash, zeros where it is not in the model. One mapped shard after the other, hashes ascending;
    all of a shard are searched at once, each between the bounds of its bucket."""
    out = np.zeros((len(h), width), np.int64)
    order = ascending(h)
    shard = shard_of(h[order], shards)
    for lo, hi in _runs(shard):
        name = f"{folder}/{level}-{shard[lo]}"
        keys = _mapped(f"{name}.keys.npy")
        if keys is None or not len(keys):
            continue
        rows = order[lo:hi]
        bucket, key = cells(h[rows], shards)
        begins = _mapped(f"{name}.begins.npy")
        first, last = begins[bucket].astype(np.int64), begins[bucket + 1].astype(np.int64)
        end = last.copy()
        while (open_ := first < last).any():
            middle = (first + last) >> 1
            less = open_ & (keys[np.minimum(middle, len(keys) - 1)] < key)
            first, last = np.where(less, middle + 1, first), np.where(less, last, np.where(open_, middle, last))
        at = np.minimum(first, len(keys) - 1)
        found = (first < end) & (keys[at] == key)
        out[rows[found]] = np.load(f"{name}.table.npy")[_mapped(f"{name}.codes.npy")[at[found]]]
    return out


class Vocabulary:
    """The words of training documents: numbers by the magnitude of their counts, then by hash; and counts."""

    def __init__(self, folder: str):
        self.folder = folder
        self.begins = np.load(f"{folder}/words.npy")  # (MAGNITUDES, shards)

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, counts); -1 and 0 for a word that is not there."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        order = np.argsort(h)
        shard = shard_of(h[order], self.begins.shape[1])
        for lo, hi in _runs(shard):
            name, s = f"{self.folder}/word-{shard[lo]}", shard[lo]
            keys = _mapped(f"{name}.keys.npy")
            if keys is None or not len(keys):
                continue
            rows = order[lo:hi]
            at = np.minimum(np.searchsorted(keys, h[rows]), len(keys) - 1)
            found = keys[at] == h[rows]
            at, rows = at[found], rows[found]
            counts[rows] = _mapped(f"{name}.counts.npy")[at]
            ids[rows] = self.begins[magnitude(counts[rows]), s] + _mapped(f"{name}.ranks.npy")[at]
        return ids, counts


def magnitude(n: np.ndarray) -> np.ndarray:
    """0 for the largest counts, MAGNITUDES - 1 for a count of 1."""
    return MAGNITUDES - np.maximum(np.minimum(np.frexp(n)[1], MAGNITUDES), 1)


def _numbers(parts: list[pa.ListArray]) -> tuple[list[bytes], list[np.ndarray]]:
    """(distinct tokens, of each document the numbers of its tokens) of the split texts of documents."""
    lengths = np.concatenate([pa.compute.list_value_length(p).to_numpy(zero_copy_only=False) for p in parts])
    coded = pa.concat_arrays([p.flatten() for p in parts]).dictionary_encode()
    ids, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.binary()).to_pylist()
    doc = np.repeat(np.arange(len(lengths)), lengths)
    if b"" in words:  # what stands before and after white space at the ends of a text
        blank = words.index(b"")
        words.pop(blank)
        doc, ids = doc[ids != blank], ids[ids != blank]
        ids -= ids > blank
    counts = np.bincount(doc, minlength=len(lengths))
    ids = np.insert(ids, np.cumsum(counts), len(words))
    return [*words, END], np.split(ids, np.cumsum(counts + 1)[:-1])


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[bytes], list[np.ndarray], pa.Table]]:
    """(distinct tokens, of each document the numbers of its tokens, their rows without texts), for about ``size`` tokens at a time.
    As ``tokens`` has them: texts are split, and their tokens numbered, by Arrow."""
    parts, rows, held = [], [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            some = batch.slice(k, ROWS_AT_ONCE)
            parts.append(pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(some.column("text"))))
            rows.append(some.drop_columns(["text"]))
            held += len(parts[-1].flatten())
            if held >= size:
                yield *_numbers(parts), pa.Table.from_batches(rows)
                parts, rows, held = [], [], 0
    if parts:
        yield *_numbers(parts), pa.Table.from_batches(rows)


def _blob_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["shard", "kind", "blob", "counts"])


def _dealt(kind: str, shard: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Rows of packed columns, one for each shard; the order of what comes is kept within it."""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 2**16 else shard, kind="stable")
    shard, columns = shard[order], [c[order] for c in columns]
    return [(int(shard[lo]), kind, pack(*(c[lo:hi] for c in columns)), None) for lo, hi in _runs(shard)]


def _count_words(shards: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, docs, _ in _slices(batches, COUNTED):
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            order = np.argsort(h)
            n = np.bincount(np.concatenate(docs), minlength=len(words))
            yield _blob_rows(_dealt("words", shard_of(h[order], shards), h[order], n[order]))

    return count


def _merge_words(folder: str):
    def merge(key: tuple, group: pa.Table) -> pa.Table:
        s = key[0].as_py()
        h, n = summed(*merged(group["blob"].to_pylist(), 2))
        size, ranks = magnitude(n), np.empty(len(n), np.uint32)
        for k in np.unique(size):
            ranks[size == k] = np.arange((size == k).sum())
        for part, array in (("keys", h), ("counts", n), ("ranks", ranks)):
            _write(f"{folder}/word-{s}.{part}.npy", array)
        return pa.Table.from_batches([_blob_rows([(s, "size", None, [int(n.sum()), *np.bincount(size, minlength=MAGNITUDES).tolist()])])])

    return merge


def padded(docs: list[np.ndarray], ids: np.ndarray, begin: int) -> np.ndarray:
    """The numbers of all tokens, with two begins before each document."""
    lead = np.array([begin, begin], np.int64)
    return np.concatenate([x for d in docs for x in (lead, ids[d])])


def _grams(x: np.ndarray, begin: int) -> tuple[np.ndarray, ...]:
    """(first, second, third, n) of the distinct trigrams of ``x``, ascending; numbers go up to ``begin``."""
    x, bits = x.astype(np.uint64), np.uint64(begin.bit_length())
    own = np.flatnonzero(x[2:] != begin)
    u, v, w = x[own], x[own + 1], x[own + 2]
    if 3 * bits <= 64:
        key = np.sort((u << (bits + bits)) | (v << bits) | w)
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n, key, low = np.diff(np.append(begins, len(key))), key[begins], (np.uint64(1) << bits) - np.uint64(1)
        return key >> (bits + bits), (key >> bits) & low, key & low, n
    order = np.lexsort((w, v, u))
    u, v, w = u[order], v[order], w[order]
    begins = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
    return u[begins], v[begins], w[begins], np.diff(np.append(begins, len(w)))


def _count_grams(folder: str, shards: int, begin: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(folder)
        for words, docs, _ in _slices(batches, COUNTED):
            ids = vocabulary.find(words)[0]
            order = np.argsort(ids)
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            *own, n = _grams(padded(docs, place, len(ids)), len(ids))
            names = np.append(ids[order], begin).astype(np.uint64)
            u, v, w = (names[x] for x in own)
            pair = (u << _WORD) | v
            yield _blob_rows(_dealt("grams", shard_of(gram(pair, w), shards), pair, w, n))

    return count


def _steps(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _merge_grams(folder: str, shards: int):
    """Of a shard of trigrams: themselves into the model; on to their pairs what these have in them as a context, and the distinct words before them."""

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        s = key[0].as_py()
        pair, w, n = merged(group["blob"].to_pylist(), 3)
        h = gram(pair, w)
        order = np.argsort(h)
        h = h[order]
        begins = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        c = np.add.reduceat(n[order].astype(np.int64), begins)
        h, pair, w = h[begins], pair[order[begins]], w[order[begins]]
        _store(folder, "three", s, shards, h, c)
        context, *values = summed(pair, c, c == 1, c == 2, c >= 3)
        ends, before = np.unique((pair & _LOW) << _WORD | w, return_counts=True)
        rows = [(s, "counts", None, _steps(c)), *_dealt("contexts", shard_of(mixed(context), shards), context, *values), *_dealt("pairs", shard_of(mixed(ends), shards), ends, before)]
        return pa.Table.from_batches([_blob_rows(rows)])

    return merge


def _aligned(keys: np.ndarray, *parts: tuple[np.ndarray, list[np.ndarray]]) -> list[np.ndarray]:
    """The columns of each part, over all ``keys``: zeros where the part has no such key."""
    out = []
    for own, columns in parts:
        at = np.searchsorted(keys, own)
        for c in columns:
            out.append(np.zeros(len(keys), np.int64))
            out[-1][at] = c
    return out


def _merge_pairs(folder: str, shards: int):
    """Of a shard of pairs: what they have as endings and as contexts into the model; what words have in them on to the words."""

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        s = key[0].as_py()
        kinds, blobs = group["kind"].to_pylist(), group["blob"].to_pylist()
        of = lambda kind, k: summed(*merged([b for b, x in zip(blobs, kinds, strict=True) if x == kind], k))
        pair, a = of("pairs", 2)
        context, *rest = of("contexts", 5)
        keys = np.union1d(pair, context)
        _store(folder, "two", s, shards, mixed(keys), *_aligned(keys, (pair, [a]), (context, rest)))
        ends, types = np.unique(pair & _LOW, return_counts=True)
        first, *values = summed(pair >> _WORD, a, a == 1, a == 2, a >= 3)
        ids = np.union1d(ends, first)
        own = _aligned(ids, (ends, [types]), (first, values))
        rows = [(s, "counts", None, _steps(a)), *((b, f"{s // FAN}", blob, None) for b, _, blob, _ in _dealt("words", (ids // np.uint64(BLOCK)).astype(np.int64), ids, *own))]
        return pa.Table.from_batches([_blob_rows(rows)])

    return merge


def _ends_of(block: int, blobs: list[bytes]) -> list[np.ndarray]:
    """What the words of a block have as endings and as contexts, by number: added up one packed part after the other."""
    dense = [np.zeros(BLOCK, np.int64) for _ in range(5)]
    for blob in blobs:
        ids, *columns = unpack(blob, 6)
        at = (ids - np.uint64(block * BLOCK)).astype(np.int64)
        for d, c in zip(dense, columns, strict=True):
            d[at] += c.astype(np.int64)
    return dense


def _add_ends(key: tuple, group: pa.Table) -> pa.Table:
    """FAN packed parts of a block as one."""
    block, part = key[0].as_py(), int(key[1].as_py())
    dense = _ends_of(block, group["blob"].to_pylist())
    there = np.flatnonzero(np.logical_or.reduce([d > 0 for d in dense]))
    return pa.Table.from_batches([_blob_rows([(block, f"{part // FAN}", pack(there.astype(np.uint64) + np.uint64(block * BLOCK), *(d[there] for d in dense)), None)])])


def _merge_ends(folder: str):
    """Of a block of words: what they have as endings and as contexts."""

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        block = key[0].as_py()
        dense = _ends_of(block, group["blob"].to_pylist())
        codes, values = encode(*dense)
        _write(f"{folder}/one-{block}.codes.npy", codes)
        _write(f"{folder}/one-{block}.table.npy", values)
        a = dense[0]
        return pa.Table.from_batches([_blob_rows([(block, "counts", None, [*_steps(a), int((a >= 3).sum()), int(a.sum())])])])

    return merge


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """For counts of 1, 2 and more, from the counts of counts; DISCOUNTS where one of these is 0."""
    if not (n1 and n2 and n3 and n4):
        return DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _added(rows: DataFrame, n: int) -> list[int]:
    """Sums of the counts over the shards."""
    sums = rows.where("kind IN ('counts', 'size')").agg(*[F.coalesce(F.sum(F.get("counts", F.lit(k))), F.lit(0)) for k in range(n)]).first()
    return [int(v) for v in sums]


def model_folder(spark) -> str:
    """A new folder in the shared one. Workers map files in it, so it must be mounted wherever tasks run."""
    shared = shared_dir(spark)
    scheme, _, path = shared.partition(":") if "://" in shared or shared.startswith("file:") else ("file", "", shared)
    if scheme != "file":
        raise ValueError(f"the model is mapped into memory: spark.checkpoint.dir must name a mounted folder, not {shared}")
    folder = f"/{path.lstrip('/')}/kneser-ney-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def fit(docs: DataFrame) -> str:
    """Count the model over all rows of ``docs`` (column text); the folder that holds it. Sums over shards are all that the driver sees."""
    spark = docs.sparkSession
    folder = model_folder(spark)
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = input_parts(docs)
    sizes = materialize(texts.mapInArrow(_count_words(parts), _BLOBS).groupBy("shard").applyInArrow(_merge_words(folder), _BLOBS))
    at = {r[0]: r[1][1:] for r in sizes.select("shard", "counts").collect()}  # a row a shard
    size = np.array([at.get(s, [0] * MAGNITUDES) for s in range(parts)]).T.reshape(-1)
    words, n = int(size.sum()), _added(sizes, 1)[0]
    if words >= 2**32 - 1:
        raise ValueError("a model numbers its words by 32 bits")
    np.save(f"{folder}/words.npy", (np.cumsum(size) - size).reshape(MAGNITUDES, parts))
    shards = max(1, -(-n // SHARD_TOKENS))
    grams = materialize(texts.mapInArrow(_count_grams(folder, shards, words), _BLOBS).groupBy("shard").applyInArrow(_merge_grams(folder, shards), _BLOBS))
    pairs = materialize(grams.where("kind != 'counts'").groupBy("shard").applyInArrow(_merge_pairs(folder, shards), _BLOBS))
    ends, parted = pairs.where("kind != 'counts'"), -(-shards // FAN)
    while parted > 1:
        ends, parted = ends.groupBy("shard", "kind").applyInArrow(_add_ends, _BLOBS), -(-parted // FAN)
    ends = materialize(ends.groupBy("shard").applyInArrow(_merge_ends(folder), _BLOBS))
    one = _added(ends, 6)
    model = {"tokens": n, "words": words, "shards": shards, "discounts": [discounts(*one[:4]), discounts(*_added(pairs, 4)), discounts(*_added(grams, 4))], "ends": [one[0], one[1], one[4], one[5]]}
    with open(f"{folder}/model.json", "w") as f:
        json.dump(model, f)
    discard(sizes, grams, pairs, ends)
    return folder


class Model:
    """A fitted model, mapped from its folder."""

    def __init__(self, folder: str):
        self.folder = folder
        with open(f"{folder}/model.json") as f:
            model = json.load(f)
        self.tokens, self.words, self.shards, self.discounts = model["tokens"], model["words"], model["shards"], model["discounts"]
        n1, n2, n3, total = model["ends"]
        d = self.discounts[0]
        self.total = total
        self.uniform = ((d[0] * n1 + d[1] * n2 + d[2] * n3) / total if total else 1.0) / (self.words + 1)
        self.vocabulary = Vocabulary(folder)

    def less(self, order: int, n: np.ndarray) -> np.ndarray:
        """Counts after their discount."""
        return n - np.array([0.0, *self.discounts[order - 1]])[np.minimum(n, 3)]

    def left(self, order: int, total: np.ndarray, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray) -> np.ndarray:
        """The share that a context leaves to the order below; 1 for one that was not seen."""
        d = self.discounts[order - 1]
        return np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / np.maximum(total, 1), 1.0)

    def log10(self, docs: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token of documents in turn, after the two before it. Documents are given by numbers of
        words, whose numbers in the model are ``ids`` (-1: unknown)."""
        begin = len(ids)
        x, ids = padded(docs, np.arange(begin), begin), np.append(ids, self.words)
        own = np.flatnonzero(x[2:] != begin) + 2
        ones = np.zeros((len(ids), 5), np.int64)
        block = np.where(ids >= 0, ids // BLOCK, -1)
        for b in np.unique(block[block >= 0]):
            if (codes := _mapped(f"{self.folder}/one-{b}.codes.npy")) is not None:
                rows = np.flatnonzero(block == b)
                ones[rows] = np.load(f"{self.folder}/one-{b}.table.npy")[codes[ids[rows] % BLOCK]]
        p1 = self.less(1, ones[:, 0]) / max(self.total, 1) + self.uniform
        left2, total2 = self.left(2, *ones[:, 1:].T), ones[:, 1]
        # Pairs: each is an ending here, and the context of the next token.
        known = (ids >= 0)[x]
        y = np.maximum(ids, 0).astype(np.uint64)[x]
        pair, known = (y[:-1] << _WORD) | y[1:], known[:-1] & known[1:]
        twos = np.zeros((len(pair), 5), np.int64)
        twos[known] = look_up(self.folder, "two", self.shards, mixed(pair[known]), 5)
        v, w, ending, context = x[own - 1], x[own], twos[own - 1], twos[own - 2]
        p2 = np.where(total2[v] > 0, self.less(2, ending[:, 0]) / np.maximum(total2[v], 1) + left2[v] * p1[w], p1[w])
        total3 = context[:, 1]
        seen = np.flatnonzero((total3 > 0) & (ending[:, 0] > 0))  # a trigram of the model ends with a pair of the model
        count = np.zeros(len(own), np.int64)
        count[seen] = look_up(self.folder, "three", self.shards, gram(pair[own[seen] - 2], y[own[seen]]), 1)[:, 0]
        return np.log10(np.where(total3 > 0, self.less(3, count) / np.maximum(total3, 1) + self.left(3, *context[:, 1:].T) * p2, p2))


def _score(folder: str):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(folder)
        for words, docs, rows in _slices(batches, SCORED):
            ids, counts = model.vocabulary.find(words)
            lengths = np.array([len(d) for d in docs], np.int64)
            begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            flat = np.concatenate(docs)
            base = np.log10((counts + 1) / (model.tokens + model.words + 1))[flat]
            logs = model.log10(docs, ids)
            total = np.add.reduceat(logs, begins)
            columns = (rows["doc_id"].combine_chunks(), rows["held_out"].combine_chunks(), lengths, np.add.reduceat((counts > 0)[flat].astype(np.int64), begins), np.full(len(docs), model.tokens), np.add.reduceat(base, begins), total, 10.0 ** np.minimum(-total / lengths, 300.0))
            kinds = (pa.int64(), pa.bool_(), *(pa.int64(),) * 3, *(pa.float64(),) * 3)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return score


def score(docs: DataFrame, folder: str, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row of ``docs``, by the model in ``folder``.

    score is log10 of the probability of the whole text with its end, perplexity 10 ** (-score / n_tokens), base_score the same of
    single words with one added to each count. Null texts are empty, and an empty text is an end; texts of any length are scored
    whole; a null doc_id stays null; repeated rows give a row each; a model of no documents gives every token the same share; of
    an empty table there are no rows. Other columns, whatever their names, play no part.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(_score(folder), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def query(spark, sf_dir):
    """op12_lm_scores: documents whose crc32(doc_id) leaves 2 by 7 are held out; one without an id is not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score(docs, fit(docs.where(~held_out)), held_out)
