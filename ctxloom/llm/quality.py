"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pair sum is taken in linear time as
1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

The model is fitted on the driver from at most ``max_train_rows`` labelled rows (a documented bound); every document is
scored, from its whole text, in one map over the input without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.llm._common import map_in_pandas, utf8

WORD_BITS = 15
BINS = 12
#: Upper edges of the bins of each structure statistic; a value falls in the first bin whose edge it does not exceed.
_RATIO = (0.0, 0.01, 0.03, 0.06, 0.1, 0.16, 0.25, 0.4, 0.6, 0.8, 0.95)
_COUNT = (0, 1, 3, 10, 30, 100, 300, 1000, 3000, 10000, 100000)
_LENGTH = (0, 1, 2, 3, 4, 5, 6, 8, 10, 15, 30)
STATS = {
    "upper": _RATIO, "digit": _RATIO, "symbol": _RATIO, "space": _RATIO, "non_ascii": _RATIO, "unique_words": _RATIO,
    "adjacent_repeats": _RATIO, "top_word": _RATIO, "marked_words": _RATIO, "unique_lines": _RATIO, "ended_lines": _RATIO,
    "word_length": _LENGTH, "words": _COUNT, "lines": _COUNT, "words_per_line": _COUNT, "n_chars": _COUNT,
}
N_STATS = len(STATS) * (BINS + 1)
N_FEATURES = N_STATS + (1 << WORD_BITS)
#: Features of documents that are scored at once.
AT_ONCE = 100_000

_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[128:] = 5
_WORDLIKE = re.compile(r"\w[\w'-]*[.,;:]?")


def structure(text: str, words: list[str], counts: Counter, n_chars: float | None) -> list[float]:
    """The statistics named in STATS, in that order; nan where undefined."""
    raw = np.frombuffer(utf8(text), np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=6) / max(len(raw), 1)
    n = len(words)
    lines = text.split("\n")
    repeats = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    marked = sum(c for w, c in counts.items() if not _WORDLIKE.fullmatch(w))
    ratio = lambda a, b: a / b if b else float("nan")
    return [
        kinds[3], kinds[2], kinds[0], kinds[1], kinds[5], ratio(len(counts), n), ratio(repeats, n - 1),
        ratio(max(counts.values(), default=0), n), ratio(marked, n), ratio(len(set(lines)), len(lines)),
        ratio(sum(x.rstrip().endswith((".", "!", "?", ":")) for x in lines), len(lines)),
        ratio(sum(len(w) * c for w, c in counts.items()), n), n, len(lines), ratio(n, len(lines)),
        float("nan") if n_chars is None or n_chars != n_chars else n_chars,
    ]


def features(text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document: one bin for each statistic, and its lower-cased words, hashed, with unit norm."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    stats = structure(text, words, counts, n_chars)
    bins = [
        k * (BINS + 1) + (BINS if value != value else int(np.searchsorted(edges, value)))
        for k, (value, edges) in enumerate(zip(stats, STATS.values(), strict=True))
    ]
    hashed: dict[int, int] = {}
    for word, c in counts.items():
        h = N_STATS + (zlib.crc32(utf8(word.lower())) & ((1 << WORD_BITS) - 1))
        hashed[h] = hashed.get(h, 0) + c
    idx = np.fromiter((*bins, *hashed), np.int32, len(bins) + len(hashed))
    tf = np.log1p(np.fromiter(hashed.values(), np.float32, len(hashed)))
    norm = float(np.sqrt((tf * tf).sum())) or 1.0
    return idx, np.concatenate([np.full(len(bins), 0.5, np.float32), tf / norm])


@dataclass
class FactorisationMachine:
    """bias, linear weights w and factors v (features x rank)."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid of documents whose features begin at ``starts``; each has at least one."""
        vx = self.v[idx] * val[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), starts)
        return self.bias + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * ((total * total).sum(1) - squares)

    def score(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(idx, val, starts), -30, 30).astype(np.float64)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 8, epochs: int = 12, rate: float = 0.08, l2: float = 2e-4, batch: int = 64, seed: int = 7) -> FactorisationMachine:
    """Adagrad on the logistic loss. With one class only, or no rows, the model is the smoothed base rate."""
    rng = np.random.default_rng(seed)
    base = (float(labels.sum()) + 1) / (len(labels) + 2)
    fm = FactorisationMachine(float(np.log(base / (1 - base))), np.zeros(N_FEATURES, np.float32), rng.normal(0, 0.02, (N_FEATURES, rank)).astype(np.float32))
    if len(labels) == 0 or labels.min() == labels.max():
        fm.v[:] = 0
        return fm
    gw, gv, gb = np.full(N_FEATURES, 1e-3, np.float32), np.full((N_FEATURES, rank), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            sizes = np.array([len(rows[i][0]) for i in part])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            idx, val = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            err = ((fm.score(idx, val, starts) - labels[part]) / len(part)).astype(np.float32)
            each = np.repeat(err, sizes)
            vx = fm.v[idx] * val[:, None]
            total = np.repeat(np.add.reduceat(vx, starts, axis=0), sizes, axis=0)
            dv = each[:, None] * val[:, None] * (total - vx)
            order = np.argsort(idx, kind="stable")
            used, at = np.unique(idx[order], return_index=True)
            dw = np.add.reduceat((each * val)[order], at) + l2 * fm.w[used]
            dv = np.add.reduceat(dv[order], at, axis=0) + l2 * fm.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += float(err.sum()) ** 2
            fm.w[used] -= rate * dw / np.sqrt(gw[used])
            fm.v[used] -= rate * dv / np.sqrt(gv[used])
            fm.bias -= rate * float(err.sum()) / gb**0.5
    return fm


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold never learned from: crc32 of the id as text, modulo 5, is 0 (a null id is held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = 6000) -> FactorisationMachine:
    """Fit on at most ``max_train_rows`` labelled documents outside the held-out fold, the first by a hash of the id.

    Rows with a null label are ignored; of repeated labels of one document the mean counts, of repeated documents the
    text with the least hash. lang, source and doc_id are no features; of further columns none but n_chars is read. A
    document's features are hashed, so what comes to the driver is bounded, whatever the texts' length.
    """
    picked = (
        labels.where(~held_out() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.avg("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    )
    schema = "doc_id string, hash long, label double, idx array<int>, val array<float>"

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [features(t, n) for t, n in zip(b["text"], b["n_chars"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype(str), "hash": b["hash"], "label": b["label"], "idx": [x[0] for x in got], "val": [x[1] for x in got]})

    found = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), _n_chars(docs)).join(F.broadcast(picked), "doc_id")
    # Of rows that share an id one text counts, so what comes to the driver is bounded by the labels.
    found = found.groupBy("doc_id").agg(F.min("hash").alias("hash"), F.min_by(F.struct("text", "n_chars", "label"), "hash").alias("r")).select("doc_id", "r.text", "hash", "r.n_chars", "r.label")
    rows = found.mapInPandas(featurise, schema).toPandas()
    rows = rows.sort_values(["doc_id", "hash"], kind="stable").drop_duplicates("doc_id")
    return fit([(np.asarray(i, np.int32), np.asarray(v, np.float32)) for i, v in zip(rows["idx"], rows["val"], strict=True)], (rows["label"].to_numpy(float) >= 0.5).astype(np.float32))


def _n_chars(docs: DataFrame) -> Column:
    return (F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")).alias("n_chars")


def _scores(fm: FactorisationMachine, rows: pd.DataFrame) -> np.ndarray:
    """The scores of a batch, some AT_ONCE features at a time."""
    out, held, size = [np.empty(0)], [], 0
    n_chars = rows["n_chars"] if "n_chars" in rows else [None] * len(rows)

    def flush() -> None:
        starts = np.concatenate([[0], np.cumsum([len(x[0]) for x in held])[:-1]])
        out.append(fm.score(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), starts))

    for text, n in zip(rows["text"], n_chars, strict=True):
        held.append(features(text, n))
        size += len(held[-1][0])
        if size >= AT_ONCE:
            flush()
            held, size = [], 0
    if held:
        flush()
    return np.concatenate(out)


def score_documents(docs: DataFrame, model: FactorisationMachine, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the probability that a document is of label 1.

    Null text counts as empty; empty and very long texts get a score like any other; rows are kept as they are, repeated
    ones too; an empty table stays empty; further columns pass through, but one called ``name`` is replaced.
    """
    docs = docs.drop(name)
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fm = FactorisationMachine(*sent.value)
        for b in batches:
            b[name] = _scores(fm, b)
            yield b

    return map_in_pandas(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train_rows: int = 6000) -> DataFrame:
    """The documents whose score reaches ``threshold``, with their own columns, whatever their names; texts as in ``score_documents``."""
    model = train(docs, labels, max_train_rows)
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fm = FactorisationMachine(*sent.value)
        for b in batches:
            yield b[_scores(fm, b) >= threshold]

    return map_in_pandas(docs, run, docs.schema)


def query(spark, sf_dir):
    """op10_quality."""
    from ctxloom.llm._common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs.select("doc_id", "text", "n_chars"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
