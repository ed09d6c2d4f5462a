"""Divergence audit, language-model scores and Merkle manifest: against their SQL on awkward rows, and against brute force."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import divergence, kneser_ney, merkle
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORDS = [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]


def _prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def _rows():
    r = random.Random(5)
    rows = [(k, _prose(k, r.randrange(60)).capitalize(), r.choice(["en", "fr"]), r.choice(["s0", "s0", "s0", "s1", "s2"]), 7, "x") for k in range(300)]
    rows += [
        (400, None, "en", "s0", None, "x"), (401, "", None, None, 0, "x"), (402, None, "xx", "alone", 1, "x"), (403, "ÄÖ Äö straße STRASSE 日本 " * 3, "de", None, 5, "x"), (404, "Äö", "de", "", 5, "x"), (405, "äö ÄÖ\x00Äö", "de", "z", None, "x"),
        (406, "one two", "yy", "a", 1, "x"), (407, "three", "yy", "b", 1, "x"), (None, "No ID", "en", "s1", 3, "x"), (408, "long " * 20_000 + "x" * 5000, "en", "s1", 9, "x"), (410, "Same Row", "fr", "s0", 8, "x"), (410, "Same Row", "fr", "s0", 8, "x"), (410, "other row of the id", "fr", "s0", 8, "x"),
    ]
    return rows


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("rows"))
    spark.createDataFrame(_rows(), SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return spark.read.parquet(f"{folder}/documents.parquet"), con


def _same(got, want):
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    frame = got.toPandas()
    plain = lambda v: None if pd.isna(v) else (int(v) if isinstance(v, (float, np.floating)) else v)
    rows = lambda f: Counter(tuple(plain(v) for v in r) for r in f[columns].itertuples(index=False))
    assert rows(frame) == rows(want)
    return frame


@pytest.mark.parametrize("dense, counted", [(1_000_000, 4_000_000), (12, 50)])
def test_divergence_against_sql(fixture, monkeypatch, dense, counted):
    """Whole, and in chunks of a few terms with counts that leave a task often."""
    docs, con = fixture
    monkeypatch.setattr(divergence, "DENSE", dense)
    got = _same(divergence.audit(docs, counted=counted), con.execute(divergence.ORACLE).df())
    assert {"de", "yy"} <= set(got.lang) and "xx" not in set(got.lang) and (got[got.lang == "yy"].value == 0).all() and len(got[got.lang == "yy"]) == 2
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_counts_are_exact():
    """Shares by long division where the product would not fit 64 bits, and ranks to the limit."""
    r = random.Random(3)
    for _ in range(2000):
        total = r.choice([r.randrange(1, 50), r.randrange(1, 9 * 10**15)])
        n = r.randrange(0, total + 1)
        assert int(divergence.share(np.array([n]), np.array([total]))[0]) == 1 + divergence.SCALE * n // total


def test_divergence_ranks_end_at_the_limit(spark):
    docs = spark.createDataFrame([(k, " ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)) if k < 3 else "plain", "en", "a" if k < 3 else "b", 0, "") for k in range(8)], SCHEMA)
    got = divergence.audit(docs).where("part = 'term' AND source = 'a'").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 201)) and [r["item"] for r in got] == sorted(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400))[:200]


def _naive(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([merkle.digest(levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4096, 4100])
def test_traversal_against_whole_trees(n):
    leaves = [merkle.digest([str(k)]) for k in range(n)]
    levels = _naive(leaves)
    depth = len(levels) - 1
    assert depth == merkle.levels_of(n) and merkle.tree_top(leaves.__getitem__, n, depth) == levels[-1][0]
    for i, path in enumerate(merkle.traverse(leaves.__getitem__, n, depth)):
        want = []
        for k in range(depth):
            at, run = i // 16**k, i // 16 ** (k + 1) * 16
            want.append(("".join(levels[k][run:at]), "".join(levels[k][at + 1 : run + 16])))
        assert path == want and merkle.fold(leaves[i], path) == levels[-1][0]


def test_traversal_keeps_few_digests():
    """Of 16 ** 3 leaves, what the runs hold never exceeds the runs and stacks of three levels."""
    made, most = [], 0
    real = merkle.Run.__init__

    def noted(self, *a):
        real(self, *a)
        made.append(self)

    merkle.Run.__init__ = noted
    try:
        for _ in merkle.traverse(lambda k: str(k), 4096, 3):
            del made[:-6]
            most = max(most, sum(len(s) for r in made for s in r.stack))
    finally:
        merkle.Run.__init__ = real
    assert most <= 16 * 3 * 4


@pytest.mark.parametrize("levels", [3, 1])
def test_merkle_against_sql(fixture, levels):
    """With blocks of 4,096 leaves, and of 16, whose roots climb further levels."""
    docs, con = fixture
    values = [F.translate("text", merkle.UPPER, merkle.LOWER) if c == "text" else F.col(c) for c in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf(*values))
    got = _same(merkle.manifest(docs, tampered, levels), con.execute(merkle.ORACLE).df())
    assert got.root.nunique() == 1 and got.verified.sum() < len(got)
    paths = merkle.authentication_paths(docs, levels).collect()
    assert len(paths) == len(_rows()) and all(merkle.fold(r.leaf, [tuple(p) for p in r.path]) == got.root[0] for r in paths)
    assert merkle.manifest(docs.limit(0)).count() == 0
    # A changed text is found, and the order of the input does not matter.
    again = merkle.manifest(docs.repartition(2), levels=levels).toPandas()
    assert set(again.root) == set(got.root) and again.verified.all()
    assert set(merkle.manifest(docs.withColumn("text", F.when(F.col("doc_id") == 17, "changed").otherwise(F.col("text")))).toPandas().root) != set(got.root)


def test_merkle_of_one_row(spark):
    row = merkle.manifest(spark.createDataFrame([(1, "Text", "en", None, 4, "")], SCHEMA)).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == merkle.digest([])


def _discounts(counts):
    n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
    if not all(n):
        return (0, *kneser_ney.DISCOUNTS)
    y = n[0] / (n[0] + 2 * n[1])
    return (0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) for k in (1, 2, 3)))


class Brute:
    """The model, from dictionaries of whole counts."""

    def __init__(self, texts):
        tokens = [kneser_ney.tokens((t or "").encode()) for t in texts]
        self.words = Counter(w for t in tokens for w in t)
        self.n, self.v = sum(self.words.values()), len(self.words)
        three = Counter(g for t in tokens for g in zip([0, 0, *t], [0, *t], t, strict=False))
        two = Counter(g[1:] for g in three)
        self.orders = [Counter(g[1:] for g in two), two, three]
        self.d = [_discounts(c) for c in self.orders]
        self.context = []
        for c, d in zip(self.orders, self.d, strict=True):
            total, left = Counter(), Counter()
            for g, k in c.items():
                total[g[:-1]] += k
                left[g[:-1]] += d[min(k, 3)]
            self.context.append((total, left))

    def p(self, *gram):
        below = 1 / (self.v + 1)
        for k, (total, left) in enumerate(self.context):
            g = gram[2 - k :]
            if n := total[g[:-1]]:
                c = self.orders[k][g]
                below = (c - self.d[k][min(c, 3)]) / n + left[g[:-1]] / n * below
        return below

    def score(self, text):
        t = kneser_ney.tokens((text or "").encode())
        return len(t), sum(math.log10((self.words[w] + 1) / (self.n + self.v + 1)) for w in t), sum(math.log10(self.p(*g)) for g in zip([0, 0, *t], [0, *t], t, strict=False)), sum(w in self.words for w in t)


def _close(got, brute, texts):
    for r, t in zip(got, texts, strict=True):
        n, base, score, known = brute.score(t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, brute.n)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-12) and r.score == pytest.approx(score, rel=1e-9, abs=1e-12) and r.perplexity == pytest.approx(10 ** (-score / n), rel=1e-6)


@pytest.mark.parametrize("shard", [3_000_000, 900])
def test_language_model_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", shard)
    rows = sorted(_rows(), key=repr)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    train = docs.where("doc_id % 4 != 0 OR doc_id IS NULL")
    folder = kneser_ney.fit(train)
    brute = Brute([t for i, t, *_ in rows if i is None or i % 4])
    new = [*[(i, t) for i, t, *_ in rows], (900, "WAI never seen before wai"), (901, "\t\n"), (902, None)]
    got = kneser_ney.score(spark.createDataFrame(new, "doc_id long, text string"), folder).collect()
    _close(got, brute, [t for _, t in new])
    # What a context leaves is a distribution: over all words and an unknown one it adds up to 1.
    for u, v in [(0, 0), (0, b"wai"), (b"wai", b"wbj"), (b"never", b"seen")]:
        assert sum(brute.p(u, v, w) for w in [*brute.words, b"?"]) == pytest.approx(1)


def test_language_model_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    folder = kneser_ney.fit(empty)
    got = kneser_ney.score(spark.createDataFrame([(1, "a b", "", "", 0, "")], SCHEMA), folder).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score, got.score) == (3, 0, 0, 0.0, 0.0)
    assert kneser_ney.score(empty, folder).count() == 0


def test_language_model_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in kneser_ney.query(spark, SF).collect()}
    held = {r.doc_id for r in docs if zlib.crc32(str(r.doc_id).encode()) % 7 == 2}
    brute = Brute([r.text for r in docs if r.doc_id not in held])
    assert {i for i, r in got.items() if r.held_out} == held and len(got) == len(docs)
    _close([got[r.doc_id] for r in docs], brute, [r.text for r in docs])
    tokens = sum(got[i].n_tokens for i in held)
    assert sum(got[i].score for i in held) / tokens > sum(got[i].base_score for i in held) / tokens + 0.3


def test_packed_columns_come_back():
    r = np.random.default_rng(4)
    for n in (0, 1, 1000):
        a, b = np.sort(r.integers(0, 2**63, n).astype(np.uint64)), r.integers(0, 2**32, n)
        x, y = kneser_ney.unpack(kneser_ney.pack(a, b), 2)
        assert (x == a).all() and (y == b).all()
    codes, values = kneser_ney.encode(*(c := [r.integers(0, 2**40, 500), r.integers(0, 3, 500), r.integers(0, 2**40, 500)]))
    assert (values[codes] == np.stack(c, 1)).all()


@pytest.mark.parametrize("run, columns", [(lambda d: divergence.audit(d), ("lang", "source", "part", "item", "value", "rank")), (lambda d: merkle.manifest(d), ("doc_id", "leaf", "root", "proof_sha256")), (lambda d: kneser_ney.score(d, kneser_ney.fit(d)), ("doc_id", "n_tokens", "base_score"))])
def test_names_of_other_columns_do_not_matter(spark, run, columns):
    docs = spark.createDataFrame(_rows()[::9] + _rows()[-13:], SCHEMA)
    clash = docs
    for name in ("tree", "rank", "n", "block", "leaf", "changed", "seq", "part", "digest", "idx", "path", "root", "item", "value", "term", "docs", "chunk", "first", "shard", "kind", "blob", "counts", "score", "held_out", "v", "a.b"):
        clash = clash.withColumn(name, F.lit("own"))
    rows = lambda df: Counter(repr([r[c] if not isinstance(r[c], float) else round(r[c], 9) for c in columns]) for r in df.collect())
    assert rows(run(docs)) == rows(run(clash))
