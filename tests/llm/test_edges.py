"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing names, for every operator and pipeline stage."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ctxloom.llm import ann, decontam, html_extract, line_dedup, near_dedup, packing, pii, quality, suffix_dedup, url_filter
from tests.conftest import SF
from tests.llm.test_llm import BASE, TEXTS, _brute_classes, _brute_spans, _docs, _prose

#: Names that operators use, or used, for columns of their own.
CLASHING = (
    "id", "own", "hash", "rest", "k", "a", "b", "root", "least", "content", "bands", "chunk", "bytes", "first", "row", "removed", "lines", "_text", "_id", "_hash", "_row", "_quality",
    "terms", "email", "ip", "card", "phone", "nth", "worded", "stays", "score", "bucket", "doc", "copy", "spans", "n_words", "rule", "verdict", "label", "window", "start", "places",
)
LONG = _prose(77, 20_000)
ROWS = [*TEXTS, (70, LONG), (71, "word " * 20_000), (72, LONG), (73, "1 " * 3000), (74, "a@b.cc " * 500), (5, "another text of the same id, long enough to be a text of its own kind")]
BENCH = [(1, " ".join(BASE.split()[20:40])), (2, None), (3, "")]


def _clash(df, taken=()):
    for name in CLASHING:
        if name not in df.columns and name not in taken:
            df = df.withColumn(name, F.lit(f"own {name}"))
    return df.withColumn("a.dot", F.lit(1))


def _sorted(df, columns):
    return sorted((repr([(c, r[c]) for c in columns]) for r in df.select(*(f"`{c}`" for c in columns)).collect()))


OPERATORS = {
    "decontamination": (lambda s, d: decontam.contamination(d, s.createDataFrame(BENCH, "item_id long, text string")), ("doc_id", "n_words", "n_hit", "items", "runs")),
    "suffix_dedup": (lambda s, d: suffix_dedup.remove_repeats(d), ("doc_id", "n_bytes", "removed", "kept")),
    "line_dedup": (lambda s, d: line_dedup.dedup_lines(d), ("doc_id", "text", "_lines", "_removed")),
    "pii": (lambda s, d: pii.spans(d), ("doc_id", "email", "ip", "card", "phone", "terms")),
    "sanitise": (lambda s, d: pii.sanitise(d), ("doc_id", "text")),
    "near_dedup": (lambda s, d: near_dedup.classes(d), ("doc_id", "class_id")),
    "packing": (lambda s, d: packing.packed(d.coalesce(1)), ("doc_id", "start", "length", "ids_crc32", "doc_tokens")),
    "quality": (lambda s, d: quality.score_documents(d, quality.fit([], np.zeros(0))), ("doc_id", "score")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_names_of_other_columns_do_not_matter(spark, name):
    run, columns = OPERATORS[name]
    docs = _docs(spark, ROWS).repartition(3)
    plain, clashing = run(spark, docs), run(spark, _clash(docs))
    assert _sorted(plain, columns) == _sorted(clashing, columns)
    if name in ("line_dedup", "sanitise", "quality", "pii"):
        kept = [c for c in _clash(docs).columns if c in clashing.columns and c not in (*columns, "score")]
        assert len(kept) > 30 and _sorted(clashing, kept) == _sorted(_clash(docs), kept)
    assert run(spark, _clash(docs.limit(0))).count() == 0
    if name not in ("packing",):
        assert clashing.count() == len(ROWS)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = _docs(spark, ROWS).drop("extra")
    plain, clashing = stage(spark, docs, SF), stage(spark, _clash(docs), SF)
    if name == "packing":
        assert {r.doc_id for r in plain.collect()} == {r.doc_id for r in clashing.collect()} == {i for i, _ in ROWS}
    else:
        assert clashing.columns == _clash(docs).columns and plain.columns == docs.columns
        assert _sorted(plain, docs.columns) == _sorted(clashing, docs.columns)
    assert stage(spark, _clash(docs.limit(0)), SF).count() == 0


def test_repeated_ids(spark):
    """Rows (1, A), (5, A), (5, B): one copy of A stays, and B with it."""
    a, b = _prose(81, 60), _prose(82, 60)
    docs = _docs(spark, [(1, a), (5, a), (5, b), (5, b), (None, ""), (None, "")])
    assert sorted((r.doc_id or 0, r.text) for r in near_dedup.dedup(docs).collect()) == sorted([(1, a), (5, b), (0, ""), (0, "")])
    marked = _docs(spark, [(1, "see me at zz@yy.xx ok"), (1, "plain and much longer than that, mail aa@bb.cc"), (None, None)])
    assert sorted(r.text or "" for r in pii.sanitise(marked).collect()) == ["", "plain and much longer than that, mail [EMAIL]", "see me at [EMAIL] ok"]


def test_a_bucket_around_two_leaders(spark):
    """300 texts about two centres that are alike themselves, all in one bucket: classes are those of brute force."""
    r = random.Random(91)
    one = _prose(92, 150).split()
    two = [w if k % 25 else f"x{k}" for k, w in enumerate(one)]
    texts = [(k, " ".join(w if r.random() > r.choice((0.0, 0.02, 0.05)) else f"y{r.randrange(9999)}" for w in (one if k % 2 else two))) for k in range(300)]
    docs = _docs(spark, texts)
    signed = near_dedup.signatures(docs).withColumn("bands", F.array(F.lit(1).cast("long"))).cache()
    name = {bytes(x.content): x.doc_id for x in signed.collect()}
    group = {}
    for x in near_dedup.components(near_dedup.links(signed, docs)).collect():
        group.setdefault(bytes(x.root), {name[bytes(x.root)]}).add(name[bytes(x.node)])
    want = {}
    for i, c in _brute_classes(texts).items():
        want.setdefault(c, set()).add(i)
    same = {}
    for i, t in texts:
        same.setdefault(t, set()).add(i)
    named = set(name.values())
    assert sorted(sorted(g) for g in group.values()) == sorted(s for g in want.values() if len(s := sorted(g & named)) > 1)


def test_copies_in_many_chunks(spark, monkeypatch):
    """Packing of anchors and of frequent runs by chunk, with a passage in most documents and whole copies."""
    monkeypatch.setattr(suffix_dedup, "PACK", 4000)
    passage, line = _prose(95, 40), _prose(96, 12)
    texts = [(k, f"{_prose(1000 + k, 20)} {passage if k % 3 else line} {_prose(2000 + k, 10)}") for k in range(90)] + [(200 + k, BASE) for k in range(30)] + [(300, passage), (301, None)]
    got = {r.doc_id: (r.n_bytes, sum(x["end"] - x["start"] for x in r.removed), bytes(r.kept)) for r in suffix_dedup.remove_repeats(_docs(spark, texts).repartition(3)).collect()}
    assert got == _brute_spans(texts)


def test_many_matches_keep_their_places(spark):
    r = random.Random(97)
    texts = [(k, "".join(r.choice("0123456789 -a") if r.random() < 0.9 else r.choice(["4111 1111 1111 1111", " x@y.zz", "é"]) for _ in range(400))) for k in range(200)]
    texts.append((999, " ".join(f"user{k}@host{k % 7}.example.com" for k in range(3000))))
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "card": r"[0-9]([\x20-]?[0-9])+"}
    found = {r.doc_id: r for r in pii.find(_docs(spark, texts)).collect()}
    for i, t in texts:
        for kind, p in patterns.items():
            want = []
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                total = sum(v - 9 * (v > 9) for v in (int(c) * (1 + n % 2) for n, c in enumerate(reversed(d))))
                if kind == "email" or 13 <= len(d) <= 19 and total % 10 == 0:
                    want.append((m.start(), m.end(), m[0]))
            assert [tuple(x) for x in (found[i][kind] if i in found else [])] == want, (i, kind)


def test_many_disclosing_words_go_by_a_shuffle(spark, monkeypatch):
    far = " plain words" * 20
    texts = [(k, f"Zorblatt wrote.{far} Then u{k}@corp.example and zorblatt, quixel again") for k in (1, 2, 3)] + [(4, "only ZORBLATT here")]
    texts += [(k, f"plain words then and wrote only again here {chr(97 + k % 26) * 3}{chr(97 + k // 26)}") for k in range(20, 80)]
    docs = _docs(spark, texts)
    sent = _sorted(pii.spans(docs), ("doc_id", "terms"))
    monkeypatch.setattr(pii, "SENT_TERMS", 0)
    assert _sorted(pii.spans(docs), ("doc_id", "terms")) == sent and "zorblatt" in str(sent)


def test_pages(spark):
    pages = [(1, "http://a.com/en/1", "<article><p>Text one of a page.</p></article>"), (1, "http://a.com/en/1", "<article><p>Text one of a page.</p></article>"), (2, None, None), (None, "", ""), (3, "x" * 100_000, "<p>" + "word " * 50_000)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    for run, columns in ((html_extract.extract, ("page_id", "url", "text", "n_chars")), (url_filter.judge, ("page_id", "host", "path", "rule", "verdict"))):
        clashing = run(_clash(rows, ("rule", "verdict", "score", "text", "html", "url")))
        assert _sorted(run(rows), columns) == _sorted(clashing, columns) and clashing.count() == len(pages) and run(rows.limit(0)).count() == 0


def test_vectors_with_other_columns_and_repeated_queries(spark):
    r = random.Random(99)
    rows = [(k % 60, [r.random() for _ in range(4)]) for k in range(80)] + [(None, [1.0] * 4), (61, None), (62, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 10 = 0")
    columns = ("query_id", "rank", "vec_id", "score")
    first = _sorted(ann.search(vectors, queries), columns)
    assert first == _sorted(ann.search(_clash(vectors.repartition(3), columns).withColumn("v", F.lit(1)), _clash(queries.repartition(2))), columns)
    assert len(first) == 60


def test_hosts_paths_and_rules_against_sql(spark):
    import duckdb

    rules = ", ".join(f"('{a}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for a, r in url_filter.RULES)
    sql = f"""
    WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE '' END AS h, CASE WHEN contains(url, '://') THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM '{SF[:-5]}0.1/pages.parquet'),
    p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u), r(action, rh, rp, rule) AS (VALUES {rules}),
    m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM p, r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
    SELECT page_id, host, path, rule, action FROM p LEFT JOIN m USING (page_id)"""
    want = {r[0]: r[1:] for r in duckdb.connect().execute(sql).fetchall()}
    got = {r.page_id: r for r in url_filter.query(spark, f"{SF[:-5]}0.1").collect()}
    assert set(got) == set(want) and sum(w[2] is not None for w in want.values()) > 100
    for k, (host, path, rule, action) in want.items():
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule) and got[k].verdict == (action or got[k].verdict)
    model = url_filter.default_model()
    for r in (r for r in got.values() if r.rule is None):
        assert r.verdict == ("block" if r.score >= 0.5 else "allow")
    assert len(model.trees) == 60


@pytest.mark.parametrize("sent", [500_000, 0])
def test_copies_are_left_out_and_buckets_go_in_rounds(spark, monkeypatch, sent):
    """Whole copies do not reach the anchors where they can be sent; two rounds settle all buckets; and a chunk may have no anchors."""
    passage = _prose(95, 40)
    own = [f"{_prose(1000 + k, 20)} {passage if k % 3 else ''} {_prose(2000 + k % 5, 30)}" for k in range(30)]
    texts = [(100 * n + k, t) for n in range(4) for k, t in enumerate(own)] + [(900, "short"), (901, "short"), (902, None)]
    monkeypatch.setattr(suffix_dedup, "SENT_COPIES", sent)
    monkeypatch.setattr(suffix_dedup, "ROUND_BYTES", sum(len((t or "").encode()) for _, t in texts) // 2 + 1)
    seen, rounds = [], []
    shared, suffixes = suffix_dedup._shared_anchors, suffix_dedup._suffixes
    monkeypatch.setattr(suffix_dedup, "_shared_anchors", lambda df, *a: seen.append(df.count()) or shared(df, *a))
    monkeypatch.setattr(suffix_dedup, "_suffixes", lambda df, cuts, *a: rounds.append(a) or suffixes(df, cuts, *a))
    docs = _docs(spark, texts).repartitionByRange(4, "doc_id")  # the last part holds short texts only
    got = {r.doc_id: (r.n_bytes, sum(x["end"] - x["start"] for x in r.removed), bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == _brute_spans(texts) and seen == [33 if sent else len(texts)] and rounds == [(0, 2), (1, 2)]
