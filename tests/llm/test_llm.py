"""The training-data operators against brute force, and their edge cases."""

import hashlib
import json
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import ann, decontam, html_extract, line_dedup, near_dedup, packing, pii, quality, suffix_dedup, url_filter
from tests.conftest import SF

DOC = "doc_id long, text string, lang string, source string, n_chars long, extra string"
BENCH = "item_id long, text string"
WORDS = [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]


def _docs(spark, texts):
    """Documents with a null id, null, empty and repeated rows among them, and a further column."""
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in texts]
    return spark.createDataFrame(rows, DOC)


def _prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = _prose(1, 120)
TEXTS = [
    (1, BASE), (2, None), (3, ""), (4, "   \n \n"), (5, BASE), (5, BASE), (6, BASE.replace("wai", "other", 1)), (7, _prose(2, 4000)), (8, "short"), (9, "ÄÖ ß é 日本 " * 30), (10, _prose(3, 80) + "\n" + BASE[:300]),
    (11, "a b c d"), (12, _prose(3, 80)), (None, _prose(4, 60)), (13, _prose(4, 60) + " tail"),
]


def _brute_hits(text, items):
    w = decontam.words(text)
    hit, found = set(), set()
    for name, t in items:
        v = decontam.words(t)
        for k in range(max(1, len(v) - 9)) if v else ():
            g = v[k : k + 10]
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit.update(range(p, p + len(g)))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [400_000, 15])
def test_decontamination(spark, monkeypatch, block_words):
    items = [(1, " ".join(BASE.split()[20:40])), (2, "short"), (3, None), (4, ""), (5, _prose(9, 30)), (6, " ".join(_prose(2, 4000).split()[100:112]).upper())]
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(decontam.blocks, "__defaults__", (block_words,))
    docs, bench = _docs(spark, TEXTS), spark.createDataFrame(items, BENCH)
    got = decontam.contamination(docs, bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == Counter((i, *_brute_hits(t, items)[:2], tuple(_brute_hits(t, items)[2])) for i, t in TEXTS)
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, t in TEXTS if not _brute_hits(t, items)[1]}
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0 and decontam.contamination(docs.limit(0), bench).count() == 0


def _brute_longest(text, items):
    """(words, place, item, place there) of the longest run that stands so in one item and holds a window of it."""
    w, best = decontam.words(text), (0, -1, None, -1)
    for name, t in items:
        v = decontam.words(t)
        least = min(10, len(v))
        for p in range(len(w)):
            for q in range(len(v)):
                n = 0
                while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                    n += 1
                if n >= least and (len(v) >= 10 or q == 0):
                    best = min(best, (-n, p, str(name), q)) if best[0] else (-n, p, str(name), q)
    return (-best[0], *best[1:])


@pytest.mark.parametrize("block_words", [400_000, 15])
def test_longest_matches(spark, block_words, monkeypatch):
    """Matches of two items that touch are two; a match goes on as long as one item does, wherever its first words stand besides."""
    monkeypatch.setattr(decontam.blocks, "__defaults__", (block_words,))
    a, b = _prose(301, 14).split(), _prose(302, 12).split()
    items = [(1, " ".join(a[:10])), (2, " ".join(b[:10])), (3, " ".join(a[2:14] + b[:11])), (10, " ".join(a[:12] + ["odd"] + b)), (4, "few words"), (5, "same " * 12), (6, "same " * 12), (7, None), (8, "")]
    texts = [(1, " ".join(a[:10] + b[:10])), (2, " ".join(a + b)), (3, " ".join(["x", *a[:12], "y"])), (4, "here few words and FEW words"), (5, "same " * 30), (6, " ".join(b + ["z"] + a)), (7, None), (8, "nothing at all"), (9, " ".join(a[1:10]))]
    got = {r.doc_id: (r.longest_match, r.longest_at, r.longest_item, r.longest_item_at) for r in decontam.contamination(_docs(spark, texts), spark.createDataFrame(items, BENCH)).collect()}
    assert got == {i: _brute_longest(t, items) for i, t in texts}
    assert got[1] == (10, 0, "1", 0) and got[5] == (12, 0, "5", 0) and got[4] == (2, 1, "4", 0)


def test_suffixes_are_in_order():
    r = random.Random(6)
    for n in (0, 1, 2, 50, 200):
        tokens = [r.randrange(3) for _ in range(n)]
        assert decontam.suffix_order(np.array(tokens, np.int64)).tolist() == sorted(range(n), key=lambda k: tokens[k:])


def _brute_lines(texts):
    """Deleted line numbers of (id, text) in order of ids, None first."""
    seen, out = set(), {}
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is not None, texts[k][0] or 0))
    for k in order:
        i, t = texts[k]
        if t is None:
            continue
        lines = t.split("\n")
        at = [n for n, x in enumerate(lines) if x.strip(" ")]
        windows = [tuple(at[n : n + 2]) for n in range(len(at) - 1)] + [(n,) for n in at if len(lines[n].split()) >= 5]
        gone = set()
        for w in sorted(windows):
            key = tuple(lines[n] for n in w)
            if key in seen:
                gone.update(w)
            seen.add(key)
        out[i] = gone
    return out


def test_line_dedup(spark):
    long = _prose(20, 60)
    texts = [(1, "a\nb\nc"), (2, "x\na\nb\ny"), (3, "a\n\nb"), (4, "b\na"), (5, f"{long}\nz"), (6, f"q\n{long}"), (7, None), (8, ""), (9, "r\nr\nr\nr"), (None, "y\nq q"), (10, "y\nq q\nlast"), (11, "\n\n"), (12, "own\none two three four five\nown too"), (13, "mine\none two three four five\nmine too\none two three four"), (14, "a1\none\ttwo\u00a0three \u3000four\x0bfive\na2"), (15, "b1\none\ttwo\u00a0three \u3000four\x0bfive\nb2\none two three four")]
    docs = _docs(spark, texts)
    out = line_dedup.dedup_lines(docs)
    want = _brute_lines(texts)
    for r in out.collect():
        t = dict(texts)[r.doc_id]
        lines = [] if t is None else t.split("\n")
        assert r._removed == len(want.get(r.doc_id, ())) and r._lines == len(lines)
        assert r.text == (None if t is None else "\n".join(x for n, x in enumerate(lines) if n not in want[r.doc_id]))
    assert out.columns[:6] == docs.columns and line_dedup.dedup_lines(docs.limit(0)).count() == 0
    assert line_dedup.dedup_lines(_docs(spark, [(1, "a\nb"), (1, "a\nb")])).where("_removed > 0").count() == 0


def _brute_classes(texts):
    def shingles(t):
        w = decontam.words(t)
        return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None

    s, parent = [shingles(t) for _, t in texts], list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if s[a] and s[b]:
                both = sum((s[a] & s[b]).values())
                if both >= 0.8 * (sum(s[a].values()) + sum(s[b].values()) - both):
                    parent[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(texts):
        groups.setdefault(root(k), []).append(i)
    least = {g: min(v, key=lambda i: (i is not None, i or 0)) for g, v in groups.items()}
    return {i: least[root(k)] for k, (i, _) in enumerate(texts)}


def test_near_dedup(spark):
    base = _prose(30, 200).split()
    copies = [(100 + k, " ".join([*base[:k], f"changed{k}", *base[k + 1 :]])) for k in range(0, 200, 7)]
    texts = TEXTS + copies + [(300, " ".join(base)), (301, " ".join(base[:100]))]
    docs = _docs(spark, texts)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got == _brute_classes(texts)
    kept = near_dedup.dedup(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(_brute_classes(texts).values())
    assert near_dedup.classes(docs.limit(0)).count() == 0


def test_near_dedup_links_beside_leaders(spark):
    """A chain in one large bucket: each text is like its neighbours only, so most links are beside the leaders."""
    words = [f"c{k}" for k in range(300)]
    docs = _docs(spark, [(k, " ".join(words[9 * k : 9 * k + 90])) for k in range(20)] + [(99, _prose(31, 90))])
    signed = near_dedup.signatures(docs).withColumn("bands", F.array(F.lit(1).cast("long"))).cache()
    name = {bytes(r.content): r.doc_id for r in signed.collect()}
    roots = near_dedup.components(near_dedup.links(signed, docs)).collect()
    assert {name[bytes(x)] for r in roots for x in (r.node, r.root)} == set(range(20)) and len({bytes(r.root) for r in roots}) == 1


def test_dart_minhash_estimates_similarity():
    a = _prose(41, 400).split()
    for keep in (0.95, 0.8, 0.5):
        b = a[: int(400 * keep)] + _prose(42, 400 - int(400 * keep)).split()
        owner, cell = near_dedup.cells([" ".join(a), " ".join(b)])
        x, y = set(cell[owner == 0]), set(cell[owner == 1])
        sig = near_dedup.dart_minhash(owner, cell, 2, 1000)
        assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.06


def test_components(spark):
    chain = [(bytes([k]), bytes([k + 1])) for k in range(20)] + [(b"\x50", b"\x51")]
    got = {bytes(r.node): bytes(r.root) for r in near_dedup.components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert got == {bytes([k + 1]): b"\x00" for k in range(20)} | {b"\x51": b"\x50"}


def _brute_spans(texts):
    first, out = {}, {}
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0))
    raws = [(i, (t or "").encode()) for i, t in order]
    for i, raw in raws:
        for k in range(len(raw) - 49):
            first.setdefault(raw[k : k + 50], i)
    for i, raw in raws:
        mask = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] != i:
                mask[k : k + 50] = True
        out[i] = (len(raw), int(mask.sum()), bytes(np.frombuffer(raw, np.uint8)[~mask]) if len(raw) else b"")
    return out


def test_suffix_dedup(spark):
    passage = _prose(50, 20)
    extra = [(200 + k, f"{_prose(500 + k, 15)} {passage} {_prose(600 + k, 15)}") for k in range(40)] + [(260, "ab" * 400), (261, "zab" + "ab" * 100), (262, BASE[:49]), (263, BASE[:50])]
    texts = TEXTS + extra
    want = _brute_spans(texts)
    got = suffix_dedup.remove_repeats(_docs(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, sum(x["end"] - x["start"] for x in r.removed), bytes(r.kept)) == want[r.doc_id], r.doc_id
    assert suffix_dedup.remove_repeats(_docs(spark, TEXTS).limit(0)).count() == 0


def test_multikey_sort():
    rows = np.random.default_rng(1).integers(97, 99, (500, 20)).astype(np.uint8)
    rows[::7] = rows[3]
    order, equal = suffix_dedup.multikey_sort(rows)
    listed = [bytes(r) for r in rows[order]]
    assert listed == sorted(map(bytes, rows)) and equal.tolist() == [False, *(a == b for a, b in zip(listed, listed[1:], strict=False))]


def test_ann_recall_and_edges(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(int(r.vec_id), np.array(r.embedding, float)) for r in vectors.collect()]
    x, ids = np.stack([v for _, v in rows]), np.array([i for i, _ in rows])
    got, hits = {}, 0
    for r in ann.search(vectors, vectors.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for i in ids[ids % 20 == 0]:
        d = np.sqrt(((x - x[ids == i][0]) ** 2).sum(1))
        d[ids == i] = np.inf
        hits += len(set(ids[np.lexsort([ids, d])[:10]]) & {v for _, v, _ in got[i]})
        assert sorted(got[i]) == sorted(got[i], key=lambda t: (t[2], t[1])) and [r for r, _, _ in sorted(got[i])] == list(range(1, 11))
    assert hits >= 0.9 * 10 * len(got)
    odd = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0])]
    small = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    out = ann.search(small, small.where("vec_id = 100")).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in out] == [(1, 0.0), (2, 0.0), (7, 1.414214)]
    assert ann.search(small.limit(0), small).count() == 0


def test_url_rules_and_trees(spark):
    urls = [(1, "http://a.example.com/en/712?x"), (2, "https://x.COM/en/1"), (3, "http://example.net/de/81"), (4, "http://net/"), (5, "http://b.net/de/"), (6, None), (7, "no scheme"), (8, "http://notcom/en/"), (9, "http://q.org/es/"), (10, "http://free-bets.example.org/fr/1"), (11, "http://x.com?en/")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert [(got[k].rule, got[k].verdict) for k in (1, 2, 3, 5, 9)] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block")]
    assert got[4].rule is None
    assert (got[6].host, got[6].path, got[6].rule) == ("", "", None) and (got[7].host, got[7].path) == ("", "") and got[8].rule is None and got[10].verdict == "block" and got[11].path == ""
    model = url_filter.train(url_filter.ALLOWED[::2], url_filter.BLOCKED[::2])
    held = [*url_filter.ALLOWED[1::2], *url_filter.BLOCKED[1::2]]
    assert ((model.score(held) >= 0.5) == np.array([False] * 16 + [True] * 16)).mean() >= 0.8


def _luhn(digits):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits)))) % 10 == 0


def test_pii_places(spark):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    texts = [
        (1, "é mail a.b@c.d@e.f or x@y and 日 1.2.3.4.5.6.7.8 and 256.1.1.1, 0001.2.3.255"), (2, "card 4111 1111 1111 1111 and 4111-1111-1111-1112 phone +1 (555) 010-9999."), (3, None), (4, ""),
        (5, "a@b.c_d@e.f.g " * 3 + "+12 3 4"), (6, "9" * 40 + " " + "1." * 50), (7, "reach bob at bob@corp.example now"), (8, "ask bob at bob@corp.example soon"), (9, "bob at bob@corp.example"), (None, "x 10.0.0.1"),
    ]
    texts += [(k, f"plain words number {chr(97 + k % 26)}{chr(97 + k // 26)} only") for k in range(20, 60)]
    got = {r.doc_id: r for r in pii.spans(_docs(spark, texts)).collect()}
    for i, t in texts:
        for kind, p in patterns.items():
            want = []
            for m in re.finditer(p, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and _luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                    want.append((m.start(), m.end(), m[0]))
            assert [tuple(x) for x in got[i][kind]] == want, (i, kind)
    assert {x["term"] for i in (7, 8, 9) for x in got[i]["terms"]} == {"bob"}
    clean = {r.doc_id: r.text for r in pii.sanitise(_docs(spark, texts)).collect()}
    assert clean[7] == "reach  at [EMAIL] now" and clean[20] == dict(texts)[20] and clean[3] is None
    assert pii.spans(_docs(spark, texts).limit(0)).count() == 0


def test_pii_terms_of_whole_documents(spark):
    """Each address comes once, its domain three times; the name stands far from it, and once without it."""
    far = " plain words" * 60
    texts = [(k, f"Zorblatt wrote.{far} Then u{k}@corp.example and zorblatt again") for k in (1, 2, 3)] + [(4, "only ZORBLATT here"), (5, "zorblatty is another word")]
    texts += [(k, f"plain words then and wrote only again here {chr(97 + k % 26) * 3}{chr(97 + k // 26)}") for k in range(20, 80)]
    docs = _docs(spark, texts)
    got = {r.doc_id: [(t["start"], t["end"]) for t in r.terms if t["term"] == "zorblatt"] for r in pii.spans(docs.unionByName(docs.where("doc_id = 4"))).collect()}
    for i, t in texts:
        assert got[i] == [m.span() for m in re.finditer(r"\bzorblatt\b", t.lower())], i
    assert {t["term"] for r in pii.spans(docs).collect() for t in r.terms} == {"zorblatt"}
    assert "zorblatt" not in {r.doc_id: r.text for r in pii.sanitise(docs).collect()}[4].lower()


def _brute_disclosures(texts):
    """{word: (bits, action)} from sets of different texts."""
    texts = sorted({t for t in texts if t is not None})
    entity, word = {}, {}
    for i, t in enumerate(texts):
        bare = list(t)
        for kind, p in pii.PATTERNS.items():
            for m in re.finditer(p.replace(r"|\G", ""), t):
                d = re.sub("[^0-9]", "", m[0])
                if not (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and _luhn(d) or kind == "phone" and 9 <= len(d) <= 15):
                    continue
                own = m[0].lower() if kind == "email" else re.sub(r"(?<![0-9])0+(?=[0-9])", "", m[0]) if kind == "ip" else d
                group = own.split("@")[-1] if kind == "email" else own.rpartition(".")[0] if kind == "ip" else own[:6] if kind == "card" else own[:-4]
                for name in (f"{kind}:{own}", f"{kind} group:{group}", kind):
                    entity.setdefault(name, set()).add(i)
                bare[m.start() : m.end()] = [" "] * (m.end() - m.start())
        for w in {w for w in re.split(r"[\W\d_]+", "".join(bare).lower()) if len(w) >= 3}:
            word.setdefault(w, set()).add(i)
    out = {}
    for name, e in entity.items():
        for w in {w for w, s in word.items() if len(s & e) >= 2}:
            share = (len(word[w] & e) + pii.PRIOR * len(e) / len(texts)) / (len(word[w]) + pii.PRIOR)
            bits = float(np.log2(share * len(texts) / len(e)))
            if share >= pii.GENERALISE_AT and bits >= pii.MIN_BITS:
                old = out.get(w, (0.0, "generalise"))
                out[w] = (max(old[0], bits), max(old[1], "remove" if share >= pii.REMOVE_AT else "generalise"))
    return out


def test_disclosing_words_of_the_table(spark):
    """Counts, smoothed shares and information over the driver's documents, against sets; copies count once."""
    docs = spark.read.parquet(f"{SF[:-5]}0.01/documents.parquet").select("doc_id", "text")
    want = _brute_disclosures([r.text for r in docs.collect()])
    for rows in (docs, docs.unionByName(docs.where("doc_id % 3 = 0")).repartition(5)):
        got = {r.term: (r.bits, r.action) for r in pii.disclosures(rows, pii.find(rows)).collect()}
        assert set(got) == set(want) and len(want) >= 20
        for w, (bits, action) in want.items():
            assert got[w][1] == action and got[w][0] == pytest.approx(bits, rel=1e-9)


def test_packing_round_trip(spark):
    path = packing._default_tokenizer()
    texts = TEXTS + [(400, "a<|endoftext|>b \x1c c"), (401, "İx ΣΑΣ é́")]
    rows = packing.packed(_docs(spark, texts).coalesce(1), with_ids=True).collect()
    whole = packing.Encoder(path)
    want = Counter((i, tuple(whole._whole(t or "").tolist() + [2])) for i, t in texts)
    pieces, sequences = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    for (i, t), n in want.items():
        got = sorted(pieces[i, len(t)])
        assert sum(len(x) for _, x in got) == len(t) * n and {y for _, x in got for y in x} == set(t)
        if n == 1:
            assert tuple(y for _, x in got for y in x) == t
    assert packing.packed(_docs(spark, texts).limit(0)).count() == 0


def test_ids_of_letters_that_fall_apart():
    """Every letter whose lower case, or normal form, is more than itself: alone, before signs and inside words."""
    encode = packing.Encoder(packing._default_tokenizer())
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha() and (len(c.lower()) > 1 or unicodedata.normalize("NFKD", c) != c and not "\uac00" <= c <= "\ud7a3")]
    texts = [t for c in letters for t in (c, f"TAR{c}.", f"TAR{c},", f"a{c}b", f"A{c}).", f"{c}, x")]
    for lo in range(0, len(texts), 2000):
        for t, ids in zip(texts[lo : lo + 2000], encode(texts[lo : lo + 2000]), strict=True):
            assert ids.tolist() == encode._whole(t).tolist(), t


def test_pack_covers_and_fills():
    lengths = [random.Random(k).randint(1, 9000) for k in range(300)]
    seen = [set() for _ in lengths]
    sizes = Counter()
    for size, parts in packing.pack(lengths):
        assert sum(n for _, _, n in parts) == size <= 4096 and size & (size - 1) == 0
        sizes[size] += size
        for d, start, n in parts:
            new = set(range(start, start + n))
            assert not new & seen[d]
            seen[d] |= new
    assert [len(s) for s in seen] == lengths and sizes[4096] > 0.5 * sum(lengths)


def test_html():
    tree = html_extract.train()
    page = '<html><head><title>t</title><script>if (a<b) {}</script></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy these</div><article><h1>Head &amp; line</h1><p>One&nbsp;two <b>th</b>ree.<p>Four.</article><footer>&copy; c</footer>'
    assert html_extract.main_text(page, tree) == "Head & line One two three. Four."
    for odd in (None, "", "<", "<p", "<!-- x", "<script>", "<div " + 'a="' * 50, "&#1114112; &bogus;"):
        assert isinstance(html_extract.main_text(odd, tree), str)
    assert html_extract.main_text("<html><body><p>Only six words are here today.</p></body></html>", tree) == "Only six words are here today."
    held = html_extract.labelled(range(1000, 1200))  # pages that the tree has not seen
    assert np.mean([html_extract.decide(tree, r[:-1]) == bool(r[-1]) for r in held]) > 0.98
    kinds = {k: html_extract.labelled(range(1000 + k, 1300, 3)) for k in range(3)}  # with tags, with names, with neither
    assert all(np.mean([html_extract.decide(tree, r[:-1]) == bool(r[-1]) for r in v]) > 0.97 for v in kinds.values())
    used = set()

    def look(node):
        if node.feature >= 0:
            used.add(html_extract.FEATURES[node.feature])
            look(node.left), look(node.right)

    look(tree)
    assert {"words", "link density", "previous words", "previous link density", "next words", "next link density"} <= used


def test_html_pages(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>Text one.</p></article>", "old"), (2, None, None, "old"), (1, "u", "<article><p>Text one.</p></article>", "old")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(rows).collect())
    assert got == [(1, "Text one.", 9), (1, "Text one.", 9), (2, "", 0)]


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    out = quality.score_documents(_docs(spark, TEXTS), model).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.doc_id == 5}) == 1
    more, marks = (spark.read.parquet(f"{SF[:-5]}0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_documents(more, quality.train(more, marks)).join(marks, "doc_id").where(quality.held_out()).collect()
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in scored]) > 0.9
    assert quality.train(docs, labels.limit(0)).v.any() == np.False_ and quality.score_documents(docs.limit(0), model).count() == 0


def test_factorisation_machine_is_the_pair_sum():
    r = np.random.default_rng(3)
    fm = quality.FactorisationMachine(0.3, r.normal(size=20), r.normal(size=(20, 4)))
    idx, val = np.array([1, 4, 9, 2]), r.normal(size=4)
    pairs = sum(fm.v[idx[a]] @ fm.v[idx[b]] * val[a] * val[b] for a in range(4) for b in range(a))
    assert np.isclose(fm.raw(idx, val, np.array([0]))[0], 0.3 + fm.w[idx] @ val + pairs)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, docs, SF))
        assert after.columns == columns and 0 < after.count() <= docs.count(), name
        docs = after
    before = {r.doc_id for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert not any(_brute_hits(t, items)[1] for _, t in texts[:60])
    assert set(_brute_classes(texts).values()) == before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == before


def test_queries_are_registered():
    from ctxloom.llm import queries

    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 11)} and set(queries.oracle_sql()) <= names
    assert json.dumps(sorted(names)) and hashlib.sha256(b"").hexdigest().startswith("e3b0")
