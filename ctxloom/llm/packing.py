"""Hierarchical multi-length packing of tokenised documents into training sequences.

Tiers are context sizes, powers of two. A document goes to the smallest tier that holds it; what exceeds the largest tier
is first cut into full sequences. Each tier, from the longest, is packed best fit; the gap that remains in a window is
filled with whole documents of shorter tiers, and at last with a cut from one. So every window of a tier is full, and as
tier sizes are powers of two none is padded; the few tokens left at the end of a shard are split into powers of two.
Sequences then go to step groups of equal token totals.

A task packs its own documents shard by shard, so the operator is one map without a shuffle, and memory is bounded by the
shard (and the longest document).
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

TIERS = (512, 1024, 2048, 4096)
#: Tokens that are packed together.
SHARD_TOKENS = 2_000_000
#: Tokens of a step group.
STEP_TOKENS = 65_536
END_OF_TEXT = 2
#: Words whose ids a task keeps.
CACHE_WORDS = 1_000_000


def _lower(text: str) -> str:
    """Lower case where Python and the tokenizer surely agree: in texts of Latin-1 signs, which also have no decomposed ones."""
    try:
        return text.lower() if text.isascii() or text.encode("latin-1") else text
    except UnicodeEncodeError:
        return text


def _plain(word: str) -> bool:
    """Whether a word of letters is letters still, lower-cased and composed: a mark that comes off would go to the sign after it."""
    return word.isascii() or unicodedata.normalize("NFC", word.lower()).isalpha()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process: Python workers serve many tasks, and keep what they have encoded."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Token ids of whole texts by a lower-casing ``tokenizers`` file whose pre-tokens never span white space, so that ids of white-space
    separated pieces can be kept and joined. Texts with control characters that only Python takes for white space are
    encoded as they are."""

    _PLAIN = re.compile(r"([^\W\d_]+)([^\w\s]*)")
    _ODD = "\x1c\x1d\x1e\x1f"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}  # by piece; when half of what may be kept is there, it becomes the old half
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, missing: list[str]) -> None:
        """Encode the missing pieces, several hundred in a text.

        A piece of letters is one pre-token, and the last id of each ends a word, so the ids are cut where words end. A piece
        with a comma or full stop at its end is its word's ids and the sign's; other pieces are encoded one by one, or, with
        more signs at the end, cut after their second word's end.
        """
        words = [w for w in missing if w.isalpha()]
        rest = [w for w in missing if not w.isalpha()]
        ended = [w for w in rest if w[-1] in ".," and w[:-1].isalpha() and _plain(w[:-1])]
        need = {w[:-1] for w in ended}.difference(self.kept)
        words += need.difference(words)
        for lo in range(0, len(words), 512):
            self._cut(words[lo : lo + 512], 1)
        signs = {c: self._whole(c).tobytes() for c in ".,"}
        kept = self.kept
        kept.update([(w, kept[w[:-1]] + signs[w[-1]]) for w in ended])
        rest = [w for w in rest if w not in kept]
        pairs = [w for w in rest if (found := self._PLAIN.fullmatch(w)) and found[2]]
        for lo in range(0, len(pairs), 512):
            self._cut(pairs[lo : lo + 512], 2)
        kept.update([(w, self._whole(w).tobytes()) for w in rest if w not in kept])

    def _cut(self, pieces: list[str], n: int) -> None:
        """Encode pieces of ``n`` pre-tokens each at once; one by one where a letter that its lower case takes apart spoils the count."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        cuts = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
        if len(cuts) == n * len(pieces) and (n == 1 or all(map(str.isascii, pieces))) and self._latin(pieces):
            cuts, raw = cuts[n - 1 :: n], ids.tobytes()
            self.kept.update(zip(pieces, [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))
        else:
            self.kept.update([(w, self._whole(w).tobytes()) for w in pieces])

    @staticmethod
    def _latin(pieces: list[str]) -> bool:
        try:
            return bool("".join(pieces).encode("latin-1"))
        except UnicodeEncodeError:
            return False

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [None if t is None else _lower(t).split() for t in texts]
        out = []
        wanted = set().union(*filter(None, split))
        if len(wanted) > CACHE_WORDS // 2:  # of one batch: text by text
            return [x for t in texts for x in self([t])] if len(texts) > 1 else [self._whole(texts[0])]
        if len(self.kept) > CACHE_WORDS // 2:
            self.kept, self.old = {}, self.kept
        missing = wanted.difference(self.kept)
        again = [w for w in missing if w in self.old]
        self.kept.update(zip(again, map(self.old.__getitem__, again), strict=True))
        if missing := list(missing.difference(again)):
            self._learn(missing)
        for t, ws in zip(texts, split, strict=True):
            if ws and any(c in t for c in self._ODD):
                out.append(self._whole(t))
            else:
                out.append(np.frombuffer(b"".join(map(self.kept.__getitem__, ws or ())), "<u4"))
        return out

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def powers(n: int) -> list[int]:
    """n as a sum of falling powers of two."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (tokens, [(document, start, length), ...]); all full; each token of each document in one piece.

    Sequences come by tier, the longest first, and are deterministic: of documents of one length the first goes first.
    """
    top = tiers[-1]
    sequences: list[tuple[int, list[tuple[int, int, int]]]] = []
    pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # of (length, -document, start), ascending
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= top:
            sequences.append((top, [(d, start, top)]))
            start += top
        if n > start:
            pools[bisect_left(tiers, n - start)].append((n - start, -d, start))
    for pool in pools:
        pool.sort()
    left: list[tuple[int, int, int]] = []
    for k in reversed(range(len(tiers))):
        size = tiers[k]
        below = tiers[k - 1] if k else 0
        # A tier's own documents that no longer fill a window with what is shorter move down, cut to powers of two there.
        while pools[k]:
            if sum(n for p in pools[: k + 1] for n, _, _ in _some(p, size)) < size:
                break
            room, pieces = size, []
            while room:
                found = next(((j, at) for j in reversed(range(k + 1)) if (at := bisect_left(pools[j], (room + 1,)) - 1) >= 0), None)
                if found:
                    n, d, start = pools[found[0]].pop(found[1])
                    pieces.append((-d, start, n))
                    room -= n
                    continue
                # Nothing fits whole: cut from the shortest document there is.
                j = next(j for j in range(k + 1) if pools[j])
                n, d, start = pools[j].pop(0)
                pieces.append((-d, start, room))
                insort(pools[bisect_left(tiers, n - room)], (n - room, d, start + room))
                room = 0
            sequences.append((size, pieces))
        if pools[k] and k:
            for n, d, start in pools[k]:
                insort(pools[k - 1], (below, d, start)) if n > below else insort(pools[k - 1], (n, d, start))
                if n > below:
                    insort(pools[bisect_left(tiers, n - below)], (n - below, d, start + below))
            pools[k] = []
    left = pools[0]
    room, pieces = 0, []
    sizes = iter(powers(sum(n for n, _, _ in left)))
    for n, d, start in left:
        while n:
            if not room:
                room = size = next(sizes)
            take = min(n, room)
            pieces.append((-d, start, take))
            n, start, room = n - take, start + take, room - take
            if not room:
                sequences.append((size, pieces))
                pieces = []
    return sequences


def _some(pool: list[tuple[int, int, int]], enough: int) -> Iterator[tuple[int, int, int]]:
    """The longest of a pool, until they are enough."""
    total = 0
    for x in reversed(pool):
        yield x
        total += x[0]
        if total >= enough:
            return


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"


def packed(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start and length in its document, ids_crc32, doc_tokens (of the document, with the
    end-of-text id 2), sequence_id, offset there, sequence_length and step_group; with ``with_ids`` also the ids.

    Null and empty texts are documents of the end-of-text id alone; very long ones are cut into full windows; repeated
    rows are packed each; an empty table gives no pieces; further columns are not read. Sequence numbers are unique over
    the table: the task's number, then the sequence's there.
    """
    path = tokenizer or _default_tokenizer()
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        base, groups, filled = TaskContext.get().partitionId() << 32, {}, 0
        ids_of: list[np.ndarray] = []
        names: list[int | None] = []
        total = 0

        def flush() -> pd.DataFrame:
            nonlocal filled, ids_of, names, total
            rows = []
            for size, pieces in pack([len(x) for x in ids_of], tiers):
                seen = groups.get(size, 0)  # tokens of this tier so far: a step group holds sequences of one size
                group = base + (size.bit_length() << 24) + seen // STEP_TOKENS
                groups[size] = seen + size
                offset = 0
                for d, start, n in pieces:
                    cut = ids_of[d][start : start + n]
                    rows.append((names[d], start, n, zlib.crc32(cut.tobytes()), len(ids_of[d]), base + filled, offset, size, group, *([cut.astype(np.int32)] if with_ids else [])))
                    offset += n
                filled += 1
            ids_of, names, total = [], [], 0
            return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64"})

        end = np.array([END_OF_TEXT], "<u4")
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.iloc[lo : lo + 256]
                for name, ids in zip(part["doc_id"], encode(list(part["text"])), strict=True):
                    ids_of.append(np.concatenate([ids, end]))
                    names.append(None if pd.isna(name) else int(name))
                    total += len(ids) + 1
                if total >= SHARD_TOKENS:
                    yield flush()
        if ids_of:
            yield flush()

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir):
    """op8_packing."""
    from ctxloom.llm._common import table

    return packed(table(spark, sf_dir, "documents"))
