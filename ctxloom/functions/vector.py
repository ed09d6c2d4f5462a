"""Vector and set similarities as column expressions; arrays of double, computed inside the JVM."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """The inner product, over the shorter length; null components count as 0."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for empty or zero vectors, and for different lengths. Norms that are known already are not made again."""
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (scale > 0)
    return F.when(ok, dot(a, b) / scale).otherwise(0.0)


def unit(v: Column) -> Column:
    """Divided by its length; zero vectors stay."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def entailment(premise: Column, hypothesis: Column, threshold: float = 0.3) -> Column:
    """1 if the premise has at least ``threshold`` of the hypothesis's words, stop words aside; else 0.2."""
    from ctxloom.functions import vocabulary as V
    from ctxloom.functions.text import token_set

    stop = F.array(*map(F.lit, V.ENTAILMENT_STOPWORDS))
    p, h = F.array_except(token_set(premise), stop), F.array_except(token_set(hypothesis), stop)
    return F.when((F.size(p) > 0) & (F.size(h) > 0) & (F.size(F.array_intersect(p, h)) >= threshold * F.size(h)), 1.0).otherwise(0.2)


def contradiction(_a: Column, _b: Column) -> Column:
    """The default contradiction scorer knows none."""
    return F.lit(0.0)


def hashed_embedding(text: Column, dims: int = 256) -> Column:
    """A vector without a model: counts of tokens by hash, signed, of length 1. No semantics; a stand-in for an embedder."""
    from ctxloom.functions.vocabulary import SEARCH_TOKEN

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dims)
            for token, n in Counter(re.findall(SEARCH_TOKEN, (t or "").lower())).items():
                h = zlib.crc32(token.encode())
                v[h % dims] += n if h >> 31 else -n
            length = np.sqrt((v * v).sum())
            out.append(v / length if length else v)
        return pd.Series(out)

    return embed(text)
