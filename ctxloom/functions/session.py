"""The engine's functions under names of Spark SQL: parser, embedder, entailment and contradiction, each to be exchanged by name.

A function is SQL text, which the optimizer takes in as an expression, or a pandas UDF, which comes in Arrow batches; a plain function of
a Series becomes one that gives vectors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
import zlib
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ctxloom.functions import vocabulary as V

_STOP = ", ".join(f"'{w}'" for w in V.ENTAILMENT_STOPWORDS)
_COMMON = ", ".join(f"'{w}'" for w in V.COMMON_WORDS)


def hashed(texts: pd.Series) -> pd.Series:
    """Counts of tokens by hash, signed, of length 1: a stand-in without semantics."""
    out = []
    for t in texts:
        v = np.zeros(256)
        for token, n in Counter(re.findall(V.SEARCH_TOKEN, (t or "").lower())).items():
            h = zlib.crc32(token.encode())
            v[h % 256] += n if h >> 31 else -n
        length = np.sqrt((v * v).sum())
        out.append(v / length if length else v)
    return pd.Series(out)


#: Name: (parameters, result, SQL body) or a UDF. What stands first may be used by what follows.
FUNCTIONS: dict[str, tuple[str, str, str] | Callable] = {
    "ctx_tokens": ("t STRING", "ARRAY<STRING>", "array_distinct(transform(regexp_extract_all(coalesce(t, ''), '[A-Za-z]+', 0), x -> lower(x)))"),
    "ctx_parse": ("t STRING", "ARRAY<STRING>", f"array_except(array_distinct(regexp_extract_all(lower(coalesce(t, '')), '(?U)\\\\b[a-z]{{4,}}\\\\b', 0)), array({_COMMON}))"),
    "ctx_content": ("t STRING", "ARRAY<STRING>", f"array_except(ctx_tokens(t), array({_STOP}))"),
    "ctx_entails": ("premise STRING, hypothesis STRING", "DOUBLE", "CASE WHEN size(ctx_content(premise)) > 0 AND size(ctx_content(hypothesis)) > 0 AND size(array_intersect(ctx_content(premise), ctx_content(hypothesis))) >= 0.3D * size(ctx_content(hypothesis)) THEN 1.0D ELSE 0.2D END"),
    "ctx_contradicts": ("a STRING, b STRING", "DOUBLE", "0.0D"),
    "ctx_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0.0D, (s, x) -> s + x * x) * aggregate(b, 0.0D, (s, x) -> s + x * x)), 0.0D)"),
    "ctx_embed": hashed,
}


def register(spark: SparkSession, others: Mapping[str, tuple[str, str, str] | Callable] | None = None) -> None:
    """Register FUNCTIONS with the session, those in ``others`` as given there. A query that names them runs with what is registered when it is analysed."""
    unknown = set(others or {}) - set(FUNCTIONS)
    if unknown:
        raise ValueError(f"no such function: {sorted(unknown)}")
    for name, function in (FUNCTIONS | dict(others or {})).items():
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        if isinstance(function, tuple):
            parameters, result, body = function
            spark.sql(f"CREATE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
        else:
            spark.udf.register(name, function if hasattr(function, "returnType") else F.pandas_udf(function, "array<double>"))
