"""Chunking: sections by a cascade of patterns, paragraphs, and a recursive splitter for what is still too long."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.functions import vocabulary as V
from ctxloom.functions.text import once, padded, python_strip, section_id, split, strip

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def sections(text: Column) -> Column:
    """The stripped parts over 50 characters, by the first pattern that gives three at least; null if none does."""
    three = lambda parts: F.when(F.size(parts) >= 3, parts)
    found = [once(F.filter(F.transform(split(text, p), strip), lambda s: F.length(s) > 50), three) for p in V.SECTION_BREAKS]
    # Only a text that holds two breaks at least is cut into three parts.
    return F.coalesce(*[F.when(F.regexp_count(text, F.lit(p)) >= 2, f) for p, f in zip(V.SECTION_BREAKS, found, strict=True)])


def recursive_split(text: str, size: int = 500, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that works; neighbours share up to ``overlap``.

    Pieces that the first separator leaves too long are split by the next; then neighbours are packed again.
    """
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    sep = next((s for s in separators if s and s in text), "")
    if not sep:
        step = max(1, size - overlap)
        return [p for p in (text[k : k + size].strip() for k in range(0, max(1, len(text) - overlap), step)) if p]
    finer = separators[separators.index(sep) + 1 :]
    out, window, length = [], [], 0
    for part in text.split(sep):
        if len(part) > size:
            if window:
                out.append(sep.join(window))
                window, length = [], 0
            out += recursive_split(part, size, overlap, finer)
            continue
        if window and length + len(sep) + len(part) > size:
            out.append(sep.join(window))
            while window and (length > overlap or length + len(sep) + len(part) > size):
                length -= len(window.pop(0)) + (len(sep) if window else 0)
        length += len(part) + (len(sep) if window else 0)
        window.append(part)
    if window:
        out.append(sep.join(window))
    return [p for p in (x.strip() for x in out) if p]


def splitter(size: int, overlap: int, largest: int):
    """``recursive_split`` of each of an array's texts as an Arrow UDF: the packing of pieces depends on their order, which column
    functions do not express well. Texts of at most ``largest`` characters stay whole."""

    @F.pandas_udf("array<array<string>>")
    def again(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda parts: None if parts is None else [[t] if len(t) <= largest else recursive_split(t, size, overlap) for t in parts])

    return again


def chunk_documents(documents: DataFrame, size: int = 500, overlap: int = 100, largest: int = 1000) -> DataFrame:
    """id, text, source_doc_id, source_title, chunk_index, section_id and section_heading of the chunks of (id, title, text).

    The text is the title and the text below it. Sections over ``largest`` are split again, each piece under its section's
    heading; texts without sections are split by size. One map over the rows: a repeated row gives its chunks again.
    """
    full = documents.select("id", "title", F.concat_ws("\n", "title", "text").alias("full")).withColumn("parts", sections(F.col("full")))
    # Python gets only what has to be split again.
    long, short = F.exists("parts", lambda p: F.length(p) > largest), F.length("full") <= size
    cut = full.select(
        "id", "title", "parts", F.when(F.col("parts").isNull() & short, python_strip(F.col("full"))).alias("whole"),
        splitter(size, overlap, largest)(F.when(long, F.col("parts"))).alias("cut"), splitter(size, overlap, 0)(F.when(F.col("parts").isNull() & ~short, F.array("full"))).alias("plain"),
    )
    one = lambda t: F.filter(F.array(t), lambda x: x != "")
    cut = cut.select("id", "title", "parts", F.coalesce("cut", F.transform("parts", lambda p: F.array(p))).alias("cut"), F.coalesce("plain", F.array(one(F.col("whole")))).alias("plain"))
    heading = lambda body: strip(F.substring(F.substring_index(body, "\n", 1), 1, 100))

    def section(body: Column, pieces: Column) -> Column:
        def placed(h: Column) -> Column:
            named = F.when(F.length(body) <= largest, pieces).otherwise(F.transform(pieces, lambda p: F.concat(F.lit("["), h["heading"], F.lit("]\n"), p)))
            return F.transform(named, lambda p: F.struct(p.alias("text"), h["id"].alias("section_id"), h["heading"].alias("section_heading")))

        return once(once(heading(body), lambda h: F.struct(h.alias("heading"), section_id(h).alias("id"))), placed)

    sectioned = F.flatten(F.zip_with("parts", "cut", section))
    plain = F.transform(F.flatten("plain"), lambda p: F.struct(p.alias("text"), F.lit(None).cast("string").alias("section_id"), F.lit(None).cast("string").alias("section_heading")))
    out = cut.select("id", "title", F.posexplode(F.coalesce(sectioned, plain)).alias("chunk_index", "c"))
    return out.select(
        F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit("_chunk_"), padded(F.col("chunk_index"), 3)).alias("id"), "c.text", F.col("id").alias("source_doc_id"), F.col("title").alias("source_title"), "chunk_index", "c.section_id", "c.section_heading"
    )


def pack_paragraphs(text: Column, most: int = 1500, least: int = 200) -> Column:
    """Paragraphs, joined while they stay under ``most`` characters; packs under ``least`` are dropped."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")
    zero = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        fits = F.length(acc["open"]) + F.length(p) < most
        return F.struct(F.when(fits, joined).otherwise(p).alias("open"), F.when(fits | (acc["open"] == ""), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"))

    packed = F.aggregate(paragraphs, zero, step, lambda acc: F.array_append(acc["done"], acc["open"]))
    return F.filter(packed, lambda p: F.length(p) >= least)


def contract_chunks(text: Column, most: int = 20) -> Column:
    """Sections of a contract: by the first pattern that gives more than five parts, those over 100 characters, cut at 2,000;
    of fewer than three, paragraphs. At most ``most``."""
    parts = [F.split(text, p, -1) for p in V.CONTRACT_BREAKS]
    found = reduce(lambda a, b: F.coalesce(a, b), [F.when(F.size(p) > 5, F.filter(F.transform(p, strip), lambda s: F.length(s) > 100)) for p in parts])
    found = F.transform(found, lambda s: F.substring(s, 1, 2000))
    return F.slice(F.when(F.size(found) >= 3, found).otherwise(pack_paragraphs(text)), 1, most)
