"""A Merkle manifest of a dataset: leaves by row, trees by source, one root, and the authentication path of every leaf.

Leaves are hashed where the documents are read. They are dealt by range of (source, doc_id), so that their places in the order
follow from the counts of the ranges before, and packed into aligned blocks of ARITY ** BLOCK_LEVELS leaves, a row each. The roots
of the blocks climb to the root of their source, and these to the root of all, one grouping a level; what stands beside a node on
its way up is joined down again. In a block, the paths of successive leaves are made by fractal traversal: for each level the
existing run of nodes is kept, and beside it the desired next run, which grows by one leaf a step and takes its place when the
last leaf below it is done. The paths above the block are then appended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.llm._common import input_parts, materialize, table

ARITY = 16
#: Levels of a block: 4,096 leaves.
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PATH = "array<struct<before:string,after:string>>"
_PACKED = "tree string, block long, n long, digest string, doc_ids array<long>, leaves array<string>, changed array<string>"
_MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """The digest of a row: each value by its number of UTF-8 bytes, a colon and itself, or a dash for null."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (c.cast("string") for c in values)]), 256)


class Run:
    """The nodes of one run of a level, built leaf by leaf. Of each level below, the nodes of one unfinished run are stacked."""

    def __init__(self, leaf_at: Callable[[int], str], level: int, number: int, n: int):
        width = ARITY ** (level + 1)
        self.leaf_at, self.level, self.at, self.end = leaf_at, level, min(n, number * width), min(n, (number + 1) * width)
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    @property
    def nodes(self) -> list[str]:
        return self.stack[self.level]

    def _push(self, k: int, node: str) -> None:
        self.stack[k].append(node)
        if k < self.level and len(self.stack[k]) == ARITY:
            self._close(k)

    def _close(self, k: int) -> None:
        node, self.stack[k] = digest(self.stack[k]), []
        self._push(k + 1, node)

    def step(self) -> None:
        """One more leaf; with the last one, the unfinished runs below are closed."""
        if self.at < self.end:
            self._push(0, self.leaf_at(self.at))
            self.at += 1
            if self.at == self.end:
                for k in range(self.level):
                    if self.stack[k]:
                        self._close(k)

    def finished(self) -> Run:
        while self.at < self.end:
            self.step()
        return self


def levels_of(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def tree_top(leaf_at: Callable[[int], str], n: int, levels: int) -> str:
    return leaf_at(0) if levels == 0 else digest(Run(leaf_at, levels - 1, 0, n).finished().nodes)


def traverse(leaf_at: Callable[[int], str], n: int, levels: int) -> Iterator[list[tuple[str, str]]]:
    """Of each leaf in turn its path: by level, what stands before and after the node in its run.

    Kept at a time are an existing and a desired run for each level, with the stack of the latter: some levels ** 2 * ARITY digests.
    """
    exist = [Run(leaf_at, k, 0, n).finished().nodes for k in range(levels)]
    desired = [Run(leaf_at, k, 1, n) for k in range(levels)]
    for i in range(n):
        path = []
        for k in range(levels):
            number, at = divmod(i // ARITY**k, ARITY)
            if i and i % ARITY ** (k + 1) == 0:
                exist[k], desired[k] = desired[k].nodes, Run(leaf_at, k, number + 1, n)
            path.append(("".join(exist[k][:at]), "".join(exist[k][at + 1 :])))
            desired[k].step()
        yield path


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``rank``, the place of each in its ``tree`` by ``order`` (from 0, nulls first), and ``n``, the rows of the tree.

    Rows are dealt by range, equal ones by the place where they were read, so a tree that holds most rows is dealt to many tasks;
    the numbers of rows of the ranges before are sums over one row for each range and tree.
    """
    keys = ("tree", *order, "_read")
    dealt = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(input_parts(rows), *keys).sortWithinPartitions(*keys).drop("_read")
    placed = materialize(dealt.withColumn("seq", F.monotonically_increasing_id()))
    part = F.shiftright("seq", 33)
    counts = placed.groupBy("tree", part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("least"))
    by = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialize(counts.select("tree", "part", (before - F.col("least")).alias("shift"), F.sum("rows").over(by).alias("n")))
    return placed.withColumn("part", part).join(counts, ["tree", "part"]).withColumn("rank", F.col("seq") + F.col("shift")).drop("seq", "part", "shift")


def _pack(levels: int):
    """A block as a row, with the digest at its top."""

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        leaves, n = group["leaf"].to_pylist(), group["n"][0].as_py()
        top = tree_top(leaves.__getitem__, len(leaves), min(levels, levels_of(n)))
        ids, changed = group["doc_id"].to_pylist(), group["changed"].to_pylist()
        names = ("tree", "block", "n", "digest", "doc_ids", "leaves", "changed")
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()))
        row = (key[0].as_py(), key[1].as_py(), n, top, ids, leaves, changed)
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    return pack


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of trees over the nodes (tree, idx, digest, n: nodes of the tree): their tops (tree, top), and (tree, idx, path) of every node.

    One grouping a level, of ARITY rows at most each; as many levels as the largest tree has. Trees that have ended stay behind.
    """
    first, levels, tops = nodes, [], None
    left = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        ended = nodes.where("n = 1").select("tree", F.col("digest").alias("top"))
        tops = ended if tops is None else tops.unionByName(ended)
        if left <= 1:
            break
        runs = nodes.where("n > 1").groupBy("tree", F.floor(F.col("idx") / ARITY).alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("nodes"), F.max("n").alias("n"))
        levels.append(materialize(runs))
        nodes = levels[-1].select("tree", F.col("run").alias("idx"), F.sha2(F.array_join("nodes.digest", ""), 256).alias("digest"), F.ceil(F.col("n") / ARITY).alias("n"))
        left = -(-left // ARITY)
    none = F.array().cast(_PATH)
    above = None
    for runs in reversed(levels):
        joined = lambda a, b: F.array_join(F.slice("nodes.digest", a, b), "")
        own = runs.select("tree", "run", F.size("nodes").alias("size"), "nodes", F.explode(F.sequence(F.lit(1), F.size("nodes"))).alias("at"))
        own = own.select("tree", "run", F.get("nodes", F.col("at") - 1)["idx"].alias("idx"), F.struct(joined(F.lit(1), F.col("at") - 1).alias("before"), joined(F.col("at") + 1, F.col("size") - F.col("at")).alias("after")).alias("beside"))
        if above is None:
            above = own.select("tree", "idx", F.array("beside").cast(_PATH).alias("path"))
        else:
            up = above.select("tree", F.col("idx").alias("run"), F.col("path").alias("rest"))
            above = own.join(up, ["tree", "run"], "left").select("tree", "idx", F.concat(F.array("beside").cast(_PATH), F.coalesce("rest", none)).alias("path"))
    if above is None:
        return tops, first.select("tree", "idx", none.alias("path"))
    return tops, first.select("tree", "idx").join(above, ["tree", "idx"], "left").select("tree", "idx", F.coalesce("path", none).alias("path"))


def packed_blocks(docs: DataFrame, tampered: Column | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """The leaves of ``docs`` in aligned blocks, a row each, with what stands above: path, subroot, root."""
    seen = F.lit(None).cast("string") if tampered is None else tampered
    rows = docs.select("doc_id", leaf(*map(F.col, FIELDS)).alias("leaf"), F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias("tree"), seen.alias("changed"))
    placed = ranked(rows, "doc_id", "leaf", "changed")
    placed = placed.withColumn("block", F.floor(F.col("rank") / ARITY**levels))
    blocks = materialize(placed.groupBy("tree", "block").applyInArrow(_pack(levels), _PACKED))
    tops, paths = climb(blocks.select("tree", F.col("block").alias("idx"), "digest", F.ceil(F.col("n") / ARITY**levels).alias("n")))
    sources = materialize(tops.withColumnRenamed("top", "digest"))
    # The sources are the nodes of one further tree, by their order.
    order = ranked(sources.select(F.col("tree").alias("source"), F.lit("").alias("tree"), "digest"), "source")
    order = materialize(order.withColumnRenamed("rank", "idx"))
    roots, over = climb(order.select("tree", "idx", "digest", "n"))
    above = order.join(over.select("idx", F.col("path").alias("upper")), "idx").join(roots.withColumnRenamed("top", "root"), "tree")
    above = above.select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "root", "upper")
    ways = paths.join(above, "tree").select("tree", F.col("idx").alias("block"), F.concat("path", "upper").alias("path"), "subroot", "root")
    return blocks.join(ways, ["tree", "block"])


def _rows(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[tuple[dict, Iterator[list[tuple[str, str]]]]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row, traverse(row["leaves"].__getitem__, len(row["leaves"]), min(levels, levels_of(row["n"])))


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = digest([before, node, after])
    return node


def _manifest(levels: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ways in _rows(batches, levels):
            upper = [(p["before"], p["after"]) for p in row["path"]]
            beside = "".join(b + a for b, a in upper)
            known: dict[str, str] = {}  # what the tops of the block fold to
            proofs, folded = [], []
            for own, changed, path in zip(row["leaves"], row["changed"], ways, strict=True):
                proofs.append(digest([*(b + a for b, a in path), beside]))
                top = fold(own if changed is None else changed, path)
                if top not in known:
                    known = {**known, top: fold(top, upper)} if len(known) < ARITY else {top: fold(top, upper)}
                folded.append(known[top])
            n, root = len(proofs), row["root"]
            columns = (row["doc_ids"], row["leaves"], [row["subroot"]] * n, [root] * n, proofs, folded, [f == root for f in folded])
            kinds = (pa.int64(), *(pa.string(),) * 5, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _MANIFEST.split(", ")])

    return rows


def _paths(levels: int):
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ways in _rows(batches, levels):
            paths = [[{"before": b, "after": a} for b, a in path] + row["path"] for path in ways]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["leaves"]), pa.array(paths, kind)], names=["doc_id", "leaf", "path"])

    return rows


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of ``docs`` (FIELDS; other columns play no part).

    ``tampered`` is the leaf of a row as it was received, null where nothing was changed: it is folded with the siblings of the
    original, and verified says whether the root comes out. Nulls count as values of their own, in every field; rows of a null
    source are the first tree, those of a null doc_id the first leaves; rows of one id go by their leaves, and repeated rows are
    leaves each; texts of any length are hashed whole; of an empty table there are no rows, and no root.
    """
    return packed_blocks(docs, tampered, levels).mapInArrow(_manifest(levels), _MANIFEST)


def authentication_paths(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, path of each row: by level up to the root, what stands before and after the node in its run. Cases as in ``manifest``."""
    return packed_blocks(docs, levels=levels).mapInArrow(_paths(levels), f"doc_id long, leaf string, path {_PATH}")


def query(spark, sf_dir):
    """op13_merkle."""
    docs = table(spark, sf_dir, "documents")
    values = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    return manifest(docs, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(*values)))


def _oracle(levels: int = 5, source_levels: int = 3) -> str:
    """DuckDB: the levels written out, for up to ARITY ** levels rows a source and ARITY ** source_levels sources."""

    def tree(name: str, by: str, k: int) -> str:
        return f"""
{name}r{k} AS (SELECT {by}, idx // {ARITY} AS run, list(digest ORDER BY idx) AS nodes, any_value(n) AS n FROM {name}{k} WHERE n > 1 GROUP BY ALL),
{name}{k + 1} AS (SELECT {by}, run AS idx, sha256(array_to_string(nodes, '')) AS digest, (n + {ARITY - 1}) // {ARITY} AS n FROM {name}r{k}),"""

    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    own = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in FIELDS) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    tops = lambda name, by, n: " UNION ALL ".join(f"SELECT {by}, digest FROM {name}{k} WHERE n = 1" for k in range(n + 1))

    def step(k: int, before: str, joined: str, div: int) -> str:
        nodes, at = "r.nodes", f"(i // {ARITY**div}) % {ARITY}"
        first, rest = f"array_to_string({nodes}[1:{at}], '')", f"array_to_string({nodes}[{at} + 2:], '')"
        return f"""
p{k + 1} AS (SELECT p.* EXCLUDE (proof, folded), CASE WHEN r.nodes IS NULL THEN proof ELSE proof || {first} || {rest} END AS proof,
  CASE WHEN r.nodes IS NULL THEN folded ELSE sha256({first} || folded || {rest}) END AS folded FROM {before} p LEFT JOIN {joined}),"""

    sql = f"""WITH d AS (SELECT doc_id, '+' || source AS s0, {own('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {own(lower)} END AS changed FROM documents),
e AS (SELECT doc_id, coalesce(s0, '') AS s, leaf, changed, row_number() OVER (PARTITION BY coalesce(s0, '') ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY coalesce(s0, '')) AS n FROM d),
t0 AS (SELECT s, i AS idx, leaf AS digest, n FROM e),"""
    sql += "".join(tree("t", "s", k) for k in range(levels)) + f"""
sub AS ({tops('t', 's', levels)}),
u0 AS (SELECT 0 AS z, row_number() OVER (ORDER BY s) - 1 AS idx, digest, count(*) OVER () AS n, s FROM sub),"""
    sql += "".join(tree("u", "z", k) for k in range(source_levels)) + f"""
top AS ({tops('u', 'z', source_levels)}),
p0 AS (SELECT e.doc_id, e.s, e.i, e.leaf, '' AS proof, coalesce(e.changed, e.leaf) AS folded FROM e),"""
    for k in range(levels):
        sql += step(k, f"p{k}", f"tr{k} r ON r.s = p.s AND r.run = p.i // {ARITY ** (k + 1)}", k)
    sql += f"\nq AS (SELECT p.doc_id, p.leaf, p.proof, p.folded, u0.digest AS subroot, u0.idx AS i FROM p{levels} p JOIN u0 ON u0.s = p.s),"
    for k in range(source_levels):
        sql += step(90 + k, "q" if k == 0 else f"p{90 + k}", f"ur{k} r ON r.run = p.i // {ARITY ** (k + 1)}", k)
    return sql + f"""
z AS (SELECT p.*, top.digest AS root FROM p{90 + source_levels} p, top)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM z"""


ORACLE = _oracle()
