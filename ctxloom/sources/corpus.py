"""Readers and writers: corpora as JSON, CSV, text files or chunk tables; annotations; results."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxloom.functions.chunk import contract_chunks
from ctxloom.functions.text import strip

DOCUMENT = "id string, title string, text string, source string"
ANNOTATION = (
    "id string, contract_file string, query string, trap_type string, difficulty string, ground_truth_answer string, relevant_sections array<string>, information_units array<string>, notes string"
)
GRAPH = "nodes array<struct<id:string,text:string,metadata:map<string,string>>>, edges array<struct<source:string,target:string,relation:string,weight:double>>"


def read_json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file {"documents": [...]}."""
    return spark.read.schema(f"documents array<struct<{DOCUMENT.replace(' string', ':string').replace(', ', ',')}>>").json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.*")


def _first(columns: list[str], names: tuple[str, ...]) -> Column | None:
    found = {c.lower().strip(): c for c in columns}
    use = [F.nullif(strip(F.col(f"`{found[n]}`")), F.lit("")) for n in names if n in found]
    return F.coalesce(*use) if use else None


#: Characters of a file that tell whether it has a header.
SNIFFED = 4096


def has_header(spark: SparkSession, path: str) -> bool:
    """Whether the first row names columns, by the standard sniffer over the file's beginning; a file that it cannot read has none."""
    head = "\n".join(r[0] for r in spark.read.text(path).head(200))[:SNIFFED].removeprefix("\ufeff")
    try:
        return csv.Sniffer().has_header(head)
    except csv.Error:
        return False


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, as read from files, with a column of consecutive numbers from 1 in the order of files and of their splits.

    Within a split rows are numbered where they are read; a split begins after the counts of those before it, of which there is one row each.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"))
    splits = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_least"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_file", "_block", (before - F.col("_least") + 1).alias("_shift"))
    return placed.join(splits, ["_file", "_block"]).withColumn(name, F.col("_seq") + F.col("_shift")).drop("_file", "_block", "_seq", "_shift")


def read_csv_corpus(spark: SparkSession, path: str, header: bool | None = True, multi_line: bool = True) -> DataFrame:
    """Documents of a CSV file, columns by their names; without a text column, all values that are not blank, joined by " | ".

    With ``header`` None the file's beginning decides whether it has one. Blank rows are dropped; missing ids are row numbers, repeated ones get a suffix
    _1, _2 ... in the order of the file. Raises ValueError if no row is usable. Quoted line breaks need ``multi_line``; a large file
    without them is read in splits.
    """
    rows = spark.read.csv(path, header=has_header(spark, path) if header is None else header, multiLine=multi_line, encoding="UTF-8")
    names = rows.columns
    rows = numbered(rows, "_n")
    every = F.concat_ws(" | ", *[F.nullif(strip(F.col(f"`{c}`")), F.lit("")) for c in names])
    text, key, title = _first(names, ("text", "content", "body")), _first(names, ("id", "doc_id", "document_id")), _first(names, ("title", "name", "header"))
    number = F.col("_n").cast("string")
    out = rows.where(every != "").select(
        F.coalesce(*([key] if key is not None else []), F.concat(F.lit("row_"), number)).alias("base"), F.coalesce(*([title] if title is not None else []), F.concat(F.lit("Row "), number)).alias("title"),
        F.coalesce(*([text] if text is not None else []), every).alias("text"), "_n",
    )
    if out.isEmpty():
        raise ValueError(f"{path} holds no usable row")
    again = F.row_number().over(Window.partitionBy("base").orderBy("_n")) - 1
    return out.select(F.when(again == 0, F.col("base")).otherwise(F.concat_ws("_", "base", again.cast("string"))).alias("id"), "title", "text", F.lit(path).alias("source"))


def read_text_corpus(spark: SparkSession, path: str, most_files: int | None = None, most_chunks: int = 20) -> DataFrame:
    """Chunks of each text file of a folder; with ``most_files`` the first so many files by path."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("path"))
    if most_files is not None:
        files = files.orderBy("path").limit(most_files)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    chunks = files.select(name.alias("name"), F.posexplode(contract_chunks(F.col("text"), most_chunks)).alias("k", "text"))
    return chunks.select(F.format_string("%s_chunk_%03d", "name", "k").alias("id"), F.col("name").alias("title"), "text", F.col("name").alias("source"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations without placeholders; a missing answer, query or file counts as one."""
    rows = spark.read.schema(f"annotations array<struct<{ANNOTATION.replace(' array<string>', ':array<string>').replace(' string', ':string').replace(', ', ',')}>>").json(path, multiLine=True)
    rows = rows.select(F.explode("annotations").alias("a")).select("a.*")
    real = [F.col(c).isNotNull() & ~F.col(c).contains("REPLACE") for c in ("ground_truth_answer", "query", "contract_file")]
    return rows.where(real[0] & real[1] & real[2])


def validate_annotations(rows: DataFrame) -> DataFrame:
    """(issue, n): totals, counts by trap type, and annotations without information units or sections."""
    checks = {"total": F.lit(True), "no_units": F.coalesce(F.size("information_units"), F.lit(0)) <= 0, "no_sections": F.coalesce(F.size("relevant_sections"), F.lit(0)) <= 0}
    checks |= {f"trap_{t}": F.col("trap_type") == t for t in ("A", "B", "C")}
    return rows.agg(*[F.count_if(c).alias(n) for n, c in checks.items()]).select(F.explode(F.create_map(*[x for n in checks for x in (F.lit(n), F.col(n))])).alias("issue", "n"))


def by_trap(rows: DataFrame, trap_type: str) -> DataFrame:
    return rows.where(F.col("trap_type") == trap_type)


def by_contract(rows: DataFrame, contract_file: str) -> DataFrame:
    return rows.where(F.col("contract_file") == contract_file)


def grouped_by_contract(rows: DataFrame) -> DataFrame:
    """contract_file, n and ids: the annotations of each file, in order of their ids."""
    return rows.groupBy("contract_file").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


def evaluation_queries(rows: DataFrame, difficulty: str | None = None, category: str | None = None) -> DataFrame:
    """Questions (query, category, difficulty, ...) of a difficulty and a category, where these are given."""
    for name, value in (("difficulty", difficulty), ("category", category)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def categories(rows: DataFrame) -> DataFrame:
    """The distinct categories."""
    return rows.select("category").distinct()


def write_annotations(rows: DataFrame, path: str) -> None:
    """Annotations as JSON lines, partitioned by trap type."""
    rows.write.mode("overwrite").partitionBy("trap_type").json(path)


def set_active(documents: DataFrame, name: str = "active_corpus") -> None:
    """Make a corpus the session's active one: a view, not a global."""
    documents.createOrReplaceTempView(name)


def active(spark: SparkSession, default: DataFrame | None = None, name: str = "active_corpus") -> DataFrame:
    """The active corpus, else the default."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    if default is None:
        raise ValueError("no corpus is active")
    return default


def clear_active(spark: SparkSession, name: str = "active_corpus") -> None:
    spark.catalog.dropTempView(name)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a flat file of ``key: value`` lines; comments, blank lines and quotes around values are left out."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"(^|\s)#.*$", "").alias("line"))
    rows = lines.select(strip(F.substring_index("line", ":", 1)).alias("key"), strip(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value")).where("line LIKE '%:%' AND key != ''")
    return rows.select("key", F.regexp_replace("value", r"^(['\"])(.*)\1$", "$2").alias("value"))


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(section, name, value) of a JSON file of sections of numbers, such as weights."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,double>>").alias("m"))
    return rows.select(F.explode("m").alias("section", "v")).select("section", F.explode("v").alias("name", "value"))


def write_parameters(rows: DataFrame, path: str) -> None:
    """The same, from (section, name, value): one file of a bounded size."""
    by_section = rows.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("name", "value"))).alias("v"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("section", "v"))), lambda x: F.struct(x["section"], F.map_from_entries(x["v"])))
    whole = by_section.agg(F.to_json(F.map_from_entries(listed)).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def read_trap_scan(spark: SparkSession, path: str) -> DataFrame:
    """Contracts of a scan: name, the three counts and the total score, a JSON array of objects."""
    schema = "name string, path string, trap_a_count int, trap_b_count int, trap_c_count int, trap_c_sections int, total_score double"
    return spark.read.schema(schema).json(path, multiLine=True)


def write_trap_scan(scan: DataFrame, path: str, most: int = 200) -> None:
    """The ``most`` contracts of the greatest total score; the ranking is the feature."""
    scan.orderBy(F.desc("total_score"), "name").limit(most).coalesce(1).write.mode("overwrite").json(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph file; nodes that repeat an id are dropped but for the first."""
    g = spark.read.schema(GRAPH).json(path, multiLine=True)
    nodes = g.select(F.posexplode("nodes").alias("pos", "n")).select("pos", "n.*")
    first = nodes.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where("r = 1").drop("r")
    return first, g.select(F.explode("edges").alias("e")).select("e.*")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks with their vectors as Parquet by source, so that reads of one source touch its files only."""
    chunks.repartition("source").write.mode("overwrite").partitionBy("source").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.length(strip(F.col("text"))) > 0)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def append_trials(trials: DataFrame, path: str) -> None:
    trials.write.mode("append").parquet(path)
