"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a dataset directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset (tests), and gets a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ctxloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder once, and read it back.

    Lost executors then cost a re-read, never a recomputation of what came before. What was shuffled on the way is not needed
    any more, and Spark deletes it at the end of the write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def input_parts(df: DataFrame, per_part: int = 1) -> int:
    """A partition count that follows the input: as many as its scan has splits (times ``per_part``), the session's default at least."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, df.rdd.getNumPartitions() * per_part)


def set_aside(docs: DataFrame, *own: str) -> DataFrame:
    """``docs`` as the columns ``own`` and one struct ``rest`` of all others, so that no name of theirs can clash with an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*others, F.lit(0).alias("_")).alias("rest") if not others else F.struct(*others).alias("rest"))


def put_back(columns: list[str], **own: Column) -> list[Column]:
    """The columns of the table that was set aside, in their order; those in ``own`` as given."""
    return [own[c].alias(c) if c in own else F.col("rest").getField(c).alias(c) for c in columns]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, each worked out once a row: neighbouring projections are merged by the optimizer, and an array that
    a lambda looks into would then be made anew for each element. A generator of one row lies between them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def map_in_pandas(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """``df.mapInPandas(run, schema)`` for columns of any name: names with dots are numbered on the way."""
    names, out = df.columns, [f.name for f in schema]
    numbered = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema)])

    def mapped(batches):
        for got in run(b.set_axis(names, axis=1) for b in batches):
            yield got[out].set_axis(numbered.names, axis=1)

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInPandas(mapped, numbered).toDF(*out)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, although ``use`` looks at it several times, or for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
