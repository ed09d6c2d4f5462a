"""A table of vectors that takes upserts: rows by id in hash buckets, a new file set for each bucket that a batch touches, and a log of commits.

A batch counts once its commit is there. One that comes again, under its number, changes nothing; one that failed half-way is written
anew. Only the buckets of a batch's ids are read and rewritten, so the work follows the batch and the size of a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW = "id string, vector array<double>, metadata map<string,string>, seq long, deleted boolean"
BUCKETS = 64


class VectorTable:
    """Rows of ROW: of those with one id the one with the greatest seq counts, and none if that one is deleted."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def commits(self) -> DataFrame:
        """(batch, bucket): which buckets each batch wrote."""
        kind = "batch long, bucket int"
        return self.spark.read.schema(kind).parquet(f"{self.path}/commits") if self._exists("commits") else self.spark.createDataFrame([], kind)

    def _latest(self) -> dict[int, int]:
        """The batch that wrote each bucket last: as many entries as there are buckets."""
        return {r.bucket: r.batch for r in self.commits().where("bucket >= 0").groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}

    def _read(self, files: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/{batch}/bucket={bucket}" for bucket, batch in sorted(files.items())]
        return self.spark.read.schema(ROW).parquet(*paths) if paths else self.spark.createDataFrame([], ROW)

    def all_rows(self) -> DataFrame:
        return self._read(self._latest())

    def rows(self) -> DataFrame:
        """id, vector and metadata of what is there."""
        return self.all_rows().where("NOT deleted").select("id", "vector", "metadata")

    def upsert(self, batch_rows: DataFrame, batch: int) -> None:
        """Merge a batch of ROW by id; as ``foreachBatch`` calls it."""
        if not self.commits().where(F.col("batch") == batch).isEmpty():
            return
        own = batch_rows.select("id", "vector", "metadata", "seq", F.coalesce("deleted", F.lit(False)).alias("deleted"))
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        own = own.withColumn("bucket", bucket)
        touched = {r[0] for r in own.select("bucket").distinct().collect()}  # a number for each bucket at most
        if touched:
            latest = self._latest()
            there = self._read({b: latest[b] for b in touched if b in latest}).withColumn("bucket", bucket)
            # What was there first wins over an equal seq of the batch.
            both = there.withColumn("_new", F.lit(0)).unionByName(own.withColumn("_new", F.lit(1)))
            w = Window.partitionBy("bucket", "id").orderBy(F.desc("seq"), "_new", F.xxhash64("vector", F.to_json("metadata")))
            merged = both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{batch}")
        rows = [(batch, b) for b in sorted(touched)] or [(batch, -1)]
        self.spark.createDataFrame(rows, "batch long, bucket int").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False):
        """A streaming query of upserts."""
        writer = stream.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
