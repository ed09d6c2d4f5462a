"""Queries that go through Structured Streaming: ``events`` arrive in slices of ten days, some of them late, with a restart half-way.

A user is a document and an event's type its text; every seventh event is a deletion. Of every fifty events one comes a slice late,
which the delay allows for; and of the first slice one in fifty comes four slices late, and is dropped by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.plans.ingestion import _LOG
from ctxloom.plans.registry import query, read
from ctxloom.sources.tables import new_folder
from ctxloom.streaming import keyed as K

SLICE_SECONDS, SLICES, DELAY = 864_000, 5, "360 hours"
_LATE = "event_id % 50 = 7 AND slice < 1"
_ARRIVED = "s AS (SELECT *, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 864000000000 AS slice FROM events), events AS (SELECT * FROM s WHERE NOT (event_id % 50 = 7 AND slice < 1))"
_SQL = f"WITH {_ARRIVED}, {_LOG}"


def slices(spark: SparkSession, d: str) -> tuple[DataFrame, object]:
    """Events with the slice in which they arrive, and the last time."""
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    # Whole microseconds: a slice is a number of events' own time, not of the session's calendar.
    slice_ = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) / (SLICE_SECONDS * 1_000_000))
    e = e.withColumn("slice", slice_)
    e = e.withColumn("arrives", F.when(F.expr(_LATE), 4).when(F.col("event_id") % 50 == 3, F.col("slice") + 1).otherwise(F.col("slice")))
    return e.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, "delete").otherwise("update").alias("op"), F.col("user_id").cast("string").alias("doc_id"),
        F.col("event_type").alias("text"), "ts", F.lit(None).cast("boolean").alias("accept"), "arrives",
    ), last


def streamed(spark: SparkSession, d: str) -> str:
    """Let the slices arrive, one micro-batch each; the folder with ``results`` and ``checkpoint``. After two slices the query ends, and a second one goes on."""
    folder = new_folder(spark, "stream")
    events, last = slices(spark, d)
    files = min(events.rdd.getNumPartitions(), 1 + events.count() // 100_000)
    source = lambda: spark.readStream.schema(K.EVENT).option("maxFilesPerTrigger", files).parquet(f"{folder}/in/*")
    run = lambda: K.start(source(), f"{folder}/results", f"{folder}/checkpoint", DELAY).awaitTermination()
    for k in range(SLICES):
        events.where(F.col("arrives") == k).drop("arrives").repartition(files).write.parquet(f"{folder}/in/{k}")
        if k == 1:
            run()
    done = spark.createDataFrame([(-1, K.TICK, "", None, None)], "seq long, op string, doc_id string, text string, accept boolean")
    done.withColumn("ts", F.lit(last) + F.expr(f"INTERVAL {2 * SLICE_SECONDS} SECONDS")).select("seq", "op", "doc_id", "text", "ts", "accept").coalesce(1).write.parquet(f"{folder}/in/{SLICES}")
    run()
    return folder


@query(f"{_SQL} SELECT seq, doc_id, action, coalesce(version, 0) AS version, substring(sha256(coalesce(text, '')), 1, 16) AS text_hash FROM r")
def stream_results(spark, d):
    """What each event does: as ``event_results``, but by keyed state over micro-batches, without what came too late."""
    rows = spark.read.schema(K.RESULT).parquet(f"{streamed(spark, d)}/results")
    return rows.select("seq", "doc_id", "action", F.coalesce("version", F.lit(0)).alias("version"), "text_hash")


@query(f"{_SQL} SELECT doc_id, version, action, seq, CASE WHEN action = 'deleted' THEN NULL ELSE substring(sha256(text), 1, 16) END AS text_hash FROM r WHERE action IN ('added', 'updated', 'deleted')")
def stream_history(spark, d):
    """Every version, read from the state itself."""
    rows = K.versions(spark, f"{streamed(spark, d)}/checkpoint")
    return rows.select("doc_id", "version", "action", "seq", F.when(F.col("action") != "deleted", F.col("text_hash")).alias("text_hash"))


@query(
    f"{_SQL}, w AS (SELECT doc_id, arg_max(text, seq) AS text, max(seq) AS seq, max(version) AS version FROM r WHERE action IN ('added', 'updated') GROUP BY doc_id), "
    "l AS (SELECT doc_id, arg_max(action, seq) AS last FROM r WHERE action IN ('added', 'updated', 'deleted') GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS n_events, count(DISTINCT action) AS n_actions FROM r GROUP BY doc_id) "
    "SELECT doc_id, text, version, last <> 'deleted' AS active, seq, n_events, n_actions FROM w JOIN l USING (doc_id) JOIN c USING (doc_id)"
)
def stream_current(spark, d):
    """The table after the stream, read from the state, with the counts of each document's results."""
    folder = streamed(spark, d)
    counts = spark.read.schema(K.RESULT).parquet(f"{folder}/results").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("action").alias("n_actions"))
    return K.current(spark, f"{folder}/checkpoint").select("doc_id", "text", "version", "active", "seq").join(counts, "doc_id")
