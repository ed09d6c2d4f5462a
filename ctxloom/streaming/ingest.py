"""Live ingestion: a stream of create, update and delete events to a current table and a version history, behind a quality gate.

Structured Streaming with ``foreachBatch``: the gate compares a new text with the whole current table, which no keyed state
could hold. The events of a document are taken one after the other, also within a batch, and a text of a batch is compared with
those that came before it. A batch writes its changes only; every COMPACT_EVERY batches they are merged into a new base. What a
batch wrote counts once its commit is there, so a batch that is tried again starts from the one before it, after a restart too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxloom.functions import text as T
from ctxloom.functions import vector as X
from ctxloom.functions import vocabulary as V
from ctxloom.operators.retrieval import pairs_of, top_similar

EVENT = "seq long, op string, doc_id string, text string"
#: Batches whose changes are kept apart from the base; queries that are kept, and those of them that the gate looks at.
COMPACT_EVERY, KEPT_QUERIES, RECENT_QUERIES = 10, 20, 5
CURRENT = "doc_id string, text string, text_hash string, embedding array<double>, version int, is_active boolean, seq long"


def gate(candidates: DataFrame, similarity: DataFrame, threshold: float = 0.3, relevance: DataFrame | None = None) -> DataFrame:
    """(doc_id, accept, score, reason): ``candidates`` are (doc_id, text), ``similarity`` and ``relevance`` (doc_id, value).

    Under five words, or over 0.95 similarity, a text is rejected; else its score decides. Without recent queries relevance is 0.5.
    """
    s = similarity.select("doc_id", F.col("value").alias("redundancy"))
    rows = candidates.join(s, "doc_id", "left")
    rows = rows.join(relevance.select("doc_id", F.col("value").alias("relevance")), "doc_id", "left") if relevance is not None else rows.withColumn("relevance", F.lit(None).cast("double"))
    rows = rows.withColumns({"redundancy": F.coalesce("redundancy", F.lit(0.0)), "relevance": F.coalesce("relevance", F.lit(0.5)), "tok": T.length_band(F.col("text")), "spec": T.specificity(F.col("text"))})
    w = V.GATE_WEIGHTS
    score = w["token_efficiency"] * F.col("tok") + w["specificity"] * F.col("spec") + w["non_redundancy"] * (1 - F.col("redundancy")) + w["query_relevance"] * F.col("relevance")
    short, copy = F.col("tok") == 0, F.col("redundancy") > 0.95
    reason = F.when(short, "too short").when(copy, "near duplicate").when(score >= threshold, "accepted").otherwise("below threshold")
    return rows.select("doc_id", (~short & ~copy & (score >= threshold)).alias("accept"), F.when(short | copy, 0.0).otherwise(score).alias("score"), reason.alias("reason"))


def changes(events: DataFrame, current: DataFrame) -> DataFrame:
    """Each event (seq, op, doc_id, text) with its action, version and text_hash: added, updated, unchanged, deleted, missing, or
    rejected where a column ``accept`` is false.

    The events of a document are folded in order, from its row in ``current``. A rejected text changes nothing.
    """
    known = current.select("doc_id", F.struct(F.col("version"), "text_hash", F.col("is_active").alias("active")).alias("old"))
    accept = F.coalesce(F.col("accept"), F.lit(True)) if "accept" in events.columns else F.lit(True)
    each = events.withColumn("e", F.struct("seq", "op", T.fingerprint(F.coalesce("text", F.lit(""))).alias("text_hash"), accept.alias("accept")))
    listed = each.groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("events")).join(known, "doc_id", "left")
    done = "array<struct<seq:bigint,action:string,version:int,text_hash:string>>"
    zero = F.struct(F.coalesce(F.col("old.version"), F.lit(0)).alias("version"), F.col("old.text_hash").alias("text_hash"), F.coalesce(F.col("old.active"), F.lit(False)).alias("active"), F.array().cast(done).alias("out"))

    def step(acc: Column, e: Column) -> Column:
        same = acc["active"] & acc["text_hash"].eqNullSafe(e["text_hash"])
        action = (
            F.when(e["op"] == "delete", F.when(acc["active"], "deleted").otherwise("missing")).when(same, "unchanged").when(~e["accept"], "rejected")
            .when(acc["version"] == 0, "added").otherwise("updated")
        )
        written, gone = action.isin("added", "updated"), action == "deleted"
        version = (acc["version"] + F.when(written, 1).otherwise(0)).cast("int")
        row = F.struct(e["seq"].alias("seq"), action.alias("action"), F.nullif(version, F.lit(0)).alias("version"), e["text_hash"].alias("text_hash"))
        return F.struct(version.alias("version"), F.when(written, e["text_hash"]).otherwise(acc["text_hash"]).alias("text_hash"), F.when(gone, False).otherwise(acc["active"] | written).alias("active"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = listed.select("doc_id", F.explode(F.aggregate("events", zero, step)["out"]).alias("r")).select("doc_id", "r.*")
    return folded.join(events.select("doc_id", "seq", "op", "text"), ["doc_id", "seq"])


def apply_events(
    events: DataFrame, current: DataFrame, gated: bool = False, threshold: float = 0.3, dims: int = 256, queries: DataFrame | None = None, write=lambda df: df
) -> tuple[DataFrame, DataFrame]:
    """(changed, results) of a batch of events: the rows of CURRENT that are new or other than before, and
    (seq, doc_id, action, version, text_hash, score, reason).

    A text that is deleted and comes again is a new version. The gate leaves a document's own old text out of the comparison.
    Whether a text is accepted depends on which texts before it were: all are taken to be, and what follows from that is worked
    out again until nothing changes, which it does after as many rounds as there are texts that lean on each other. ``write`` cuts
    the lineage of a round. ``queries`` (text) are recent ones, for relevance.
    """
    rows, judged = changes(events, current), None
    if gated:
        asked = write(events.where("op != 'delete'").select("seq", "doc_id", "text", X.hashed_embedding(F.coalesce("text", F.lit("")), dims).alias("query")))
        touched = events.select("doc_id").distinct()
        active = current.where("is_active").select(F.col("doc_id").alias("other"), F.col("embedding").alias("vector"), F.lit(-1).cast("long").alias("since"))
        similarity = X.dot(F.col("query"), F.col("vector"))
        short = asked.select("seq", "doc_id", "query")
        # Documents that no event of the batch touches are there for all of its texts; the others for as long as a version lasts.
        still = active.join(touched.withColumnRenamed("doc_id", "other"), "other", "left_anti").select("vector")
        base = write(pairs_of(short.select("seq", "query"), still).groupBy("seq").agg(F.max(similarity).alias("base")))
        moving = active.join(touched.withColumnRenamed("doc_id", "other"), "other", "left_semi").unionByName(asked.select(F.col("doc_id").alias("other"), F.col("query").alias("vector"), F.col("seq").alias("since")))
        beside = write(pairs_of(short, moving).where("since < seq AND other != doc_id").select("seq", "other", "since", similarity.alias("sim")))
        relevance = None
        if queries is not None:
            recent = queries.select(X.hashed_embedding(F.col("text"), dims).alias("vector"))
            found = pairs_of(short.select("seq", "query"), recent).groupBy("seq").agg(F.greatest(F.lit(0.0), F.max(similarity)).alias("value"))
            relevance = write(found.withColumnRenamed("seq", "doc_id"))
        before = None
        while True:
            versions = rows.where("action IN ('added', 'updated', 'deleted')").select(F.col("doc_id").alias("other"), F.col("seq").alias("since"), F.col("action") != "deleted")
            versions = versions.toDF("other", "since", "there").unionByName(active.join(touched.withColumnRenamed("doc_id", "other"), "other", "left_semi").select("other", "since", F.lit(True).alias("there")))
            lasting = versions.withColumn("until", F.lead("since").over(Window.partitionBy("other").orderBy("since"))).where("there")
            near = beside.join(lasting, ["other", "since"]).where("until IS NULL OR until > seq").groupBy("seq").agg(F.max("sim").alias("moving"))
            value = F.greatest(F.lit(0.0), F.coalesce("base", F.lit(0.0)), F.coalesce("moving", F.lit(0.0)))
            similar = asked.select("seq").join(base, "seq", "left").join(near, "seq", "left").select(F.col("seq").alias("doc_id"), value.alias("value"))
            judged = write(gate(asked.select(F.col("seq").alias("doc_id"), "text"), similar, threshold, relevance).withColumnRenamed("doc_id", "seq"))
            rows = changes(events.join(judged.select("seq", "accept"), "seq", "left"), current)
            state = tuple(judged.where("accept").agg(F.count(F.lit(1)), F.sum(F.xxhash64("seq").cast("decimal(38,0)"))).first())
            if state == before:
                break
            before = state
    if judged is not None:
        rows = rows.join(judged.select("seq", "score", "reason"), "seq", "left")
    else:
        rows = rows.withColumns({"score": F.lit(None).cast("double"), "reason": F.lit(None).cast("string")})
    results = rows.select("seq", "doc_id", "action", "version", "text_hash", "score", "reason")
    last = rows.where("action IN ('added', 'updated', 'deleted')").withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("seq")))).where("r = 1")
    written = rows.where("action IN ('added', 'updated')").withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("seq")))).where("r = 1")
    fresh = written.select("doc_id", "text", "text_hash", X.hashed_embedding(F.coalesce("text", F.lit("")), dims).alias("embedding"), F.col("seq").alias("own"))
    old = current.select("doc_id", F.col("text").alias("old_text"), F.col("text_hash").alias("old_hash"), F.col("embedding").alias("old_embedding"), F.col("seq").alias("old_seq"))
    changed = last.select("doc_id", "version", (F.col("action") != "deleted").alias("is_active")).join(fresh, "doc_id", "left").join(old, "doc_id", "left")
    new = F.col("own").isNotNull()  # a document may be deleted without a new text, and then keeps its old one
    pick = lambda a, b: F.when(new, F.col(a)).otherwise(F.col(b))
    changed = changed.select(
        "doc_id", pick("text", "old_text").alias("text"), pick("text_hash", "old_hash").alias("text_hash"), pick("embedding", "old_embedding").alias("embedding"),
        "version", "is_active", pick("own", "old_seq").alias("seq"),
    )
    return changed, results


class Index:
    """The tables of an ingestion under one folder: ``base`` and ``changes`` of the current table, ``results``, ``queries`` and ``commits``.

    Another Index on the same folder goes on where the last commit left it.
    """

    def __init__(self, spark: SparkSession, path: str, gated: bool = False, threshold: float = 0.3) -> None:
        self.spark, self.path, self.gated, self.threshold = spark, path.rstrip("/"), gated, threshold
        self.base, self.batch = -1, -1
        if self._exists("commits"):
            last = spark.read.schema("base int, batch int").parquet(f"{self.path}/commits").orderBy(F.desc("batch")).first()
            if last:
                self.base, self.batch = last

    def _exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _written(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def current(self) -> DataFrame:
        """The base, with what later batches changed."""
        if self.batch < 0:
            return self.spark.createDataFrame([], CURRENT)
        base = self.spark.read.schema(CURRENT).parquet(f"{self.path}/base/{self.base}") if self.base >= 0 else self.spark.createDataFrame([], CURRENT)
        names = [f"{self.path}/changes/{k}" for k in range(self.base + 1, self.batch + 1) if self._exists(f"changes/{k}")]
        if not names:
            return base
        later = None
        for name in names:
            one = self.spark.read.schema(CURRENT).parquet(name).withColumn("from", F.lit(int(name.rsplit("/", 1)[1])))
            later = one if later is None else later.unionByName(one)
        last = later.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("from")))).where("r = 1").select(*base.columns)
        return base.join(last.select("doc_id"), "doc_id", "left_anti").select(*base.columns).unionByName(last)

    def active(self) -> DataFrame:
        return self.current().where("is_active")

    def results(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/results").where(F.col("batch") <= self.batch)

    def history(self, doc_id: str | None = None) -> DataFrame:
        """Every version that was written or deleted, in order."""
        rows = self.results().where(F.col("action").isin("added", "updated", "deleted"))
        return (rows if doc_id is None else rows.where(F.col("doc_id") == doc_id)).orderBy("doc_id", "seq")

    def stats(self) -> DataFrame:
        return self.results().groupBy("action").agg(F.count(F.lit(1)).alias("n"))

    def recent_queries(self, most: int = KEPT_QUERIES) -> DataFrame:
        """(n, text) of the last queries that were asked, the latest first."""
        if not self._exists("queries"):
            return self.spark.createDataFrame([], "n long, text string")
        return self.spark.read.schema("n long, text string").parquet(f"{self.path}/queries").orderBy(F.desc("n")).limit(most)

    def query(self, text: str, k: int = 5) -> DataFrame:
        """(id, text, version, score, rank, css): the k active documents nearest to a query, and the sufficiency of their graph.

        The query is kept for the relevance of texts to come.
        """
        from ctxloom.operators import graph as G
        from ctxloom.operators import sufficiency as S

        n = (self.recent_queries(1).agg(F.max("n")).first()[0] or 0) + 1
        asked = self.spark.createDataFrame([(n, text)], "n long, text string")
        asked.write.mode("append").parquet(f"{self.path}/queries")
        active = self.active()
        vector = asked.select(F.col("n").alias("query_id"), X.hashed_embedding(F.col("text")).alias("query"))
        hits = top_similar(vector, active.select(F.col("doc_id").alias("id"), F.col("embedding").alias("vector")), k)
        found = hits.join(active.withColumnRenamed("doc_id", "id"), "id").select("id", "text", "version", "score", "rank", "embedding")
        nodes = found.select(
            F.lit("q").alias("graph_id"), F.col("rank").alias("pos"), "id", "text", T.base_document(F.col("id")).alias("base"), T.chunk_index(F.col("id")).alias("chunk"),
            F.lit(None).cast("string").alias("section"), "embedding",
        )
        queries = vector.select(F.lit("q").alias("graph_id"), F.lit(text).alias("query"), F.col("query").alias("vector"))
        css = S.features(nodes, G.build_edges(nodes), queries).select(S.score().alias("css"))
        return found.drop("embedding").join(F.broadcast(css), F.lit(True)).orderBy("rank")  # css is one row

    def ingest(self, events: DataFrame, batch: int) -> None:
        """One batch; called by the stream, and again with the same number after a failure."""
        if batch <= self.batch:
            return
        current, number = self.current(), iter(range(1 << 30))
        scratch = lambda df: self._written(f"scratch/{batch}/{next(number)}", df)
        queries = self.recent_queries(RECENT_QUERIES)
        queries = None if queries.isEmpty() else queries
        changed, results = apply_events(events, current, self.gated, self.threshold, queries=queries, write=scratch)
        self._written(f"results/batch={batch}", results)
        self._written(f"changes/{batch}", changed)
        base, self.batch = self.base, batch
        if batch - base >= COMPACT_EVERY:
            self._written(f"base/{batch}", self.current())
            self.base = batch
        self.spark.createDataFrame([(self.base, batch)], "base int, batch int").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self._delete(f"scratch/{batch}")
        if self.base > base:  # what the new base holds is not needed any more
            self._delete(f"base/{base}")
            for k in range(base + 1, batch + 1):
                self._delete(f"changes/{k}")

    def _delete(self, name: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def load(self, documents: DataFrame) -> None:
        """A batch of documents (doc_id, text) without the gate."""
        gated, self.gated = self.gated, False
        self.ingest(documents.select(F.lit(0).cast("long").alias("seq"), F.lit("create").alias("op"), "doc_id", "text"), self.batch + 1)
        self.gated = gated

    def start(self, events: DataFrame, checkpoint: str, once: bool = False):
        """Begin a streaming query over a stream of EVENT rows."""
        writer = events.writeStream.foreachBatch(self.ingest).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: counts and sums by event-time window and type, for streams and tables alike."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Extension: sessions of each user, closed by a gap."""
    source = events.withWatermark("ts", gap) if events.isStreaming else events
    return source.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
