"""Keyed, stateful ingestion: create, update and delete events of documents, folded one document at a time in the order of their sequence.

The state of a document is its row, its versions, and the events that still wait. An event is applied when the watermark has passed
its time: by then all that may come before it is there, so results do not depend on how the stream was cut into batches, or on
order within the allowed delay. What comes later than that is dropped by the watermark. State lives in Spark's store, with a
checkpoint, and both it and the results go on after a restart; a document's state grows with its versions, never with the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "seq long, op string, doc_id string, text string, ts timestamp, accept boolean"
RESULT = "doc_id string, seq long, action string, version int, text_hash string, text string"
ROW = "version int, text_hash string, active boolean, text string, seq long"
VERSION = "seq long, action string, version int, text_hash string"
_WAITING = "seq long, op string, text string, at long, accept boolean"
#: An event of this op says that the stream has come to its time, and nothing else.
TICK = "tick"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fingerprint(text: str | None) -> str:
    """As the column function of that name: 16 hex digits of SHA-256."""
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()[:16]


def folded(row: tuple, event: tuple) -> tuple[tuple, str]:
    """(row, action) of a document's row (version, text_hash, active, text, seq) after an event (seq, op, text, at, accept)."""
    version, known, active, text, since = row
    seq, op, new, _, accept = event
    if op == "delete":
        return ((version, known, False, text, since), "deleted") if active else (row, "missing")
    mark = fingerprint(new)
    if active and mark == known:
        return row, "unchanged"
    if accept is False:
        return row, "rejected"
    return (version + 1, mark, True, new, seq), "updated" if version else "added"


class DocumentLog(StatefulProcessor):
    """What the events of each document do, in their order. Nothing is held outside the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", ROW)
        self.versions = handle.getListState("versions", VERSION)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: Any) -> None:
        """A document of a table that the stream goes on from."""
        r = initialState
        self.row.update((int(r["version"]), r["text_hash"], bool(r["active"]), r["text"], int(r["seq"])))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        came = [(r["seq"], r["op"], r["text"], r["at"], r["accept"]) for r in rows if r["op"] != TICK]
        if came:
            self.waiting.appendList(came)
            self.handle.registerTimer(min(e[3] for e in came))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """Events whose time the watermark has passed are applied; for the rest the next time is set."""
        now = timerValues.getCurrentWatermarkInMs()
        events = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: e[0])
        ready, later = [e for e in events if e[3] <= now], [e for e in events if e[3] > now]
        row = tuple(self.row.get() or (0, None, False, None, None)) if ready else (0, None, False, None, None)
        out = []
        for e in ready:
            row, action = folded(row, e)
            mark = fingerprint(e[2])
            out.append((key[0], e[0], action, row[0] or None, mark, e[2] if action in ("added", "updated") else None))
        if ready:
            written = [(s, a, v, m if a != "deleted" else row[1]) for _, s, a, v, m, _ in out if a in ("added", "updated", "deleted")]
            if row[0]:
                self.row.update(row)
            if written:
                self.versions.appendList(written)
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if later:
            self.handle.registerTimer(min(e[3] for e in later))
        return (Row(doc_id=d, seq=s, action=a, version=v, text_hash=m, text=t) for d, s, a, v, m, t in out)

    def close(self) -> None:
        pass


def document_log(events: DataFrame, delay: str = "1 hour", start: DataFrame | None = None) -> DataFrame:
    """RESULT rows of a stream of EVENT rows: what each event does (added, updated, unchanged, rejected, deleted, missing), and the version then.

    ``delay`` is how much later than the latest event an event may come. ``start`` (doc_id and ROW) is a table to go on from.
    """
    use_store(events.sparkSession)
    timed = events.withWatermark("ts", delay).withColumn("at", F.unix_millis("ts")).groupBy("doc_id")
    initial = None if start is None else start.groupBy("doc_id")
    return timed.transformWithState(statefulProcessor=DocumentLog(), outputStructType=RESULT, outputMode="Append", timeMode="EventTime", initialState=initial)


def use_store(spark: SparkSession) -> None:
    """State with several variables needs the RocksDB store."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != _PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def start(events: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", once: bool = True, begin: DataFrame | None = None):
    """A streaming query from ``events`` into a Parquet table of results, each written exactly once."""
    writer = document_log(events, delay, begin).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The table as the state has it: doc_id and ROW of every document that was ever written."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "row").load()
    return state.select("key.doc_id", "value.*")


def versions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Every version that was written or deleted, as the state has it: doc_id and VERSION."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "versions").load()
    return state.selectExpr("key.doc_id AS doc_id", "list_element.*") if "list_element" in state.columns else state.selectExpr("key.doc_id AS doc_id", "inline(list_value)")
