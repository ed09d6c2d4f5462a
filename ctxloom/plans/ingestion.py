"""Queries of ingestion: ``events`` as a log of documents, and a small log of tickets behind the gate.

A user is a document and an event's type its text; every seventh event is a deletion.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxloom.plans.registry import query, read, values
from ctxloom.streaming import ingest as I

_LOG = (
    "log AS (SELECT event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'delete' ELSE 'update' END AS op, CAST(user_id AS VARCHAR) AS doc_id, event_type AS text FROM events), "
    "p AS (SELECT *, lag(op) OVER w AS before_op, lag(text) OVER w AS before_text, count(*) FILTER (WHERE op <> 'delete') OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM log WINDOW w AS (PARTITION BY doc_id ORDER BY seq)), "
    "a AS (SELECT *, CASE WHEN op = 'delete' THEN CASE WHEN before_op = 'update' THEN 'deleted' ELSE 'missing' END WHEN before_op = 'update' AND before_text = text THEN 'unchanged' WHEN earlier = 0 THEN 'added' ELSE 'updated' END AS action FROM p), "
    "r AS (SELECT seq, doc_id, text, action, nullif(CAST(count(*) FILTER (WHERE action IN ('added', 'updated')) OVER (PARTITION BY doc_id ORDER BY seq) AS INT), 0) AS version FROM a)"
)


def log(spark, d):
    e = read(spark, d, "events")
    op = F.when(F.col("event_id") % 7 == 0, "delete").otherwise("update")
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("doc_id"), F.col("event_type").alias("text"))


@query(f"WITH {_LOG} SELECT seq, doc_id, action, coalesce(version, 0) AS version FROM r")
def event_results(spark, d):
    """What each event does, with the version that its document then has."""
    return I.changes(log(spark, d), spark.createDataFrame([], I.CURRENT)).select("seq", "doc_id", "action", F.coalesce("version", F.lit(0)).alias("version"))


@query(f"WITH {_LOG} SELECT doc_id, version, action, seq, substring(sha256(text), 1, 16) AS text_hash FROM r WHERE action IN ('added', 'updated', 'deleted')")
def event_history(spark, d):
    rows = I.changes(log(spark, d), spark.createDataFrame([], I.CURRENT)).where("action IN ('added', 'updated', 'deleted')")
    return rows.select("doc_id", "version", "action", "seq", "text_hash")


@query(
    f"WITH {_LOG}, w AS (SELECT doc_id, arg_max(text, seq) AS text, max(seq) AS seq, max(version) AS version FROM r WHERE action IN ('added', 'updated') GROUP BY doc_id), "
    "l AS (SELECT doc_id, arg_max(action, seq) AS last FROM r WHERE action IN ('added', 'updated', 'deleted') GROUP BY doc_id) SELECT doc_id, text, version, last <> 'deleted' AS is_active, seq FROM w JOIN l USING (doc_id)"
)
def event_current(spark, d):
    """The table after the log, taken in two batches: the second goes on where the first ended."""
    events = log(spark, d)
    first = I.apply_events(events.where("seq % 1000 < 500 AND seq < 500"), spark.createDataFrame([], I.CURRENT))[0]
    changed = I.apply_events(events.where("NOT (seq % 1000 < 500 AND seq < 500)"), first)[0]
    kept = first.join(changed.select("doc_id"), "doc_id", "left_anti")
    return kept.select(*changed.columns).unionByName(changed).select("doc_id", "text", "version", "is_active", "seq")


@query(f"WITH {_LOG} SELECT action, count(*) AS n, count(DISTINCT doc_id) AS documents FROM r GROUP BY action")
def event_counts(spark, d):
    rows = I.changes(log(spark, d), spark.createDataFrame([], I.CURRENT))
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


_LATE = "Invoice 4471 for $1,250.00 is 30 days late, and the account will be closed after 45 days unless payment arrives by 03/01/2024."
_TICKETS = [
    (1, "create", "t1", "Customer reports 3 failed logins on 01/02/2024 after the new release went out to 250 users; refund of $40.00 promised within 5 days.", "added", 1),
    (2, "create", "t2", "Thanks!", "rejected", None),
    (3, "create", "t3", _LATE, "added", 1),
    (4, "create", "t4", _LATE, "rejected", None),
    (5, "update", "t1", "The login fault of 01/02/2024 was traced to one server of 12; the fix went live within 3 hours and 250 users were told.", "updated", 2),
    (6, "update", "t1", "The login fault of 01/02/2024 was traced to one server of 12; the fix went live within 3 hours and 250 users were told.", "unchanged", 2),
    (7, "delete", "t3", None, "deleted", 1),
    (8, "create", "t5", _LATE, "added", 1),
    (9, "delete", "t9", None, "missing", None),
    (10, "create", "t3", _LATE, "rejected", 1),
]
_WANTED = values("t", ("seq", "doc_id", "action", "version"), [(s, i, a, v) for s, _, i, _, a, v in _TICKETS])


@query(f"WITH {_WANTED.sql} SELECT seq, doc_id, action, CAST(coalesce(version, 0) AS INT) AS version FROM t")
def ticket_log(spark, d):
    """A log of tickets in one batch, behind the gate: a copy of a text is rejected, until the first one is deleted."""
    events = spark.createDataFrame([(s, op, i, t) for s, op, i, t, _, _ in _TICKETS], I.EVENT)
    return I.apply_events(events, spark.createDataFrame([], I.CURRENT), gated=True)[1].select("seq", "doc_id", "action", F.coalesce("version", F.lit(0)).alias("version"))
