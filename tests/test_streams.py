"""Keyed ingestion: the fold of one document, order and lateness, restarts, and a table to go on from."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ctxloom.streaming import ingest as I
from ctxloom.streaming import keyed as K

T0 = dt.datetime(2024, 1, 1)


def _event(seq, op, doc, text=None, minute=None, accept=None):
    return (seq, op, doc, text, T0 + dt.timedelta(minutes=seq if minute is None else minute), accept)


def _feed(spark, folder, name, events):
    spark.createDataFrame(events, K.EVENT).coalesce(1).write.parquet(f"{folder}/in/{name}")


def _run(spark, folder, delay="10 minutes", begin=None):
    source = spark.readStream.schema(K.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    K.start(source, f"{folder}/out", f"{folder}/cp", delay, begin=begin).awaitTermination()


def _results(spark, folder):
    return sorted((r.seq, r.doc_id, r.action, r.version) for r in spark.read.schema(K.RESULT).parquet(f"{folder}/out").collect())


def test_fold_of_a_document():
    row, out = (0, None, False, None, None), []
    for e in [(1, "delete", None, 0, None), (2, "create", "a", 0, None), (3, "update", "a", 0, None), (4, "update", "b", 0, False), (5, "update", "b", 0, True), (6, "delete", None, 0, None), (7, "delete", None, 0, None), (8, "create", "b", 0, None), (9, "update", None, 0, None)]:
        row, action = K.folded(row, e)
        out.append((action, row[0]))
    assert out == [("missing", 0), ("added", 1), ("unchanged", 1), ("rejected", 1), ("updated", 2), ("deleted", 2), ("missing", 2), ("updated", 3), ("updated", 4)]


def test_order_restart_and_late_rows(spark, tmp_path):
    """Slices out of order within the delay, a query that ends half-way, and rows behind the watermark: as the batch fold of what was in time."""
    r, folder = random.Random(8), str(tmp_path)
    events = [_event(k, r.choice(["create", "update", "update", "delete"]), f"d{r.randrange(6)}", f"text {r.randrange(4)}") for k in range(1, 121)]
    late = [e for e in events if e[0] in (5, 9)]
    rest = [e for e in events if e not in late]
    r.shuffle(block := rest[:60])
    slices = [sorted(rest[60 * k // 3 : 60 * (k + 1) // 3], key=lambda e: r.random()) for k in range(3)] + [rest[60:80], [*rest[80:100], *late], rest[100:]]
    swapped = slices[0][:4]  # some events of the first slice come with the second
    slices[0], slices[1] = slices[0][4:], slices[1] + swapped
    for k in range(3):
        _feed(spark, folder, k, slices[k])
    _run(spark, folder, "25 minutes")
    assert 0 < len(_results(spark, folder)) < 60
    for k in range(3, 6):
        _feed(spark, folder, k, slices[k])
    _feed(spark, folder, 6, [_event(-1, K.TICK, "", minute=10_000)])
    _run(spark, folder, "25 minutes")
    batch = I.changes(spark.createDataFrame([e[:4] for e in rest], "seq long, op string, doc_id string, text string"), spark.createDataFrame([], I.CURRENT))
    assert _results(spark, folder) == sorted((x.seq, x.doc_id, x.action, x.version) for x in batch.collect())
    state = {x.doc_id: x for x in K.current(spark, f"{folder}/cp").collect()}
    history = sorted((x.doc_id, x.seq, x.action, x.version) for x in K.versions(spark, f"{folder}/cp").collect())
    assert history == sorted((d, s, a, v) for s, d, a, v in _results(spark, folder) if a in ("added", "updated", "deleted"))
    for d, x in state.items():
        mine = [h for h in history if h[0] == d]
        assert x.version == mine[-1][3] and x.active == (mine[-1][2] != "deleted")


def test_goes_on_from_a_table(spark, tmp_path):
    folder = str(tmp_path)
    begin = spark.createDataFrame([("a", 3, K.fingerprint("old"), True, "old", 0), ("b", 1, K.fingerprint("gone"), False, "gone", 0)], f"doc_id string, {K.ROW}")
    _feed(spark, folder, 0, [_event(1, "update", "a", "old"), _event(2, "update", "a", "new"), _event(3, "delete", "b"), _event(4, "create", "b", "gone", accept=False), _event(5, "create", "c", None), _event(6, "create", "b", "gone")])
    _feed(spark, folder, 1, [_event(-1, K.TICK, "", minute=10_000)])
    _run(spark, folder, begin=begin)
    assert _results(spark, folder) == [(1, "a", "unchanged", 3), (2, "a", "updated", 4), (3, "b", "missing", 1), (4, "b", "rejected", 1), (5, "c", "added", 1), (6, "b", "updated", 2)]


def test_only_what_the_watermark_has_not_passed_waits(spark, tmp_path):
    folder = str(tmp_path)
    _feed(spark, folder, 0, [_event(k, "update", "a", f"t{k}") for k in range(1, 9)] + [_event(50, "update", "b", "x")])
    _feed(spark, folder, 1, [_event(-1, K.TICK, "", minute=20)])
    _run(spark, folder)
    left = spark.read.format("statestore").option("path", f"{folder}/cp").option("stateVarName", "waiting").load()
    assert [r[0] for r in left.select("list_element.seq").collect()] == [50]  # which the watermark has not passed


@pytest.mark.parametrize("name", ["stream_results"])
def test_late_slices_are_really_dropped(spark, name):
    from ctxloom.plans import streams
    from tests.conftest import SF

    events, _ = streams.slices(spark, SF)
    by = {r.arrives: r.n for r in events.groupBy("arrives").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(by) == {0, 1, 2, 3, 4} and by[4] >= 5 and by[3] >= 5


def test_documents_are_folded_without_data_frames(spark):
    """A document's few events come as rows: a data frame for each document of each batch costs more than its events. A row is read only for events to apply."""
    from types import SimpleNamespace as N

    log, calls = K.DocumentLog(), []
    log.handle = N(registerTimer=calls.append)
    log.waiting = N(appendList=calls.append, get=lambda: iter([(3, "update", "x", 90, None)]))
    log.row = N(get=lambda: pytest.fail("no event is ready"), exists=lambda: pytest.fail("no event is ready"))
    rows = [{"seq": 3, "op": "update", "text": "x", "at": 90, "accept": None}, {"seq": -1, "op": K.TICK, "text": None, "at": 95, "accept": None}]
    assert list(log.handleInputRows(("a",), iter(rows), None)) == []
    assert calls == [[(3, "update", "x", 90, None)], 90]
    assert list(log.handleExpiredTimer(("a",), N(getCurrentWatermarkInMs=lambda: 50), None)) == [] and calls[-1] == 90
