"""Streams equal their batch jobs when the input arrives as several files (one per micro-batch)."""

import os
import tempfile

from pyspark.sql import functions as F

from tagloom.operators import state as S
from tagloom.sources import fixtures as X
from tagloom.sources.tables import table
from tagloom.streaming.incremental import latest_settings, stream_incremental_scores, stream_latest_settings, streamed_scores

from conftest import SF_SMALL


def _split_events(spark, n_files=4):
    """The events table cut into files by event_id range (arrival order = event order)."""
    d = tempfile.mkdtemp(prefix="tagloom-stream-")
    ev = table(spark, SF_SMALL, "events")
    lo, hi = ev.agg(F.min("event_id"), F.max("event_id")).first()
    step = (hi - lo) // n_files + 1
    for i in range(n_files):
        part = ev.where((F.col("event_id") >= lo + i * step) & (F.col("event_id") < lo + (i + 1) * step))
        part.coalesce(1).write.parquet(os.path.join(d, f"part{i}"))
        src = [f for f in os.listdir(os.path.join(d, f"part{i}")) if f.endswith(".parquet")][0]
        os.replace(os.path.join(d, f"part{i}", src), os.path.join(d, f"events-{i}.parquet"))
    return d


def test_stream_cache_equals_batch(spark):
    d = _split_events(spark)
    path = stream_incremental_scores(spark, d, max_files_per_trigger=1)
    got = {(r.hash, r.repo_name): (r.data, r.n_bytes) for r in streamed_scores(spark, path).collect()}
    want = {(r.hash, r.repo_name): (r.data, r.n_bytes) for r in S.insert_cache(X.cache_log(spark, SF_SMALL)).collect()}
    assert got == want


def test_stream_settings_equals_batch(spark):
    d = _split_events(spark)
    path = stream_latest_settings(spark, d)
    got = {(r.dataset, r.key): r.value for r in latest_settings(spark, path).collect()}
    want = {(r.dataset, r.key): r.value for r in S.upsert_settings(X.settings_log(spark, SF_SMALL)).collect()}
    assert got == want


def test_late_files_with_other_data(spark):
    """A key that arrives again later, with other data, keeps what it got first; a run over new files alone reads the
    touched buckets; the latest settings follow the sequence number, not the arrival."""
    d = tempfile.mkdtemp(prefix="tagloom-late-")
    ev = table(spark, SF_SMALL, "events").where("event_id < 40")
    rows = [r.asDict() for r in ev.collect()]

    def put(name, part):
        spark.createDataFrame(part, ev.schema).coalesce(1).write.parquet(os.path.join(d, name))
        src = [f for f in os.listdir(os.path.join(d, name)) if f.endswith(".parquet")][0]
        os.replace(os.path.join(d, name, src), os.path.join(d, f"events-{name}.parquet"))
    put("a", rows[20:])
    w = tempfile.mkdtemp(prefix="tagloom-late-out-")
    out = os.path.join(w, "table")
    stream_incremental_scores(spark, d, out)
    first = {(r.hash, r.repo_name): r.data for r in streamed_scores(spark, out).collect()}
    again = [{**r, "event_id": r["event_id"] + 1000} for r in rows[20:]]      # the same keys, later writes
    put("b", again + rows[:20])
    settings = stream_latest_settings(spark, d, os.path.join(w, "settings"))
    got = {(r.dataset, r.key): r.value for r in latest_settings(spark, settings).collect()}
    want = {}
    for r in sorted(again + rows, key=lambda r: r["event_id"]):
        want[(f"ds{r['user_id'] % 7}", r["event_type"])] = r["value"]
    assert {k: float(v) for k, v in got.items()} == want
    stream_incremental_scores(spark, d, out)       # goes on from its checkpoint: only the new file is read
    now = {(r.hash, r.repo_name): r.data for r in streamed_scores(spark, out).collect()}
    assert all(now[k] == v for k, v in first.items()) and len(now) >= len(first)
    assert len(now) == spark.read.parquet(out).count()


def _put(spark, d, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(d, name))
    src = [f for f in os.listdir(os.path.join(d, name)) if f.endswith(".parquet")][0]
    os.replace(os.path.join(d, name, src), os.path.join(d, f"events-{name}.parquet"))


def _batch_result(spark, rows, schema):
    from tagloom.streaming.incremental import _cache_rows
    log = _cache_rows(spark.createDataFrame(rows, schema))
    return {(r.hash, r.repo_name): (r.data, r.n_bytes) for r in S.insert_cache(log).collect()}


def test_late_and_repeated_files_equal_the_batch(spark):
    """Later files repeat keys, with later and with earlier writes; the result is the batch's over all of them, and repeats are
    not written again."""
    d, w = tempfile.mkdtemp(prefix="tagloom-late-"), tempfile.mkdtemp(prefix="tagloom-late-out-")
    ev = table(spark, SF_SMALL, "events").where("event_id < 60")
    rows = [r.asDict() for r in ev.collect()]
    later = [{**r, "event_id": r["event_id"] + 1000} for r in rows]
    earlier = [{**r, "event_id": r["event_id"] - 1000} for r in rows[::2]]
    out = os.path.join(w, "table")
    seen = []
    for name, part in (("a", rows), ("b", later), ("c", earlier), ("d", rows)):
        _put(spark, d, name, part, ev.schema)
        seen += part
        stream_incremental_scores(spark, d, out)
        got = {(r.hash, r.repo_name): (r.data, r.n_bytes) for r in streamed_scores(spark, out).collect()}
        assert got == _batch_result(spark, seen, ev.schema)
    written = {r.version: r["count"] for r in spark.read.parquet(out).groupBy("version").count().collect()}
    keys = len(got)
    assert written[0] == keys and sum(written.values()) == keys + len({k for k in _batch_result(spark, earlier, ev.schema)})


def test_a_batch_reads_no_earlier_version(spark):
    """Earlier versions may be gone: the next batch doesn't look at them."""
    import shutil
    d, w = tempfile.mkdtemp(prefix="tagloom-late-"), tempfile.mkdtemp(prefix="tagloom-late-out-")
    ev = table(spark, SF_SMALL, "events").where("event_id < 30")
    rows = [r.asDict() for r in ev.collect()]
    out = os.path.join(w, "table")
    _put(spark, d, "a", rows[:15], ev.schema)
    stream_incremental_scores(spark, d, out)
    shutil.move(os.path.join(out, "version=0"), os.path.join(w, "elsewhere"))
    _put(spark, d, "b", rows, ev.schema)
    stream_incremental_scores(spark, d, out)
    left = {(r.hash, r.repo_name) for r in streamed_scores(spark, out).collect()}
    assert left == set(_batch_result(spark, rows, ev.schema)) - set(_batch_result(spark, rows[:15], ev.schema))
