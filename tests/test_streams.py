"""Streams of files: statuses after quiet, windows with late events, a snapshot between two batches, indexing that breaks off."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException

from folium.operators.index import TermIndex
from folium.operators.retrieval import fit_tfidf
from folium.streaming import status, updates

SCHEMA = "key long, task string, status string, ts timestamp, id long"
T0 = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def drop_file(spark, folder, name, rows, schema=SCHEMA):
    """One more file in the folder, named so that files come in their order."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def landed(spark, tmp_path, batches):
    import shutil
    import time

    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        drop_file(spark, tmp_path, f"b{i}", rows)
        part = next((tmp_path / f"b{i}").glob("part-*.parquet"))
        shutil.copyfile(part, folder / f"{i:03}.parquet")
        time.sleep(0.05)
    return str(folder)


def test_status_after_quiet(spark, tmp_path):
    folder = landed(spark, tmp_path, [
        [(1, "parse", "running", at(0), 1), (1, "parse", "ready", at(0.3), 2), (2, "parse", "ready", at(0.2), 3), (None, "parse", "ready", at(0), 4), (3, None, "ready", at(0), 5)],
        [(9, "x", "ready", at(20), 6)],  # time goes on: 1 and 2 are quiet
        [(1, "parse", "running", at(15), 1), (1, "parse", "error", at(21), 8), (1, "chunk", "completed", at(21.2), 9), (1, "chunk", "completed", at(21.2), 9)],  # late or repeated ones change nothing
        [(9, "x", "ready", at(60), 10)],
        [(9, "x", "ready", at(90), 11)],
    ])
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = status.run_to_table(updates.quiet_status(events, wait=0.5, late="5 seconds"), "quiet_status_test", str(tmp_path / "cp"), mode="append")
    got = sorted((r["key"], r["last"].astimezone(timezone.utc) if r["last"].tzinfo else r["last"], r["available"], r["completed"], r["percent"], r["failed"]) for r in out.collect() if r["key"] != 9)
    assert [g[0] for g in got] == [1, 1, 2]
    assert [g[2:] for g in got] == [(["viewer"], 1, 20, []), (["search"], 1, 20, ["parse"]), (["viewer"], 1, 20, [])]


def test_windows_with_late_events(spark, tmp_path):
    folder = landed(spark, tmp_path, [
        [(1, "parse", "ready", at(0), 1), (1, "chunk", "ready", at(30), 2)],
        [(1, "parse", "ready", at(50), 3), (2, "parse", "ready", at(130), 4)],
        [(2, "parse", "ready", at(10), 5)],  # late, but within what is waited for
        [(2, "parse", "ready", at(4000), 6)],
        [(3, "chunk", "ready", at(4010), 9)],  # Spark drops late rows by the watermark of the batch before
        [(2, "parse", "ready", at(20), 7), (2, "parse", "ready", at(8000), 8)],  # too late
    ])
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = status.run_to_table(status.windowed_counts(events, "ts", "1 minute", "task", "10 minutes"), "windows_test", str(tmp_path / "cp"), mode="append")
    first = {(r["task"], r["start"].timestamp() - T0.timestamp()): r["n"] for r in out.collect()}
    assert first == {("parse", 0.0): 3, ("chunk", 0.0): 1, ("parse", 120.0): 1, ("parse", 3960.0): 1, ("chunk", 3960.0): 1}


def test_snapshot_then_updates(spark, tmp_path):
    rows = [(1, "parse", "running", at(0), 1), (1, "parse", "ready", at(1), 2), (2, "parse", "queued", at(0), 3)]
    folder = landed(spark, tmp_path, [rows[:2], rows[2:]])
    sub = updates.subscribe(spark, folder, SCHEMA)
    late = [(1, "parse", "older", at(-5), 0), (2, "parse", "ready", at(9), 4)]  # comes after the snapshot, though it is older
    drop_file(spark, tmp_path, "more", late)
    next((tmp_path / "more").glob("part-*.parquet")).rename(tmp_path / "in" / "900.parquet")
    assert {(r["key"], r["status"]) for r in sub.snapshot(["key", "task"]).collect()} == {(1, "ready"), (2, "queued")}
    got = status.run_to_table(sub.updates(), "updates_test", str(tmp_path / "cp"), mode="append")
    assert sorted(r["id"] for r in got.collect()) == [0, 4]
    everything = sub.snapshot(["key", "task"]).select("key", "status").collect() + got.select("key", "status").collect()
    assert len(everything) == 4
    nothing = updates.subscribe(spark, str(tmp_path / "none"), SCHEMA)
    assert nothing.snapshot(["key", "task"]).count() == 0


def test_indexing_goes_on_after_a_failure(spark, tmp_path):
    docs = [(i, f"text number {i} about thing{i % 3} and more") for i in range(12)]
    folder = tmp_path / "chunks"
    for i in range(4):
        spark.createDataFrame(docs[3 * i : 3 * i + 3], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(folder))
    read = lambda: spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    index, done = TermIndex(spark, str(tmp_path / "index")), []

    def broken(segment, n):
        done.append(segment)
        if len(done) == 2:
            raise RuntimeError("lost between two batches")

    with pytest.raises(StreamingQueryException):
        updates.index_stream(read(), index, str(tmp_path / "cp"), "job", broken).awaitTermination()
    assert len(index.segments()) == 2
    updates.index_stream(read(), index, str(tmp_path / "cp"), "job").awaitTermination()
    assert index.segments() == [f"job-{i}" for i in range(4)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = {(r["doc_id"], r["term"], round(r["w"], 9)) for r in fit_tfidf(table)[1].collect()}
    assert {(r["doc_id"], r["term"], round(r["w"], 9)) for r in index.postings().collect()} == want


def test_each_batch_is_sent(spark, tmp_path):
    folder, sent = landed(spark, tmp_path, [[(1, "parse", "ready", at(0), 1)]]), []
    events = spark.readStream.schema(SCHEMA).parquet(folder)
    q = status.each_batch(events, lambda batch, number: sent.append((number, batch.count())), str(tmp_path / "cp"), 0.1)
    q.processAllAvailable()
    q.stop()
    assert sent == [(0, 1)]
