"""Status updates as streams: one status after a document falls quiet, a snapshot with the updates after it, resumed indexing.

* `quiet_status` keeps, for each document, the latest event of each task, and sends its status once no event came for `wait`
  seconds of event time. What is kept is a maximum by time and number, so late and repeated events cannot corrupt it.
* `subscribe` gives the present status with the files it was read from, and a stream of the events in all other files, so
  that an event is in one of the two and never in both.
* `index_stream` adds micro-batches to a term index as segments named by their number. A batch that runs again after a failure finds
  its segment there or writes it anew, so each text is indexed once.

Cases: events without key, task or time are left out; events later than the watermark are dropped by Spark, which counts them;
a status of no known task has no features; an empty stream sends nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import timezone

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folium.operators.index import TermIndex
from folium.streaming.status import FEATURES, latest_per_key

#: What events have: the document, the task, its status, the time, and a number that tells events of equal time apart.
EVENT = ["key", "task", "status", "ts", "id"]
STATUS = "key long, available array<string>, completed int, percent int, failed array<string>, last timestamp"


def newest(latest: dict[str, list]) -> int:
    return max((ms for ms, _, _ in latest.values()), default=0)


def status_row(key: int, latest: dict[str, list], features: dict[str, str]) -> tuple:
    """The status of a document by the latest event of each task, [ms, number, status]."""
    ready = {t for t, (_, _, s) in latest.items() if s in ("ready", "completed")}
    failed = sorted(t for t, (_, _, s) in latest.items() if s in ("error", "failed"))
    done = [t for t in features if t in ready]
    return key, [features[t] for t in done], len(done), 100 * len(done) // max(1, len(features)), failed, pd.Timestamp(newest(latest), unit="ms", tz=timezone.utc)


def quiet_status(events: DataFrame, wait: float = 0.5, late: str = "10 seconds", forget: float = 3600.0, features: dict[str, str] = FEATURES) -> DataFrame:
    """A status (STATUS) for each time a document of a stream of events (EVENT) has had no event for `wait` seconds.

    A document without events for `forget` seconds is dropped from the state; what comes then begins anew.
    """

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest, sent = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, True)
        out = []
        if state.hasTimedOut:
            if sent:
                state.remove()
                return
            out, sent = [status_row(key[0], latest, features)], True
        elif not sent and state.getCurrentWatermarkMs() >= newest(latest) + 1000 * wait:  # it was quiet before these came
            out = [status_row(key[0], latest, features)]
        for batch in rows if not state.hasTimedOut else ():
            for task, status, ts, number in zip(batch["task"], batch["status"], batch["ts"], batch["id"], strict=True):
                event = [int(pd.Timestamp(ts).value // 1_000_000), int(number), status]
                if task not in latest or event[:2] > latest[task][:2]:
                    latest[task], sent = event, False
        state.update((json.dumps(latest), sent))
        due = newest(latest) + int(1000 * (forget if sent else wait))
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "available", "completed", "percent", "failed", "last"])

    given = events.select(*EVENT).where("key is not null and task is not null and ts is not null").withWatermark("ts", late)
    return given.groupBy("key").applyInPandasWithState(update, STATUS, "latest string, sent boolean", "append", GroupStateTimeout.EventTimeTimeout)


class Subscription:
    """The present status, the files it stands for, and what comes after them."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path, self.schema = spark, path, schema
        try:
            files = spark.read.schema(schema).parquet(path).inputFiles()  # Spark's own listing
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            files = []
        self.files = files
        self.read = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)

    def snapshot(self, keys: list[str], at: str = "ts", value: str = "status", tie: str = "id") -> DataFrame:
        """The latest value of each key among the events that were there."""
        return latest_per_key(self.read, keys, at, value, tie)

    def updates(self, max_files: int = 1000) -> DataFrame:
        """A stream of the events in files that the snapshot has not read."""
        seen = self.spark.createDataFrame([(f,) for f in self.files], "file string").select(F.regexp_replace("file", "^file:/+", "/").alias("__file"))
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", max_files).parquet(self.path)
        return stream.withColumn("__file", F.regexp_replace("_metadata.file_path", "^file:/+", "/")).join(F.broadcast(seen), "__file", "left_anti").drop("__file")


def subscribe(spark: SparkSession, path: str, schema: T.StructType | str) -> Subscription:
    return Subscription(spark, path, schema)


def index_stream(
    chunks: DataFrame, index: TermIndex, checkpoint: str, job: str, after: Callable[[str, int], None] | None = None
) -> StreamingQuery:
    """Runs what has arrived of a stream of chunks into an index. Started again with the same checkpoint, it goes on where it stopped.

    `after` is called with each new segment and its number of chunks, for marking documents as ready.
    """

    def add(batch: DataFrame, number: int) -> None:
        segment = f"{job}-{number}"
        rows = batch.select(index.key, index.text).persist()  # read for terms and for keys
        try:
            if index.append(rows, segment) and after:
                after(segment, rows.count())
        finally:
            rows.unpersist()

    return chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
