"""Task status as a stream: the latest event per task, folded to a document's status.

The fold is recomputed from the latest event of each key, so late or repeated events cannot corrupt it. The watermark
bounds the state: a key without events for that long is dropped from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.plans.registry import query
from folium.session import table

FEATURES = {"parse": "viewer", "chunk": "search", "embed": "chat", "reference": "references", "summary": "summary"}


def read_events(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """Events of files as they arrive, a few files at a time; event time is a timestamp with zone."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def latest_per_key(events: DataFrame, keys: list[str], at: str, value: str, tie: str) -> DataFrame:
    """The value of the latest event of each key, for a stream or a table."""
    return events.groupBy(*keys).agg(F.max(F.struct(at, tie, value)).alias("m")).select(*keys, F.col(f"m.{value}").alias(value), F.col(f"m.{at}").alias(at))


def windowed_counts(events: DataFrame, at: str, width: str, by: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n")).select("window.start", by, "n")


def status_of(flags: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Available features, completed tasks and percent of a row of task flags."""
    done = F.array_compact(F.array(*[F.when(f, F.lit(name)) for name, f in flags.items()]))
    return done, F.size(done), F.floor(F.size(done) * 100 / len(flags)).cast("int")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs what has arrived to a memory table; for tests and snapshots."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def each_batch(stream: DataFrame, sink, checkpoint: str, seconds: float = 0.5):
    """Sends every micro-batch to the sink, at most every `seconds`: the debounce."""
    return stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()


query("r06_latest_state", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")(
    lambda spark, sf_dir: latest_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "value", "event_id").select("user_id", "event_type", "value")
)
query("r11_event_filter", "SELECT event_id FROM events WHERE contains(props, '7')")(lambda spark, sf_dir: table(spark, sf_dir, "events").where(F.col("props").contains("7")).select("event_id"))
query("r01_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")(
    lambda spark, sf_dir: table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"))
)


@query("a17_status_fold", """WITH t AS (SELECT user_id, bool_or(event_type = 'click') AS a, bool_or(event_type = 'view') AS b, bool_or(event_type = 'purchase') AS c, bool_or(value > 90) AS d, bool_or(value < 1) AS e FROM events GROUP BY user_id)
SELECT user_id, (a::INT + b::INT + c::INT + d::INT + e::INT)::BIGINT AS completed, floor((a::INT + b::INT + c::INT + d::INT + e::INT) * 100 / 5)::INT AS percent FROM t""")
def a17(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = e.groupBy("user_id").agg(*[F.bool_or(c).alias(n) for n, c in (("a", F.col("event_type") == "click"), ("b", F.col("event_type") == "view"), ("c", F.col("event_type") == "purchase"), ("d", F.col("value") > 90), ("e", F.col("value") < 1))])
    _, completed, percent = status_of({n: F.col(n) for n in "abcde"})
    return t.select("user_id", completed.cast("long").alias("completed"), percent.alias("percent"))
