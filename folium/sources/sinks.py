"""File sinks: chunks as JSON, tables as CSV, extraction reports with a summary of each document, and a retrieval log.

All write folders of part files, one per task; a rerun replaces what it wrote before, only the log is appended to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str, by: str | None = None) -> None:
    """Chunks as JSON lines, in a folder for each value of `by` where it is given."""
    (chunks.write.partitionBy(by) if by else chunks.write).mode("overwrite").option("ignoreNullFields", False).json(path)


def write_table(rows: DataFrame, path: str) -> None:
    """A table as CSV with its header; quotes inside fields are doubled."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def extraction_reports(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, summary, citations) from (key, type, text, confidence): the total, mean, counts above 0.7 and below 0.5, and by type, of each document."""
    c = F.col("confidence")
    by_type = found.groupBy(key, "type").agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    totals = found.groupBy(key).agg(
        F.count("*").alias("total"), F.round(F.avg(c), 6).alias("average"), F.count_if(c > 0.7).alias("high"), F.count_if(c < 0.5).alias("low"),
        F.array_sort(F.collect_list(F.struct("type", "text", "confidence"))).alias("citations"),
    )
    return totals.join(by_type, key).select(key, F.struct("total", "average", "high", "low", "by_type").alias("summary"), "citations")


def write_reports(found: DataFrame, path: str, key: str = "doc_id") -> None:
    """One JSON record a document, with its summary block first."""
    extraction_reports(found, key).write.mode("overwrite").json(path)


def append_retrieval_log(hits: DataFrame, question: str, path: str) -> None:
    """What was found for a question, in rank order within each record, appended with the time of the call."""
    ranked = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in ("rank", *(c for c in hits.columns if c != "rank"))])))
    record = hits.agg(ranked.alias("hits")).select(F.current_timestamp().alias("at"), F.lit(question).alias("question"), F.size("hits").alias("n"), "hits")
    record.write.mode("append").json(path)
