"""Ordered work over groups: rows are dealt by their group and sorted, and Python walks along a partition.

Groups are many and small, so a frame for each of them would cost more than its work: batches are read across groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that goes back to Spark.
BATCH = 10_000
_NONE = object()


def dealt(rows: DataFrame, by: str, order: Iterable[str | Column]) -> DataFrame:
    """Rows of a group in one partition, one after the other, in order."""
    return rows.repartition(by).sortWithinPartitions(by, *order)


def fold_groups(rows: DataFrame, by: str, order: Iterable[str | Column], work: Callable[[list[tuple]], Iterable[tuple]], schema: StructType) -> DataFrame:
    """What `work` makes of each group's rows, which it gets in order, as tuples; `by` is their first column. One group is held at a time."""
    target = to_arrow_schema(schema)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out = _NONE, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != group:
                    if held:
                        out.extend(work(held))
                    group, held = row[0], []
                    if len(out) >= BATCH:
                        yield batch_of(out)
                        out = []
                held.append(row)
        if held:
            out.extend(work(held))
        if out:
            yield batch_of(out)

    columns = [by, *[c for c in rows.columns if c != by]]
    return dealt(rows.select(*columns), by, order).mapInArrow(run, schema)


def walk(rows: DataFrame, given: list[str], start: Callable[[], Callable[..., tuple]], added: StructType) -> DataFrame:
    """Rows with the columns that a walk along their partition adds: `start` gives a function from a row's `given` columns to the new ones."""
    target = to_arrow_schema(added)
    schema = StructType([*rows.schema.fields, *added.fields])
    places = [rows.columns.index(c) for c in given]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            new = [step(*row) for row in zip(*(batch.column(i).to_pylist() for i in places), strict=True)]
            columns = zip(*new, strict=True) if new else [()] * len(target)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, f.type) for c, f in zip(columns, target, strict=True)]], names=[*batch.schema.names, *target.names])

    return rows.mapInArrow(run, schema)
