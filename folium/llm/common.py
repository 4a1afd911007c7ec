"""What the operators share: reading, written intermediate tables, words, and links to components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.session import shared_folder, ship_package, table

__all__ = ["WORD", "Scratch", "add_columns", "by_ids", "columns_of", "components", "fresh", "int_array", "map_groups", "number_array", "plainly_named", "shared_folder", "table", "utf8", "words_of", "written_shuffles_dropped"]

#: Words of the contracts: runs of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables written once to the shared folder, so that lineage ends there and a lost executor costs no rework.

    `drop` removes a table that nothing reads any more; what a returned DataFrame still reads must stay.
    """

    def __init__(self, spark: SparkSession, tag: str):
        ship_package(spark)
        self.spark, self.base = spark, f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._folium_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._folium_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def written_shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it ends, not when the driver next collects garbage: what is read again is written to Scratch."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like this one that none of the frames has, whatever its case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words of UTF-8 text. bytes.split() splits at exactly space and 9 to 13."""
    return text.lower().split()


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; a null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


#: Ids are joined by broadcast up to so many (8 bytes each, about 64 MB in a task); beyond, by a shuffle.
BROADCAST_IDS = 2_000_000


def by_ids(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of wide rows with a written table of distinct ids; rows are not shuffled unless ids are many."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def plainly_named(df: DataFrame) -> DataFrame:
    """df with numbered columns: what hands rows to Python resolves names anew, and fails on those with dots or backticks."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def add_columns(rows: DataFrame, on: str, work: Callable[[pa.Array], list[pa.Array]], added: str | T.StructType) -> DataFrame:
    """rows and, after their columns, those that work makes of each batch of the column `on`.

    The other columns stay Arrow, which keeps them as they are; pandas would make whole numbers beside nulls doubles.
    """
    at, new = rows.columns.index(on), (T.StructType.fromDDL(added) if isinstance(added, str) else added).fields
    names = [*rows.columns, *(f.name for f in new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch.column(at))], names=names)

    return plainly_named(rows).mapInArrow(run, T.StructType([*rows.schema.fields, *new]))


def map_groups(rows: DataFrame, keys: list[str], work: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """work on the columns of each group of rows with equal keys (whole numbers), as applyInPandas, for many small groups.

    Rows are shuffled and sorted by key and streamed; one group at a time is held, and its columns are plain arrays.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last, out = [], None, []
        for batch in batches:
            columns = {c: batch[c].to_numpy() for c in batch.columns}
            key = np.stack([columns[k] for k in keys], axis=1) if len(batch) else np.empty((0, len(keys)))
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                here = tuple(key[i].tolist())
                if held and here != last:
                    out += work({c: np.concatenate([h[c] for h in held]) if len(held) > 1 else held[0][c] for c in held[0]})
                    held = []
                held.append({c: v[i:j] for c, v in columns.items()})
                last = here
            if len(out) >= 5000:
                yield frame(out)
                out = []
        if held:
            out += work({c: np.concatenate([h[c] for h in held]) for c in held[0]})
        if out:
            yield frame(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def int_array(values: list[int]) -> Column:
    """A constant array of longs, made from one literal so that a long one stays cheap to plan."""
    if not values:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def number_array(values: list[float]) -> Column:
    """A constant array of doubles."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def components(spark: SparkSession, scratch: Scratch, links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): a row (id, comp) for each id that has a link, comp the smallest id.

    Alternates large-star and small-star steps: each step hangs every vertex's larger (then smaller) neighbours on the
    smallest one, in joins and group-bys whose rows never exceed the number of links. The smallest neighbour of a
    vertex is an aggregate, joined back, so that a hub with most links needs no group in one task. Each round is
    written to the shared folder; the loop ends when a round changes nothing.
    """
    current = scratch.write(
        links.where("a <> b and a is not null and b is not null").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(),
        "links",
    )
    before = None
    while True:
        # large-star: the larger neighbours of every vertex go to its smallest (itself included)
        both = current.union(current.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        large = scratch.write(large, "large")
        # small-star: the smaller neighbours of every vertex, and itself, go to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").union(least.select("v", F.col("m").alias("u"))).distinct()
        small = scratch.write(small, "small")
        state = small.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        scratch.drop(large, current)
        current = small
        if before == state:
            break
        before = state
    return current.groupBy("v").agg(F.min("u").alias("comp")).select(F.col("v").alias("id"), "comp").union(
        current.select(F.col("u").alias("id"), F.col("u").alias("comp")).distinct()
    )
