"""Stores that grow: a term index that is appended to without a refit, and a cell index for vectors with a number of candidates.

`TermIndex` keeps term counts, which don't change when texts are added, in a Parquet table with a folder for each segment, whose files
are sorted by term. Document frequencies and so weights and norms follow from all segments when they are read, and are written
once for each state of the store; appends only write their own texts. A segment has a name, and a name that is there already
is not appended again, so a batch that runs twice counts once. The terms of a search are pushed down to the files, whose
sorted row groups without them are not read.

`VectorIndex` assigns vectors to cells of a k-means model and writes them by cell. A search visits the cells nearest the query
until they hold the number of candidates asked for, and ranks what is in them exactly. The exact scan (`dense_search`) stays
the default way; `recall` measures what the candidates miss.

Cases: texts without letters have no terms and are not found, null keys are not stored; keys that repeat within and between
segments count as one document; null and empty vectors are not stored, zero vectors are never found; stores without rows
answer with none.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.operators.retrieval import BROADCAST_NORMS, BROADCAST_TERMS, dense_search, hashing_embedder, most_frequent, term_counts
from folium.plans.registry import query
from folium.session import scratch_path, table

#: Vectors that cells are fitted on at most, and bytes of texts whose terms are sorted together in one task's memory.
FITTED, SORTED_BYTES = 100_000, 8_000_000
#: Queries that meet a slice of a cell in one task, about.
ASKED = 16_384
#: Queries that are worked out together.
TOGETHER = 256


class TermIndex:
    """Texts by their terms, in a folder that all executors see."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", text: str = "text", bigrams: bool = True, max_features: int | None = 50_000):
        self.spark, self.folder, self.key, self.text, self.bigrams, self.max_features = spark, folder.rstrip("/"), key, text, bigrams, max_features

    def table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def segments(self) -> list[str]:
        """Names of the segments, which are few. A segment counts once its row in `segments` is written, after its terms."""
        found = self.table("segments")
        return sorted(r["segment"] for r in found.select("segment").distinct().collect()) if found is not None else []

    def append(self, docs: DataFrame, segment: str) -> bool:
        """Adds docs (key, text) as a segment; whether it was new. What a broken run has left of it is written over."""
        if segment in self.segments():
            return False
        named = docs.where(F.col(self.key).isNotNull())
        size = named.agg(F.sum(F.octet_length(self.text))).first()[0] or 0
        counts = term_counts(named, self.key, self.text, self.bigrams, 1 + size // SORTED_BYTES)
        self.write(counts, f"terms/segment={segment}")
        n = named.select(self.key).distinct()
        n.write.mode("overwrite").parquet(f"{self.folder}/keys/segment={segment}")
        self.spark.createDataFrame([(segment,)], "segment string").write.mode("append").parquet(f"{self.folder}/segments")
        return True

    def write(self, counts: DataFrame, name: str) -> None:
        """Sorted by term, so that readers can leave out what has none of theirs; terms are not shuffled."""
        counts.select(self.key, "term", "tf").sortWithinPartitions("term").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}")

    def keys(self) -> DataFrame:
        return self.table("keys").where(F.col("segment").cast("string").isin(self.segments()))

    def counts(self) -> DataFrame | None:
        """(key, term, tf) of all segments; a key that is in several counts as one text."""
        there = self.segments()
        found = self.table("terms") if there else None
        if found is None:
            return None
        rows = found.where(F.col("segment").cast("string").isin(there))
        rows = rows.select(self.key, "term", "tf")
        shared = len(there) > 1 and self.keys().groupBy(self.key).count().where("count > 1").limit(1).count()
        return rows.groupBy(self.key, "term").agg(F.sum("tf").alias("tf")) if shared else rows

    def fitted(self) -> tuple[DataFrame, DataFrame] | None:
        """Vocabulary (term, df, cf, idf) and norms (key, norm) of the present state, worked out once and kept in the folder."""
        there = self.segments()
        counts = self.counts()
        if counts is None:
            return None
        state = f"state={len(there)}-{hash_of(there)}"
        if self.table(f"norms/{state}") is None:
            vocab = most_frequent(counts, self.max_features)
            n = self.keys().select(self.key).distinct().count()
            vocab.select("term", "df", "cf", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")).write.mode("overwrite").parquet(f"{self.folder}/vocabulary/{state}")
            idf = self.table(f"vocabulary/{state}").select("term", "idf")
            weight = F.col("tf") * F.col("idf")
            norms = counts.join(small(idf, self.max_features), "term").groupBy(self.key).agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
            norms.write.mode("overwrite").parquet(f"{self.folder}/norms/{state}")
        return self.table(f"vocabulary/{state}"), self.table(f"norms/{state}")

    def postings(self) -> DataFrame | None:
        """(key, term, w), as one fit over all texts gives them."""
        fitted = self.fitted()
        if fitted is None:
            return None
        vocab, norms = fitted
        weighed = self.counts().join(small(vocab.select("term", "idf"), self.max_features), "term")
        weighed = weighed.join(F.broadcast(norms) if norms.count() <= BROADCAST_NORMS else norms, self.key)
        return weighed.select(self.key, "term", (F.col("tf") * F.col("idf") / F.col("norm")).alias("w"))

    def search(self, keywords: list[str], k: int) -> DataFrame | None:
        """The k best (key, score): each keyword is a query of one term, and scores are summed."""
        fitted = self.fitted()
        if fitted is None:
            return None
        vocab, norms = fitted
        asked = list(dict.fromkeys(keywords))
        weights = vocab.where(F.col("term").isin(asked)).select("term", "idf")
        hits = self.counts().where(F.col("term").isin(asked)).join(F.broadcast(weights), "term")  # a few keywords
        sums = hits.groupBy(self.key).agg(F.sum(F.col("tf") * F.col("idf")).alias("s")).join(norms, self.key)
        return sums.select(self.key, (F.col("s") / F.col("norm")).alias("score")).orderBy(F.desc(F.round("score", 6)), self.key).limit(k)

    def merge(self, into: str) -> TermIndex:
        """The same texts in another folder as one segment, where many small appends have left many small files."""
        whole = TermIndex(self.spark, into, self.key, self.text, self.bigrams, self.max_features)
        counts = self.counts()
        if counts is not None and not whole.segments():
            whole.write(counts.repartitionByRange("term"), "terms/segment=merged")
            self.keys().select(self.key).distinct().write.mode("overwrite").parquet(f"{whole.folder}/keys/segment=merged")
            self.spark.createDataFrame([("merged",)], "segment string").write.mode("append").parquet(f"{whole.folder}/segments")
        return whole


def small(idf: DataFrame, most: int | None) -> DataFrame:
    """A vocabulary of a bounded number of terms, for a join by broadcast."""
    return F.broadcast(idf) if most is not None and most <= BROADCAST_TERMS else idf


def hash_of(names: list[str]) -> int:
    """A number for a list of names that is the same in every process."""
    return zlib.crc32("\n".join(names).encode())


class VectorIndex:
    """Vectors in cells, in a folder that all executors see."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "vec_id", vector: str = "embedding"):
        self.spark, self.folder, self.key, self.vector = spark, folder.rstrip("/"), key, vector

    def build(self, vectors: DataFrame, cells: int | None = None, seed: int = 7) -> VectorIndex:
        """Fits cells, by default the root of the vectors in number, on at most FITTED vectors by hash of their key, and writes every vector to its cell.

        A vector without direction (zero, or with a component that is null or not finite) is in cell -1, which no search visits.
        """
        value = F.transform(F.col(self.vector), lambda x: x.cast("double"))
        whole = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
        stored = vectors.where(F.col(self.key).isNotNull() & (F.size(self.vector) > 0)).select(*[F.col(f"`{c}`") for c in vectors.columns], F.when(whole, value).alias("__v"))
        n = stored.where("__v is not null").count()
        cells = min(cells or round(n**0.5), n)
        if cells > 1:
            fit_on = stored.where("__v is not null").select(array_to_vector("__v").alias("features"), F.xxhash64(self.key).alias("__h"))
            if n > FITTED:
                fit_on = fit_on.orderBy("__h").limit(FITTED).repartition("__h")  # the limit leaves them in one partition
            model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=15).fit(fit_on)
            centres = [c.tolist() for c in model.clusterCenters()]
            good = model.transform(stored.where("__v is not null").withColumn("features", array_to_vector("__v"))).withColumnRenamed("prediction", "cell").drop("features", "__v")
            rows = good.unionByName(stored.where("__v is null").drop("__v").withColumn("cell", F.lit(-1)))
        else:
            centres = [[float(x) for x in r["__v"]] for r in stored.where("__v is not null").select("__v").limit(1).collect()]
            rows = stored.withColumn("cell", F.when(F.col("__v").isNotNull(), 0).otherwise(-1)).drop("__v")
        self.spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/centres")
        rows.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/vectors")
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/vectors")
        rows.groupBy("cell").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/sizes")
        return self

    def centres(self) -> np.ndarray:
        """Directions of the cells, as many as the model has."""
        rows = self.spark.read.parquet(f"{self.folder}/centres").orderBy("cell").collect()
        return unit(np.array([r["centre"] for r in rows], float).reshape(len(rows), -1))

    def cells_for(self, vector: list[float], candidates: int) -> list[int]:
        """The cells nearest the vector that together hold so many candidates."""
        sizes = {r["cell"]: r["n"] for r in self.spark.read.parquet(f"{self.folder}/sizes").collect()}  # one row a cell
        if not any(c >= 0 for c in sizes):
            return []
        near, out, held = np.argsort(-(self.centres() @ np.asarray(vector, float)), kind="stable"), [], 0
        for cell in near.tolist():
            out.append(cell)
            held += sizes.get(cell, 0)
            if held >= candidates:
                break
        return out

    def search(self, vector: list[float], k: int, candidates: int | None = None) -> DataFrame:
        """The k best (key, cos, score) among the candidates; by default ten times k, at least 100 and at most 1000.

        Only the folders of the visited cells are read.
        """
        candidates = candidates or min(max(10 * k, 100), 1000)
        cells = self.cells_for(vector, candidates)
        rows = self.spark.read.parquet(f"{self.folder}/vectors").where(F.col("cell").isin(cells) if cells else F.lit(False))
        asked = self.spark.createDataFrame([([float(x) for x in vector],)], f"{self.vector} array<double>")
        return dense_search(rows, asked, k, self.key, self.vector)


def recall(exact: DataFrame, found: DataFrame, key: str = "vec_id") -> float:
    """The share of the exact top-k that the found one has; both are top-k lists."""
    n = exact.count()
    return exact.join(F.broadcast(found.select(key)), key, "left_semi").count() / n if n else 1.0


def search_all(index: VectorIndex, queries: DataFrame, k: int, candidates: int | None = None, slice_rows: int = 4096) -> DataFrame:
    """(query, rank, key, cos) for many queries (query, q) at once: each query meets only the rows of the cells it visits.

    Cells that follow each other are dealt to slices of about `slice_rows` rows, a larger cell to several. A query goes once to each slice
    with cells it visits, which it names, and queries in blocks, so that a task holds a slice and a block; it gives the best of each query.
    """
    spark, candidates = index.spark, candidates or min(max(10 * k, 100), 1000)
    sizes = spark.read.parquet(f"{index.folder}/sizes").where("cell >= 0")
    held = {r["cell"]: r["n"] for r in sizes.collect()}  # one row a cell
    schema = f"query {queries.schema['query'].dataType.simpleString()}, key {index_type(index)}, cos double"
    if not held:
        return spark.createDataFrame([], "query long, rank int, key long, cos double").withColumnRenamed("key", index.key)
    centres = index.centres()
    dealt, edges = slices_of(held, len(centres), slice_rows)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, first, last = np.array([held.get(c, 0) for c in range(len(centres))]), *edges.T
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                part = batch.iloc[at : at + TOGETHER]
                near = np.argsort(-(unit(np.array(part["q"].tolist(), float)) @ centres.T), axis=1, kind="stable")
                before = np.cumsum(sizes[near], axis=1) - sizes[near]
                visited = np.zeros(near.shape, bool)
                np.put_along_axis(visited, near, before < candidates, axis=1)
                visited &= sizes > 0
                counted = np.concatenate([np.zeros((len(part), 1), np.int64), np.cumsum(visited, axis=1)], axis=1)
                i, s = np.nonzero(counted[:, last] > counted[:, first])
                named = [np.packbits(visited[x, first[y] : last[y]]).tobytes() for x, y in zip(i.tolist(), s.tolist(), strict=True)]
                yield pd.DataFrame({"query": part["query"].to_numpy()[i], "q": part["q"].to_numpy()[i], "slice": s.astype(np.int32), "named": named})

    def best(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": asked["query"].to_numpy()[:0], "key": rows["key"].to_numpy()[:0], "cos": np.zeros(0)})]
        rows = rows.sort_values("key", kind="stable") if len(asked) else rows[:0]
        x, keys, place = unit(np.array(rows["v"].tolist(), float).reshape(len(rows), -1 if len(rows) else 0)), rows["key"].to_numpy(), rows["place"].to_numpy()
        for at in range(0, len(asked) if len(rows) else 0, TOGETHER):
            part = asked.iloc[at : at + TOGETHER]
            named = np.unpackbits(np.frombuffer(b"".join(part["named"]), np.uint8).reshape(len(part), -1), axis=1)
            cos = unit(np.array(part["q"].tolist(), float)) @ x.T
            shown = np.where(named[:, place] == 1, np.round(cos, 6), -np.inf)
            least = np.partition(shown, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(part), -np.inf)
            i, j = np.nonzero((shown >= least[:, None]) & (shown > -np.inf))
            order = np.lexsort((j, -shown[i, j], i))  # equal ones by key
            i, j = i[order], j[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[first], j[first]
            out.append(pd.DataFrame({"query": part["query"].to_numpy()[i], "key": keys[j], "cos": cos[i, j]}))
        return pd.concat(out)

    blocks = max(1, -(-queries.count() // ASKED))
    fields = f"query {queries.schema['query'].dataType.simpleString()}, q array<double>, slice int, named binary"
    sized = F.broadcast(spark.createDataFrame(dealt, "cell int, first int, slices int, place int"))  # one row a cell
    asked = queries.select("query", F.transform("q", lambda x: x.cast("double")).alias("q")).mapInPandas(visits, fields)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    rows = spark.read.parquet(f"{index.folder}/vectors").where("cell >= 0").select(F.col(index.key).alias("key"), F.col(index.vector).alias("v"), "cell")
    rows = rows.join(sized, "cell").select("key", "v", "place", (F.col("first") + F.pmod(F.xxhash64("key"), "slices")).cast("int").alias("slice"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = asked.groupBy("slice", "block").cogroup(rows.groupBy("slice", "block")).applyInPandas(best, schema)
    order = Window.partitionBy("query").orderBy(F.desc(F.round("cos", 6)), "key")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query", (F.col("rank") - 1).alias("rank"), F.col("key").alias(index.key), "cos")


def slices_of(held: dict[int, int], cells: int, slice_rows: int) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """(cell, its first slice, how many it has, its place among the slice's cells) by the rows that cells hold, and the cells from ... to ... of each slice."""
    dealt, edges, filled = [], [], slice_rows
    for cell in range(cells):
        n = held.get(cell, 0)
        parts = max(1, -(-n // slice_rows))
        if filled + n > slice_rows:
            edges += [[cell, cell]] * parts
            filled = 0
        filled += n if parts == 1 else slice_rows
        for edge in range(len(edges) - parts, len(edges)):
            edges[edge] = [edges[edge][0], cell + 1]
        dealt.append((cell, len(edges) - parts, parts, cell - edges[-1][0]))
    return dealt, np.array(edges, np.int64).reshape(-1, 2)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def index_type(index: VectorIndex) -> str:
    return index.spark.read.parquet(f"{index.folder}/vectors").schema[index.key].dataType.simpleString()


def build_stores(chunks: DataFrame, folder: str, key: str = "doc_id", text: str = "text", segment: str = "0", embed: Callable[[Column], Column] = hashing_embedder) -> tuple[TermIndex, VectorIndex]:
    """Both stores of chunks: their terms as a segment and their vectors in cells."""
    terms = TermIndex(chunks.sparkSession, f"{folder}/terms", key, text)
    terms.append(chunks.select(key, text), segment)
    vectors = VectorIndex(chunks.sparkSession, f"{folder}/vectors", key).build(chunks.select(key, embed(F.col(text)).alias("embedding")))
    return terms, vectors


# ---------------------------------------------------------------- queries

_POSTINGS_SQL = r"""WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents),
gram AS (SELECT doc_id, unnest(t) AS term FROM tok UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM tok),
tf AS (SELECT doc_id, term, count(*) AS tf FROM gram GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
vocab AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 50000), n),
wt AS (SELECT doc_id, tf * idf AS w FROM tf JOIN vocab USING (term))
SELECT doc_id, count(*) AS terms, round(sum(w) / sqrt(sum(w * w)), 4) AS weight FROM wt GROUP BY doc_id"""


@query("k34_appended_index", _POSTINGS_SQL)
def k34(spark, sf_dir):
    """Three appends and one that is repeated, read as one store."""
    docs, index = table(spark, sf_dir, "documents"), TermIndex(spark, scratch_path(spark, "terms"))
    for i in (0, 1, 2, 1):
        index.append(docs.where(F.col("doc_id") % 3 == i), f"part-{i}")
    return index.postings().groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("w"), 4).alias("weight"))


@query("t01_knn_candidates")
def t01_candidates(spark, sf_dir):
    """For every vector whose number is divisible by 20, its ten nearest among the candidates of its cells. These vectors hardly cluster, so
    three quarters of them are candidates; the recall is above 0.95 then."""
    v = table(spark, sf_dir, "embeddings")
    index = VectorIndex(spark, scratch_path(spark, "cells")).build(v)
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    return search_all(index, asked, 10, candidates=int(v.count() * 0.75)).withColumn("cos", F.round("cos", 6))
