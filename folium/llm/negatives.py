"""Hard-negative mining by length buckets and coordinate pruning.

Scores are inner products of whole-number vectors, so a search for products of at least t with an anchor has two bounds. Rows
are taken in buckets of falling length: with |a| |r| < t a bucket, and all after it, are out. In a bucket, directions are held
as a sorted list for each coordinate; of an anchor, the FOCUS coordinates where its direction is largest are its focus. A row
whose cosine is at least t / (|a| |bucket|) lies within that angle of the anchor, and so its focus coordinates lie in ranges
around the anchor's own: the ranges' rows are intersected and only what is in all of them is multiplied out, exactly. Where an
anchor's narrowest range holds most of a bucket, lists have nothing to tell and the bucket is multiplied out at once.

Two searches use this. The first finds the best rows of each anchor's label: t is the worst of the best so far, and begins with
what a bounded sample of rows gives, a lower bound whatever the sample. The second finds, for each positive, the best rows of
other labels whose scores lie between two shares of the positive's: t begins at the lower one and rises as places are taken.

Anchors are the query set; rows are dealt in slices and anchors in chunks of bounded bytes, each slice meets each chunk once, and
best rows of slices are merged by anchor. So tasks hold one chunk and one slice, and a label with most of the rows is many
slices.

Cases: rows without label, vector or vec_id, or with a null or non-finite component, take no part; rows that repeat a vec_id are rows of
their own, and each other's candidates; only vectors of equal length are compared; components beyond 2**53 count as that, scores
beyond a long as the largest or smallest; positives whose range is empty (below zero) have no negatives; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.llm.common import Scratch, add_columns, table

#: Scale of components, positives of an anchor, negatives of a positive, and their range in percent of the positive's score.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Rows of a length bucket at most, share of its longest row that a row must have, focus coordinates, and share of a bucket up to which lists are used.
BUCKET, SHORTEST, FOCUS, TELLING = 1024, 0.9, 4, 0.25
#: Bytes of a chunk of anchors and of a slice of rows, slices aimed at, rows of a slice at least, rows of the sample.
CHUNK_BYTES, SLICE_BYTES, SLICES, LEAST_ROWS, SAMPLE = 16_000_000, 64_000_000, 64, 256, 2000

_LONG = np.iinfo(np.int64)


def whole(vectors: pa.ListArray) -> list[pa.Array]:
    """floor(SCALE * x) of each vector as bytes of longs, null where a component is null or not finite."""
    values, out = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), []  # nulls become NaN
    offsets, there = vectors.offsets.to_numpy(), vectors.is_valid().to_numpy(zero_copy_only=False)
    for ok, i, j in zip(there, offsets[:-1], offsets[1:], strict=True):
        x = values[i:j]
        out.append(np.clip(np.floor(SCALE * x), -(2.0**53), 2.0**53).astype(np.int64).tobytes() if ok and np.isfinite(x).all() else None)
    return [pa.array(out, pa.binary())]


def matrix(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.int64).reshape(len(packed), len(packed[0]) // 8)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of each row of a with each of b, as longs."""
    if not len(a) or not len(b) or not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 2**53:  # whole numbers that doubles hold
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)


class Best:
    """For each of n searches, the k best (score, then smaller id, then smaller row) rows so far."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), _LONG.min), np.full((n, k), _LONG.max)
        self.row, self.taken = np.full((n, k), -1, np.int64), np.zeros((n, k), bool)

    def worst(self) -> np.ndarray:
        """The score that a row must reach, for searches whose places are taken; the smallest long for others."""
        return np.where(self.taken[:, -1], self.score[:, -1], _LONG.min)

    def offer(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        if not len(search):
            return
        some, at = np.unique(search, return_inverse=True)
        k = self.score.shape[1]
        old = np.repeat(np.arange(len(some)), k)
        who = np.concatenate([old, at])
        columns = [np.concatenate([getattr(self, name)[some].ravel(), new]) for name, new in (("score", score), ("id", ids), ("row", row), ("taken", np.ones(len(at), bool)))]
        order = np.lexsort((columns[2], columns[1], ~columns[0], ~columns[3], who))  # ~score falls as score rises
        who = who[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        stay = order[place < k]
        for name, values in zip(("score", "id", "row", "taken"), columns, strict=True):
            getattr(self, name)[some] = values[stay].reshape(len(some), k)


class Buckets:
    """Rows of equal dimension by falling length, in buckets with a sorted list of directions for each coordinate."""

    def __init__(self, x: np.ndarray):
        size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(-size, kind="stable")
        self.x, self.size, self.edges, at = x[self.order], size[self.order], [], 0
        while at < len(x):
            short = np.searchsorted(-self.size, -SHORTEST * self.size[at], side="right")
            stop = max(at + 1, min(int(short), at + BUCKET))
            self.edges.append((at, stop))
            at = stop
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_lists(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, coordinate) in ascending order of each coordinate of the bucket's directions, and those values."""
        if start not in self.lists:
            unit = self.x[start:stop] / np.maximum(self.size[start:stop], 1e-300)[:, None]
            order = np.argsort(unit, axis=0)
            self.lists[start] = order, np.take_along_axis(unit, order, axis=0)
        return self.lists[start]

    def search(self, anchors: np.ndarray, least: np.ndarray, start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor numbers, row numbers, scores) of blocks of pairs, among them all of this bucket with a score of at least `least`."""
        size = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
        reach = size * self.size[start] * (1 + 1e-9)
        live = np.flatnonzero((least <= 0) | (least <= reach))
        angled = (least[live] > 0) & (reach[live] > 0)
        plain, pruned = live[~angled], live[angled]
        if len(pruned) and stop - start > 8:
            order, values = self.sorted_lists(start, stop)
            direction = anchors[pruned] / size[pruned][:, None]
            focus = np.argsort(-np.abs(direction), axis=1)[:, :FOCUS]
            at = np.take_along_axis(direction, focus, axis=1)
            around = np.arccos(np.clip(least[pruned] / reach[pruned], -1, 1))[:, None] + 1e-9
            mid = np.arccos(np.clip(at, -1, 1))
            low, high = np.cos(np.minimum(np.pi, mid + around)) - 1e-9, np.cos(np.maximum(0, mid - around)) + 1e-9
            lo, hi = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
            for f in np.unique(focus):
                mine = focus == f
                lo[mine], hi[mine] = np.searchsorted(values[:, f], low[mine]), np.searchsorted(values[:, f], high[mine], side="right")
            narrow = (hi - lo).min(axis=1) <= TELLING * (stop - start)
            for i in np.flatnonzero(narrow).tolist():
                lists = [order[lo[i, c] : hi[i, c], focus[i, c]] for c in range(focus.shape[1])]
                rows = np.flatnonzero(np.bincount(np.concatenate(lists), minlength=stop - start) == len(lists)) + start
                if len(rows):
                    a = pruned[i : i + 1]
                    yield np.repeat(a, len(rows)), rows, products(anchors[a], self.x[rows])[0]
            plain = np.concatenate([plain, pruned[~narrow]])
        else:
            plain = live
        for part in np.array_split(plain, max(1, len(plain) * (stop - start) // 2_000_000 + 1)):
            score = products(anchors[part], self.x[start:stop])
            i, j = np.nonzero(score >= least[part][:, None])
            yield part[i], j + start, score[i, j]


def by_dimension(blobs: pd.Series) -> Iterator[np.ndarray]:
    """Row numbers of vectors of each length."""
    size = blobs.map(len).to_numpy()
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def best_of_label(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of the slice for each anchor, of its label and not itself, that reach what it must (`least`)."""
    out = []
    for label, mine in anchors.groupby("label", sort=False):
        same = rows[rows["label"] == label]
        for at in by_dimension(mine["v"]) if len(same) else ():
            some, fit = mine.iloc[at], same[same["v"].map(len) == len(mine["v"].iloc[at[0]])]
            if not len(fit):
                continue
            a, buckets = matrix(some["v"].tolist()), Buckets(matrix(fit["v"].tolist()))
            ids, keys = fit["vec_id"].to_numpy()[buckets.order], fit["rid"].to_numpy()[buckets.order]
            own, floor, best = some["rid"].to_numpy(), some["least"].to_numpy(), Best(len(some), k)
            for start, stop in buckets.edges:
                for i, j, score in buckets.search(a, np.maximum(floor, best.worst()), start, stop):
                    other = own[i] != keys[j]
                    best.offer(i[other], score[other], ids[j[other]], keys[j[other]])
            i, c = np.nonzero(best.taken)
            out.append(pd.DataFrame({"anchor": own[i], "score": best.score[i, c], "vec_id": best.id[i, c], "rid": best.row[i, c]}))
    return pd.concat(out) if out else pd.DataFrame({c: np.array([], np.int64) for c in ("anchor", "score", "vec_id", "rid")})


def best_in_ranges(anchors: pd.DataFrame, rows: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    """The k best rows of the slice for each anchor and score of its positives, of another label and in the score's range."""
    out = []
    for at in by_dimension(anchors["v"]):
        some = anchors.iloc[at]
        fit = rows[rows["v"].map(len) == len(some["v"].iloc[0])]
        if not len(fit):
            continue
        a, buckets = matrix(some["v"].tolist()), Buckets(matrix(fit["v"].tolist()))
        ids, keys, labels = (fit[c].to_numpy()[buckets.order] for c in ("vec_id", "rid", "label"))
        own, label = some["rid"].to_numpy(), some["label"].to_numpy()
        scores = [np.asarray(s, np.int64) for s in some["scores"]]
        who = np.repeat(np.arange(len(some)), [len(s) for s in scores])
        score_of = np.concatenate(scores)
        bottom, top = np.array([-(-low * int(s) // 100) for s in score_of], np.int64), np.array([high * int(s) // 100 for s in score_of], np.int64)
        first = np.searchsorted(who, np.arange(len(some) + 1))
        best = Best(len(who), k)
        for start, stop in buckets.edges:
            need = np.maximum(bottom, best.worst())
            least = np.minimum.reduceat(need, first[:-1])
            for i, j, score in buckets.search(a, least, start, stop):
                other = label[i] != labels[j]
                i, j, score = i[other], j[other], score[other]
                for c in range(int((first[1:] - first[:-1]).max())):  # few: positives of an anchor
                    search = first[i] + c
                    fits = (search < first[i + 1]) & (score >= need[np.minimum(search, len(need) - 1)]) & (score <= top[np.minimum(search, len(need) - 1)])
                    best.offer(search[fits], score[fits], ids[j[fits]], keys[j[fits]])
        i, c = np.nonzero(best.taken)
        out.append(pd.DataFrame({"anchor": own[who[i]], "positive_score": score_of[i], "score": best.score[i, c], "vec_id": best.id[i, c], "rid": best.row[i, c]}))
    return pd.concat(out) if out else pd.DataFrame({c: np.array([], np.int64) for c in ("anchor", "positive_score", "score", "vec_id", "rid")})


def searched(anchors: DataFrame, rows: DataFrame, slices: int, chunks: int, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work(anchors, rows) for each chunk of anchors and slice of rows; both are bounded in bytes."""
    dealt = anchors.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.lit(chunks)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    held = rows.withColumn("slice", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(slices)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return dealt.groupBy("chunk", "slice").cogroup(held.groupBy("chunk", "slice")).applyInPandas(work, schema)


def best_rows(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of what the slices found, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    is_anchor is a condition on their columns. Negatives of a positive are the best of the rows of other labels whose score is
    from `low` to `high` percent of the positive's.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "negatives")
    given = vectors.where("vec_id is not null and label is not null and embedding is not null").select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    rows = add_columns(given, "embedding", whole, "v binary").drop("embedding").where("v is not null")
    rows = scratch.write(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    n, asking, widest = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1)), F.max(F.length("v"))).first()
    widest = max(widest or 0, 8)
    slices = max(1, min(SLICES, -(-n // LEAST_ROWS)), -(-n * widest // SLICE_BYTES))
    chunks = max(1, -(-asking * widest // CHUNK_BYTES))
    sample = rows.select("vec_id", "label", "rid", "v").orderBy(F.xxhash64("rid", F.lit(2))).limit(max(1, min(SAMPLE, SLICE_BYTES // widest))).toPandas()
    known = spark.sparkContext.broadcast(sample)

    def started(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = best_of_label(batch.assign(least=_LONG.min), known.value, positives)
            worst = found.groupby("anchor")["score"].agg(["size", "min"])
            worst = worst[worst["size"] == positives]["min"].to_dict()
            yield batch.assign(least=np.array([worst.get(r, _LONG.min) for r in batch["rid"]], np.int64))

    anchors = rows.where("asks").select("rid", "vec_id", "label", "v")
    ready = scratch.write(anchors.mapInPandas(started, "rid long, vec_id long, label long, v binary, least long"), "anchors")

    def find_positives(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return best_of_label(a, r, positives)

    def find_negatives(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return best_in_ranges(a, r, negatives, low, high)

    held = rows.select("rid", "vec_id", "label", "v")
    found = searched(ready.select("rid", "label", "v", "least"), held, slices, chunks, find_positives, "anchor long, score long, vec_id long, rid long")
    best = scratch.write(best_rows(found, ["anchor"], positives).select("anchor", F.col("vec_id").alias("positive_id"), F.col("rank").alias("place"), F.col("score").alias("positive_score")), "positives")
    asked = best.where("positive_score >= 0").groupBy("anchor").agg(F.collect_set("positive_score").alias("scores"))
    ranged = ready.join(asked.withColumnRenamed("anchor", "rid"), "rid").select("rid", "label", "v", "scores")
    found = searched(ranged, held, slices, chunks, find_negatives, "anchor long, positive_score long, score long, vec_id long, rid long")
    worst = best_rows(found, ["anchor", "positive_score"], negatives).select("anchor", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = best.join(worst, ["anchor", "positive_score"]).join(ready.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.rid <> b.rid AND len(a.e) = len(b.e)
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.vec_id, s.rid)::INTEGER AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
