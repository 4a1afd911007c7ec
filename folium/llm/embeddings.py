"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one representative per group.

Equal vectors are one class. Centres are fitted on a bounded sample (at most SAMPLE vectors and SAMPLE_BYTES bytes, those
with the smallest hashes of their id); every vector is assigned. A vector's home is the cell of its nearest centre. It is
also a guest of each cell c whose bisecting plane with its home h is no farther than a linked vector can lie,
(x.h - x.c) / |h - c| <= sqrt(2 - 2t), so two linked vectors with homes A and B meet in A and in B: the cells lose no link at
the threshold t. One of the two is enough; it is A where B is among the next half of the cells after A, in a circle. How many
centres to use is chosen on the sample, by the comparisons and guests each number would cost; where vectors don't cluster,
most would be guests of most cells, and few cells with many blocks are the cheaper exact plan (such data are quadratic).

The homes of a cell are cut into blocks of bounded bytes. A task holds one block and streams by it the blocks of the next
half of the circle (each pair of blocks meets once) and the guests. Products are taken in single precision over a few
rotated dimensions and the length of the rest, which bounds the cosine from above; what passes is computed in double
precision. A block gives each vector's number of links and, instead of the pairs, a tree for each group it connects;
components of all trees follow with the usual rounds.

Cases: vectors that are null, empty, zero or hold a null or non-finite component link with nothing; float columns are kept as
floats and double columns as doubles, at any scale; vectors of another length than most share one cell per length; rows that
repeat a vec_id are vectors of their own with a common component; a null vec_id links with nothing and is kept; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm.common import Scratch, add_columns, components, table

THRESHOLD = 0.95
#: Bounds of the sample that centres are fitted on.
SAMPLE, SAMPLE_BYTES = 20_000, 32_000_000
#: Vectors of a block at most, and their bytes in double precision; products that are held at once.
BLOCK, BLOCK_BYTES, HELD = 8192, 48_000_000, 8_000_000
#: Comparisons that cost as much as one guest; dimensions of the bound.
GUEST, FEW = 4000, 16
#: Vectors per cell aimed at, sampled vectors per centre at least, and rounds of k-means.
PER_CELL, PER_CENTRE, ITERATIONS = 1000, 8, 12

Links = tuple[np.ndarray, np.ndarray]


def unit(packed: pd.Series | list[bytes], kind: type) -> np.ndarray:
    """Normalised rows, in double precision. The largest component goes first, so that no square over- or underflows."""
    x = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(11)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ITERATIONS):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def compares(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Whether a meets b, of n in a circle: of two different ones, exactly one meets the other."""
    ahead = (b - a) % n
    return (ahead > 0) & ((2 * ahead < n) | ((2 * ahead == n) & (a < b)))


def membership(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, and the matrix of the cells where it is a guest or at home."""
    dots = x @ centres.T
    home = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))
    reach = np.sqrt(2 - 2 * threshold) * apart[home] + 1e-9
    k, here = len(centres), np.arange(len(x))
    near = (dots[here, home][:, None] - dots <= reach) & compares(np.arange(k)[None, :], home[:, None], k)
    near[here, home] = True
    return home, near


def fit_centres(sample: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Centres for n vectors: of halving numbers, the one with the least cost of comparisons and guests."""
    k = int(min(max(1, n // PER_CELL), max(1, len(sample) // PER_CENTRE)))
    best, cost = None, np.inf
    while k >= 1:
        centres = spherical_kmeans(sample, k)
        home, members = membership(sample, centres, threshold)
        homes = np.bincount(home, minlength=k)
        here = float((homes * (members.sum(axis=0) - homes / 2)).sum()) * n / len(sample) + GUEST * float(members.sum())
        if here < cost:
            best, cost = centres, here
        k //= 2
    return best


def bounded(x: np.ndarray) -> np.ndarray:
    """Few dimensions and the length of the others, in single precision: their products bound those of the rows from above."""
    if x.shape[1] <= FEW + 1:
        return x.astype(np.float32)
    turn = np.linalg.qr(np.random.default_rng(5).normal(size=(x.shape[1], x.shape[1])))[0][:, :FEW]
    few = x @ turn
    rest = np.sqrt(np.maximum(1 - (few * few).sum(axis=1), 0))
    return np.concatenate([few, rest[:, None]], axis=1).astype(np.float32)


def links_between(left: np.ndarray, right: np.ndarray, threshold: float) -> Links:
    """Row numbers of all pairs whose product reaches the threshold."""
    lb, rb, out = bounded(left), bounded(right).T, [(np.array([], np.int64), np.array([], np.int64))]
    for at in range(0, len(left), max(1, HELD // max(1, len(right)))):
        part = slice(at, at + max(1, HELD // max(1, len(right))))
        i, j = np.nonzero(lb[part] @ rb >= threshold - 1e-5)
        if not len(i):
            continue
        rows, cols = np.unique(i), np.unique(j)
        if 20 * len(i) > len(rows) * len(cols):  # a group of near copies: one product of its rows
            a, b = np.nonzero(left[part][rows] @ right[cols].T >= threshold)
            i, j = rows[a], cols[b]
        else:
            keep = [np.einsum("ij,ij->i", left[part][i[n : n + 50_000]], right[j[n : n + 50_000]]) >= threshold for n in range(0, len(i), 50_000)]
            keep = np.concatenate(keep)
            i, j = i[keep], j[keep]
        out.append((i + at, j))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def join_groups(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """group (the smallest row number each row is known to reach) after joining the rows a with the rows b."""
    while True:
        x, y = group[a], group[b]
        apart = x != y
        if not apart.any():
            return group
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(group, np.maximum(x, y), np.minimum(x, y))
        while (group[group] != group).any():
            group = group[group]


class Block:
    """The home vectors of a task, by ascending id, with what was found about them so far."""

    def __init__(self, rows: pd.DataFrame, kind: type, threshold: float):
        rows = rows.sort_values(["rep", "k1"], kind="stable")
        self.ids, self.k1 = rows["rep"].to_numpy(np.int64), rows["k1"].to_numpy(np.int64)
        self.copies, self.x = rows["copies"].to_numpy(np.int64), unit(rows["v"], kind)
        self.n, self.group = np.zeros(len(rows), np.int64), np.arange(len(rows))
        self.threshold, self.kind = threshold, kind

    def within(self) -> None:
        """Links inside the block."""
        i, j = links_between(self.x, self.x, self.threshold)
        i, j = i[i != j], j[i != j]
        self.n += np.bincount(i, self.copies[j], len(self.n)).astype(np.int64)
        self.group = join_groups(self.group, i, j)

    def meet(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Links with vectors of other blocks: their numbers, and their joints with the smallest row they meet."""
        ids, k1, copies = (rows[c].to_numpy(np.int64) for c in ("rep", "k1", "copies"))
        i, j = links_between(self.x, unit(rows["v"], self.kind), self.threshold)
        self.n += np.bincount(i, copies[j], len(self.n)).astype(np.int64)
        n, least = np.bincount(j, self.copies[i], len(ids)).astype(np.int64), np.full(len(ids), len(self.n))
        np.minimum.at(least, j, i)
        self.group = join_groups(self.group, i, least[j])
        some = n > 0
        return found(ids[some], k1[some], n[some], self.ids[least[some]])

    def result(self) -> pd.DataFrame:
        some = (self.n > 0) | (self.group != np.arange(len(self.n)))
        return found(self.ids[some], self.k1[some], self.n[some], self.ids[self.group[some]])


def found(rep: np.ndarray, k1: np.ndarray, n: np.ndarray, joint: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"rep": rep, "k1": k1, "n": n, "joint": joint})


def packed_vectors(vectors: DataFrame, kind: type) -> DataFrame:
    """(vec_id, k1, k2, v): the bytes and their 128-bit digest, null for vectors that link with nothing."""

    def pack(lists: pa.ListArray) -> list[pa.Array]:
        values = lists.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # nulls become NaN, -0 becomes 0
        there, raw, digests = lists.is_valid().to_numpy(zero_copy_only=False), [], []
        for ok, start, end in zip(there, lists.offsets.to_numpy()[:-1], lists.offsets.to_numpy()[1:], strict=True):
            v = values[start:end]
            raw.append(v.tobytes() if ok and v.any() and np.isfinite(v).all() else None)
            digests.append(xxhash.xxh3_128_digest(raw[-1] or b""))
        keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(raw, pa.binary())]

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if kind is np.float32 else "array<double>").alias("embedding"))
    return add_columns(rows, "embedding", pack, "k1 long, k2 long, v binary").drop("embedding")


def similar_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id) for every row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    rows = packed_vectors(vectors, kind)
    usable = rows.where("v is not null and vec_id is not null")
    distinct = scratch.write(usable.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "distinct")
    n, widest = distinct.agg(F.count("*"), F.max(F.length("v"))).first()
    few = max(1, min(SAMPLE, SAMPLE_BYTES // (widest or 1)))
    sample = [bytes(r["v"]) for r in distinct.orderBy(F.xxhash64("rep"), "k1").select("v").limit(few).collect()]
    lengths = [len(v) for v in sample]
    width = max(set(lengths), key=lambda x: (lengths.count(x), x)) if lengths else 0
    sample = [v for v in sample if len(v) == width]
    centres = spark.sparkContext.broadcast(fit_centres(unit(sample, kind), n, threshold) if sample else None)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = centres.value
        for batch in batches:
            usual = (batch["v"].map(len) == width).to_numpy()
            if usual.any():
                part = batch[usual]
                home, members = membership(unit(part["v"], kind), c, threshold)
                at, cell = np.nonzero(members)
                yield part.iloc[at].assign(cell=cell, home=home[at] == cell)
            if not usual.all():
                yield batch[~usual].assign(cell=-batch["v"][~usual].map(len), home=True)

    fields = "rep long, k1 long, copies long, v binary, cell int, home boolean"
    cells = distinct.select("rep", "k1", "copies", "v").mapInPandas(assign, fields)
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(256), F.lit(BLOCK_BYTES * np.dtype(kind).itemsize // 8) / F.max(F.length("v"))))
    sizes = scratch.write(cells.where("home").groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("hb")), "sizes")
    # one row a cell: no more than the sample has vectors per centre, and one per odd length
    sized = cells.join(F.broadcast(sizes), "cell").withColumn("own", F.pmod(F.xxhash64("rep", "k1"), "hb").cast("int"))
    every = F.sequence(F.lit(0), F.col("hb") - 1)
    ahead = F.transform(F.sequence(F.lit(0), F.floor(F.col("hb") / 2).cast("int")), lambda d: F.pmod(F.col("own") - d, F.col("hb")))
    # a block of a circle meets the next half; of two opposite ones, the smaller number meets the larger
    mine = F.filter(ahead, lambda i: (F.lit(2) * F.pmod(F.col("own") - i, F.col("hb")) < F.col("hb")) | (i <= F.col("own")))
    dealt = sized.withColumn("i", F.explode(F.when(F.col("home"), mine).otherwise(every)))
    dealt = dealt.withColumn("held", F.col("home") & (F.col("i") == F.col("own"))).select("cell", "i", "held", "rep", "k1", "copies", "v")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, block = None, [], None

        def opened() -> Block:
            made = Block(pd.concat(parts, ignore_index=True), kind, threshold)
            parts.clear()
            made.within()
            return made

        for batch in batches:
            for key, rows in batch.groupby(["cell", "i", "held"], sort=False):
                if key[:2] != at:
                    if parts:
                        block = opened()
                    if block is not None:
                        yield block.result()
                    at, block = key[:2], None
                if key[2]:
                    parts.append(rows)
                    continue
                if parts:
                    block = opened()
                if block is not None:
                    yield block.meet(rows)
        if parts:
            block = opened()
        if block is not None:
            yield block.result()

    held_first = dealt.repartition("cell", "i").sortWithinPartitions("cell", "i", F.col("held").desc())
    compared = scratch.write(held_first.mapInPandas(compare, "rep long, k1 long, n long, joint long"), "compared")
    comps = components(spark, scratch, compared.where("rep <> joint").select(F.col("rep").alias("a"), F.col("joint").alias("b")))
    counts = compared.groupBy("rep", "k1").agg(F.sum("n").alias("n"))
    classes = distinct.select("rep", "k1", "k2", "copies").join(counts, ["rep", "k1"], "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("comp", "rep").alias("comp"))
    with_class = rows.select("vec_id", "k1", "k2", (F.col("v").isNotNull() & F.col("vec_id").isNotNull()).alias("ok")).join(classes, ["k1", "k2"], "left")
    return with_class.select(
        "vec_id", F.when(F.col("ok"), F.col("n")).otherwise(0).cast("long").alias("n_links"), F.when(F.col("ok"), F.col("comp")).otherwise(F.col("vec_id")).alias("component_id")
    )


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
