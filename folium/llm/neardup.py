"""MinHash near-duplicate groups with sequential Bayesian verification.

A document's set holds the hashes of its runs of five words. Two sets link from `percent` of Jaccard similarity on: 85 in
`op6_neardup`, 80 in the pipeline; at these, all bands miss a pair with a chance of about 8e-7 and 7e-5. Documents with
equal word sequences are one class, met by a 128-bit digest; its smallest doc_id stands for it from here on. Signatures of the representatives are cut into bands;
representatives that share a band's bucket are candidates. A candidate pair is first compared on batches of its two
signatures: after each batch the posterior of the similarity (uniform prior) decides, and the pair is dropped once the
chance of reaching the threshold is below MISS. What survives is verified exactly, on the full sets.

Only components are asked for, so not every pair of a large group is needed. First every representative is compared
with one pivot, the smallest representative in any of its buckets. Then, in buckets that still hold several components,
those outside the bucket's largest component are compared with that component and with each other, block against block.
Blocks hold signatures and sets, bounded in number and in bytes; a block gives one confirmed link per document and
component, not the pairs. Pairs inside one component are already joined. Nothing is capped or sampled.

Cases: texts without words have an empty set and link with nothing; fewer than five words are one shingle; a null
doc_id links with nothing and is kept; rows that repeat a doc_id are one vertex with the links of each in
`near_duplicate_groups`, and documents of their own in `drop_near_duplicates`; an empty table gives an empty result; other
columns are only carried by `drop_near_duplicates`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import Scratch, add_columns, by_ids, columns_of, components, fresh, map_groups, table, utf8, words_of

SHINGLE = 5
#: The similarity of op6_neardup, in percent.
PERCENT = 85
BANDS, ROWS, BATCH = 24, 5, 24
HASHES = BANDS * ROWS
#: The chance at which a batch may drop a pair that does reach the threshold.
MISS = 1e-5
#: Rows of a block on either side of a comparison, and bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 16_000_000

_RANDOM = np.random.default_rng(20240501)
MULTIPLY = (_RANDOM.integers(0, 1 << 32, HASHES, np.uint32) | 1).astype(np.uint32)
ADD = _RANDOM.integers(0, 1 << 32, HASHES, np.uint32).astype(np.uint32)
BAND_MULTIPLY = _RANDOM.integers(0, 1 << 63, ROWS, np.int64).astype(np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalising mix of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the runs of n words, sorted; the whole sequence if it is shorter."""
    if not words:
        return np.array([], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    runs = max(1, len(words) - n + 1)
    h = np.full(runs, len(words) if len(words) < n else n, np.uint64)
    for i in range(min(n, len(words))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + each[i : i + runs]
    return np.unique(mixed(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each hash over the set."""
    x, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        least = np.minimum(least, (x[at : at + 512, None] * MULTIPLY + ADD).min(axis=0))
    return least


def fewest_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """By number of hashes compared: the fewest matches with which a pair goes on.

    With a uniform prior, k matches of n make the similarity Beta(k + 1, n - k + 1), and its chance of reaching t is that
    of at most k successes in n + 1 trials at t.
    """
    out = np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        chance, k = 0.0, -1
        while chance < miss:
            k += 1
            chance += math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
        out[n] = k
    return out


def survives(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices stay candidates, batch after batch."""
    rows, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for at in range(0, HASHES, BATCH):
        matches = matches + (a[rows, at : at + BATCH] == b[rows, at : at + BATCH]).sum(axis=1)
        keep = matches >= least[min(at + BATCH, HASHES)]
        rows, matches = rows[keep], matches[keep]
    return rows


def unpack(column: pd.Series | np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, HASHES)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig) from (doc_id, text); k1, k2 digest the word sequence."""

    def sketch(texts: pa.Array) -> list[pa.Array]:
        n, digests, sigs = [], [], []
        for text in texts:
            words = words_of(utf8(text.as_py()))
            shingles = shingle_set(words)
            n.append(len(shingles))
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            sigs.append(signature(shingles).tobytes() if len(shingles) else None)
        keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return [pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sigs, pa.binary())]

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return add_columns(rows, "text", sketch, "n_shingles long, k1 long, k2 long, sig binary").drop("text")


def banded(reps: DataFrame) -> DataFrame:
    """(bucket, rep) for each band of each representative."""

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                parts = unpack(batch["sig"]).reshape(-1, BANDS, ROWS).astype(np.uint64)
                h = mixed((parts * BAND_MULTIPLY).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pd.DataFrame({"bucket": h.view(np.int64).ravel(), "rep": np.repeat(batch["rep"].to_numpy(), BANDS)})

    return reps.mapInPandas(bands, "bucket long, rep long")


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the signatures don't rule out."""
    least = fewest_matches(percent / 100)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.iloc[survives(unpack(batch["sa"]), unpack(batch["sb"]), least)][["a", "b"]]

    with_a = pairs.join(reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
    with_b = with_a.join(reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    return with_b.select("a", "b", "sa", "sb").mapInPandas(judge, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, s): the full sets of the documents with these ids (distinct, in doc_id), made again from their texts."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["doc_id"], "s": [shingle_set(words_of(utf8(t))).tobytes() for t in batch["text"]]})

    wanted = scratch.write(ids, "ids")
    texts = by_ids(docs.select(F.col("doc_id").cast("long"), "text"), wanted, "doc_id", "left_semi")
    return scratch.write(texts.mapInPandas(make, "id long, s binary"), "sets")


def linked(x: bytes, y: bytes, percent: int) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, docs: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The pairs (a written table) whose full sets are similar enough."""
    sets = full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), scratch)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[linked(x, y, percent) for x, y in zip(batch["sa"], batch["sb"], strict=True)], ["a", "b"]]

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    links = scratch.write(with_b.select("a", "b", "sa", "sb").mapInPandas(check, "a long, b long"), "confirmed")
    scratch.drop(sets)
    return links


def blocks_for() -> Column:
    """How many blocks the rows (with n, the sizes of their sets) of a group need."""
    return F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.col("n") * 8) / BLOCK_BYTES)).cast("int")


def across(buckets: DataFrame, comps: DataFrame, reps: DataFrame, docs: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Confirmed links (a, b) between different components that share a bucket; one at least per pair of them that has any."""
    least = fewest_matches(percent / 100)
    members = buckets.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("comp", "rep").alias("comp"))
    sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    several = sizes.groupBy("bucket").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("n_comps")
    ).where("n_comps > 1")
    minors = scratch.write(members.join(several, "bucket").where("comp <> main"), "minors")

    # a minor and the whole main component, once, in however many buckets they meet
    sizes = reps.select("rep", "n")
    with_main = scratch.write(minors.select("rep", "comp", "main").distinct().join(sizes, "rep"), "with-main")
    mains = with_main.select(F.col("main").alias("comp")).distinct()
    of_main = comps.select(F.col("id").alias("rep"), "comp").join(mains, "comp").union(
        reps.select("rep", F.col("rep").alias("comp")).join(mains, "comp").join(comps.select(F.col("id").alias("rep")), "rep", "left_anti").select("rep", "comp")
    )
    of_main = scratch.write(of_main.join(sizes, "rep").select("rep", "comp", "n"), "of-main")
    dealt = of_main.groupBy("comp").agg(blocks_for().alias("nj")).join(with_main.groupBy(F.col("main").alias("comp")).agg(blocks_for().alias("ni")), "comp")
    each_i, each_j = F.explode(F.sequence(F.lit(0), F.col("ni") - 1)), F.explode(F.sequence(F.lit(0), F.col("nj") - 1))
    # -1 - i tells these blocks from those of a bucket
    right = of_main.join(dealt, "comp").withColumn("i", each_i)
    right = right.select(F.col("comp").alias("cell"), (-1 - F.col("i")).alias("i"), F.pmod(F.xxhash64("rep"), "nj").cast("int").alias("j"), F.lit(False).alias("is_left"), "rep", "comp")
    left = with_main.join(dealt.withColumnRenamed("comp", "main"), "main").withColumn("j", each_j)
    left = left.select(F.col("main").alias("cell"), (-1 - F.pmod(F.xxhash64("rep"), "ni")).cast("int").alias("i"), "j", F.lit(True).alias("is_left"), "rep", "comp")

    # minors of a bucket with each other, block against block
    several_minors = minors.where("n_comps > 2").select("bucket", "rep", "comp").join(sizes, "rep")
    many = several_minors.join(several_minors.groupBy("bucket").agg(blocks_for().alias("nb")), "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), "nb").cast("int"))
    every = F.sequence(F.lit(0), F.col("nb") - 1)
    low = many.withColumn("o", F.explode(F.filter(every, lambda b: b >= F.col("own")))).select(F.col("bucket").alias("cell"), F.col("own").alias("i"), F.col("o").alias("j"), F.lit(True).alias("is_left"), "rep", "comp")
    high = many.withColumn("o", F.explode(F.filter(every, lambda b: b <= F.col("own")))).select(F.col("bucket").alias("cell"), F.col("o").alias("i"), F.col("own").alias("j"), F.lit(False).alias("is_left"), "rep", "comp")
    cells = scratch.write(left.union(right).union(low).union(high), "cells")
    if cells.isEmpty():
        return cells.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    sets = full_sets(docs, cells.select(F.col("rep").alias("doc_id")).distinct(), scratch)
    loaded = cells.join(reps.select("rep", "sig"), "rep").join(sets.withColumnRenamed("id", "rep"), "rep")

    def compare(block: dict[str, np.ndarray]) -> list[tuple]:
        found, here = [], block["is_left"].astype(bool)
        if not here.any() or here.all():
            return found
        sigs, rep, comp, own = unpack(block["sig"]), block["rep"], block["comp"], block["s"]
        right = np.flatnonzero(~here)
        for i in np.flatnonzero(here):
            at = right[comp[right] != comp[i]]
            at = at[survives(np.broadcast_to(sigs[i], (len(at), HASHES)), sigs[at], least)]
            at = at[np.argsort(-(sigs[at] == sigs[i]).sum(axis=1), kind="stable")]
            joined = set()
            for j in at:
                if comp[j] not in joined and linked(own[i], own[j], percent):
                    joined.add(comp[j])
                    found.append((int(rep[i]), int(rep[j])))
        return found

    return map_groups(loaded, ["cell", "i", "j"], compare, "a long, b long").distinct()


def near_duplicate_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    rows = scratch.write(sketches(docs), "sketches")
    sets = rows.where("n_shingles > 0 and doc_id is not null")
    classes = sets.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    reps = scratch.write(
        sets.select("doc_id", "k1", "k2", "sig", F.col("n_shingles").alias("n")).join(classes, ["k1", "k2"]).where("doc_id = rep").dropDuplicates(["rep", "k1", "k2"]).select("rep", "sig", "n"),
        "representatives",
    )
    buckets = banded(reps)
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("bucket", "pivot")
    buckets = scratch.write(buckets.join(shared, "bucket"), "buckets")

    pairs = buckets.groupBy("rep").agg(F.min("pivot").alias("b")).where("rep <> b").select(F.col("rep").alias("a"), "b")
    links = confirmed(scratch.write(likely(pairs, reps, percent), "first-candidates"), docs, scratch, percent)
    comps = scratch.write(components(spark, scratch, links), "first-components")
    more = scratch.write(across(buckets.select("bucket", "rep"), comps, reps, docs, scratch, percent), "cross-links")
    if not more.isEmpty():
        comps = scratch.write(components(spark, scratch, links.union(more)), "components")

    stands_for = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("comp", "rep").alias("component_id"))
    found = rows.select("doc_id", "n_shingles", "k1", "k2").join(stands_for, ["k1", "k2"], "left")
    # rows that repeat a doc_id with other texts belong to the smallest of their components
    alone = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    scratch.drop(buckets, reps)
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group, that of its smallest doc_id; rows without words or doc_id stay.

    Where doc_ids repeat, rows with other texts are documents of their own, told apart by a 64-bit hash of doc_id and text;
    of rows that agree in both, the first by all columns stays.
    """
    spark, columns = docs.sparkSession, columns_of(docs)
    scratch, own = Scratch(spark, "dedup"), F.col("doc_id").cast("long")
    repeats = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeats.isEmpty():
        groups = near_duplicate_groups(docs.select("doc_id", "text"), percent)
        gone = scratch.write(groups.where("doc_id <> component_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "gone")
        return by_ids(docs, gone, "doc_id", "left_anti").select(*columns)
    vertex, inner = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")), fresh("vertex", docs)
    groups = scratch.write(near_duplicate_groups(docs.select(vertex.alias("doc_id"), "text"), percent).where("n_shingles > 0 and doc_id is not null"), "groups")
    named = docs.select(vertex.alias("v"), own.alias("d")).where("v is not null").distinct().join(groups.select(F.col("doc_id").alias("v"), "component_id").distinct(), "v")
    first = named.groupBy("component_id").agg(F.min(F.struct("d", "v"))["v"].alias(inner))
    counted = groups.groupBy(F.col("doc_id").alias(inner)).agg(F.count("*").alias("n"))
    once, several = (scratch.write(first.join(counted.where(c), inner).select(inner), name) for c, name in (("n = 1", "once"), ("n > 1", "several")))
    dropped = scratch.write(groups.select(F.col("doc_id").alias(inner)).distinct().join(once, inner, "left_anti"), "gone")
    with_vertex = docs.withColumn(inner, vertex)
    # rows without a vertex are no match for any id, so they stay
    kept = by_ids(with_vertex, dropped, inner, "left_anti").select(*columns)
    row = F.struct(*columns)
    firsts = by_ids(with_vertex, several, inner, "left_semi").groupBy(inner).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return kept.unionByName(firsts.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), PERCENT)
    return groups.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
