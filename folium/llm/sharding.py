"""Sharding by sampled splitters, in DataFrame operations only.

The sort key of a row is (hash of the text, hash of the doc_id, position in the written key table), so equal texts are
neighbours. Keys are drawn with a chance in proportion to the bytes of their group (rows of one text hash); the drawn hashes
split the key space into fine ranges, which are measured exactly. Ranges above the limit are subdivided by further drawn
splitters until none is above: first between groups, then inside the groups that are larger than the limit, on the whole
key. Ranges are dealt to shards, the largest first, each to the emptiest shard, so that shards come out near equal (law
`bytes`). The ranges of one group of equal texts are dealt together, unless the group is larger than a shard.

Only splitters and one measure per range reach the driver: about 8 MAX_RANGES at most, whatever the input. The place
in a shard is the range's offset and the rank in the range, so no task sorts a whole shard.

Cases: a null text counts 16 bytes and hashes as itself; repeated rows differ in the key's third part, and only which of them
goes where may change between reruns; one row larger than a shard fills a shard; fewer rows than shards leave shards empty;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.llm.common import Scratch, int_array, number_array, table

#: Fine ranges per shard at least, rows per range aimed at, and the most ranges aimed at.
RANGES_PER_SHARD, ROWS_PER_RANGE, MAX_RANGES = 128, 250_000, 1 << 13
#: An overfull range gets about so many splitters for each time the limit fits into it.
MORE = 4

Key = tuple[int, int, int]
LOWEST = -(1 << 63)
HIGHEST = (1 << 63) - 1


def range_of(splitters: list[Key]) -> Column:
    """How many splitters are at or below the key: a binary search over constant arrays."""
    if not splitters:
        return F.lit(0)
    parts = [int_array([s[i] for s in splitters]) for i in range(3)]
    steps, step = [], 1
    while step <= len(splitters):
        steps.insert(0, step)
        step *= 2

    def at_or_above(i: Column) -> Column:
        b1, b2, b3 = (F.element_at(p, i) for p in parts)
        k1, k2, k3 = F.col("k1"), F.col("k2"), F.col("k3")
        return (k1 > b1) | ((k1 == b1) & ((k2 > b2) | ((k2 == b2) & (k3 >= b3))))

    def advance(found: Column, step: Column) -> Column:
        ahead = (found + step).cast("int")
        return F.when(ahead > len(splitters), found).when(at_or_above(F.least(ahead, F.lit(len(splitters)))), ahead).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def drawn(*keys: Column | str | int) -> Column:
    """A number in [0, 1) hashed from the keys."""
    return F.pmod(F.xxhash64(*[F.lit(k) if isinstance(k, int) else k for k in keys]), F.lit(1 << 40)) / F.lit(float(1 << 40))


def around(k1: int) -> list[Key]:
    """Splitters before and after a group."""
    return [(k1, LOWEST, LOWEST), *([(k1 + 1, LOWEST, LOWEST)] if k1 < HIGHEST else [])]


def per_range(where: Column, values: dict[int, float], count: int) -> Column:
    return F.element_at(number_array([float(values.get(r, 0.0)) for r in range(count)]), (where + 1).cast("int"))


def between_groups(groups: DataFrame, total: int, limit: float) -> list[Key]:
    """Splitters at group borders, so that no range of several groups is above the limit."""
    as_keys = groups.select("k1", F.lit(LOWEST).alias("k2"), F.lit(LOWEST).alias("k3"), "b")
    first = groups.where(drawn(0, "k1") < F.col("b") * F.lit(2 / limit)).select("k1", "b").collect()
    splitters = sorted({s for r in first for s in (around(r["k1"]) if 2 * r["b"] > limit else [(r["k1"], LOWEST, LOWEST)])})
    step = 0
    while True:
        at = range_of(splitters)
        over = as_keys.groupBy(at.alias("r")).agg(F.sum("b").alias("b"), F.count("*").alias("n")).where((F.col("b") > limit) & (F.col("n") > 1)).collect()
        if not over:
            return splitters
        step += 1
        chance = F.col("b") * per_range(at, {r["r"]: MORE / limit for r in over}, len(splitters) + 1)
        splitters = sorted({*splitters, *(s for r in as_keys.where(drawn(step, "k1") < chance).select("k1").collect() for s in around(r["k1"]))})


def inside_groups(keys: DataFrame, large: DataFrame, limit: float) -> list[Key]:
    """Splitters inside the groups above the limit, on the whole key, so that each range is below it or a single row."""
    rows = keys.join(F.broadcast(large), "k1", "left_semi")  # fewer groups than limits fit into all bytes
    splitters, step = [], 0
    while True:
        at = range_of(splitters)
        over = rows.groupBy("k1", at.alias("r")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("b") > limit) & (F.col("n") > 1)).collect()
        if not over:
            return splitters
        step += 1
        chance = F.col("size") * per_range(at, {r["r"]: MORE / limit for r in over}, len(splitters) + 1)
        more = rows.where(drawn(-step, "k1", "k2", "k3") < chance).select("k1", "k2", "k3").collect()
        splitters = sorted({*splitters, *((r["k1"], r["k2"], r["k3"]) for r in more)})


def plan_ranges(keys: DataFrame, shards: int, scratch: Scratch) -> tuple[list[Key], dict[int, tuple[int, int]]]:
    """Splitters in key order, and the bytes and rows of each range between them that has rows."""
    groups = scratch.write(keys.groupBy("k1").agg(F.sum("size").alias("b"), F.count("*").alias("n")), "groups")
    total, rows = groups.agg(F.sum("b"), F.sum("n")).first()
    if not rows:
        return [], {}
    limit = 2 * total / min(MAX_RANGES, max(shards * RANGES_PER_SHARD, rows // ROWS_PER_RANGE))
    splitters = between_groups(groups, total, limit)
    large = groups.where((F.col("b") > limit) & (F.col("n") > 1)).select("k1")
    inner = inside_groups(keys, large, limit) if not large.isEmpty() else []
    if inner:
        splitters = sorted({*splitters, *inner, *(s for k1 in {k[0] for k in inner} for s in around(k1))})
    scratch.drop(groups)
    measured = keys.groupBy(range_of(splitters).alias("r")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return splitters, {r["r"]: (r["b"], r["n"]) for r in measured}


def deal(splitters: list[Key], sizes: dict[int, tuple[int, int]], shards: int) -> list[int]:
    """The shard of each range: the largest first, each to the emptiest; ranges inside a group go together while they fit."""
    room = sum(b for b, _ in sizes.values()) / shards
    items: list[list[int]] = []
    for r in range(len(splitters) + 1):
        inside = r > 0 and splitters[r - 1][1:] != (LOWEST, LOWEST)
        if inside:
            items[-1].append(r)
        else:
            items.append([r])
    weight = {r: b for r, (b, _) in sizes.items()}
    whole = [item for item in items if sum(weight.get(r, 0) for r in item) <= room]
    whole += [[r] for item in items if sum(weight.get(r, 0) for r in item) > room for r in item]
    heap, shard_of = [(0, shard) for shard in range(shards)], [0] * (len(splitters) + 1)
    for item in sorted(whole, key=lambda item: (-sum(weight.get(r, 0) for r in item), item)):
        filled, shard = heapq.heappop(heap)
        for r in item:
            shard_of[r] = shard
        heapq.heappush(heap, (filled + sum(weight.get(r, 0) for r in item), shard))
    return shard_of


def shard_rows(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs."""
    scratch, body = Scratch(docs.sparkSession, "shards"), F.col(text)
    keys = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("k1"),
        F.xxhash64(F.col(doc_id)).alias("k2"),
        F.monotonically_increasing_id().alias("k3"),
    )
    keys = scratch.write(keys, "keys")
    splitters, sizes = plan_ranges(keys, shards, scratch)
    shard_of, base_of, rows_in = deal(splitters, sizes, shards), [0] * (len(splitters) + 1), [0] * shards
    for r in range(len(splitters) + 1):
        base_of[r] = rows_in[shard_of[r]]
        rows_in[shard_of[r]] += sizes.get(r, (0, 0))[1]
    ranged = keys.withColumn("r", range_of(splitters))
    place = F.row_number().over(Window.partitionBy("r").orderBy("k1", "k2", "k3")) - 1
    at = (F.col("r") + 1).cast("int")
    return ranged.select(
        "doc_id", "size", "text_crc32", F.element_at(int_array(shard_of), at).cast("int").alias("shard"), (F.element_at(int_array(base_of), at) + place).cast("long").alias("slot")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
