"""Mixing sources to target weights, in DataFrame operations only.

Tokens are aggregated per source, targets follow from the weights, and a source's repetition rate is its target over
its size. Every document is then emitted floor(rate) times, and once more if a number in [0, 1) hashed from the seed
and its doc_id is below the fraction: the same copies on every run, at any partitioning, with no shuffle of texts.

Cases: a null or empty text has size 0 and takes part in its source's rate without weight; a null source is a source
of its own, ordered last; rows that repeat a doc_id share its draw; an empty table gives an empty result; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.llm.common import WORD, Scratch, columns_of, fresh, table

#: Rates are joined by broadcast up to so many sources (about 10 MB); beyond, by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    The excess over max_repeat times a source's size goes to the others by weight until none is above. The fixed point
    is a water level: with sources in the order of cap / weight, those before the first one whose share at the level
    fits below its cap are capped. The windows run over one row a source, never over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    ranked = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_repeat)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / weight_left).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    first = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(every)
    return level.withColumn("water", first["level"]).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("water") * F.col("w")).alias("target")
    )


def copies(doc_id: Column, rate: Column, seed: str) -> Column:
    """floor(rate), and one more where the hash of seed and doc_id is below the fraction."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3, seed: str = "mix", text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs with a last column, named by mix_column(docs): a struct (size, source_size, target, copies)."""
    spark = docs.sparkSession
    sizes = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rates = Scratch(spark, "mix").write(source_targets(sizes, weights, max_repeat), "rates")
    n, s, t, mix = (fresh(name, docs) for name in ("n", "s", "t", "mix"))
    rates = rates.select(F.col("source").alias(s), F.struct("source_size", "target").alias(t))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = docs.withColumn(n, word_count(F.col(text))).join(rates, F.col(source).eqNullSafe(F.col(s)))
    of_source, wanted = F.col(t)["source_size"], F.col(t)["target"]
    rate = F.when(of_source > 0, F.least(F.lit(float(max_repeat)), wanted / of_source)).otherwise(0.0)
    planned = F.struct(F.col(n).alias("size"), of_source.alias("source_size"), wanted.alias("target"), copies(F.col(doc_id), rate, seed).alias("copies"))
    return joined.select(*columns_of(docs), planned.alias(mix))


def mix_column(docs: DataFrame) -> str:
    return fresh("mix", docs)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as the plan says."""
    n, number = F.col(mix_column(docs))["copies"], fresh("copy", docs)
    planned = plan_mix(docs, **options)
    return planned.where(n > 0).select(*columns_of(docs), F.explode(F.sequence(F.lit(1), n)).alias(number)).select(*columns_of(docs))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    m = F.col(mix_column(docs))
    return plan_mix(docs).select(
        "doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * m["copies"]).alias("taken")
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 3 AS cap FROM s
), l AS (
  SELECT *, cap / w AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r
), f AS (
  SELECT level AS water FROM l WHERE level * w <= cap ORDER BY ratio, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, water * w) AS target FROM l, f
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, t.target / t.source_size) ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
