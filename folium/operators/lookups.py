"""Small operators over library tables: rows of a key, newest rows, pages of rows, fallbacks, counts and orderings.

They are plain functions on DataFrames and Columns; the queries that use them sit beside the tables they belong to.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.session import shared_folder

# ---------------------------------------------------------------- rows of a key, newest rows, pages


def matching(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows that agree with a row of `keys` in all columns of `keys`; nulls agree with nothing."""
    return rows.join(keys, keys.columns, "left_semi").select(*rows.columns)


def first_rows(rows: DataFrame, order: list, n: int, skip: int = 0) -> DataFrame:
    """Rows skip to skip + n in an order; Spark keeps the best skip + n of each partition, so nothing is sorted whole."""
    ordered = rows.orderBy(*order)
    return (ordered.offset(skip) if skip else ordered).limit(n)


def first_by_rank(rows: DataFrame, tests: list[Column], order: list) -> DataFrame:
    """The row that passes the earliest test, ties by `order`; a row that passes none comes last."""
    rank = F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)], F.lit(len(tests)))
    return first_rows(rows, [rank, *order], 1)


def best_per_group(rows: DataFrame, by: list, order: list) -> DataFrame:
    """The first row of each group; the ranking stops early in each partition, so a hot group is not shuffled whole."""
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def containing(rows: DataFrame, needles: dict[str, str]) -> DataFrame:
    """Rows where one of the columns contains its needle, case ignored; nulls contain nothing."""
    hits = [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(n.lower())), F.lit(False)) for c, n in needles.items()]
    return rows.where(reduce(lambda a, b: a | b, hits))


def of_year(rows: DataFrame, at: str, year: str) -> DataFrame:
    """Rows of a year that is given as text."""
    return rows.where(F.year(at).cast("string") == year)


def latest_sessions(sessions: DataFrame, document: str, at: str, tie: str, state: str) -> DataFrame:
    """The newest session of each document, unless its state is one of the words that stand for nothing."""
    newest = best_per_group(sessions, [document], [F.desc(at), F.desc(tie)])
    return newest.where(~F.lower(state).isin("none", "null"))


def to_retry(rows: DataFrame, done: Column, tries: Column, most: int = 3) -> DataFrame:
    return rows.where(~done & (tries < most))


def history(messages: DataFrame, question: Column | None = None) -> DataFrame:
    """Messages without those of the system and, where a question is given, without the user's that equal it."""
    kept = messages.where(F.col("role") != "system")
    return kept if question is None else kept.where(~((F.col("role") == "user") & (F.trim("text") == question)))


# ---------------------------------------------------------------- fallbacks and unions


def look_up_first(rows: DataFrame, lookups: list[tuple[DataFrame, Column, str]], out: str, default: Column | None = None, own: Column | None = None) -> DataFrame:
    """`out` is `own` where it is there, else the value of the first table that has one, else the default.

    A lookup is (table with a unique `key`, the row's column or expression for it, name of the table's value)."""
    values = [] if own is None else [own]
    for i, (found, key, value) in enumerate(lookups):
        side = found.select(F.col("key").alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        rows = rows.join(side, key == F.col(f"__k{i}"), "left")
        values.append(F.col(f"__v{i}"))
    rows = rows.withColumn(out, F.coalesce(*values, *([] if default is None else [default])))
    return rows.drop(*[f"__{c}{i}" for c in "kv" for i in range(len(lookups))])


def with_exists(rows: DataFrame, others: DataFrame, key: str, other_key: str, out: str) -> DataFrame:
    there = others.select(F.col(other_key).alias("__k")).distinct()
    return rows.join(there, F.col(key) == F.col("__k"), "left").withColumn(out, F.col("__k").isNotNull()).drop("__k")


def get_or_compute(rows: DataFrame, saved: DataFrame, key: str, value: str, compute: Column) -> DataFrame:
    """Saved values, and computed ones for the keys without; `origin` tells which."""
    missing = rows.join(saved.select(key), key, "left_anti")
    return saved.select(key, F.col(value).alias("v"), F.lit("saved").alias("origin")).unionByName(missing.select(key, compute.alias("v"), F.lit("computed").alias("origin")))


def with_previous(rows: DataFrame, group: str, order: str, value: Column, asks_back: Column, out: str) -> DataFrame:
    """A row that asks back takes the value of the row just before it, else (and where that has none) its own."""
    w = Window.partitionBy(group).orderBy(order)
    before = F.when(F.lag(order).over(w) == F.col(order) - 1, F.lag(value).over(w))
    return rows.withColumn(out, F.coalesce(F.when(asks_back, before), value))


def union_of_stores(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both; columns that one has not are null there."""
    return first.unionByName(second, allowMissingColumns=True)


def roles_of_nodes(id: str, **parts: DataFrame) -> DataFrame:
    """One row (id, role) per node: the first part, in the order given, that the node is in names its role."""
    ranked = [p.select(F.col(id).alias("id"), F.struct(F.lit(i).alias("rank"), F.lit(name).alias("role")).alias("r")) for i, (name, p) in enumerate(parts.items())]
    return reduce(DataFrame.unionByName, ranked).groupBy("id").agg(F.min("r").alias("r")).select("id", F.col("r.role").alias("role"))


# ---------------------------------------------------------------- counts


def counts_per(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def count_where(rows: DataFrame, total: str, **tests: Column) -> DataFrame:
    """One row: how many rows there are, and how many pass each test."""
    return rows.agg(F.count("*").alias(total), *[F.count(F.when(t, 1)).alias(name) for name, t in tests.items()])


def largest_groups(rows: DataFrame, by: str, n: int) -> DataFrame:
    return first_rows(counts_per(rows, by), [F.desc("n"), by], n)


def session_list(messages: DataFrame, session: str, at: str) -> DataFrame:
    return messages.groupBy(session).agg(F.count("*").alias("n"), F.max(at).alias("updated"))


# ---------------------------------------------------------------- orderings


def ranked_in_groups(rows: DataFrame, by: str, order: list) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))


def numbered(rows: DataFrame, order: list[str], out: str = "n") -> DataFrame:
    """Rows with their place from 1 on in ascending order (nulls first), without one task that sorts them all.

    Rows are dealt to ranges of the order and written, so that both uses see the same ranges; each range is numbered on its own
    behind the counts of those before, of which there is one a range. Rows that agree in all of `order` share a range, so
    its last column should tell them apart.
    """
    path = f"{shared_folder(rows.sparkSession)}/numbered-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    dealt.write.option("compression", "zstd").parquet(path)
    dealt = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__rows"))
    before = sizes.select("__range", (F.sum("__rows").over(Window.orderBy("__range")) - F.col("__rows")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(F.broadcast(before), "__range").withColumn(out, (F.col("__before") + place).cast("long")).select(*rows.columns, out)


# ---------------------------------------------------------------- responses and rules


def document_response(documents: DataFrame, id: str, title: str) -> DataFrame:
    return documents.select(F.col(id).alias("id"), F.coalesce(title, F.lit("Unknown")).alias("title"), F.concat(F.lit("/documents/"), id, F.lit("/file")).alias("url"))


def key_tests(id: Column, title: Column, name: Column, key: str) -> list[Column]:
    """The tests of a key in their order: id, exact title, part of the name."""
    return [id.cast("string") == key, title == key, F.contains(F.lower(name), F.lit(key.lower()))]


def rect_to_viewport(x: Column, y: Column, scale: float, height: float) -> tuple[Column, Column]:
    """Points of a page from its lower left to pixels from the upper left."""
    return x * scale, height - y * scale


def box_to_pixels(x: Column, y: Column, width: float, height: float) -> tuple[Column, Column]:
    return F.round(x * width, 4), F.round(y * height, 4)


def side_of(x: Column, middle: float) -> Column:
    return F.when(x < middle, 1).otherwise(2)


def line_height(heights: Column, least: float = 8.0, default: float = 12.0) -> Column:
    """Mean of the heights between 0 and 100, an aggregate; the default where there is none."""
    return F.greatest(F.lit(least), F.coalesce(F.avg(F.when((heights > 0) & (heights < 100), heights)), F.lit(default)))


def char_width(width: Column, text: Column, least: float = 3.0, default: float = 6.0) -> Column:
    """Mean width of a character of the items that have text and a width, an aggregate; the default where there is none."""
    each = F.when((F.length(text) > 0) & (width != 0), width / F.length(text))
    return F.greatest(F.lit(least), F.coalesce(F.avg(each), F.lit(default)))


def vertical_threshold(height: Column, page_height: float) -> Column:
    """Ten lines, an eighth of the page or so, or 60."""
    return F.round(F.greatest(height * 10, F.lit(0.12 * page_height), F.lit(60.0))).cast("long")


def horizontal_threshold(width: Column, page_width: float) -> Column:
    """Five characters, a little of the page, or 20."""
    return F.round(F.greatest(width * 5, F.lit(0.03 * page_width), F.lit(20.0))).cast("long")


def sections_of_chunks(chunks: DataFrame, title: str, order: str, text: str) -> DataFrame:
    named = F.coalesce(title, F.lit("none")).alias("title")
    return chunks.groupBy(named).agg(F.min(order).alias("first"), F.sum(F.length(text)).cast("long").alias("chars"), F.count("*").alias("n"))


def creation_year(date: Column) -> Column:
    """Year of a date like D:20210506, else its first four characters."""
    return F.when(date.startswith("D:"), F.substring(date, 3, 4)).otherwise(F.substring(date, 1, 4))


def year_of_date(date: Column) -> Column:
    return F.split_part(date, F.lit("-"), F.lit(1))


def known(value: Column) -> Column:
    return F.coalesce(value, F.lit("Unknown"))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt(F.pow(x1 - x0, F.lit(2)) + F.pow(y1 - y0, F.lit(2)))


def rounded_box(**edges: Column) -> list[Column]:
    return [F.round(value, 4).alias(name) for name, value in edges.items()]


def clean_arxiv_id(id: Column) -> Column:
    return F.trim(F.regexp_replace(id, "^arXiv:", ""))


def best_pdf_link(arxiv_id: Column, open_access: Column, doi: Column, landing: Column) -> Column:
    return F.coalesce(F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_id), open_access, F.concat(F.lit("https://doi.org/"), doi), landing)


def confidence_of_distance(d: Column) -> Column:
    return F.when(d < 10, 0.9).otherwise(0.5)


def pseudo_count(score: Column) -> Column:
    return F.floor(score * 100 + 0.5)
