"""Page layout: line statistics, grouping of text items to lines and columns, overlaps.

Statistics are aggregates and windows per page. Folds that depend on order (items to lines, x clusters) run on one page's
items at a time, which is bounded by the page.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from folium.functions import text as T
from folium.operators import lookups as L
from folium.operators.grid import uncovered
from folium.operators.grouped import dealt, fold_groups, walk
from folium.plans.registry import query
from folium.session import table


def position_statistics(lines: DataFrame, by: list[str], x: str) -> DataFrame:
    """Mean, upper median, population deviation, quartiles by index floor(n p), least and most."""
    s = F.array_sort(F.collect_list(x))

    def at(p: float) -> Column:
        return F.element_at("__s", (F.floor(F.size("__s") * p) + 1).cast("int"))

    g = lines.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), s.alias("__s"), F.min(x).alias("least"), F.max(x).alias("most"))
    return g.select(*by, "mean", "std", at(0.5).alias("median"), at(0.25).alias("q1"), at(0.75).alias("q3"), "least", "most")


def without_outliers(lines: DataFrame, by: list[str], x: str, reach: float = 1.5) -> DataFrame:
    """Lines within reach times the quartile distance of the quartiles of their group."""
    s = position_statistics(lines, by, x)
    iqr = F.col("q3") - F.col("q1")
    return lines.join(s.select(*by, (F.col("q1") - reach * iqr).alias("__lo"), (F.col("q3") + reach * iqr).alias("__hi")), by).where(F.col(x).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


# Words that make a line with a number no reference, and lines that are headings by themselves.
NUMBERED_LABELS = ["figure", "table", "equation", "chapter", "section"]
PLAIN_HEADINGS = ["abstract", "introduction", "conclusion", "discussion", "results"]


def is_page_furniture(text: Column, shortest: int = 10, word: int = 15) -> Column:
    """Whether a line is too short to be a reference, a page number, a numbered label, a heading or one short word."""
    line = T.strip(F.coalesce(text, F.lit("")))
    words = T.word_list(F.lower(line))
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    digits = lambda w: w.rlike("^[0-9]+$")
    tail = F.when(first == "page", F.slice(words, 2, 4)).otherwise(words)
    numbered = digits(F.get(tail, F.lit(0))) & ((F.size(tail) == 1) | ((F.size(tail) == 3) & (F.get(tail, F.lit(1)) == "of") & digits(F.get(tail, F.lit(2)))))
    labelled = first.isin(NUMBERED_LABELS) & second.rlike("^[0-9]")
    alone = (F.size(words) == 1) & ((F.length(line) < word) | first.isin(PLAIN_HEADINGS))
    return (F.length(line) < shortest) | F.coalesce(numbered, F.lit(False)) | F.coalesce(labelled, F.lit(False)) | F.coalesce(alone, F.lit(False))


def reference_lines(lines: DataFrame, by: list[str], x: str, y: str, text: str, x_reach: float = 1.5, y_reach: float = 2.0) -> DataFrame:
    """Lines that are no outliers of their group: x and y within so many quartile distances of their quartiles, and no page furniture.

    A line without a place counts as at 0, and has no part in the quartiles."""
    bounds = {}
    for name, column, reach in (("x", x, x_reach), ("y", y, y_reach)):
        s = position_statistics(lines.where(F.col(column).isNotNull()), by, column)
        far = (F.col("q3") - F.col("q1")) * reach
        bounds[name] = s.select(*by, (F.col("q1") - far).alias(f"__{name}_lo"), (F.col("q3") + far).alias(f"__{name}_hi"))
    near = lines.join(bounds["x"], by, "left").join(bounds["y"], by, "left")
    inside = [F.coalesce(F.coalesce(F.col(c), F.lit(0)).between(F.col(f"__{n}_lo"), F.col(f"__{n}_hi")), F.lit(True)) for n, c in (("x", x), ("y", y))]
    return near.where(inside[0] & inside[1] & ~is_page_furniture(F.col(text))).select(*[lines[c] for c in lines.columns])


def most_common(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; the one seen first wins a tie, the larger one if they were seen together."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*by).agg(F.max(F.struct("n", (-F.col("first")).alias("f"), value)).alias("m")).select(*by, F.col(f"m.{value}").alias(value), "m.n")


def line_spacing(lines: DataFrame, page: str, order: str, y: str, default: float = 12.0) -> DataFrame:
    dy = F.abs(F.col(y) - F.lag(y).over(Window.partitionBy(page).orderBy(order)))
    gaps = lines.withColumn("__d", dy)
    return gaps.groupBy(page).agg(F.coalesce(F.avg(F.when((F.col("__d") > 0) & (F.col("__d") < 50), F.col("__d"))), F.lit(default)).alias("spacing"))


def isolated(lines: DataFrame, page: str, order: str, y: str, factor: float = 1.5) -> DataFrame:
    """Lines with a gap before or after above factor times the page's mean spacing."""
    w = Window.partitionBy(page).orderBy(order)
    near = lines.withColumn("__b", F.abs(F.col(y) - F.lag(y).over(w))).withColumn("__a", F.abs(F.lead(y).over(w) - F.col(y)))
    limit = F.col("spacing") * factor
    return near.join(line_spacing(lines, page, order, y), page).withColumn("isolated", F.coalesce(F.col("__b") > limit, F.lit(False)) | F.coalesce(F.col("__a") > limit, F.lit(False))).drop("__a", "__b", "spacing")


def items_to_lines(items: DataFrame, page: str, order: str, x: str, y: str, text: str, tolerance: float = 2.0) -> DataFrame:
    """An item joins the current line if its y is within the tolerance of the line's first item; lines are ordered by x."""
    kind = "struct<y:double,line:int,out:array<struct<line:int,x:double,t:string>>>"
    seq = items.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(text).alias("t")))).alias("s"))

    def fold(acc: Column, i: Column) -> Column:
        same = F.coalesce(F.abs(i["y"] - acc["y"]) <= tolerance, F.lit(False))
        line = F.when(same, acc["line"]).otherwise(acc["line"] + 1)
        item = F.struct(line.alias("line"), i["x"].alias("x"), i["t"].alias("t"))
        return F.struct(F.when(same, acc["y"]).otherwise(i["y"]).alias("y"), line.alias("line"), F.array_append(acc["out"], item).alias("out")).cast(kind)

    start = F.expr(f"cast(named_struct('y', null, 'line', 0, 'out', array()) as {kind})")
    placed = seq.select(page, F.explode(F.aggregate("s", start, fold)["out"]).alias("i")).select(page, "i.line", "i.x", "i.t")
    return placed.groupBy(page, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "t"))), lambda v: v["t"]), " ").alias("text"), F.min("x").alias("x"))


def numbered_lines(items: DataFrame, page: str, order: str, x: str, y: str, width: str, tolerance: float = 2.0, gap: float | None = None, in_order: bool = False) -> DataFrame:
    """Items with the number of their line on the page and that line's y (its first item's).

    From the top down (larger y first), or with in_order as they come, an item within the tolerance of the line's y belongs to it.
    A line ends at a horizontal gap above `gap`: between neighbours by x, or with in_order between an item and the one before.
    One page is handled at a time; items without a place are left out."""

    def number() -> Callable[..., tuple[int, float]]:
        on, at, ends, line = None, None, 0.0, -1

        def step(p, px: float, py: float, w: float | None) -> tuple[int, float]:
            nonlocal on, at, ends, line
            if p != on or at is None:
                on, at, ends, line = p, None, 0.0, -1
            far = in_order and gap is not None and px - ends > gap
            if at is None or abs(py - at) > tolerance or far:
                at, line = py, line + 1
            ends = px + (w if w is not None and w == w else 0.0)
            return line, at

        return step

    def split() -> Callable[..., tuple[int]]:
        on, ends, part = None, 0.0, -1

        def step(p, line: int, px: float, w: float | None) -> tuple[int]:
            nonlocal on, ends, part
            if on is None or p != on[0]:
                part = -1
            if (p, line) != on or px - ends > gap:
                part += 1
            on, ends = (p, line), px + (w if w is not None and w == w else 0.0)
            return (part,)

        return step

    rows = items.select(page, order, x, y, width, *[c for c in items.columns if c not in (page, order, x, y, width)])
    place, start, above = F.col(x).cast("double"), F.col(width).cast("double"), F.col(y).cast("double")
    rows = rows.where(place.isNotNull() & above.isNotNull()).withColumns({"__x": place, "__y": above, "__w": start})
    numbered = walk(dealt(rows, page, [order] if in_order else [F.desc("__y"), order]), [page, "__x", "__y", "__w"], number, StructType().add("line", "long").add("line_y", "double"))
    if gap is not None and not in_order:
        # rows are still dealt by page
        parts = walk(numbered.sortWithinPartitions(page, "line", "__x", order), [page, "line", "__x", "__w"], split, StructType().add("__part", "long"))
        numbered = parts.withColumn("line", F.col("__part")).drop("__part")
    return numbered.drop("__x", "__y", "__w")


def text_lines(items: DataFrame, page: str, order: str, x: str, text: str, font: str, size: str) -> DataFrame:
    """(page, line, y, x, text, fonts, font, size) of numbered items: texts by x, blanks left out; the most frequent font, the first of
    equals; the mean of sizes above 0, else 0."""
    rows = items.groupBy(page, "line").agg(
        F.first("line_y").alias("y"), F.min(x).alias("x"), F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(order).alias("o"), F.trim(text).alias("t"), F.col(font).alias("f")))).alias("i"),
        F.coalesce(F.avg(F.when(F.col(size) > 0, F.col(size))), F.lit(0.0)).cast("double").alias("size"),
    )
    named = F.filter(F.transform("i", lambda v: v["f"]), lambda f: f.isNotNull() & (f != ""))
    rows = rows.withColumn("all", named).withColumn("fonts", F.array_distinct("all"))
    counts = F.transform("fonts", lambda f, i: F.struct(F.size(F.filter("all", lambda a: a == f)).alias("n"), (-i).alias("first"), f.alias("f")))
    words = F.filter(F.transform("i", lambda v: v["t"]), lambda t: t.isNotNull() & (t != ""))
    return rows.select(page, "line", "y", "x", F.array_join(words, " ").alias("text"), "fonts", F.coalesce(F.array_max(counts)["f"], F.lit("")).alias("font"), "size")


def lines_in_fonts(lines: DataFrame, fonts: DataFrame, group: str | None = None) -> DataFrame:
    """Lines (font, fonts) with a font of `fonts` (font), a list per `group` where one is given."""
    by = [group] if group else []
    wanted = fonts.groupBy(*by).agg(F.collect_set("font").alias("__wanted"))
    joined = lines.join(wanted, group) if group else lines.crossJoin(F.broadcast(wanted))  # one row
    return joined.where(F.array_contains("__wanted", F.col("font")) | F.arrays_overlap("__wanted", "fonts")).drop("__wanted")


def near_margins(lines: DataFrame, margins: DataFrame, group: str, x: str, before: float = 3.0, inside: float = 40.0, start: float = 8.0) -> DataFrame:
    """Lines from `before` left of a common x of their group (a short list) to `inside` right of it, with is_start up to `start` right
    of the first such x."""
    common = margins.groupBy(group).agg(F.array_sort(F.collect_list("anchor")).alias("__common"))
    fits = F.filter("__common", lambda c: F.col(x).between(c - before, c + inside))
    rows = lines.join(common, group).withColumn("margin", F.try_element_at(fits, F.lit(1))).drop("__common")
    return rows.where("margin is not null").withColumn("is_start", F.col(x) <= F.col("margin") + start)


def merge_rectangles(shapes: DataFrame, page: str, order: str, reach: float = 30.0) -> DataFrame:
    """(page, cluster, n, x0, y0, x1, y1): in order, a rectangle with an area joins the first cluster whose box, widened by the reach, it
    overlaps, and widens that box; else it opens one. One page is handled at a time."""

    def merge(rows: list[tuple]) -> list[tuple]:
        boxes: list[list[float]] = []
        for _, _, x0, y0, x1, y1 in rows:
            if None in (x0, y0, x1, y1) or not (x1 > x0 and y1 > y0):
                continue
            for b in boxes:
                if x0 < b[2] + reach and x1 > b[0] - reach and y0 < b[3] + reach and y1 > b[1] - reach:
                    b[:] = [min(b[0], x0), min(b[1], y0), max(b[2], x1), max(b[3], y1), b[4] + 1]
                    break
            else:
                boxes.append([x0, y0, x1, y1, 1])
        return [(rows[0][0], i, b[4], *b[:4]) for i, b in enumerate(boxes)]

    sides = ["x0", "y0", "x1", "y1"]
    schema = StructType([shapes.schema[page], *[StructField(c, LongType()) for c in ("cluster", "n")], *[StructField(c, DoubleType()) for c in sides]])
    return fold_groups(shapes.select(page, order, *[F.col(c).cast("double").alias(c) for c in sides]), page, [order], merge, schema)


def x_clusters(lines: DataFrame, page: str, x: str, tolerance: float = 10.0) -> DataFrame:
    """(page, cluster, n, anchor): going up in x, a line belongs to the last cluster if within the tolerance of its first x, else opens one."""
    kind = "array<struct<x:double,n:bigint>>"
    places = lines.groupBy(page, F.col(x).cast("double").alias("x")).agg(F.count("*").alias("n"))
    seq = places.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("s"))

    def fold(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["x"].alias("x"), (last["n"] + p["n"]).alias("n"))
        near = F.coalesce(p["x"] - last["x"] <= tolerance, F.lit(False))
        return F.when(near, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(p))).cast(kind)

    folded = F.aggregate("s", F.expr(f"cast(array() as {kind})"), fold)
    return seq.select(page, F.posexplode(folded).alias("at", "c")).select(page, (F.col("at") + 1).cast("long").alias("cluster"), "c.n", F.col("c.x").alias("anchor"))


def running_clusters(lines: DataFrame, group: str, order: list[str], x: str, tolerance: float = 5.0, most: int = 2) -> DataFrame:
    """(group, rank, x, n) of the clusters with most lines: line after line, the first cluster whose mean lies within the tolerance takes
    the line, which moves the mean, or the line opens one. Of equally large ones the earlier comes first; x is rounded to one decimal.

    One group, the lines of a page or the links of a document, is folded at a time; clusters are few."""

    def fold(rows: list[tuple]) -> list[tuple]:
        sums: list[float] = []
        sizes: list[int] = []
        for row in rows:
            place = row[-1]
            if place is None or place != place:
                continue
            at = next((k for k, (s, n) in enumerate(zip(sums, sizes, strict=True)) if abs(s / n - place) <= tolerance), None)
            if at is None:
                sums.append(place)
                sizes.append(1)
            else:
                sums[at] += place
                sizes[at] += 1
        ranked = sorted(range(len(sums)), key=lambda k: -sizes[k])[:most]
        return [(rows[0][0], r, math.floor(sums[k] / sizes[k] * 10 + 0.5) / 10, sizes[k]) for r, k in enumerate(ranked, 1)]

    schema = StructType([lines.schema[group], StructField("rank", LongType()), StructField("x", DoubleType()), StructField("n", LongType())])
    keys = [F.col(c).alias(f"__{i}") for i, c in enumerate(order)]
    return fold_groups(lines.select(group, *keys, F.col(x).cast("double").alias("__place")), group, [f"__{i}" for i in range(len(order))], fold, schema)


def two_columns(lines: DataFrame, page: str, x: str, width: float) -> DataFrame:
    """Whether a page has a second x cluster with over a tenth of its lines, over 30 % of the width away."""
    c = x_clusters(lines, page, x).withColumn("r", F.row_number().over(Window.partitionBy(page).orderBy(F.desc("n"), "cluster"))).withColumn("all", F.sum("n").over(Window.partitionBy(page)))
    first, second = F.max(F.when(F.col("r") == 1, F.col("anchor"))), F.max(F.when(F.col("r") == 2, F.col("anchor")))
    share = F.max(F.when(F.col("r") == 2, F.col("n") / F.col("all")))
    return c.groupBy(page).agg(F.coalesce((share > 0.1) & (F.abs(first - second) > 0.3 * width), F.lit(False)).alias("two_columns"), ((first + second) / 2).alias("middle"))


def union_of_boxes(spans: DataFrame, by: list[str]) -> DataFrame:
    return spans.groupBy(*by, "y0", "y1").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


# ---------------------------------------------------------------- queries

_LINES = "SELECT CAST(floor(l_orderkey / 10) AS BIGINT) AS page, l_orderkey * 10 + l_linenumber AS pos, l_quantity AS x, (l_orderkey * 31 + l_linenumber * 12) % 700 AS y, l_returnflag AS font, l_tax * 100 AS size FROM {lineitem}"
_DUCK = _LINES.replace("{lineitem}", "lineitem")


def _paged(spark, sf_dir) -> DataFrame:
    """Line items of ten orders to a page."""
    return table(spark, sf_dir, "lineitem").withColumn("page", F.floor(F.col("l_orderkey") / 10))


def _lines(spark, sf_dir) -> DataFrame:
    return spark.sql(_LINES, lineitem=table(spark, sf_dir, "lineitem"))


query("a29_position_statistics", f"""WITH l AS ({_DUCK}), s AS (SELECT page, avg(x) AS mean, stddev_pop(x) AS std, list(x ORDER BY x) AS s, min(x) AS least, max(x) AS most FROM l GROUP BY page)
SELECT page, round(mean, 6) AS mean, round(std, 6) AS std, s[(floor(len(s) * 0.5) + 1)::INT] AS median, s[(floor(len(s) * 0.25) + 1)::INT] AS q1, s[(floor(len(s) * 0.75) + 1)::INT] AS q3, least, most FROM s""")(
    lambda spark, sf_dir: position_statistics(_lines(spark, sf_dir), ["page"], "x").withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))
)
query("p19_without_outliers", f"""WITH l AS ({_DUCK}), s AS (SELECT page, list(y ORDER BY y) AS s FROM l GROUP BY page), q AS (SELECT page, s[(floor(len(s) * 0.25) + 1)::INT] AS q1, s[(floor(len(s) * 0.75) + 1)::INT] AS q3 FROM s)
SELECT page, pos, y FROM l JOIN q USING (page) WHERE y BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)""")(
    lambda spark, sf_dir: without_outliers(_lines(spark, sf_dir), ["page"], "y", 0.5).select("page", "pos", "y")
)
_TITLED = "SELECT *, CASE WHEN pos % 11 = 0 THEN 'Page ' || pos % 90 || ' of 90' WHEN pos % 11 = 1 THEN 'Figure ' || pos % 9 || ' shows things' WHEN pos % 11 = 2 THEN 'Introduction' WHEN pos % 11 = 3 THEN 'short' ELSE 'A line of a reference, ' || pos END AS text FROM ({})"
query("p19_reference_lines", f"""WITH l AS ({_TITLED.format(_DUCK)}), s AS (SELECT page, list(x ORDER BY x) AS xs, list(y ORDER BY y) AS ys FROM l GROUP BY page),
q AS (SELECT page, xs[(floor(len(xs) * 0.25) + 1)::INT] AS x1, xs[(floor(len(xs) * 0.75) + 1)::INT] AS x3, ys[(floor(len(ys) * 0.25) + 1)::INT] AS y1, ys[(floor(len(ys) * 0.75) + 1)::INT] AS y3 FROM s)
SELECT page, pos, text FROM l JOIN q USING (page) WHERE x BETWEEN x1 - 1.5 * (x3 - x1) AND x3 + 1.5 * (x3 - x1) AND y BETWEEN y1 - 2 * (y3 - y1) AND y3 + 2 * (y3 - y1) AND pos % 11 > 3""")(
    lambda spark, sf_dir: reference_lines(spark.sql(_TITLED.format(_LINES), lineitem=table(spark, sf_dir, "lineitem")), ["page"], "x", "y", "text").select("page", "pos", "text")
)
query("a18_most_common_font", f"WITH l AS ({_DUCK}), c AS (SELECT page, font, count(*) AS n, min(pos) AS f FROM l GROUP BY ALL) SELECT page, font, n FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, f, font DESC) AS r FROM c) WHERE r = 1")(
    lambda spark, sf_dir: most_common(_lines(spark, sf_dir), ["page"], "font", "pos")
)
query("a19_body_profile", f"WITH l AS ({_DUCK}), c AS (SELECT font, count(*) AS n, min(pos) AS f FROM l GROUP BY font), b AS (SELECT font FROM c ORDER BY n DESC, f LIMIT 1) SELECT font, round(avg(size), 6) AS size FROM l JOIN b USING (font) GROUP BY font")(
    lambda spark, sf_dir: _lines(spark, sf_dir).join(F.broadcast(most_common(_lines(spark, sf_dir), [], "font", "pos").select("font")), "font").groupBy("font").agg(F.round(F.avg("size"), 6).alias("size"))
)
query("a20_line_spacing", f"WITH l AS ({_DUCK}), g AS (SELECT page, abs(y - lag(y) OVER (PARTITION BY page ORDER BY pos)) AS d FROM l) SELECT page, round(coalesce(avg(d) FILTER (d > 0 AND d < 50), 12), 6)::DOUBLE AS spacing FROM g GROUP BY page")(
    lambda spark, sf_dir: line_spacing(_lines(spark, sf_dir), "page", "pos", "y").withColumn("spacing", F.round("spacing", 6))
)
query("w08_isolated_lines", f"""WITH l AS ({_DUCK}), g AS (SELECT *, abs(y - lag(y) OVER w) AS b, abs(lead(y) OVER w - y) AS a FROM l WINDOW w AS (PARTITION BY page ORDER BY pos)),
s AS (SELECT page, coalesce(avg(b) FILTER (b > 0 AND b < 50), 12) AS spacing FROM g GROUP BY page) SELECT page, pos, coalesce(b > 1.5 * spacing, false) OR coalesce(a > 1.5 * spacing, false) AS isolated FROM g JOIN s USING (page)""")(
    lambda spark, sf_dir: isolated(_lines(spark, sf_dir), "page", "pos", "y").select("page", "pos", "isolated")
)
query("a26_items_to_lines")(lambda spark, sf_dir: items_to_lines(_lines(spark, sf_dir), "page", "pos", "x", "y", "font"))
# lines that start at two places of a page, those of every line item
_INDENTED = "SELECT page, pos, CAST(17 * floor(x / 17) + x % 2 AS DOUBLE) AS x FROM ({})"
_CLUSTERS = f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER () AS line FROM ({_INDENTED.format(_DUCK)})), a(page, x) AS (
  SELECT page, min(x) FROM l GROUP BY page UNION ALL SELECT l.page, min(l.x) FROM a JOIN l ON l.page = a.page AND l.x > a.x + 10 GROUP BY l.page, a.x
), m AS (SELECT l.page, l.line, max(a.x) AS anchor FROM l JOIN a ON a.page = l.page AND a.x <= l.x GROUP BY l.page, l.line),
c AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY anchor) AS cluster, count(*) AS n, anchor FROM m GROUP BY page, anchor)"""


def _indented(spark, sf_dir) -> DataFrame:
    return spark.sql(_INDENTED.format(_LINES), lineitem=table(spark, sf_dir, "lineitem"))


query("a23_anchored_clusters", f"{_CLUSTERS} SELECT page, cluster, n, anchor FROM c")(lambda spark, sf_dir: x_clusters(_indented(spark, sf_dir), "page", "x"))
# line by line: the first cluster whose mean is near takes the line, or a new one does
query("a24_x_clusters", f"""WITH RECURSIVE l AS (SELECT page, CAST(x AS DOUBLE) AS x, row_number() OVER (PARTITION BY page ORDER BY pos, x) AS i FROM ({_DUCK})),
f(page, i, s, n) AS (
  SELECT page, 0::BIGINT, []::DOUBLE[], []::BIGINT[] FROM l GROUP BY page UNION ALL
  SELECT page, i, CASE WHEN p = 0 THEN list_append(s, x) ELSE list_transform(s, lambda v, k: v + CASE WHEN k = p THEN x ELSE 0 END) END,
    CASE WHEN p = 0 THEN list_append(n, 1::BIGINT) ELSE list_transform(n, lambda v, k: v + CASE WHEN k = p THEN 1 ELSE 0 END) END
  FROM (SELECT l.page, l.i, l.x, f.s, f.n, coalesce(list_position(list_transform(f.s, lambda v, k: abs(v / f.n[k] - l.x) <= 5), true), 0) AS p FROM f JOIN l ON l.page = f.page AND l.i = f.i + 1)
), e AS (SELECT page, unnest(s) AS s, unnest(n) AS n, generate_subscripts(s, 1) AS c FROM f QUALIFY i = max(i) OVER (PARTITION BY page))
SELECT page, row_number() OVER (PARTITION BY page ORDER BY n DESC, c) AS rank, floor(s / n * 10 + 0.5) / 10 AS x, n FROM e QUALIFY rank <= 2""")(
    lambda spark, sf_dir: running_clusters(_lines(spark, sf_dir), "page", ["pos", "x"], "x")
)
query("a23_two_columns", f"""{_CLUSTERS}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, cluster) AS r, sum(n) OVER (PARTITION BY page) AS lines FROM c)
SELECT page, coalesce(max(n / lines) FILTER (r = 2) > 0.1 AND abs(max(anchor) FILTER (r = 1) - max(anchor) FILTER (r = 2)) > 15, false) AS two_columns, (max(anchor) FILTER (r = 1) + max(anchor) FILTER (r = 2)) / 2 AS middle FROM r GROUP BY page""")(
    lambda spark, sf_dir: two_columns(_indented(spark, sf_dir), "page", "x", 50.0)
)
query("a37_column_assignment", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 25 THEN 1 ELSE 2 END AS col FROM lineitem")(
    lambda spark, sf_dir: table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", L.side_of(F.col("l_quantity"), 25).alias("col"))
)
query("a28_font_distribution", f"WITH l AS ({_DUCK}), c AS (SELECT font, count(*) AS n FROM l GROUP BY font) SELECT font, n, round(n / sum(n) OVER (), 6)::DOUBLE AS share FROM c QUALIFY n >= 3 AND n / sum(n) OVER () BETWEEN 0.1 AND 0.8")(
    lambda spark, sf_dir: _lines(spark, sf_dir).groupBy("font").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6)).where("n >= 3 and share between 0.1 and 0.8")
)
_METRICS = "SELECT CAST(floor(l_orderkey / 10) AS BIGINT) AS page, greatest(8, coalesce(avg(CASE WHEN l_quantity > 0 AND l_quantity < 100 THEN l_quantity END), 12)) AS h, greatest(3, coalesce(avg(CASE WHEN l_extendedprice <> 0 THEN l_extendedprice / 1000 / length(CAST(l_orderkey AS VARCHAR)) END), 6)) AS w FROM lineitem GROUP BY 1"


def _metrics(spark, sf_dir) -> DataFrame:
    return _paged(spark, sf_dir).groupBy("page").agg(L.line_height(F.col("l_quantity")).alias("height"), L.char_width(F.col("l_extendedprice") / 1000, F.col("l_orderkey").cast("string")).alias("width"))


query("a22_adaptive_thresholds", f"SELECT page, CAST(round(greatest(10 * h, 0.12 * 800, 60)) AS BIGINT) AS dy, CAST(round(greatest(5 * w, 0.03 * 600, 20)) AS BIGINT) AS dx FROM ({_METRICS}) q")(
    lambda spark, sf_dir: _metrics(spark, sf_dir).select("page", L.vertical_threshold(F.col("height"), 800.0).alias("dy"), L.horizontal_threshold(F.col("width"), 600.0).alias("dx"))
)
query("a21_text_metrics", f"SELECT page, round(h, 6) AS height, round(w, 6) AS width FROM ({_METRICS}) q")(
    lambda spark, sf_dir: _metrics(spark, sf_dir).select("page", F.round("height", 6).alias("height"), F.round("width", 6).alias("width"))
)
query("a32_line_boxes", "SELECT CAST(floor(l_orderkey / 10) AS BIGINT) AS page, l_linenumber AS y0, min(l_quantity) AS x0, max(l_quantity + l_discount) AS x1 FROM lineitem GROUP BY 1, 2")(
    lambda spark, sf_dir: union_of_boxes(_paged(spark, sf_dir).select("page", F.col("l_linenumber").alias("y0"), F.col("l_linenumber").alias("y1"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + F.col("l_discount")).alias("x1")), ["page"]).drop("y1")
)
query("a12_sections_of_chunks", "SELECT coalesce(source, 'none') AS title, min(doc_id) AS first, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS n FROM documents GROUP BY 1")(
    lambda spark, sf_dir: L.sections_of_chunks(table(spark, sf_dir, "documents"), "source", "doc_id", "text")
)
query("o10_reading_order", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (ORDER BY l_orderkey, l_quantity, l_linenumber) AS BIGINT) AS n FROM lineitem")(
    lambda spark, sf_dir: L.numbered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber"), ["l_orderkey", "l_quantity", "l_linenumber"]).select("l_orderkey", "l_linenumber", "n")
)
_TEXT_BOXES = "SELECT doc_id AS id, CAST(floor(doc_id / 50) AS BIGINT) AS page, CAST(doc_id * 7 % 80 AS DOUBLE) AS x0, CAST(doc_id * 13 % 80 AS DOUBLE) AS y0, CAST(doc_id * 7 % 80 + 10 AS DOUBLE) AS x1, CAST(doc_id * 13 % 80 + 5 AS DOUBLE) AS y1 FROM {documents}"
_AREAS = "SELECT page_id, CAST(floor(page_id / 50) AS BIGINT) AS page, CAST(page_id * 11 % 60 AS DOUBLE) AS ax0, CAST(page_id * 17 % 60 AS DOUBLE) AS ay0, CAST(page_id * 11 % 60 + 40 AS DOUBLE) AS ax1, CAST(page_id * 17 % 60 + 40 AS DOUBLE) AS ay1 FROM {pages}"
_BOXES_SQL = f"t AS ({_TEXT_BOXES.replace('{documents}', 'documents')}), a AS ({_AREAS.replace('{pages}', 'pages')})"
_COVERS = "a.page = t.page AND greatest(0, least(x1, ax1) - greatest(x0, ax0)) * greatest(0, least(y1, ay1) - greatest(y0, ay0)) / 50 >"

query("p18_uncovered_texts", f"WITH {_BOXES_SQL} SELECT id FROM t WHERE NOT EXISTS (SELECT 1 FROM a WHERE {_COVERS} 0.7)")(
    lambda spark, sf_dir: uncovered(spark.sql(_TEXT_BOXES, documents=table(spark, sf_dir, "documents")), spark.sql(_AREAS, pages=table(spark, sf_dir, "pages"))).select("id")
)


@query("j08_outside_images_and_tables", f"WITH {_BOXES_SQL} SELECT id FROM t WHERE NOT EXISTS (SELECT 1 FROM a WHERE page_id % 3 = 0 AND {_COVERS} 0.7) AND NOT EXISTS (SELECT 1 FROM a WHERE page_id % 3 > 0 AND {_COVERS} 0.95)")
def j08(spark, sf_dir):
    """A third of the areas are images, the rest tables, which must cover more."""
    texts, areas = spark.sql(_TEXT_BOXES, documents=table(spark, sf_dir, "documents")), spark.sql(_AREAS, pages=table(spark, sf_dir, "pages"))
    return uncovered(uncovered(texts, areas.where("page_id % 3 = 0")), areas.where("page_id % 3 > 0"), 0.95).select("id")


# items of a page in two halves, about ten pixels wide
_ITEMS = "SELECT page, pos, CAST(x * 10 AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(10 + pos % 13 AS DOUBLE) AS width, font, CAST(size AS DOUBLE) AS size, concat(font, pos % 10) AS text FROM ({})"


def _items(spark, sf_dir) -> DataFrame:
    return spark.sql(_ITEMS.format(_LINES), lineitem=table(spark, sf_dir, "lineitem"))


# from the top down, the tops of lines are found one after the other as clusters' anchors are
_TOPS = f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER () AS rid FROM ({_ITEMS.format(_DUCK)})), a(page, y) AS (
  SELECT page, max(y) FROM l GROUP BY page UNION ALL SELECT l.page, max(l.y) FROM a JOIN l ON l.page = a.page AND l.y < a.y - 2 GROUP BY l.page, a.y
), m AS (SELECT l.rid, l.page, l.pos, l.x, l.width, l.font, l.size, l.text, min(a.y) AS top FROM l JOIN a ON a.page = l.page AND a.y >= l.y GROUP BY ALL)"""
query("a27_sorted_lines", f"{_TOPS} SELECT page, top AS y, string_agg(text, ' ' ORDER BY x, pos, text) AS text, min(x) AS x FROM m GROUP BY page, top")(
    lambda spark, sf_dir: text_lines(numbered_lines(_items(spark, sf_dir), "page", "pos", "x", "y", "width"), "page", "pos", "x", "text", "font", "size").select("page", "y", "text", "x")
)
query("a35_lines_split_at_gaps", f"""{_TOPS}, g AS (SELECT *, coalesce((x - lag(x + width) OVER (PARTITION BY page, top ORDER BY x, pos) > 20)::INT, 0) AS cut FROM m),
i AS (SELECT *, sum(cut) OVER (PARTITION BY page, top ORDER BY x, pos ROWS UNBOUNDED PRECEDING) AS part FROM g)
SELECT page, top AS y, min(x) AS x, string_agg(text, ' ' ORDER BY x, pos, text) AS text FROM i GROUP BY page, top, part""")(
    lambda spark, sf_dir: text_lines(numbered_lines(_items(spark, sf_dir), "page", "pos", "x", "y", "width", gap=20.0), "page", "pos", "x", "text", "font", "size").select("page", "y", "x", "text")
)
query("a36_lines_in_order")(
    lambda spark, sf_dir: text_lines(numbered_lines(_items(spark, sf_dir), "page", "pos", "x", "y", "width", gap=20.0, in_order=True), "page", "pos", "x", "text", "font", "size").drop("fonts")
)
query("a39_line_fonts", f"""{_TOPS}, o AS (SELECT *, row_number() OVER (PARTITION BY page, top ORDER BY x, pos, text) AS seen FROM m), f AS (SELECT page, top, font, count(*) AS n, min(seen) AS seen FROM o GROUP BY page, top, font), s AS (SELECT page, top, coalesce(avg(size) FILTER (size > 0), 0) AS size FROM m GROUP BY page, top)
SELECT page, top AS y, font, round(size, 6) AS size FROM f JOIN s USING (page, top) QUALIFY row_number() OVER (PARTITION BY page, top ORDER BY n DESC, seen) = 1""")(
    lambda spark, sf_dir: text_lines(numbered_lines(_items(spark, sf_dir), "page", "pos", "x", "y", "width"), "page", "pos", "x", "text", "font", "size").select("page", "y", "font", F.round("size", 6).alias("size"))
)
query("p20_lines_in_fonts", f"WITH l AS ({_DUCK}), w AS (SELECT page, max(font) AS font FROM l GROUP BY page) SELECT page, pos FROM l JOIN w USING (page, font)")(
    lambda spark, sf_dir: lines_in_fonts(_lines(spark, sf_dir).withColumn("fonts", F.array("font")), _lines(spark, sf_dir).groupBy("page").agg(F.max("font").alias("font")), "page").select("page", "pos")
)
query("p21_near_margins", f"{_CLUSTERS}, t AS (SELECT page, anchor FROM c WHERE n > 3), k AS (SELECT l.page, pos, x, min(anchor) AS margin FROM l JOIN t ON l.page = t.page AND x BETWEEN anchor - 3 AND anchor + 40 GROUP BY l.page, l.line, pos, x) SELECT page, pos, x <= margin + 8 AS is_start FROM k")(
    lambda spark, sf_dir: near_margins(_indented(spark, sf_dir), x_clusters(_indented(spark, sf_dir), "page", "x").where("n > 3"), "page", "x").select("page", "pos", "is_start")
)
query("a25_merged_rectangles")(
    lambda spark, sf_dir: merge_rectangles(_items(spark, sf_dir).selectExpr("page", "pos", "x x0", "y y0", "x + width x1", "y + size y1"), "page", "pos")
)
