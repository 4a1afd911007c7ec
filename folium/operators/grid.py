"""Joins of points and boxes that lie near each other on a page, over grids of cells: rows meet only where they share a cell.

Every join is an equality of page, level and cell, so a page with many rows is spread over tasks by its cells. Levels halve the width of
the cells; which of them a row needs follows from what it looks for, and how many a page has from how full its fullest cell is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coordinates beyond so many widths of a cell are not told apart by doubles and meet nothing.
FARTHEST = 1e12


def _cells(low: Column, high: Column, width: Column) -> Column:
    """Numbers of the cells from the one of `low` to the one of `high`, both widened by what rounding may shift."""
    slack = width * 1e-9 + (F.abs(low) + F.abs(high)) * 1e-15
    return F.sequence(F.floor((low - slack) / width), F.floor((high + slack) / width))


def nearest(points: DataFrame, places: DataFrame, by: Sequence[str], point: tuple[str, str], place: tuple[str, str], reach: tuple[float, float, float, float], order: Sequence[str], limit: float | None = None, full: int = 16) -> DataFrame:
    """Points with a last column `nearest`: a struct (distance, place) of the nearest place with the same `by`, null where none is in reach.

    `point` and `place` name the coordinates. A place is in reach (left, right, below, above) if its x lies from x - left to x + right of the point and
    its y from y - below to y + above, and if its distance is below the limit, where one is given. Of equally near ones the first in `order` is taken.
    Rows with a null key, or a coordinate that is null, not a number or too far out, meet nothing. Repeated points are looked up once, of
    places on one spot only the first can be nearest; so neither makes a hot cell.

    A page whose cells, as large as the reach, hold more than `full` spots has finer levels. One place of each fine cell tells each
    point how far the nearest can be at most; then it looks only at the at most four cells, of the level fit for that distance, that are so near. Whether any page is that full is asked first.
    """
    by, (left, right, below, above) = list(by), reach
    width, height, none = left + right, below + above, F.lit(float("inf"))

    def inside(x: Column, y: Column) -> Column:
        return (F.abs(x) < FARTHEST * width) & (F.abs(y) < FARTHEST * height)  # null and NaN are not

    def cell(x: Column, y: Column, level: Column) -> list[Column]:
        return [F.floor(x * F.pow(F.lit(2.0), level) / width).alias("__cx"), F.floor(y * F.pow(F.lit(2.0), level) / height).alias("__cy")]

    x, y, px, py = (F.col(c) for c in ("__x", "__y", "__px", "__py"))
    keyed = places.select(*by, F.col(place[0]).cast("double").alias("__x"), F.col(place[1]).cast("double").alias("__y"), F.struct(*order).alias("__order"), F.struct(*places.columns).alias("__place"))
    spots = keyed.where(inside(x, y)).groupBy(*by, "__x", "__y").agg(F.min("__order").alias("__order"), F.min_by("__place", "__order").alias("__place"))
    fullest = spots.groupBy(*by, *cell(x, y, F.lit(0))).agg(F.count("*").alias("__n")).groupBy(*by).agg(F.max("__n").alias("__n"))
    deep = (fullest.agg(F.max("__n")).first()[0] or 0) > full
    depths = fullest.where(F.col("__n") > full).select(*by, F.least(F.ceil(F.log2(F.col("__n") / full) / 2), F.lit(30)).cast("int").alias("__depth"))

    def with_depth(rows: DataFrame) -> DataFrame:
        return rows.join(depths, by, "left").withColumn("__depth", F.coalesce("__depth", F.lit(0))) if deep else rows.withColumn("__depth", F.lit(0))

    dealt = with_depth(spots).withColumn("__level", F.explode(F.sequence(F.lit(0), "__depth"))).select("*", *cell(x, y, F.col("__level"))).drop("__depth")

    from_x, from_y = (F.col(c).cast("double") for c in point)
    asked = with_depth(points.select(*by, from_x.alias("__px"), from_y.alias("__py")).where(inside(px, py)).distinct())
    dx, dy = x - px, y - py
    distance = F.sqrt(dx * dx + dy * dy)
    fits = dx.between(-left, right) & dy.between(-below, above)
    if limit is not None:
        fits = fits & (distance < limit)
    at, key = ["__level", "__cx", "__cy"], [*by, "__px", "__py"]

    def looked_at(rows: DataFrame, radius: Column) -> DataFrame:
        """Rows (level) for each cell of their level within the reach and the radius."""
        scale = F.pow(F.lit(2.0), F.col("__level"))
        across = F.explode(_cells(px - F.least(F.lit(left), radius), px + F.least(F.lit(right), radius), F.lit(width) / scale))
        return rows.withColumn("__cx", across).withColumn("__cy", F.explode(_cells(py - F.least(F.lit(below), radius), py + F.least(F.lit(above), radius), F.lit(height) / scale)))

    farthest, bounded = none if limit is None else F.lit(float(limit)), asked
    if deep:
        shown = dealt.where("__level > 0").groupBy(*by, *at).agg(F.min(F.struct("__x", "__y")).alias("s")).select(*by, *at, "s.*")
        fine = asked.where("__depth > 0").withColumn("__level", F.explode(F.sequence(F.lit(1), "__depth")))
        fine = looked_at(fine, F.lit(min(width, height)) / F.pow(F.lit(2.0), F.col("__level")))
        bounded = asked.join(fine.join(shown, [*by, *at]).where(fits).groupBy(*key).agg(F.min(distance).alias("__bound")), key, "left")
    bound = F.least(F.coalesce("__bound", none), farthest) if deep else farthest
    level = F.floor(F.log2(F.lit(min(width, height)) / (2 * F.greatest(bound, F.lit(1e-300)))))
    level = F.when(bound == none, 0).otherwise(F.greatest(F.lit(0), F.least(level, F.col("__depth"))))
    met = looked_at(bounded.withColumn("__level", level.cast("int")), bound).join(dealt, [*by, *at]).where(fits)
    found = met.groupBy(*key).agg(F.min_by(F.struct(distance.alias("distance"), F.col("__place").alias("place")), F.struct(distance, F.col("__order"))).alias("nearest"))
    kept = points.withColumns({"__px": from_x, "__py": from_y})
    return kept.join(found, key, "left").select(*points.columns, "nearest")


def uncovered(texts: DataFrame, areas: DataFrame, limit: float = 0.7) -> DataFrame:
    """Text boxes (page, x0, y0, x1, y1) of which no area (page, ax0, ay0, ax1, ay1) of the page covers more than the limit; boxes without area go.

    An area that covers more than half of a box covers its centre. So a box asks, with its centre, one cell of each size of areas, and an
    area lies in the at most four cells of its own size. Below a limit of a half all areas of the page are compared. Equal boxes and
    equal areas are compared once. Boxes and areas with a null are not covered and don't cover.
    """
    sides = ["page", "x0", "y0", "x1", "y1"]
    w = F.greatest(F.lit(0.0), F.least("x1", "ax1") - F.greatest("x0", "ax0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "ay1") - F.greatest("y0", "ay0"))
    own = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    boxes = texts.where(own > 0)
    asked, meet = boxes.select(*sides).distinct(), ["page"]
    found = areas.select("page", *[F.col(c).cast("double").alias(c) for c in ("ax0", "ay0", "ax1", "ay1")]).where("ax1 > ax0 and ay1 > ay0").distinct()
    if limit >= 0.5:
        meet = ["page", "__size", "__cx", "__cy"]
        found = found.withColumn("__size", F.ceil(F.log2(F.greatest(F.col("ax1") - F.col("ax0"), F.col("ay1") - F.col("ay0")))).cast("int"))
        sizes = found.agg(F.collect_set("__size").alias("__sizes"))  # one row, at most one size for each exponent of a double
        width = F.pow(F.lit(2.0), F.col("__size"))
        found = found.withColumn("__cx", F.explode(_cells(F.col("ax0"), F.col("ax1"), width))).withColumn("__cy", F.explode(_cells(F.col("ay0"), F.col("ay1"), width)))
        middle = [F.floor((F.col(a) / 2 + F.col(b) / 2) / width) for a, b in (("x0", "x1"), ("y0", "y1"))]
        asked = asked.crossJoin(F.broadcast(sizes)).withColumn("__size", F.explode("__sizes")).drop("__sizes").withColumns({"__cx": middle[0], "__cy": middle[1]})
    covered = asked.join(found, meet).where(w * h / own > limit).select(*sides).distinct()
    return boxes.join(covered, sides, "left_anti")
