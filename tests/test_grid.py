"""Grid joins against comparing all rows of a page, and box merges against the plain fold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folium.operators import citations, grid


def _scene(seed: int, n: int, places: int, clustered: bool):
    rng = random.Random(seed)

    def spot():
        if clustered and rng.random() < 0.7:
            return 0.5 + rng.gauss(0, 0.01), 0.5 + rng.gauss(0, 0.01)
        return rng.choice([rng.random(), rng.randrange(11) / 10]), rng.choice([rng.random(), rng.randrange(11) / 10])

    a = [(i, rng.choice([1, 1, 1, 2, None]), *spot()) for i in range(n)]
    r = [(1000 + i, i // 3, rng.choice([1, 1, 1, 2, None]), *spot()) for i in range(places)]
    return a + [(n, 1, None, 0.5), (n + 1, 1, math.nan, 0.5), (n + 2, 1, -math.inf, 0.5), (n + 3, 1, 1e300, 0.0)], r + r[:20] + [(5, 0, 1, None, 0.1), (6, 0, 1, math.nan, 0.1)]


@pytest.mark.parametrize("clustered, full", [(False, 16), (True, 2)])
def test_nearest_references_equal_all_pairs(spark, clustered, full):
    a, r = _scene(3, 150, 600, clustered)
    points = spark.createDataFrame(a, "annotation_id int, page int, ax double, ay double")
    refs = spark.createDataFrame(r, "ref_id int, ref_order int, page int, rx double, ry double")
    want = {}
    for i, page, ax, ay in a:
        near = [(math.sqrt((ax - rx) * (ax - rx) + (1 - ay - ry) * (1 - ay - ry)), o, k) for k, o, p, rx, ry in r if None not in (page, ax, rx) and p == page]
        want[i] = min((d for d in near if d[0] < 0.1), default=(None, None, None))
    got = {x["annotation_id"]: x for x in citations.match_annotations(points, refs).collect()}
    assert {i: x["ref_id"] for i, x in got.items()} == {i: w[2] for i, w in want.items()}
    assert all(x["distance"] == want[i][0] for i, x in got.items())
    met = grid.nearest(points.drop("annotation_id"), refs, ["page"], ("ax", "ay"), ("rx", "ry"), (0.05, 0.2, 0.0, 0.3), ["ref_order", "ref_id"], full=full)
    assert met.columns == ["page", "ax", "ay", "nearest"] and met.count() == len(a)
    for x in met.collect():
        near = []
        for k, o, p, rx, ry in r:
            if None not in (x["page"], x["ax"], rx) and p == x["page"]:
                dx, dy = rx - x["ax"], ry - x["ay"]
                if -0.05 <= dx <= 0.2 and 0 <= dy <= 0.3:
                    near.append((math.sqrt(dx * dx + dy * dy), o, k))
        assert (x["nearest"] and (x["nearest"]["distance"], x["nearest"]["place"]["ref_id"])) == (min((d[0], d[1], d[2]) for d in near)[::2] if near else None)


def test_starting_lines_equal_all_pairs(spark):
    rng = random.Random(5)
    c = [(i, rng.randrange(3), rng.randrange(60), rng.randrange(300)) for i in range(120)]
    lines = [(i, rng.randrange(3), rng.randrange(60), rng.randrange(300), rng.choice([True, False, False, None]), f"t{i}") for i in range(400)]
    got = citations.starting_line(spark.createDataFrame(c, "citation_id int, page int, cx int, cy int"), spark.createDataFrame(lines, "line_index int, page int, lx int, ly int, is_start boolean, text string"))
    want = {}
    for i, page, cx, cy in c:
        near = [(not s, math.hypot(lx - cx, ly - cy), k) for k, p, lx, ly, s, _ in lines if p == page and -5 <= lx - cx <= 8 and abs(ly - cy) <= 15]
        if near:
            want[i] = min(near)[2]
    assert {x["citation_id"]: x["line_index"] for x in got.collect()} == want and len(want) > 50
    assert got.columns == ["citation_id", "page", "cx", "cy", "line_index", "lx", "ly", "is_start", "text", "distance"]


@pytest.mark.parametrize("limit", [0.3, 0.5, 0.7, 0.95])
def test_uncovered_equals_all_pairs(spark, limit):
    rng = random.Random(7)

    def box(most):
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        return x, y, x + rng.choice([0, rng.uniform(0, most)]), y + rng.uniform(0, most)

    t = [(i, rng.randrange(3), *box(8)) for i in range(300)]
    a = [(rng.randrange(3), *box(rng.choice([2, 10, 60]))) for _ in range(60)]
    got = grid.uncovered(spark.createDataFrame(t + [(900, None, 0.0, 0.0, 1.0, 1.0), (901, 1, None, 0.0, 1.0, 1.0)], "id int, page int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(a + a[:5] + [(1, None, 0.0, 1.0, 1.0)], "page int, ax0 double, ay0 double, ax1 double, ay1 double"), limit)

    def share(b, o):
        return max(0, min(b[2], o[2]) - max(b[0], o[0])) * max(0, min(b[3], o[3]) - max(b[1], o[1])) / ((b[2] - b[0]) * (b[3] - b[1]))

    want = [i for i, p, *b in t if b[2] > b[0] and b[3] > b[1] and not any(q == p and share(b, o) > limit for q, *o in a)]
    assert sorted(x["id"] for x in got.collect() if x["id"] != 900) == want and 0 < len(want) < 250


def test_candidates_grow_with_the_page_not_with_its_square(spark):
    """Ten times the points and places of one full page: the rows that meet grow about as much, where all pairs within the reach grow a hundredfold."""

    def met(n: int) -> int:
        def spots(seed: int, x: str, y: str):
            return spark.range(n).select("id", F.lit(1).alias("page"), F.rand(seed).alias(x), F.rand(seed + 1).alias(y))

        plan = grid.nearest(spots(1, "ax", "ay").drop("id"), spots(5, "rx", "ry"), ["page"], ("ax", "ay"), ("rx", "ry"), (0.1,) * 4, ["id"], 0.1)
        assert plan.where("nearest is not null").count() == n
        plan.collect()
        return _joined_rows(plan)

    small, large = met(4000), met(40_000)
    assert large < 15 * small and small < 100 * 4000


def _joined_rows(plan) -> int:
    """The largest number of rows that any operator of the executed plan gave."""
    most, todo = 0, [plan._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            most = max(most, metric.get().value())
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return most


def test_merged_boxes_equal_the_fold(spark):
    rng = random.Random(11)
    boxes = [(rng.randrange(4), rng.choice([0.1, 0.104, 0.107, 0.111, 0.115, 0.3]), x := round(rng.random() * 2, 3), x + rng.choice([0.01, 0.3]), rng.random()) for _ in range(200)]
    want = []
    for dest in range(4):
        last = None
        for b in sorted(b[1:] for b in boxes if b[0] == dest):
            if last and abs(b[0] - last[0]) < 0.008 and b[1] - last[2] < 0.05:
                last[:] = [min(b[0], last[0]), min(b[1], last[1]), max(b[2], last[2]), max(b[3], last[3])]
            else:
                last = list(b)
                want.append((dest, last))
    got = citations.merge_boxes(spark.createDataFrame(boxes, "dest int, y1 double, x1 double, x2 double, y2 double"))
    assert sorted(tuple(x) for x in got.collect()) == sorted((d, *b) for d, b in want)


def test_summary_of_methods(spark):
    rows = spark.createDataFrame([("a", 0.9), ("a", None), (None, 0.7), ("b", 0.5), ("", 0.8)], "m string, confidence double")
    got = citations.citation_summary(rows, method="m").first()
    assert (got["total"], got["average"], got["high"], got["low"], got["by_method"]) == (5, 0.58, 2, 1, {"a": 2, "b": 1, "unknown": 2})
    assert citations.citation_summary(rows.where("false")).first()["total"] == 0
