"""What queries may not do as tables grow, read off their plans, and the rows that go with it."""

import re

from pyspark.sql.types import StructType

from folium.operators import keywords, layout, spans
from folium.operators.grouped import fold_groups
from folium.plans.catalogue import QUERIES, SQL
from folium.session import table


def exchanges(frame) -> int:
    """Shuffles of a plan before it runs."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\bExchange (?:hash|range|single|round)", plan, re.IGNORECASE))


def test_keyword_texts_are_dealt_once(spark, sf_dir):
    scored = keywords.best_distinct(keywords.yake_scores(table(spark, sf_dir, "documents")), 30)
    assert exchanges(scored) == 1


def test_no_frame_for_each_group(spark, sf_dir):
    for name in ("t20_merge_synonyms", "t21_select_diverse", "t22_refined_concepts", "a24_x_clusters", "a25_merged_rectangles", "a27_sorted_lines", "a36_lines_in_order", "a39_line_fonts"):
        assert "FlatMapGroupsInPandas" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString(), name


def test_groups_go_on_over_batches(spark):
    rows = spark.range(0, 5000).selectExpr("if(id % 3 = 2, null, id % 3) g", "id").repartition(3)
    schema = StructType().add("g", "long").add("n", "long").add("rising", "boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = fold_groups(rows, "g", ["id"], lambda r: [(r[0][0], len(r), all(a[1] < b[1] for a, b in zip(r, r[1:], strict=False)))], schema).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((tuple(r) for r in got), key=str) == [(0, 1667, True), (1, 1667, True), (None, 1666, True)]


def test_lines_go_on_over_batches(spark):
    items = spark.createDataFrame([(p, i, float(i * 10), 100.0 - i // 4 * 12, 5.0 if i % 2 else None) for p in range(3) for i in range(12)], "page long, pos long, x double, y double, width double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {(r["page"], r["pos"]): (r["line"], r["line_y"]) for r in layout.numbered_lines(items, "page", "pos", "x", "y", "width", gap=7.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # a gap of 10 follows items without a width, one of 5 the others
    assert got == {(p, i): (i // 4 * 3 + (0, 1, 1, 2)[i % 4], 100.0 - i // 4 * 12) for p in range(3) for i in range(12)}


def test_pages_of_places_fill_up(spark):
    """Twenty pages at any size, as many rows as the table has to a page."""
    for name in ("j06_nearest_reference", "j07_starting_line"):
        assert SQL[name].count("doc_id % 20 AS page") >= 1 and "50" not in SQL[name], name


def test_common_subsequence_bounds_runs():
    """One pass tells the longest common subsequence with each beginning of a run, which no score exceeds, and few runs are compared."""
    chunk, run = "a quick brown fox ran over it", "the quick brawn fox, and a dog ran it over"

    def plainly(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    shared = spans.common(spans.letter_places(chunk), len(chunk), run)
    assert shared == [plainly(chunk, run[:i]) for i in range(len(run) + 1)]
    assert all(spans.matched(chunk, run[:i]) <= n for i, n in enumerate(shared))


def test_few_runs_are_compared(monkeypatch):
    words = [f"{a}{b}" for a in ("stone", "river", "cloud", "amber", "tiger", "lemon") for b in ("mark", "field", "son", "wick", "ton")]
    texts = [" ".join(words[(i * 7 + j * 11) % 30] for j in range(6)) for i in range(40)]
    page, chunk = spans.Page(texts), " ".join(texts[9:11])
    runs = [(i, n) for i in page.starts(chunk) for n in range(1, min(8, len(texts) - i) + 1)]
    score, start, size = max((spans.percentage(chunk, page.run(i, i + n)), -i, -n) for i, n in runs)
    calls = []
    compared = spans.percentage
    monkeypatch.setattr(spans, "percentage", lambda a, b: calls.append(1) or compared(a, b))
    assert page.best(chunk, 8) == (-start, -start - size - 1, score)
    assert len(calls) < len(runs) / 4
