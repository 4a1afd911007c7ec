"""Rules of headings on literal lines, a golden of lines to sections, and clusters against a fold line by line."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folium.operators import headings, layout

from .test_functions import one


@pytest.mark.parametrize("text, score", [("a b", 100), ("a " * 7 + "b", 100), ("a " * 8 + "b", 0), ("a " * 14 + "b", 0), ("a " * 16 + "b", 0), ("x" * 101, 0), ("  two   words ", 100)])
def test_short_lines(spark, text, score):
    assert one(spark, headings.shortness_score(F.col("t")), t=text) == score


@pytest.mark.parametrize("ratio, score", [(0.99, 0), (1.0, 100), (1.3, 100), (0.5, 0)])
def test_font_sizes(spark, ratio, score):
    assert one(spark, headings.font_size_score(F.col("t"), F.lit(10.0)), t=10.0 * ratio) == score


@pytest.mark.parametrize("font, score", [("Times", 0), ("Times-Bold", 100), ("Helvetica", 100), ("Times-OBLIQUE", 100)])
def test_font_styles(spark, font, score):
    assert one(spark, headings.font_style_score(F.col("t"), F.lit("Times" if font.startswith("Times") and "-" not in font else font if font != "Helvetica" else "Times")), t=font) == score


@pytest.mark.parametrize("line, kind, level, score", [
    ("1.2.3 Deep Matters", "arabic", 3, 100), ("2. Methods", "arabic", 1, 150), ("123 Methods", "", 1, 0), ("B.21 Proofs", "letter", 2, 0), ("b) Case study", "sub", 2, 150), ("xii) Twelve", "sub", 2, 0), ("(iv) Fourth", "parentheses", 2, 0),
    ("XX Findings", "roman", 1, 150), ("XXI Findings", "roman", 1, 0), ("3 x + 4 Sums", "arabic", 1, 0), ("1  Two  blanks", "arabic", 1, 100), ("", "", 1, 0), ("  ", "", 1, 0), ("7", "", 1, 0), ("1 ends here. Not", "arabic", 1, 0), ("((a) Odd", "", 1, 0),
])
def test_numbers(spark, line, kind, level, score):
    s = one(spark, headings.section_number(F.col("t")), t=line)
    assert (s["kind"], s["level"], s["score"]) == (kind, level, score)


BODY = "this is a line of the body of the paper, set as all of them are"
PAPER = [  # page, y, text, font, size
    (1, 780.0, "Some running text before all of it, which is long enough to be body", "Body", 10.0),
    (1, 740.0, "1 Introduction", "Body-Bold", 14.0), (1, 700.0, BODY, "Body", 10.0), (1, 688.0, BODY, "Body", 10.0), (1, 676.0, BODY, "Body", 10.0),
    (1, 640.0, "1.1 Related Work", "Body-Bold", 12.0), (1, 600.0, BODY, "Body", 10.0), (1, 588.0, "1 Introduction", "Body", 8.0), (1, 576.0, BODY, "Body", 10.0),
    (2, 780.0, "1.2 Further Things", "Body-Bold", 12.0), (2, 740.0, BODY, "Body", 10.0), (2, 728.0, BODY, "Body", 10.0),
    (2, 690.0, "2 Methods", "Body-Bold", 14.0), (2, 650.0, BODY, "Body", 10.0), (2, 638.0, BODY, "Body", 10.0), (2, 600.0, "2 Methods", "Body-Bold", 14.0), (2, 560.0, BODY, "Body", 10.0), (2, 520.0, "References", "Body-Bold", 14.0), (2, 480.0, None, "Body", 10.0),
]


def test_sections_of_lines(spark):
    rows = [(d, page, i, y, text, font, size) for d in (1, 2) for i, (page, y, text, font, size) in enumerate(PAPER)]
    random.Random(1).shuffle(rows)
    lines = spark.createDataFrame(rows, "doc_id long, page long, line long, y double, text string, font string, size double")
    got = headings.section_scan(lines)
    for doc in (1, 2):
        mine = sorted((r["line"], r["is_heading"], r["section"], r["section_title"], r["section_level"], r["parent"]) for r in got.where(F.col("doc_id") == doc).collect())
        assert [m[0] for m in mine if m[1]] == [1, 5, 9, 12, 17]
        titles = {0: (None, None, 0), 1: ("1 Introduction", 1, 0), 2: ("1.1 Related Work", 2, 1), 3: ("1.2 Further Things", 2, 1), 4: ("2 Methods", 1, 0), 5: ("References", 1, 0)}
        want = [0] + [1] * 4 + [2] * 4 + [3] * 3 + [4] * 5 + [5] * 2
        assert [m[2] for m in mine] == want and [m[3:] for m in mine] == [titles[s] for s in want]
    assert headings.section_scan(lines.limit(0)).count() == 0


def test_clusters_line_by_line(spark):
    rng, rows = random.Random(5), []
    for page in range(6):
        rows += [(page, i, rng.choice([50.0, 53.0, 57.0, 300.0, 303.5]) + rng.random() * 3) for i in range(60)]
    rows += [(9, 0, None), (8, 0, 10.0), (8, 1, 15.0), (8, 2, 17.6), (8, 3, 40.0)]
    lines = spark.createDataFrame(rows, "page long, pos long, x double")
    want = []
    for page in {r[0] for r in rows}:
        clusters = []
        for _, _, x in sorted(r for r in rows if r[0] == page and r[2] is not None):
            for c in clusters:
                if abs(sum(c) / len(c) - x) <= 5:
                    c.append(x)
                    break
            else:
                clusters.append([x])
        clusters.sort(key=lambda c: -len(c))
        want += [(page, k, math.floor(sum(c) / len(c) * 10 + 0.5) / 10, len(c)) for k, c in enumerate(clusters[:2], 1)]
    assert sorted(map(tuple, layout.running_clusters(lines, "page", ["pos"], "x").collect())) == sorted(want)


@pytest.mark.parametrize("text, out", [
    ("Page 3 of 12", True), ("1234567890123", True), ("page 12345678901", True), ("Figure 3 shows", True), ("figures 3 shows", False), ("Chapter two of all", False), ("Section 12", True), ("Introduction", True),
    ("Smith, J. A title.", False), ("short", True), ("internationalization", False), (None, True), ("   ", True), ("12 of 13 of 14 things", False), ("Results", True),
])
def test_page_furniture(spark, text, out):
    from pyspark.sql.types import StringType, StructField, StructType

    rows = spark.createDataFrame([(text,)], StructType([StructField("t", StringType())]))
    assert rows.select(layout.is_page_furniture(F.col("t"))).first()[0] is out


def test_reference_lines(spark):
    rows = [(1, i, 50.0 + i % 3, 700.0 - 10 * i, f"A reference of the list, number {i}") for i in range(20)] + [(1, 20, 300.0, 600.0, "A line far to the right"), (1, 21, 51.0, -900.0, "A line far down the page"), (1, 22, 51.0, 650.0, "Page 2"), (1, 23, None, 650.0, "A line without x, at 0")]
    lines = spark.createDataFrame(rows, "page long, pos long, x double, y double, text string")
    assert sorted(r["pos"] for r in layout.reference_lines(lines, ["page"], "x", "y", "text").collect()) == list(range(20))


def test_split_with_a_buffer(spark):
    from folium.operators import documents

    topic = lambda n: F.when(n.contains("cat"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    docs = spark.createDataFrame([(1, "A cat. Some dog. A dog. Last dog. More dog. Old dog."), (2, "One."), (3, "")], "k long, body string")
    cut = lambda b, q: sorted(tuple(r) for r in documents.semantic_split(docs, "k", percentile=q, embed=topic, buffer=b).collect())
    assert cut(0, 0.5) == [(1, 0, "A cat."), (1, 1, "Some dog. A dog. Last dog. More dog. Old dog."), (2, 0, "One.")]
    assert cut(1, 0.5) == [(1, 0, "A cat. Some dog."), (1, 1, "A dog. Last dog. More dog. Old dog."), (2, 0, "One.")]
