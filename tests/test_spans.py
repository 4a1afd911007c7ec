"""Fuzzy runs of spans against every run of up to 100 spans, and the boxes of their lines."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from folium.operators import spans

WORDS = "alpha beta gamma delta eps one two three four five six seven river stone cloud grass amber ivory".split()


def all_runs(texts, text, longest=100):
    """Every run from every span that is like a seed; the first best one."""
    chunk, best = spans.plain(text), (0.0, None)
    words = chunk.split()
    seeds = ["".join(words[:n]) for n in (10, 5, 2) if len(words) >= n]
    for i, t in enumerate(texts):
        if max((SequenceMatcher(None, spans.plain(t), s).ratio() for s in seeds), default=0) < 0.4:
            continue
        for j in range(i, min(len(texts), i + longest)):
            run = spans.plain("".join(texts[i : j + 1]))
            score = round(100 * sum(m.size for m in SequenceMatcher(None, chunk, run).get_matching_blocks()) / len(chunk), 2) if run else 0.0
            if score > best[0]:
                best = (score, (i, j))
    return best


@pytest.fixture(scope="module")
def pages():
    part = lambda i, j: " ".join(WORDS[i:j])
    pages = {
        1: ["## 00", part(0, 6), part(6, 12), "## 99 ## 88", part(12, 18), "## 11"],
        2: [part(0, 2), "## 7", "zq xk jq zx kq " + part(0, 5), part(5, 12), "## 55", "## 66", part(12, 18)],
        3: ["## 1", "## 2 " + part(10, 12), "## 3"],
        4: [part(0, 6), *["##"] * 97, part(6, 12), part(12, 18)],
        5: ["Αλφα αlpha beta\n", "𝑔amma, DELTA – eps ", "", "one two\tthree"],
    }
    rng = random.Random(8)
    for page in range(10, 30):  # pages of many spans whose words come in any order, with letters changed
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 160))]
        spoilt = [w if rng.random() < 0.8 else w.replace(rng.choice(w), rng.choice("xyz")) for w in words]
        pages[page] = [" ".join(spoilt[i : i + 4]) + rng.choice(["", " ", "-"]) for i in range(0, len(words), 4)]
    return pages


def test_against_all_runs(spark, pages):
    rng, chunks = random.Random(3), []
    for page, texts in pages.items():
        words = " ".join(texts).split()
        at = rng.randrange(max(1, len(words) - 20))
        chunks += [(page, 0, " ".join(WORDS)), (page, 1, " ".join(words[at : at + rng.randint(2, 40)])), (page, 2, "word"), (page, 3, None), (page, 4, " ")]
    chunks += [(99, 0, "no such page at all"), (None, 0, "alpha beta")]
    rows = [(page, i, t) for page, texts in pages.items() for i, t in enumerate(texts)] + [(None, 0, "alpha beta")]
    c, s = spark.createDataFrame(chunks, "page long, chunk_id long, text string"), spark.createDataFrame(rows, "page long, pos long, text string")
    for longest in (100, 3):
        got = {(r["page"], r["chunk_id"]): (r["score"], (r["first"], r["last"]) if r["found"] else None) for r in spans.span_runs(c, s, longest=longest).collect()}
        want = {(page, n): all_runs(pages[page], text, longest) if page in pages and text else (0.0, None) for page, n, text in chunks}
        assert got == {k: (score, run if score >= 0.75 else None) for k, (score, run) in want.items()}
    assert {(r["page"], r["chunk_id"]) for r in spans.best_spans(c, s, 80.0).collect()} == {k for k, v in ((k, all_runs(pages[k[0]], dict(((p, n), t) for p, n, t in chunks)[k])) for k in want if k[0] in pages) if v[0] >= 80}


def test_bounds_skip_most_runs(pages, monkeypatch):
    calls = []
    plain = spans.percentage
    monkeypatch.setattr(spans, "percentage", lambda a, b: calls.append(1) or plain(a, b))
    texts = pages[10] * 2 + ["quick zebras jump", " over fjords & 49 hawks"] + pages[10]
    chunk = "quick zebras jump over fjords 49 hawks river"
    assert spans.Page(texts).best(chunk)[2] == all_runs(texts, chunk)[0]
    runs = sum(min(100, len(texts) - i) for i in spans.Page(texts).starts(spans.plain(chunk)))
    assert len(calls) < runs / 4


def test_boxes(spark):
    s = [(1, 0, "the quick brown fox", 10.0, 20.0, 50.0, 30.0), (1, 1, "jumps over the", 50.0, 20.0, 90.0, 30.0), (1, 2, "lazy dog and more", 10.0, 32.0, 60.0, 42.0), (1, 3, "unrelated zzz", 0.0, 50.0, 9.0, 60.0)]
    s = spark.createDataFrame(s, "page long, pos long, text string, x0 double, y0 double, x1 double, y1 double")
    sizes = spark.createDataFrame([(1, 100.0, 200.0)], "page long, width double, height double")
    asked = spark.createDataFrame([(7, 1, "The quick brown fox jumps over the lazy dog"), (7, 1, "brown fox"), (8, 2, "The quick brown"), (9, 1, None)], "request_id long, page long, text string")
    got = sorted(((r["request_id"], r["found"], r["score"], [tuple(b) for b in r["boxes"]]) for r in spans.span_boxes(asked, s, sizes).collect()), key=str)
    assert got[0][:2] == (7, True) and got[0][3] == [(0.1, 0.1, 0.9, 0.15), (0.1, 0.16, 0.6, 0.21)] or got[1][3] == [(0.1, 0.1, 0.9, 0.15), (0.1, 0.16, 0.6, 0.21)]
    assert got[2:] == [(8, False, 0.0, []), (9, False, 0.0, [])]


def test_folding():
    assert spans.plain("Ά α β\n≤𝐀𝑥  Q r—s") == "alpha with tonos alpha beta ax q r s" and spans.plain(None) == ""


def test_texts_are_compared_in_slices(spark):
    texts = [None, "", "α ≤ 𝑥  A-b"] + [f"Text {i} ﬁn" for i in range(2 * spans.TEXTS)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1).withColumn("c", spans.comparable(F.col("text")))
    assert [r["c"] for r in rows.orderBy("i").collect()] == [spans.plain(t) for t in texts]
    assert "ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString()
    assert spans.comparable.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
