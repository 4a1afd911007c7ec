"""Large pages of spans: how runs are bounded and how chunks are dealt."""

import random

from pyspark.sql import functions as F

from folium.operators import spans

WORDS = [a + b for a in ("stone", "river", "cloud", "amber", "tiger", "lemon", "north") for b in ("mark", "field", "son", "wick", "ton", "")]


def plainly(page, chunk, longest):
    """The best of all runs that begin at a span like a seed."""
    text, best = spans.plain(chunk), (0.0, None)
    for i in page.starts(text):
        for n in range(1, min(longest, len(page.texts) - i) + 1):
            score = spans.percentage(text, page.run(i, i + n))
            if score > best[0]:
                best = (score, (i, i + n - 1, score))
    return best[1]


def test_all_starts_are_bounded_at_once():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(WORDS, k=5)) + rng.choice(["", " ", "-\n", " α ", "É"]) for _ in range(60)] + ["", None, "…", "a b"]
    page = spans.Page(texts)
    chunks = [" ".join(" ".join(t or "" for t in texts[i : i + 3]).split()[1:12]) for i in range(0, 60, 7)]
    chunks += [c.replace("o", "x") for c in chunks] + [" ".join(rng.choices(WORDS, k=12)), "a b", "ab", "x", "zz qq", "β 12"]
    for chunk in chunks:
        for longest in (1, 8):
            assert page.best(chunk, longest) == plainly(page, chunk, longest), chunk
        text = spans.plain(chunk)
        got = {(start, n): lacking for lacking, start, n in page.reach(text, 4, 8)}
        for start in range(len(texts)):
            for n in range(1, min(8, len(texts) - start) + 1):
                run = page.run(start, start + n)
                lacking = len(text) - spans.common(spans.letter_places(text), len(text), run)[-1]
                assert got.get((start, n), 5) <= lacking


def test_most_starts_are_not_compared_with_seeds(monkeypatch):
    """Seeds are asked for where a run could win, not at every span of a page."""
    rng, calls = random.Random(5), []
    texts = [" ".join(rng.choices(WORDS, k=6)) for _ in range(300)]
    chunk = " ".join(" ".join(texts[200:203]).split()[3:15])
    page, begins = spans.Page(texts), spans.Page.begins
    want = plainly(page, chunk, 8)
    monkeypatch.setattr(spans.Page, "begins", lambda self, i, seeds: calls.append(i) or begins(self, i, seeds))
    assert page.best(chunk, 8) == want and want[2] > 95 and len(calls) < 30


def test_chunks_of_a_large_page_are_dealt_to_many_tasks(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(WORDS, k=6)) for _ in range(600)]
    s = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, texts[0])], "page long, pos long, text string")
    rows = [(1, i, " ".join(texts[i : i + 2])) for i in range(0, 200, 5)] + [(2, 0, texts[0]), (2, 0, texts[0]), (None, 1, "x y"), (3, 2, None)]
    c = spark.createDataFrame(rows, "page long, chunk_id long, text string")
    monkeypatch.setattr(spans, "SPANS", 50)
    got = spans.span_runs(c, s, longest=4)
    pages = {1: spans.Page(texts), 2: spans.Page(texts[:1])}
    best = [pages[p].best(t, 4) if p in pages else None for p, _, t in rows]
    want = sorted((str(p), k, (*b[:2], b[2]) if b else None) for (p, k, _), b in zip(rows, best, strict=True))
    assert sorted(((str(r["page"]), r["chunk_id"], (r["first"], r["last"], r["score"]) if r["found"] else None) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sum(b is not None for b in best) == len(rows) - 2
    tasks = {r["t"] for r in got.where("page = 1").select(F.spark_partition_id().alias("t")).collect()}
    assert len(tasks) > 1
