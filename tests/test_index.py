"""Appends against one fit, searches against the exact scan, and the recall of candidates."""

import random

import pytest
from pyspark.sql import functions as F

from folium.operators import index as I
from folium.operators.retrieval import RERANKERS, dense_search, fit_tfidf, keyword_search, rerank
from folium.session import table


@pytest.fixture(scope="module")
def store(spark, sf_dir, tmp_path_factory):
    docs = table(spark, sf_dir, "documents")
    index = I.TermIndex(spark, str(tmp_path_factory.mktemp("terms")))
    for i in range(4):
        assert index.append(docs.where(F.col("doc_id") % 4 == i), f"s{i}")
    return docs, index


def postings(frame):
    return {(r["doc_id"], r["term"]): round(r["w"], 9) for r in frame.collect()}


def test_appends_equal_one_fit(store, tmp_path):
    docs, index = store
    want = postings(fit_tfidf(docs)[1])
    assert postings(index.postings()) == want
    assert not index.append(docs, "s1") and len(index.segments()) == 4  # a segment that is there
    merged = index.merge(str(tmp_path / "merged"))
    assert merged.segments() == ["merged"] and postings(merged.postings()) == want


def test_search_is_pushed_down(store):
    docs, index = store
    words = ["the", "thing", "of and", "no such word"]
    asked = docs.sparkSession.createDataFrame([(w,) for w in words], "term string")
    rows = lambda f: [(r["doc_id"], round(r["score"], 6)) for r in f.collect()]
    found = index.search(words, 10)
    assert rows(found) == rows(keyword_search(fit_tfidf(docs)[1], asked, 10))
    assert "In(term" in found._jdf.queryExecution().executedPlan().toString()  # pushed to the files


def test_odd_texts_and_a_cap(spark, tmp_path):
    rows = [(1, "alpha beta alpha"), (2, None), (3, ""), (None, "alpha"), (4, "gamma"), (4, "gamma delta"), (5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = I.TermIndex(spark, str(tmp_path / "i"), max_features=3)
    assert index.postings() is None and index.search(["alpha"], 3) is None
    index.append(docs.where("doc_id < 3 or doc_id is null"), "a")
    index.append(docs.where("doc_id >= 3"), "b")
    assert {r["term"] for r in index.fitted()[0].collect()} == {"alpha", "gamma", "alpha beta"}
    assert [r["doc_id"] for r in index.search(["alpha"], 3).collect()] == [1]
    first = {r["term"]: r["cf"] for r in index.fitted()[0].collect()}
    index.append(spark.createDataFrame([(1, "beta beta beta beta")], "doc_id long, text string"), "c")  # a key of another segment
    assert {r["term"]: r["cf"] for r in index.fitted()[0].collect()} != first
    assert {(r["doc_id"], r["term"]) for r in index.postings().collect()} >= {(1, "beta")}


@pytest.fixture(scope="module")
def clustered(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(i, [c + rng.gauss(0, 0.35) for c in centres[i % 20]]) for i in range(3000)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (None, centres[0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").cache()


def test_candidates_have_the_nearest(spark, clustered, tmp_path):
    index = I.VectorIndex(spark, str(tmp_path / "v")).build(clustered, cells=20)
    good = clustered.where("vec_id < 3000")
    some = {r["vec_id"]: r["embedding"] for r in clustered.where("vec_id % 600 = 0 and vec_id < 3000").collect()}
    measured = []
    for v in some.values():
        asked = spark.createDataFrame([([float(x) for x in v],)], "embedding array<double>")
        exact, found = dense_search(good, asked, 10), index.search(v, 10, 450)
        measured.append(I.recall(exact, found))
        assert found.count() == 10
    assert sum(measured) / len(measured) >= 0.95
    every = index.search(list(some.values())[0], 10, 10**9)
    assert [r["vec_id"] for r in every.collect()] == [r["vec_id"] for r in dense_search(good, spark.createDataFrame([([float(x) for x in some[0]],)], "embedding array<double>"), 10).collect()]
    queries = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in some.items()], "query long, q array<double>")
    got = I.search_all(index, queries, 10, 450, slice_rows=40)
    for k, v in some.items():
        assert [(r["vec_id"], round(r["cos"], 5)) for r in got.where(F.col("query") == k).orderBy("rank").collect()] == [(r["vec_id"], round(r["cos"], 5)) for r in index.search(v, 10, 450).collect()]


def test_queries_meet_cells_in_blocks(spark, sf_dir, tmp_path, monkeypatch):
    index = I.VectorIndex(spark, str(tmp_path / "v")).build(table(spark, sf_dir, "embeddings"), cells=3)
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    rows = lambda f: sorted((r["query"], r["rank"], r["vec_id"], round(r["cos"], 6)) for r in f.collect())
    whole = rows(I.search_all(index, asked, 3, 100))
    monkeypatch.setattr(I, "ASKED", 7)
    parted = I.search_all(index, asked, 3, 100)
    assert rows(parted) == whole and len(whole) == 75
    assert "block" in parted._jdf.queryExecution().optimizedPlan().toString()


def test_recall_on_the_given_vectors(spark, sf_dir, tmp_path):
    """Ten nearest of every twentieth vector, against the exact scan."""
    v = table(spark, sf_dir, "embeddings")
    got = I.t01_candidates(spark, sf_dir).groupBy("query").agg(F.collect_set("vec_id").alias("ids")).collect()
    vectors = {r["vec_id"]: r["embedding"] for r in v.collect()}
    import numpy as np

    keys = np.array(sorted(vectors))
    x = np.array([vectors[k] for k in keys.tolist()], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    share = []
    for r in got:
        cos = x @ x[np.searchsorted(keys, r["query"])]
        best = set(keys[np.lexsort((keys, -np.round(cos, 6)))[:10]].tolist())
        share.append(len(best & set(r["ids"])) / len(best))
    assert len(got) == len([k for k in vectors if k % 20 == 0]) and sum(share) / len(share) >= 0.95


def test_no_vectors(spark, tmp_path):
    index = I.VectorIndex(spark, str(tmp_path / "v")).build(spark.createDataFrame([(1, [0.0])], "vec_id long, embedding array<float>"))
    assert index.search([1.0], 3).count() == 0


def test_rerank(spark):
    hits = spark.createDataFrame([(0, "a", "xx yy"), (1, "b", "the question"), (2, "c", "question")], "rank int, id string, text string")
    assert [r["id"] for r in rerank(hits, F.lit("question"), 2).collect()] == ["a", "b"] == [r["id"] for r in RERANKERS["none"](hits, 2).collect()]
    by_length = lambda q, t: F.when(t.contains(q), 1.0 / F.length(t)).otherwise(0.0)
    assert [r["id"] for r in rerank(hits, F.lit("question"), 2, by_length).collect()] == ["c", "b"]
