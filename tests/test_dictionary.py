"""Dictionary matching: both methods on documents, the automaton on hard cases, and lemmas against the Column rule."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.operators import dictionary
from folium.operators.dictionary import Automaton, Lemmas, by_length, find_terms, from_the_left
from folium.operators.keywords import prepared_terms
from folium.session import table


def rows(found):
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("take", ["leftmost", "longest"])
def test_methods_agree_on_documents(spark, sf_dir, take):
    docs, terms = table(spark, sf_dir, "documents"), dictionary._terms(spark, sf_dir)
    found = rows(find_terms(docs, terms, take=take))
    assert found and found == rows(find_terms(docs, terms, take=take, method="ngrams"))
    common = prepared_terms(spark.createDataFrame([("the",), ("the of",), ("of the and",), ("ing of the",)], "name string"))
    found = rows(find_terms(docs, common, take=take))
    assert len(found) > 500 and found == rows(find_terms(docs, common, take=take, method="ngrams"))


def test_no_overlap_and_longest_wins(spark):
    terms = prepared_terms(spark.createDataFrame([("neural network",), ("neural networks model",), ("network",), ("model of model of x",), ("...",)], "name string"))
    docs = spark.createDataFrame([(1, "Neural networks, models of models: network."), (2, None), (3, ""), (None, "a network"), (4, "neural neural networks modeling network")], "doc_id long, text string")
    want = [(None, 2, 1, "network"), (1, 1, 3, "neural network model"), (1, 6, 1, "network"), (4, 2, 2, "neural network"), (4, 5, 1, "network")]
    assert rows(find_terms(docs, terms)) == sorted(want, key=str)
    assert rows(find_terms(docs, terms).where("doc_id = 1")) == rows(find_terms(docs, terms, method="ngrams").where("doc_id = 1"))
    with pytest.raises(ValueError):
        find_terms(docs, terms, method="trie")


def test_automaton_finds_every_run():
    rng = random.Random(2)
    for _ in range(300):
        terms = [[rng.choice("abc") for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 12))]
        words = [rng.choice("abcd") for _ in range(30)]
        want = sorted({(i, len(t)) for t in terms for i in range(len(words)) if words[i : i + len(t)] == t})
        found = list(Automaton(terms).matches(words))
        assert sorted(found) == want
        at, left = 0, []
        while at < len(words):  # a scan, word by word
            n = max((m for i, m in want if i == at), default=0)
            if n:
                left.append((at, n))
            at += n or 1
        assert from_the_left(found) == left
        longest = []
        for i, n in sorted(want, key=lambda m: (-m[1], m[0])):
            if all(i + n <= j or j + m <= i for j, m in longest):
                longest.append((i, n))
        assert by_length(found) == longest


def test_lemmas_are_the_columns(spark, sf_dir):
    odd = "s ss es ses xes ties dies flies dishes boss classes ing ring sing being running making ed red need tied planned played aes ches quizzes busses iesed".split()
    words = table(spark, sf_dir, "documents").select(F.explode(T.word_list(T.plain_words(F.col("text")))).alias("w")).union(spark.createDataFrame([(w,) for w in odd], "w string")).distinct()
    known = Lemmas()
    assert all(known[r["w"]] == r["l"] for r in words.select("w", T.lemma(F.col("w")).alias("l")).collect())


def test_large_dictionaries_are_joined(spark, monkeypatch):
    terms = prepared_terms(spark.createDataFrame([("alpha beta",), ("beta",)], "name string"))
    docs = spark.createDataFrame([("x", "alpha beta beta")], "k string, t string")
    want = [("x", 1, 2, "alpha beta"), ("x", 3, 1, "beta")]
    assert rows(find_terms(docs, terms, "k", "t")) == want
    monkeypatch.setattr(dictionary, "MAX_TERMS", 1)
    assert rows(find_terms(docs, terms, "k", "t")) == want


def test_texts_are_scanned_in_slices():
    texts = [None if i % 97 == 0 else f"the cats {i}" for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts)], names=["doc_id", "words"])
    found = list(dictionary.scan_texts(iter([batch, batch.slice(0, 0)]), Automaton([["cat"]]), from_the_left, "doc_id", pa.int64()))
    assert len(found) > 1 and max(b.num_rows for b in found) <= dictionary.SLICE
    rows = [r for b in found for r in b.to_pylist()]
    assert rows == [{"doc_id": i, "start": 2, "n": 1, "form": "cat"} for i in range(1000) if i % 97]
