"""Substring dedup against windows held in a dictionary."""

import hashlib
import random

import pytest

from folium.llm import repeats

from .brute import without_repeats


def removed(spark, docs, partitions=3, **how):
    table = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, chunk long, lines string").repartition(partitions)
    got = repeats.repeated_passages(table, kept_text=True, **how).collect()
    for r in got:
        assert r["n_removed"] == sum(s["length"] for s in r["spans"]) and r["kept_sha256"] == hashlib.sha256(r["kept"].encode()).hexdigest()
    return sorted(((r["doc_id"], r["n_words"], [(s["start"], s["length"]) for s in r["spans"]], r["kept"]) for r in got), key=str)


def wanted(docs, window=13):
    out = []
    for (doc, _), (gone, words) in zip(docs, without_repeats(docs, window), strict=True):
        spans, at = [], 0
        while at < len(gone):
            stop = at
            while stop < len(gone) and gone[stop]:
                stop += 1
            if stop > at:
                spans.append((at, stop - at))
            at = stop + 1
        out.append((doc, len(words), spans, " ".join(w for w, x in zip(words, gone, strict=True) if not x)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(4)
    body = lambda n, k=40: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    shared, licence = body(60), "this is a line of a licence that very many of the documents hold as it is"
    docs = [(i, body(rng.randint(0, 120), 4000)) for i in range(40)]
    docs += [(40 + i, f"{body(20, 900)} {licence}\n{body(20, 900)}") for i in range(30)]
    docs += [(80 + i, f"{body(i)} {shared} {body(9 - i)}") for i in range(9)] + [(-5, shared), (95, shared), (95, shared), (96, shared + " " + shared)]
    docs += [(100, "a b " * 200), (101, "a b " * 90), (102, "a " * 50), (103, "a " * 50 + "b"), (104, " ".join(shared.split()[:12])), (105, " ".join(shared.split()[:13]))]
    docs += [(None, shared), (None, shared), (110, None), (111, ""), (112, " \t\n"), (113, "y" * 70_000), (114, body(30_000)), (115, "y" * 70_000 + " " + licence), (116, "Straße naïve " * 14), (117, "Straße naïve " * 14), (118, licence.upper())]
    return docs


def test_against_windows(spark, odd_texts):
    assert removed(spark, odd_texts) == wanted(odd_texts)


def test_small_chunks_groups_and_shuffled_answers(spark, odd_texts, monkeypatch):
    for name, value in (("CHUNK", 300), ("PER_BUCKET", 300), ("PER_GROUP", 100), ("BROADCAST_BYTES", 0), ("PREFIX", 5)):
        monkeypatch.setattr(repeats, name, value)
    assert removed(spark, odd_texts, 5) == wanted(odd_texts)


@pytest.mark.parametrize("window", [1, 2, 7, 20])
def test_other_windows(spark, odd_texts, window):
    some = [x for x in odd_texts if x[0] not in (114,)]
    assert removed(spark, some, window=window) == wanted(some, window)


def test_no_rows(spark):
    assert removed(spark, []) == [] and removed(spark, [(1, None)]) == [(1, 0, [], "")]
