"""Spelling variants against the neighbours that one edit can make."""

import itertools
import random

import numpy as np
import pytest

from folium.llm import spelling

from .brute import variants


def found(spark, docs):
    table = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n long, word string")
    got = spelling.spelling_variants(table).collect()
    assert len({r["word"] for r in got}) == len(got)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(9)
    parts = ["th", "ing", "re", "on", "an", "ed", "Ü", "ñ", "ß", "EA", "x", "ÿ"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 5))) for _ in range(1500)]
    words += ["".join(p) for p in itertools.permutations("abcdef")]  # equal counts, one leaf
    words += ["y" * 40, "y" * 41, "y" * 40 + "x", "z" * 60, "z" * 61, "apple", "apples", "aple", "×÷×÷×", "×÷×÷"]
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "—x", "1", "中"]) for _ in range(400))) for i in range(60)]
    docs += [(100 + i, " ".join(words[-740:])) for i in range(3)] + [(200, "apple " * 9 + "applet " * 4), (201, "APPLET apples " * 3), (202, "aplet " * 3)]
    return docs + [(None, "Apple apple"), (7, docs[7][1]), (300, None), (301, ""), (302, " \n1 2 -- 中")]


def test_against_all_edits(spark, odd_texts):
    want = variants(odd_texts)
    assert found(spark, odd_texts) == want
    assert any(v[1] != v[0] for v in want.values() if v[0])  # chains are followed


def test_small_subtrees_and_leaves(spark, odd_texts, monkeypatch):
    for name, value in (("USUAL_DEPTH", 5), ("SUBTREES", 10**6), ("LEAF", 3), ("HELD", 50), ("COUNTED", 100)):
        monkeypatch.setattr(spelling, name, value)
    assert found(spark, odd_texts[:20] + odd_texts[63:]) == variants(odd_texts[:20] + odd_texts[63:])


def test_no_rows(spark):
    assert found(spark, []) == {} and found(spark, [(1, None), (2, "abc abc abc")]) == {}


def test_verifier():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 36))) for _ in range(300)} | {"a" * n for n in range(1, 36)})
    a, b = map(np.ravel, np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    a, b = a[a != b], b[a != b]

    def slow(x, y):
        if len(x) == len(y):
            return sum(p != q for p, q in zip(x, y, strict=True)) == 1
        x, y = sorted((x, y), key=len)
        return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))

    want = [slow(words[i], words[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert spelling.Verifier(words)(a, b).tolist() == want
    assert [spelling.one_edit(words[i], words[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)] == want


def test_sf_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.op12_spelling(spark, sf_dir).collect()}
    assert got == variants(docs)
