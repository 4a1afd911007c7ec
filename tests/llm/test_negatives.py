"""Hard negatives against all products: ties, repeated rows, odd vectors, skewed lengths, and the bounds themselves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import negatives

from .brute import mined_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long"


def mined(spark, rows, **how):
    table = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = negatives.hard_negatives(table, F.col("vec_id") % 50 == 0, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def wanted(rows, **how):
    fine = [r for r in rows if None not in r and None not in r[1] and all(map(math.isfinite, r[1]))]
    return mined_negatives([(i, label, [math.floor(256 * x) for x in v]) for i, v, label in fine], **how)


@pytest.fixture(scope="module")
def odd_vectors():
    rng = random.Random(3)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = [(i, f32([c + rng.gauss(0, 0.3 + i % 3) for c in centre[i % 4]]), i % 4) for i in range(1200)]
    rows += [(i, [x * 40 for x in rows[i][1]], rows[i][2]) for i in range(0, 300, 7)]  # long ones, with ids that repeat
    rows += [(50, rows[50][1], rows[50][2]), (51, rows[50][1], 3), (1200, rows[0][1], 1)]  # equal rows: ties
    rows += [(2000, None, 1), (2050, [1.0] * 8, None), (2100, [1.0, None] * 4, 1), (2150, [float("nan")] * 8, 1), (2200, [float("inf")] * 8, 1), (None, [1.0] * 8, 1)]
    rows += [(2250, [0.0] * 8, 1), (2300, [], 1), (2301, [], 2), (2350, [1.0, 2.0], 1), (2351, [1.0, 2.0], 1), (2352, [0.5, 1.0], 2), (2400, [-1e-9] * 8, 2)]
    return rows


def test_against_all_products(spark, odd_vectors):
    assert mined(spark, odd_vectors) == wanted(odd_vectors)
    assert mined(spark, odd_vectors, positives=2, negatives=7, low=10, high=60) == wanted(odd_vectors, positives=2, negatives=7, low=10, high=60)


def test_many_slices_and_chunks(spark, odd_vectors, monkeypatch):
    for name, value in (("CHUNK_BYTES", 600), ("LEAST_ROWS", 20), ("BUCKET", 50), ("SAMPLE", 10)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, odd_vectors) == wanted(odd_vectors)


def test_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(50, [1.0], 1)]) == []


@pytest.mark.parametrize("spread", [0.05, 0.5, 3])
def test_buckets_lose_no_row(spread):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(6, 24)) * 200
    x = np.floor(centre[rng.integers(0, 6, 900)] + rng.normal(size=(900, 24)) * 200 * spread).astype(np.int64)
    anchors = x[::30] + 1
    buckets, exact = negatives.Buckets(x), anchors @ x.T
    least = np.sort(exact, axis=1)[:, -20]
    found = {(i, int(buckets.order[j])): s for start, stop in buckets.edges for a, b, c in buckets.search(anchors, least, start, stop) for i, j, s in zip(a.tolist(), b.tolist(), c.tolist(), strict=True)}
    assert {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(exact >= least[:, None])), strict=True)} <= set(found)
    assert all(exact[i, j] == s for (i, j), s in found.items())
    if spread < 0.1:
        assert len(found) < len(anchors) * len(x) / 3  # lists leave most rows out


def test_large_components_stay_exact():
    a = np.array([[2**40, -3], [2**53, 2**53]])
    assert negatives.products(a, a)[0, 0] == 2**63 - 1 and negatives.products(a[:1, 1:], a[:, 1:])[0].tolist() == [9, -3 * 2**53]
    b = np.array([[2**30 + 1, 7]])
    assert negatives.products(b, b)[0, 0] == (2**30 + 1) ** 2 + 49
