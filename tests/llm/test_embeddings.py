"""Embedding links against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from folium.llm import embeddings

from .brute import cosine_links, smallest_reachable


def check(spark, rows, element="float"):
    links = cosine_links([(i, None if v is None else [x if x is None else float(np.float32(x)) if element == "float" else x for x in v]) for i, v in rows])
    reach = smallest_reachable([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in links])
    degree = Counter(a for a, _ in links)
    got = embeddings.similar_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{element}>")).collect()
    assert sorted(map(tuple, got)) == sorted((i, degree[n], reach[i]) for n, (i, _) in enumerate(rows))
    return links


@pytest.mark.parametrize("first", [1, 1 << 62])
def test_chains_with_small_and_large_ids(spark, first):
    rng = random.Random(4)
    plane = [(first + n, [float(np.cos(n * 0.28)), float(np.sin(n * 0.28))]) for n in range(20)]
    order = [i for i, _ in plane]
    rng.shuffle(order)
    links = check(spark, [(i, v) for i, (_, v) in zip(order, plane, strict=True)])
    assert len(links) >= 38


@pytest.mark.parametrize("block", [8192, 7])
def test_blocks_and_cells_meet_once(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "PER_CELL", 40)
    monkeypatch.setattr(embeddings, "GUEST", 1)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 24))
    rows = [(int(i), (centres[i % 6] + rng.normal(size=24) * (0.05 + 0.4 * (i % 5))).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(5)] + [(rows[0][0], (np.array(rows[0][1]) * 2).tolist())]
    assert len(check(spark, rows)) > 500


def test_double_vectors_keep_their_precision_and_scale(spark):
    rows = [(1, [1.0, 0.0]), (2, [1e300, 1e299]), (3, [1e-60, 0.0]), (4, [1e-310, 0.0]), (5, [0.0, 5e-324]), (6, [-1.0, 0.0]), (7, [float("inf"), 1.0])]
    assert {(a, b) for a, b in check(spark, rows, "double")} >= {(0, 1), (0, 2), (0, 3)}


def test_links_between_is_every_pair():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 40))
    x[200:300] = x[:1] + 0.1 * rng.normal(size=(100, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = embeddings.links_between(x[:250], x[150:], 0.95)
    a, b = np.nonzero(x[:250] @ x[150:].T >= 0.95)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(a.tolist(), b.tolist(), strict=True)) and len(a) > 1000


def test_cells_lose_no_link():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = embeddings.spherical_kmeans(x, 12)
    home, members = embeddings.membership(x, centres, 0.95)
    i, j = np.nonzero(x @ x.T >= 0.95)
    assert (members[j, home[i]] ^ members[i, home[j]] | (home[i] == home[j])).all()


def test_joined_groups_are_components():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 500, 300), rng.integers(0, 500, 300)
    reach = smallest_reachable(range(500), zip(a.tolist(), b.tolist(), strict=True))
    assert embeddings.join_groups(np.arange(500), a, b).tolist() == [reach[i] for i in range(500)]
