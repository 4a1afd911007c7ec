"""Many queries against vectors in cells: what tasks get stays bounded, and the best are those of the plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.operators import index as I


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8))
    x[350:420] = x[:70]  # equal vectors tie
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").cache()


@pytest.mark.parametrize("slice_rows", [15, 100, 5000])
def test_slices_have_every_cell(slice_rows):
    rng = np.random.default_rng(2)
    held = {c: int(n) for c, n in enumerate(rng.integers(0, 60, 40)) if n}
    dealt, edges = I.slices_of(held, 40, slice_rows)
    for cell, first, parts, place in dealt:
        for s in range(first, first + parts):
            assert edges[s][0] + place == cell < edges[s][1]
    rows = [sum(held.get(c, 0) / dealt[c][2] for c in range(a, b)) for a, b in edges.tolist()]
    assert max(rows) <= slice_rows and [c for c, *_ in dealt] == list(range(40))


def test_a_query_goes_to_slices_not_to_cells(spark, vectors, tmp_path):
    """Rows between the visits and the search: a query with its vector once for each slice, however many cells it visits there."""
    index = I.VectorIndex(spark, str(tmp_path / "v")).build(vectors, cells=40)
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    for slice_rows in (9, 90, 4096):
        found = I.search_all(index, asked, 5, 500, slice_rows=slice_rows)
        got = {}
        for r in found.orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append((r["vec_id"], round(r["cos"], 5)))
        assert len(got) == 35
        for r in asked.where("query % 140 = 0").collect():
            assert got[r["query"]] == [(x["vec_id"], round(x["cos"], 5)) for x in index.search(r["q"], 5, 500).collect()]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "slice" in plan and "MapInPandas visits" in plan
    visits = next(line for line in plan.splitlines() if "MapInPandas visits" in line)
    assert "cell" not in visits and "named" in visits
