import random

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    """A folder whose documents hold nulls in every column, empty and very long texts, ties, repeated rows and clashing names."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "Straße", "naïve", "x1", "the", "of"]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = body(60)
    rows = [(i, body(rng.randint(1, 80)), "en", f"s{i % 4}") for i in range(40)]
    rows += [(40 + i, base + f" tail{i}", "en", "s1") for i in range(5)]
    rows += [(50, base, "en", None), (51, base, None, "s2"), (51, base, None, "s2"), (52, None, "en", "s1"), (53, "", "de", "s1"), (54, " \n\t ", "de", "s1")]
    rows += [(None, base, "en", "s1"), (55, body(40_000), "en", "s3"), (56, "y" * 70_000, "en", "s3"), (57, "mail a.b@c.de, +1 (456) 555-2186 or 10.0.0.1", "en", "s3")]
    rows += [(58, "4111 1111 1111 1111 and 4111111111111112; iban GB82 WEST 1234 5698 7654 32. ssn: 219-09-9999, tel (555) 123-4567", "en", "s3"), (59, "a@b.c%d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 +12 34", "en", "s3"), (60, "one two", "en", "s3")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, target double, rep long"
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, 0.5, 0.1, 7) for r in rows], schema)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0) if i % 5 else None) for i in range(45)] + [(3, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, [float(rng.gauss(0, 1)) for _ in range(8)], 0) for i in range(30)]
    vectors += [(30, vectors[0][1], 1), (31, [x * 2 for x in vectors[0][1]], 1), (32, [x + 0.01 for x in vectors[1][1]], 1), (33, None, 1), (34, [0.0] * 8, 1), (35, [float("nan")] * 8, 1), (36, [1.0, None] * 4, 1), (37, [], 1), (38, [1.0, 2.0], 1), (39, [1.0, 2.0], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_docs(spark, odd_docs, tmp_path_factory):
    """The same tables without rows."""
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{odd_docs}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder
