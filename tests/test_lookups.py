"""Operators over library tables on literal rows."""

from pyspark.sql import functions as F

from folium.operators import lookups as L


def got(df):
    return [tuple(r) for r in df.collect()]


def test_numbering_equals_a_sort(spark):
    values = [(None if i % 50 == 0 else "abc"[i % 3], (i * 7919) % 1000, i) for i in range(1000)]
    rows = spark.createDataFrame(values, "a string, b int, n0 int").repartition(7)
    out = {r.n0: r.n for r in L.numbered(rows, ["a", "b", "n0"]).collect()}
    order = sorted(values, key=lambda v: (v[0] is not None, v[0] or "", v[1], v[2]))
    assert out == {v[2]: i + 1 for i, v in enumerate(order)}
    assert got(L.numbered(rows.limit(0), ["b"])) == []


def test_numbering_when_keys_are_equal(spark):
    rows = spark.range(100).select(F.lit(1).alias("k"), "id")
    assert sorted(r.n for r in L.numbered(rows, ["k"]).collect()) == list(range(1, 101))


def test_rows_of_keys_pages_and_ranks(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "Xy"), (3, None, "xz"), (3, "c", "q")], "id int, name string, t string")
    assert sorted(got(L.matching(rows.select("id"), spark.createDataFrame([(3,), (3,), (None,)], "id int")))) == [(3,), (3,)]
    assert got(L.first_rows(rows.select("id", "name"), ["id", F.desc("name")], 2, 1)) == [(2, "b"), (3, "c")]
    assert got(L.containing(rows, {"t": "X"}).select("id").orderBy("id")) == [(2,), (3,)]
    cascade = L.key_tests(F.col("id"), F.col("name"), F.col("t"), "x")
    assert got(L.first_by_rank(rows, cascade, ["id"]).select("id")) == [(2,)]
    assert got(L.first_by_rank(rows, L.key_tests(F.col("id"), F.col("name"), F.col("t"), "none"), ["id"]).select("id")) == [(1,)]
    assert sorted(got(L.best_per_group(rows, ["id"], [F.desc("name")]).select("id", "name"))) == [(1, "a"), (2, "b"), (3, "c")]


def test_sessions_and_history(spark):
    sessions = spark.createDataFrame([("d", 1, 1, "open"), ("d", 2, 2, "None"), ("e", 1, 3, "x")], "doc string, at int, id int, state string")
    assert got(L.latest_sessions(sessions, "doc", "at", "id", "state").select("doc")) == [("e",)]
    messages = spark.createDataFrame([("system", "s"), ("user", " q "), ("assistant", "q"), ("user", "r")], "role string, text string")
    assert sorted(got(L.history(messages, F.lit("q")))) == [("assistant", "q"), ("user", "r")]
    tries = spark.createDataFrame([(1, False, 2), (2, False, 3), (3, True, 0)], "id int, ok boolean, n int")
    assert got(L.to_retry(tries, F.col("ok"), F.col("n")).select("id")) == [(1,)]


def test_fallbacks(spark):
    rows = spark.createDataFrame([(1, "own"), (2, None), (3, None), (4, None)], "id int, v string")
    first = spark.createDataFrame([(1, "f"), (2, "f"), (3, None)], "key int, x string")
    second = spark.createDataFrame([(13, "s")], "key int, x string")
    out = L.look_up_first(rows, [(first, F.col("id"), "x"), (second, F.col("id") + 10, "x")], "out", F.lit("-"), F.col("v"))
    assert sorted(got(out.select("id", "out"))) == [(1, "own"), (2, "f"), (3, "s"), (4, "-")]
    assert sorted(got(L.with_exists(rows.select("id"), second.union(second), "id", "key", "there"))) == [(i, False) for i in range(1, 5)]
    saved = spark.createDataFrame([(1, 5)], "id int, q int")
    assert sorted(got(L.get_or_compute(rows, saved, "id", "q", F.col("id") * 10)))[:2] == [(1, 5, "saved"), (2, 20, "computed")]


def test_previous_only_of_the_row_just_before(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 3, "c"), (2, 0, "d")], "s int, turn int, v string")
    out = L.with_previous(rows, "s", "turn", "v", F.lit(True), "p")
    assert sorted(got(out.select("s", "turn", "p"))) == [(1, 0, "a"), (1, 1, "a"), (1, 3, "c"), (2, 0, "d")]


def test_first_role_of_a_node(spark):
    a, b = (spark.createDataFrame([(i,) for i in ids], "k int") for ids in ([2], [1, 2, 3]))
    assert sorted(got(L.roles_of_nodes("k", central=a, sibling=b))) == [(1, "sibling"), (2, "central"), (3, "sibling")]


def test_counts(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("b", 3)], "g string, v int")
    assert got(L.count_where(rows, "total", big=F.col("v") > 2, gone=F.col("v").isNull())) == [(3, 1, 1)]
    assert got(L.largest_groups(rows, "g", 1)) == [("a", 2)]


def test_small_rules(spark):
    row = spark.range(1)
    cases = [
        (L.creation_year(F.lit("D:20210506")), "2021"), (L.creation_year(F.lit("1999-01")), "1999"), (L.year_of_date(F.lit("2021-05-06")), "2021"),
        (L.clean_arxiv_id(F.lit("arXiv:2101.1 ")), "2101.1"), (L.distance(F.lit(0), F.lit(0), F.lit(3), F.lit(4)), 5.0), (L.confidence_of_distance(F.lit(None).cast("int")), 0.5),
        (L.best_pdf_link(F.lit(None), F.lit("oa"), F.lit("10.1/x"), F.lit("land")), "oa"), (L.best_pdf_link(F.lit(None), F.lit(None), F.lit("10.1/x"), F.lit("land")), "https://doi.org/10.1/x"),
        (L.pseudo_count(F.lit(0.126)), 13), (L.side_of(F.lit(30), 25), 2),
        (L.vertical_threshold(F.lit(20.0), 800.0), 200),
    ]
    values = row.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(values) == [v for _, v in cases]
