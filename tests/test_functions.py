"""Text, reference and fold functions on literal rows, with the cases that are easy to get wrong."""


import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folium.functions import references as R
from folium.functions import text as T
from folium.operators import citations, documents, keywords, layout, library, retrieval
from folium.sources import files, sinks


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)) if names else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("word, lemma, short", [
    ("studies", "study", "study"), ("boxes", "box", "box"), ("names", "name", "name"), ("classes", "class", "class"), ("glass", "glass", "glass"),
    ("running", "run", "runn"), ("making", "make", "mak"), ("planned", "plan", "plann"), ("carried", "carry", "carri"), ("Used", "used", "used"),
])
def test_lemmas(spark, word, lemma, short):
    assert one(spark, T.lemma(F.col("w")), w=word) == lemma
    assert one(spark, T.short_lemma(F.col("w")), w=word) == short


def test_reference_fields(spark):
    raw = '[3] Smith, J., and Lee, K. "A title here". (2015) doi:10.1234/ab.c. https://doi.org/10.1/z https://example.org/x, '
    assert one(spark, R.doi(F.col("r")), r=raw) == "10.1234/ab.c"
    assert one(spark, R.url(F.col("r")), r=raw) == "https://example.org/x"
    assert one(spark, R.year(F.col("r")), r=raw) == 2015
    assert one(spark, R.year(F.col("r")), r="(1234) then 1999") == 1999
    assert one(spark, R.title(F.col("r")), r=raw) == "A title here"
    assert one(spark, R.doi(F.col("r")), r="nothing") is None


@pytest.mark.parametrize("raw, title, names", [
    ("(4) Jones, A. et al. Learning about numbers. 1985 arXiv:2101.01234v2", "Learning about numbers", ["Jones, A."]),
    ("Miller, T. M., Ruiz-Lee, K. (2004a). A short history of maps. In Proc. of X. https://a.b/c", "A short history of maps", ["Miller, T. M.", "Ruiz-Lee, K."]),
    ("Plain words without any sign", "Plain words without any sign", None),
    ("see https://a.b/c", None, None),
])
def test_titles_and_authors(spark, raw, title, names):
    assert one(spark, R.title(F.col("r")), r=raw) == title and one(spark, R.authors(F.col("r")), r=raw) == names


@pytest.mark.parametrize("raw, doi, arxiv, url", [
    ("(see doi.org/10.1002/(sici)1097-4571(1999)50:1).", "10.1002/(sici)1097-4571(1999)50:1)", None, None),
    ("[10.1234/abc]; arXiv: hep-th/9901001 and http://www.x.org/a_(b).", "10.1234/abc", "hep-th/9901001", "http://www.x.org/a_(b)"),
    ("https://arxiv.org/pdf/2113.01234 https://ARXIV.org/abs/2112.01234v10", None, "2112.01234v10", None),
])
def test_identifiers(spark, raw, doi, arxiv, url):
    assert one(spark, R.doi(F.col("r")), r=raw) == doi and one(spark, R.arxiv_id(F.col("r")), r=raw) == arxiv and one(spark, R.url(F.col("r")), r=raw) == url


def test_clusters_are_anchored_at_their_first_x(spark):
    lines = spark.createDataFrame([(1, float(x)) for x in (24, 0, 8, 16, 100, 0, 109, 111)] + [(2, 5.0)], "page int, x double")
    got = layout.x_clusters(lines, "page", "x").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 3, 0.0), (1, 2, 2, 16.0), (1, 3, 2, 100.0), (1, 4, 1, 111.0), (2, 1, 1, 5.0)]


def test_items_to_lines(spark):
    items = spark.createDataFrame([(1, 1, 5.0, 10.0, "b"), (1, 2, 1.0, 11.5, "a"), (1, 3, 0.0, 12.5, "c"), (1, 4, 0.0, 40.0, "d")], "page int, o int, x double, y double, t string")
    got = layout.items_to_lines(items, "page", "o", "x", "y", "t").orderBy("line").collect()
    assert [r["text"] for r in got] == ["a b", "c", "d"]


def test_search_texts_equals_fitted_search(spark):
    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "red bird"), (3, None), (4, ""), (5, "blue bird red bird")], "doc_id int, text string")
    words = spark.createDataFrame([("red",), ("bird",), ("none",)], "term string")
    fitted = retrieval.keyword_search(retrieval.fit_tfidf(docs)[1], words, 10).collect()
    assert [(r[0], round(r[1], 9)) for r in fitted] == [(r[0], round(r[1], 9)) for r in retrieval.search_texts(docs, words, 10).collect()]
    assert [r[0] for r in fitted] == [2, 5, 1]


def test_frequent_terms_are_counted_by_hash_first(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SPARE", 1)
    docs = spark.createDataFrame([(1, "aa bb aa cc"), (2, "aa bb dd"), (2, "bb aa"), (3, None), (None, "cc ee"), (4, "ff gg hh")], "doc_id int, text string")
    tf = retrieval.term_counts(docs, bigrams=False)
    assert {(r["doc_id"], r["term"]): r["tf"] for r in tf.where("doc_id = 2").collect()} == {(2, "aa"): 2, (2, "bb"): 2, (2, "dd"): 1}  # a key in two rows
    tf = retrieval.term_counts(docs.where("doc_id <> 2 or text like '%dd'"), bigrams=False)
    assert "Aggregate" not in tf._jdf.queryExecution().optimizedPlan().toString()  # terms are counted within their rows
    few = retrieval.often_enough(tf, retrieval.hashed_terms(docs, "doc_id", "text", False), 2)
    assert {r["term"] for r in few.collect()} == {"aa", "bb", "cc"}  # the two asked for, and what else reaches the count
    assert [tuple(r) for r in retrieval.most_frequent(tf, 3).collect()] == [("aa", 2, 3), ("bb", 2, 2), ("cc", 1, 1)]


def test_embedder_hands_over_numbers(spark):
    import zlib

    import numpy as np

    texts = ["red fish blue fish", "", None, "é ñandú x 12"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("v", retrieval.hashing_embedder(F.col("text")))
    assert "array<int>" in str(got._jdf.queryExecution().executedPlan().toString()) or "crc32" in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        v = np.zeros(64)
        for w in {0: ["red", "fish", "blue", "fish"], 3: ["ñandú", "12"]}.get(r["i"], []):
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h >> 16 & 1 else -1
        assert r["v"] == (v / (np.linalg.norm(v) or 1)).tolist()


def test_sentences_are_dealt_without_vectors(spark):
    rows = [(1, [1.0, 2.0, 0.3]), (2, [0.1, -5.0, 7.0]), (3, [0.0, 0.0, 0.0]), (4, None)]
    both = spark.createDataFrame(rows, "i int, v array<double>").crossJoin(spark.createDataFrame(rows, "j int, w array<double>"))
    got = both.select(retrieval.cosine(F.col("v"), F.col("w")).alias("a"), retrieval.vector_cosine(F.col("v"), F.col("w")).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and sum(r["a"] is None for r in got) == 12
    docs = spark.createDataFrame([(1, "# A\nOne two three. Four five. Six ![c](i/a.png) seven! i/b.png ![d](i/b.png)"), (2, None)], "doc_id int, text string")
    chunks = documents.chunk_markdown(docs)
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") < 5  # parts are not joined to their chunks again
    assert {i["path"] for r in chunks.collect() for i in r["images"]} == {"i/a.png", "i/b.png"}


def test_quote_plus(spark):
    from urllib.parse import quote_plus

    text = "a~b*c d/é?&="
    assert one(spark, T.quote_plus(F.col("t")), t=text) == quote_plus(text)


def test_renumbering(spark):
    answer = "x [c3] y [c1] z [c3]"
    assert one(spark, citations.renumber(F.col("a")), a=answer) == "x [c1] y [c2] z [c1]"
    assert one(spark, citations.renumber(F.col("a"), chained=True), a=answer) == "x [c2] y [c2] z [c2]"


def test_set_operations_keep_duplicates(spark):
    a = F.array(F.lit(1), F.lit(1), F.lit(2))
    assert one(spark, library.set_add(a, F.lit(2))) == [1, 1, 2]
    assert one(spark, library.set_remove(a, F.array(F.lit(2)))) == [1, 1]


def test_line_joining(spark):
    lines = F.split(F.col("t"), r"\|")
    assert one(spark, citations.join_lines(lines), t="exam-|ple of|http:|//x/|y") == "example of http://x/y"


def test_merge_compares_with_the_merged_box(spark):
    boxes = spark.createDataFrame([("d", 0.1, 0.10, 0.20, 0.12), ("d", 0.1, 0.24, 0.30, 0.12), ("d", 0.1, 0.34, 0.40, 0.12), ("d", 0.5, 0.1, 0.2, 0.52)], "dest string, y1 double, x1 double, x2 double, y2 double")
    assert citations.merge_boxes(boxes).count() == 2


def test_occurrences_do_not_overlap(spark):
    assert one(spark, documents.occurrences(F.col("t"), F.lit("aa")), t="aaaaa AA") == [0, 2, 6]


def test_matches_do_not_overlap(spark):
    docs = spark.createDataFrame([(1, "deep neural networks and neural network models")], "doc_id long, text string")
    terms = keywords.prepared_terms(spark.createDataFrame([("neural network",), ("deep neural network",), ("network model",), ("model",)], "name string"))
    got = sorted((r["start"], r["form"]) for r in keywords.leftmost_longest(keywords.candidates(docs, terms)).collect())
    assert got == [(1, "deep neural network"), (5, "neural network"), (7, "model")]


def test_diverse_selection_starts_with_the_best(spark):
    rows = spark.createDataFrame([(1, "deep model", 0.9), (1, "deep model tree", 0.8), (1, "graph", 0.7)], "doc_id long, keyword string, score double")
    got = [r["keyword"] for r in keywords.select_diverse(rows, 2, weight=0.5).orderBy("rank").collect()]
    assert got == ["deep model", "graph"]


def test_merging_keeps_the_total(spark):
    rows = spark.createDataFrame([(1, "data models", 3, None, 0.5), (1, "data model", 2, "u", 0.4), (1, "graph", 1, None, 0.3)], "doc_id long, keyword string, count long, url string, score double")
    got = {r["keyword"]: (r["count"], r["merged"]) for r in keywords.merge_synonyms(rows).collect()}
    assert got == {"data model": (5, 2), "graph": (1, 1)}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 10), word=st.sampled_from(["model", "graph"]))
def test_counts_whole_words_only(spark, n, word):
    text = f" {word}," * n + f" pre{word} {word}post"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r["keyword"], r["n"]) for r in keywords.counted_keywords(docs, [word]).collect()] == [(word.title(), n)]


def test_streamed_state_equals_the_table(spark, sf_dir, tmp_path):
    from folium.session import table
    from folium.streaming import status

    events = table(spark, sf_dir, "events")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    keys = ["user_id", "event_type"]
    stream = status.latest_per_key(status.read_events(spark, source, events.schema), keys, "ts", "value", "event_id")
    got = status.run_to_table(stream, "latest_state", str(tmp_path / "check")).select(*keys, "value")
    want = status.latest_per_key(events, keys, "ts", "value", "event_id").select(*keys, "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_scans(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1,\n "t": "x"}')
    (tmp_path / "b.json").write_text('{"id": broken')
    rows = files.read_parsed_json(spark, str(tmp_path), "id long, t string").collect()
    assert sorted((r["id"] is None, r["t"]) for r in rows if r["t"] or r["id"] is None) == [(False, "x"), (True, None)]
    (tmp_path / "r.xml").write_text('<a><biblStruct><analytic><title>T</title><author><persName><surname>S</surname></persName></author></analytic><monogr><imprint><date when="2019-01"/></imprint></monogr></biblStruct></a>')
    assert tuple(files.read_tei_references(spark, str(tmp_path / "r.xml")).first()) == ("T", ["S"], "2019")
    assert files.list_files(spark, str(tmp_path / "*.json")).count() == 2


def test_partition_overwrite_leaves_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    library.write_partitioned(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    library.write_partitioned(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_whole_texts_by_the_start_of_their_names(spark, tmp_path):
    for name in ("paper-1.md", "paper-2.md", "other.md"):
        (tmp_path / name).write_text(f"# {name}\n")
    assert sorted(r["text"] for r in files.read_whole_texts(spark, str(tmp_path), "paper-").collect()) == ["# paper-1.md\n", "# paper-2.md\n"]


def test_file_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c\nd', None), (2, "", "x")], "id int, text string, note string")
    sinks.write_table(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv")).where("id = '1'").first()["text"] == 'a "b", c\nd'
    for _ in range(2):
        sinks.write_chunks(rows, str(tmp_path / "json"), "id")
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "json")).select("id", "text", "note").collect())) == [(1, 'a "b", c\nd', None), (2, "", "x")]
    found = spark.createDataFrame([(1, "doi", "10.1/x", 0.95), (1, "inline", "(A, 2000)", 0.4), (1, "inline", "(B, 2001)", 0.9)], "doc_id int, type string, text string, confidence double")
    sinks.write_reports(found, str(tmp_path / "reports"))
    report = spark.read.json(str(tmp_path / "reports")).first()
    assert (report["summary"]["total"], report["summary"]["average"], report["summary"]["high"], report["summary"]["low"]) == (3, 0.75, 2, 1)
    assert report["summary"]["by_type"].asDict() == {"doi": 1, "inline": 2} and len(report["citations"]) == 3
    hits = spark.createDataFrame([(1, "b"), (0, "a")], "rank int, id string")
    for _ in range(2):
        sinks.append_retrieval_log(hits, "why", str(tmp_path / "log"))
    logged = spark.read.json(str(tmp_path / "log")).collect()
    assert len(logged) == 2 and [h["id"] for h in logged[0]["hits"]] == ["a", "b"]
