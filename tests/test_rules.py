"""Rules of references, lines, keywords and records on literal rows, and folds against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from folium.functions import references as R
from folium.functions import text as T
from folium.operators import documents, headings, keywords, layout, records
from folium.sources import files

from .test_functions import one


@pytest.mark.parametrize("title, clean, names", [
    ("Anna Smith and Bert K. Lee. 2019. A study.", "A study", ["Anna Smith", "Bert K. Lee"]),
    ("J. Brown, and K. Lee. 2001. More", "More", ["J. Brown", "K. Lee"]),
    ("2019a. Late things. 1999.", "Late things", []), ("2019 Things", "Things", []), (" . Plain things. ", "Plain things", []), ("", "", []), ("Year 2019 inside", "Year 2019 inside", []),
])
def test_titles(spark, title, clean, names):
    assert one(spark, R.clean_title(F.col("t")), t=title) == clean
    assert one(spark, R.title_authors(F.col("t")), t=title) == names


def test_long_names_are_linear(spark):
    assert one(spark, R.clean_title(F.col("t")), t="Aa Bb, " * 5000 + "!") == "Aa Bb, " * 5000 + "!"


def test_repair(spark):
    rows = spark.createDataFrame([("Anna Smith. 2019. T.", None, None, "2018. V"), ("T 1999", "x", ["", "A"], None), (None, "in 2001", [" "], None)], "t string, y string, a array<string>, v string")
    got = [tuple(r) for r in rows.select(*R.repair(F.col("t"), F.col("y"), F.col("a"), F.col("v"))).collect()]
    assert got == [("T", "2019", ["Anna Smith"], "V"), ("T 1999", None, ["A"], None), (None, "2001", [], None)]


@pytest.mark.parametrize("text, title, names, year", [
    ("[1] Smith J, and Lee K. 2001. Long title of it. Journal. Press", "Long title of it", ["Smith J", "Lee K"], 2001),
    ("Smith. A title without year. Journal", "A title without year", ["Smith"], None),
    ("Smith 2003. Only.", "Smith 2003. Only.", ["Smith 2003"], 2003), ("Smith 2003. Only this.", "Only this", ["Smith 2003"], 2003), ("word", "word", ["word"], None), ("", "", [], None),
])
def test_popup_fields(spark, text, title, names, year):
    row = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in zip("abc", R.popup_fields(F.col("t")))]).first()
    assert tuple(row) == (title, names, year)


@pytest.mark.parametrize("text, form, title", [
    ("[3] Smith J and Lee K (1999). A study. Venue", "authorYear", "A study"), ("A study. Smith J, 1999. Venue", "titleFirst", "A study"), ("Smith 1999 rest", "simple", ""), ("nothing", "unknown", ""),
])
def test_components(spark, text, form, title):
    c = one(spark, R.components(F.col("t")), t=text)
    assert (c["format"], c["title"]) == (form, title)


@pytest.mark.parametrize("line, kind, level, score", [
    ("1.2 Related work", "arabic", 2, 150), ("21 Results", "arabic", 1, 0), ("17 -- Tracked", "arabic", 1, 0), ("4 1 3", "arabic", 1, 0), ("1 @dataclass Foo", "arabic", 1, 0), ("1 Some new thing", "arabic", 1, 100),
    ("A.1 Proofs", "letter", 2, 100), ("V V B B", "letter", 1, 0), ("I Introduction", "letter", 1, 150), ("IV. Methods", "roman", 1, 150), ("IIII Methods", "roman", 1, 0), ("a) Setting", "sub", 2, 100),
    ("(a) small", "parentheses", 2, 0), ("(12) Large", "parentheses", 2, 100), ("References", "", 1, 100), ("Data", "", 1, 0), ("Plain text.", "", 1, 0),
])
def test_section_numbers(spark, line, kind, level, score):
    s = one(spark, headings.section_number(F.col("t")), t=line)
    assert (s["kind"], s["level"], s["score"]) == (kind, level, score)


@pytest.mark.parametrize("line, score", [("Title Case Here", 100), ("Title case here", 0), ("ALL CAPS", 100), ("AB", 100), ("lower", 0), ("Has 1 digit", 0), ("One Two Three Four Five Six Seven Eight Nine", 0)])
def test_case_scores(spark, line, score):
    assert one(spark, headings.case_score(F.col("t")), t=line) == score


@pytest.mark.parametrize("word, valid", [("neural nets", True), ("abc", False), ("four words in here", False), ("gpt 4 model", False), ("bengio model", False), ("future working", False), ("Deep Learning", True)])
def test_valid_keywords(spark, word, valid):
    assert one(spark, T.is_valid_keyword(F.col("w")), w=word) is valid


def test_keywords_alike_are_left_out(spark):
    rows = spark.createDataFrame([(1, "deep nets", 0.1), (1, "deep net", 0.2), (1, "shallow", 0.3), (1, "shadow", 0.35), (1, "broad", 0.4), (2, "deep net", 0.5), (1, "other", 0.6)], "doc_id long, keyword string, score double")
    got = sorted((r["doc_id"], r["keyword"]) for r in keywords.best_distinct(rows, 3).collect())
    assert got == [(1, "broad"), (1, "deep nets"), (1, "shallow"), (2, "deep net")]


def test_long_terms_match(spark):
    terms = keywords.prepared_terms(spark.createDataFrame([("one two three four five six",), ("five six",), ("two",)], "name string"))
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, ""), (3, None), (4, "five")], "doc_id long, text string")
    found = keywords.candidates(docs, terms)
    assert sorted((r["doc_id"], r["start"], r["n"]) for r in found.collect()) == [(1, 1, 6), (1, 2, 1), (1, 5, 2)]
    assert [(r["start"], r["n"]) for r in keywords.leftmost_longest(found).collect()] == [(1, 6)]


def test_merge_asks_for_one_category(spark):
    rows = [(1, "red blue green data", 1, None, 0.9, "X"), (1, "red blue green vision", 1, None, 0.8, "Y"), (1, "green blue red speech", 1, None, 0.7, "X")]
    got = {r["keyword"]: r["merged"] for r in keywords.merge_synonyms(spark.createDataFrame(rows, "doc_id long, keyword string, count long, url string, score double, category string")).collect()}
    assert got == {"red blue green data": 1, "red blue green vision": 1, "green blue red speech": 1}
    three = [(1, "a b c d", 1, None, 0.9, "X"), (1, "d c b a", 2, None, 0.8, "X"), (1, "c a d b", 1, None, 0.7, "Y")]
    got = {r["keyword"]: r["merged"] for r in keywords.merge_synonyms(spark.createDataFrame(three, "doc_id long, keyword string, count long, url string, score double, category string")).collect()}
    assert got == {"a b c d": 2, "c a d b": 1}


def test_single_words_where_nothing_is_longer(spark):
    rows = spark.createDataFrame([(1, "alpha", 5, None), (1, "omega", 9, None), (2, "alpha beta", 1, None), (2, "gamma", 7, None)], "doc_id long, keyword string, count long, url string")
    assert sorted((r["doc_id"], r["keyword"]) for r in keywords.refine_concepts(rows).collect()) == [(1, "alpha"), (1, "omega"), (2, "alpha beta")]


def _lines(items, tolerance, gap, in_order):
    """Lines of (pos, x, y, width) by the rule, item after item."""
    lines = []
    if in_order:
        for i in sorted(items):
            last = lines[-1] if lines else None
            if last and abs(last[0][2] - i[2]) <= tolerance and i[1] - (last[-1][1] + last[-1][3]) <= gap:
                last.append(i)
            else:
                lines.append([i])
        return sorted(sorted(i[0] for i in line) for line in lines)
    for i in sorted(items, key=lambda i: (-i[2], i[0])):
        home = next((line for line in lines if abs(line[0][2] - i[2]) <= tolerance), None)
        home.append(i) if home else lines.append([i])
    out = []
    for line in lines:
        part = []
        for i in sorted(line, key=lambda i: (i[1], i[0])):
            if part and i[1] - (part[-1][1] + part[-1][3]) > gap:
                out.append(part)
                part = []
            part.append(i)
        out.append(part)
    return sorted(sorted(i[0] for i in part) for part in out)


@pytest.mark.parametrize("in_order", [False, True])
def test_lines_against_brute_force(spark, in_order):
    rng = random.Random(5)
    pages = {p: [(i, float(rng.randrange(0, 200)), float(rng.randrange(0, 40)), float(rng.randrange(1, 30))) for i in range(60)] for p in range(4)}
    rows = spark.createDataFrame([(p, *i) for p, items in pages.items() for i in items] + [(9, 0, None, 1.0, 1.0)], "page long, pos long, x double, y double, width double")
    placed = layout.numbered_lines(rows, "page", "pos", "x", "y", "width", 2.0, 20.0, in_order).collect()
    for p, items in pages.items():
        got: dict = {}
        for r in placed:
            if r["page"] == p:
                got.setdefault(r["line"], []).append(r["pos"])
        assert sorted(sorted(v) for v in got.values()) == _lines(items, 2.0, 20.0, in_order)
    assert {r["page"] for r in placed} == set(pages)


def test_text_lines(spark):
    rows = spark.createDataFrame([(1, 0, 5.0, " b ", "f", 10.0, 0, 1.0), (1, 1, 1.0, "a", "g", 0.0, 0, 1.0), (1, 2, 9.0, "", "g", 20.0, 0, 1.0), (2, 0, 1.0, None, None, None, 0, 3.0)], "page long, pos long, x double, text string, font string, size double, line long, line_y double")
    got = {r["page"]: (r["text"], r["font"], r["size"], r["x"]) for r in layout.text_lines(rows, "page", "pos", "x", "text", "font", "size").collect()}
    assert got == {1: ("a b", "g", 15.0, 1.0), 2: ("", "", 0.0, 1.0)}


def test_rectangles(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 100.0, 0.0, 110.0, 10.0), (1, 2, 35.0, 0.0, 75.0, 10.0), (1, 3, 5.0, 5.0, 5.0, 9.0), (2, 0, 1.0, 1.0, 1.0, 1.0)], "page long, pos long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["page"], r["n"], r["x0"], r["x1"]) for r in layout.merge_rectangles(rows, "page", "pos").collect())
    assert got == [(1, 1, 100.0, 110.0), (1, 2, 0.0, 75.0)]


def test_guarded_additions(spark):
    c = spark.createDataFrame([(1, "u", [5], 0), (2, "u", None, 0), (3, "v", [5, 5], 0)], "collection_id long, user_id string, document_ids array<long>, updated_at int")
    d = spark.createDataFrame([(5, "u"), (6, "u"), (7, "v")], "document_id long, user_id string")
    r = spark.createDataFrame([(1, "u", 5), (2, "u", 6), (2, "u", 7), (3, "u", 5), (3, "v", 7), (3, "v", 7), (4, "u", 5)], "collection_id long, user_id string, document_id long")
    after, touched = records.add_guarded(c, d, r, F.lit(1))
    assert {x["collection_id"]: (x["document_ids"], x["updated_at"]) for x in after.collect()} == {1: ([5], 0), 2: ([6], 1), 3: ([5, 5, 7], 1)}
    assert sorted(x["collection_id"] for x in touched.collect()) == [1, 2, 3]


def test_updates_return_the_rows_after(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, v string")
    after, touched = records.update_returning(rows, F.col("v") != "c", {"v": F.lit("c")})
    assert sorted(map(tuple, after.collect()), key=str) == [(1, "c"), (2, None), (3, "c")] and [tuple(r) for r in touched.collect()] == [(1, "c")]


def test_stamps_defaults_and_deletes(spark):
    old = spark.createDataFrame([(1, "red", 0, 0)], "id long, color string, created_at int, updated_at int")
    got = records.insert_stamped(old, spark.createDataFrame([(2, None), (3, "blue")], "id long, color string"), F.lit(9), {"color": F.lit("#ffff00")})
    assert sorted(map(tuple, got.collect())) == [(1, "red", 0, 0), (2, "#ffff00", 9, 9), (3, "blue", 9, 9)]
    left, n = records.delete_of(got, id=2, color="blue")
    assert left.count() == 3 and n.first()[0] == 0
    with pytest.raises(ValueError):
        records.delete_of(got)


def test_nested_ids_become_strings(spark):
    rows = spark.createDataFrame([(1, [(2, 3)], [4])], "id long, items array<struct<id:long,n:long>>, ids array<long>")
    assert records.with_string_ids(rows, "id", "ids").first().asDict(True) == {"id": "1", "items": [{"id": "2", "n": 3}], "ids": ["4"]}


def test_boxes_and_images(spark):
    sizes = F.expr("map(1, named_struct('w', 100D, 'h', 200D))")
    got = one(spark, records.boxes_of_text(F.col("t"), sizes), t="1,50,50,10,20;2,5,6,7,8;x,1,1,1,1;1,2,3;")
    assert [tuple(b) for b in got] == [(1, 0.5, 0.25, 0.1, 0.1), (2, 5.0, 6.0, 7.0, 8.0)]
    assert one(spark, records.inline_images(F.col("t")), t="a data:image/png;base64,aGk= b data:image/png;base64,a b") == [bytearray(b"hi")]


def test_images_of_chunks(spark):
    images = [("c", "images/1.png"), ("d", "images/2.png")]
    rows = spark.createDataFrame([("s", 0, "see images/1.png  here", images), ("s", 1, "end", images), ("t", 0, "none", None)], "section string, chunk long, text string, found array<struct<caption:string,path:string>>")
    got = {(r["section"], r["chunk"]): (r["text"], [i["path"] for i in r["images"]]) for r in documents.with_images(rows, "section", "chunk", "found").collect()}
    assert got == {("s", 0): ("see here", ["images/1.png"]), ("s", 1): ("end", ["images/2.png"]), ("t", 0): ("none", [])}


def test_chunks_of_sections(spark):
    rows = [(1, 0, "T", 3, "See Fig 1 now.", [("Fig 1", "a"), ("Fig 2", "b")]), (1, 1, "U", 4, "![Fig 9](images/x.png)", None), (1, 2, "V", 5, None, None), (1, 3, "W", 6, "Text.", None)]
    got = documents.chunk_sections(spark.createDataFrame(rows, "doc_id long, pos long, title string, page int, text string, figures array<struct<figure_id:string,path:string>>"))
    seen = {r["pos"]: (r["title"], r["text"], r["images"] and [i["figure_id"] for i in r["images"]]) for r in got.collect()}
    assert seen == {0: ("T", "See Fig 1 now.", ["Fig 1"]), 1: ("U", "", ["Fig 9"]), 3: ("W", "Text.", None)}


def test_page_sizes_and_terms(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<f><surface n="1" lrx="612.0" lry="792"/><surface n="x" lrx="1" lry="2"/><surface n="2" lrx="bad" lry="2"/></f>')
    assert [tuple(r)[1:] for r in files.read_page_sizes(spark, str(tmp_path / "p.xml")).collect()] == [(1, 612.0, 792.0)]
    (tmp_path / "t.json").write_text('[{"name": "A", "url": "u"}, {"name": " "}, {"url": "v"}]')
    assert [tuple(r) for r in files.read_terms(spark, str(tmp_path / "t.json")).collect()] == [("A", "u", None)]
