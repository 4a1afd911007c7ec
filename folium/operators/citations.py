"""Citation and reference linking: reference parsing, in-text citations, markers, nearest boxes, text of a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import references as R
from folium.functions import text as T
from folium.operators import lookups as L
from folium.operators.grid import nearest
from folium.plans.registry import query
from folium.session import table

# ---------------------------------------------------------------- operators


def parse_references(refs: DataFrame, raw: str = "raw") -> DataFrame:
    """All parsed fields, the best link and its kind, in one projection."""
    text = F.col(raw)
    parsed = refs.withColumns({"doi": R.doi(text), "arxiv_id": R.arxiv_id(text), "url": R.url(text), "year": R.year(text), "title": R.title(text), "authors": R.authors(text)})
    target, kind = R.link(F.col("doi"), F.col("arxiv_id"), F.col("url"), R.scholar_link(text, F.col("title"), F.col("authors"), F.col("year")))
    return parsed.withColumns({"link": target, "link_type": kind})


def marker_numbers(answer: Column) -> Column:
    """Zero-based numbers of the [cN] markers, in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[c(\d+)\]"), 1), lambda n: n.cast("int") - 1)


def valid_markers(answer: Column, contexts: Column) -> Column:
    return F.filter(marker_numbers(answer), lambda n: (n >= 0) & (n < contexts))


def renumber(answer: Column, keep: Column | None = None, chained: bool = False) -> Column:
    """[cN] markers renumbered 1, 2, ... by first appearance. `keep` limits to known ones (others stay); `chained` rewrites
    one number after the other, the largest first, so that a new number may be rewritten again."""
    order = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[c(\d+)\]"), 1), lambda n: n.cast("int")))
    if keep is not None:
        order = F.filter(order, lambda n: F.array_contains(keep, n))
    pairs = F.transform(order, lambda n, i: F.struct(n.alias("old"), (i + 1).alias("new")))
    if chained:
        down = F.reverse(F.array_sort(pairs))
        return F.aggregate(down, answer, lambda t, p: F.replace(t, F.concat(F.lit("[c"), p["old"].cast("string"), F.lit("]")), F.concat(F.lit("[c"), p["new"].cast("string"), F.lit("]"))))
    marked = F.aggregate(pairs, answer, lambda t, p: F.replace(t, F.concat(F.lit("[c"), p["old"].cast("string"), F.lit("]")), F.concat(F.lit("[c\x01"), p["new"].cast("string"), F.lit("]"))))
    return F.replace(marked, F.lit("\x01"), F.lit(""))


def answer_flags(answer: Column) -> tuple[Column, Column, Column]:
    """Confidence, whether the chat history was used, and the answer without either marker."""
    confidence = F.regexp_extract(answer, r"\[CONFIDENCE:\s*([0-9.]+)\]", 1).try_cast("double")
    clean = T.strip(F.regexp_replace(F.replace(answer, F.lit("[CHAT_HISTORY]"), F.lit("")), r"\[CONFIDENCE:\s*[0-9.]+\]", ""))
    return confidence, answer.contains("[CHAT_HISTORY]"), clean


def score_confidence(scores: DataFrame, score: str = "score") -> DataFrame:
    """Mean retrieval score; above 1 it is a percentage; within 0.3 and 0.95; 0.5 without scores."""
    mean = F.avg(score)
    return scores.agg(F.coalesce(F.least(F.lit(0.95), F.greatest(F.lit(0.3), F.when(mean > 1, mean / 100).otherwise(mean))), F.lit(0.5)).alias("confidence"))


def ordinal_citations(answers: DataFrame, hits: DataFrame, key: str = "doc_id", answer: str = "answer") -> DataFrame:
    """Marker [cN] meets the hit of rank N - 1; first appearance first, others dropped."""
    marks = answers.select(key, F.posexplode(F.array_distinct(marker_numbers(F.col(answer)))).alias("position", "rank"))
    return marks.join(F.broadcast(hits), "rank").withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("position")))  # hits are a top-k list


def assemble_answers(answers: DataFrame, hits: DataFrame, key: str = "doc_id", answer: str = "answer") -> DataFrame:
    """(key, answer, citations, confidence, used_history) of generated answers over the hits (rank, text, score) they saw, a top-k list.

    Markers of hits are renumbered by first appearance and listed as (number, rank, score, excerpt); markers of no hit stay as they are.
    Confidence is the answer's own, else the one of the hits' scores."""
    confidence, used, clean = answer_flags(F.col(answer))
    totals = hits.agg((F.max("rank") + 1).alias("n")).crossJoin(score_confidence(hits).withColumnRenamed("confidence", "of_scores"))  # one row
    known = F.sequence(F.lit(1), F.coalesce(F.col("n"), F.lit(0)).cast("int"), F.lit(1))
    keep = F.when(F.coalesce(F.col("n"), F.lit(0)) > 0, known).otherwise(F.expr("cast(array() as array<int>)"))
    cited = ordinal_citations(answers, hits, key, answer)
    lists = cited.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("number", "rank", "score", T.normalise_excerpt(F.col("text")).alias("excerpt")))).alias("citations"))
    rows = answers.crossJoin(F.broadcast(totals)).select(key, renumber(clean, keep).alias("answer"), F.coalesce(confidence, "of_scores").alias("confidence"), used.alias("used_history"))
    return rows.join(lists, key, "left")


def collect_mentions(refs: DataFrame, markers: DataFrame) -> DataFrame:
    """Markers (target with a leading #) gathered per reference; references without any keep an empty list."""
    by = markers.select(F.regexp_replace("target", "^#", "").alias("ref_id"), "mention").groupBy("ref_id").agg(F.array_sort(F.collect_list("mention")).alias("mentions"))
    return refs.join(by, "ref_id", "left").withColumn("mentions", F.coalesce("mentions", F.expr("cast(array() as array<string>)")))


def match_annotations(annotations: DataFrame, references: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Nearest reference box on the same page, the annotation's y flipped, strictly below the threshold; the first wins a tie."""
    flipped = annotations.withColumn("__y", 1 - F.col("ay"))
    met = nearest(flipped, references, ["page"], ("ax", "__y"), ("rx", "ry"), (threshold,) * 4, ["ref_order", "ref_id"], threshold)
    return met.select("annotation_id", F.col("nearest.place.ref_id").alias("ref_id"), F.col("nearest.distance").alias("distance"))


def starting_line(citations: DataFrame, lines: DataFrame) -> DataFrame:
    """The line a citation points at: x within -5 and +8, y within 15; starting lines first, then the nearest. Rows are those of
    both, with the distance; a null is_start is no start, citations without a line are left out."""
    kinds = citations.withColumn("__start", F.explode(F.array(F.lit(True), F.lit(False))))
    marked = lines.withColumn("__start", F.coalesce("is_start", F.lit(False)))
    met = nearest(kinds, marked, ["page", "__start"], ("cx", "cy"), ("lx", "ly"), (5, 8, 15, 15), ["line_index"]).where("nearest is not null")
    first = Window.partitionBy("citation_id").orderBy(F.desc("__start"), "nearest.distance", "nearest.place.line_index")
    taken = met.withColumn("__r", F.row_number().over(first)).where("__r = 1")
    return taken.select(*citations.columns, *[F.col("nearest.place")[c].alias(c) for c in lines.columns if c != "page"], F.col("nearest.distance").alias("distance"))


def references_from_lines(lines: DataFrame, group: str = "doc_id", order: str = "pos") -> DataFrame:
    """Lines from each starting line to the next, joined: a hyphen at a line's end glues, as do ':' and '/'."""
    run = lines.withColumn("ref", F.sum(F.col("is_start").cast("int")).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).where("ref > 0")
    parts = run.groupBy(group, "ref").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]).alias("lines"))
    return parts.select(group, "ref", join_lines(F.col("lines")).alias("text"))


def join_lines(lines: Column) -> Column:
    def glue(text: Column, line: Column) -> Column:
        part = F.trim(line)
        return (
            F.when(text == "", part).when(text.endswith("-"), F.concat(F.left(text, F.length(text) - 1), part))
            .when(text.endswith(":") | text.endswith("/"), F.concat(text, part)).otherwise(F.concat_ws(" ", text, part))
        )

    return F.aggregate(lines, F.lit(""), glue)


def consecutive_ids(annotations: DataFrame) -> DataFrame:
    """Islands of annotations with ids n, n + 1, ... of one suffix and destination."""
    island = F.col("id") - F.row_number().over(Window.partitionBy("suffix", "dest").orderBy("id"))
    return annotations.withColumn("island", island).groupBy("suffix", "dest", "island").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).drop("island")


def merge_boxes(boxes: DataFrame, max_dy: float = 0.008, max_gap: float = 0.05) -> DataFrame:
    """Boxes of one destination on one line and close together become one; each is compared with the box merged so far.

    A box that is too low below the one before it, or too far right of every box of its line so far, opens a new box whatever was merged. Windows
    find these, and only the boxes between two of them are folded."""
    above = Window.partitionBy("dest").orderBy("y1", "x1", "x2", "y2")
    along = Window.partitionBy("dest", "__line").orderBy("y1", "x1", "x2", "y2")
    so_far = along.rowsBetween(Window.unboundedPreceding, -1)

    def runs(opens: Column, order: Window) -> Column:
        return F.sum(F.when(opens, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))

    lines = boxes.select("dest", "y1", "x1", "x2", "y2", (F.col("y1") - F.lag("y1").over(above) >= max_dy).alias("__low")).withColumn("__line", runs(F.col("__low"), above))
    parts = lines.withColumn("__far", F.col("x1") - F.max("x2").over(so_far) >= max_gap).withColumn("__part", runs(F.col("__far"), along))
    ordered = parts.groupBy("dest", "__line", "__part").agg(F.array_sort(F.collect_list(F.struct("y1", "x1", "x2", "y2"))).alias("b"))
    kind = "array<struct<y1:double,x1:double,x2:double,y2:double>>"

    def fold(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        near = (F.size(acc) > 0) & (F.abs(b["y1"] - last["y1"]) < max_dy) & (b["x1"] - last["x2"] < max_gap)
        joined = F.struct(F.least(b["y1"], last["y1"]).alias("y1"), F.least(b["x1"], last["x1"]).alias("x1"), F.greatest(b["x2"], last["x2"]).alias("x2"), F.greatest(b["y2"], last["y2"]).alias("y2"))
        return F.when(near, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(b))).cast(kind)

    return ordered.select("dest", F.explode(F.aggregate("b", F.expr(f"cast(array() as {kind})"), fold)).alias("m")).select("dest", "m.*")


def best_candidate(papers: DataFrame, title: str, year: int, author: str) -> DataFrame:
    """Papers scored: equal title 100, contained title 50, year 50, first author 30; accepted above 20, else the first."""
    t = F.lower("title")
    score = F.when(t == title.lower(), 100).when(t.contains(title.lower()) | F.lit(title.lower()).contains(t), 50).otherwise(0) + F.when(F.col("year") == year, 50).otherwise(0) + F.when(F.lower("author").contains(author.lower()), 30).otherwise(0)
    scored = papers.withColumn("score", score)
    return scored.orderBy(F.desc(F.when(F.col("score") > 20, F.col("score")).otherwise(-1)), "pos").limit(1)


def citation_summary(citations: DataFrame, low: float = 0.5, low_inclusive: bool = False, method: str | None = None) -> DataFrame:
    """Total, mean confidence, counts above 0.7 and below `low`; with a column `method`, also a map by_method of its counts, null as 'unknown'.
    A null confidence counts as 0."""
    c = F.coalesce("confidence", F.lit(0.0))
    figures = [F.sum("n"), F.round(F.sum("s") / F.sum("n"), 6), F.sum("high"), F.sum("low")]
    named = F.coalesce(F.nullif(F.col(method), F.lit("")), F.lit("unknown")) if method else F.lit("")
    per = citations.groupBy(named.alias("method")).agg(F.count("*").alias("n"), F.sum(c).alias("s"), F.count_if(c > 0.7).alias("high"), F.count_if(c <= low if low_inclusive else c < low).alias("low"))
    of_methods = [F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "n")))).alias("by_method")] if method else []
    return per.agg(*[F.coalesce(f, F.lit(0.0 if k == "average" else 0)).alias(k) for f, k in zip(figures, ("total", "average", "high", "low"), strict=True)], *of_methods)


# How a reference starts, tried in this order, and the headings that close a list of references.
REFERENCE_STARTS = [
    ("numbered", r"^\s*\[(\d+)\]"),
    ("author-year", r"^\s*[A-Z][a-z]+,\s*[A-Z]\..*?\(\d{4}\)"),
    ("author-year", r"^\s*[A-Z][a-z]+\s+et\s+al\..*?\(\d{4}\)"),
    ("doi", r"(?i)^\s*(?:doi:|DOI:|\[doi\])"),
    ("url", r"(?i)^\s*(?:https?:|www\.)"),
    ("arxiv", r"(?i)^\s*arXiv:"),
    ("numbered-dot", r"^\s*(\d+)\.\s+"),
]
CLOSING_HEADING = r"(?i)^\s*(Appendix|Index|Acknowledgments|Figures|Tables)\s"
NO_TEXT = "(no text found)"


def reference_walk(targets: DataFrame, lines: DataFrame, dx: float = 25.0, dy: float = 60.0, longest: int = 1000) -> DataFrame:
    """The reference that each target (id, page, x, y) points at, read from lines (page, pos, x, y, text); y grows upwards.

    Lines within dy below the target, and those within dy of the top of the next page, are read from the top if they start within
    dx of it: from the first that starts a reference to the next start of the same kind (not included) or a closing
    heading (included). Where none starts one, all of them are taken, in the order of pos, as `proximity` with little confidence; without
    lines the method is `none`. Only lines of two pages meet a target, and only those of its window are gathered.
    """
    text = F.trim("text")
    kind = F.coalesce(*[F.when(text.rlike(pattern), name) for name, pattern in REFERENCE_STARTS])
    read = lines.select("page", "pos", F.col("x").alias("lx"), F.col("y").alias("ly"), text.alias("t"), kind.alias("kind"), text.rlike(CLOSING_HEADING).alias("closing"))
    tops = lines.groupBy("page").agg(F.max("y").alias("top"))
    here = read.withColumns({"next": F.lit(False), "top": F.lit(None).cast("double")})
    after = read.join(tops, "page").withColumn("page", F.col("page") - 1).withColumn("next", F.lit(True)).select(*here.columns)
    met = targets.join(here.unionByName(after), "page").where(F.when(F.col("next"), F.col("ly") >= F.col("top") - dy).otherwise(F.col("ly").between(F.col("y") - dy, F.col("y"))))
    line = F.struct("next", (-F.col("ly")).alias("down"), "pos", "t", "kind", "closing")
    aligned = F.abs(F.coalesce("lx", F.lit(0)) - F.col("x")) <= dx
    walks = met.groupBy("id").agg(F.count("*").alias("candidates"), F.array_sort(F.collect_list(F.when(aligned, line))).alias("all"))
    walks = walks.withColumn("walk", F.filter("all", lambda l: l["t"] != ""))
    walks = walks.withColumn("start", F.array_position(F.transform("walk", lambda l: l["kind"].isNotNull()), True))
    walks = walks.withColumn("of", F.try_element_at("walk", F.nullif(F.col("start").cast("int"), F.lit(0)))["kind"])

    def ends(l: Column, i: Column) -> Column:
        return (i >= F.col("start")) & (F.col("start") > 0) & F.coalesce(l["kind"] == F.col("of"), l["closing"])

    walks = walks.withColumn("stop", F.array_position(F.transform("walk", ends), True).cast("int"))
    walks = walks.withColumn("last", F.when(F.col("stop") == 0, F.size("walk")).when(F.try_element_at("walk", F.nullif("stop", F.lit(0)))["kind"].isNull(), F.col("stop")).otherwise(F.col("stop") - 1))
    in_order = F.array_sort(F.transform("all", lambda l: F.struct(l["pos"].alias("pos"), l["t"].alias("t"))))
    started = F.transform(F.slice("walk", F.greatest(F.col("start").cast("int"), F.lit(1)), F.greatest(F.col("last") - F.col("start").cast("int") + 1, F.lit(0))), lambda l: l["t"])
    taken = F.when(F.col("start") > 0, started).otherwise(F.transform(in_order, lambda l: l["t"]))
    visited = F.when(F.col("stop") == 0, F.col("walk")).otherwise(F.slice("walk", F.lit(1), F.col("stop")))
    walks = walks.where(F.size("all") > 0).withColumns({"taken": taken, "spans_pages": F.exists(visited, lambda l: l["next"])})
    joined = F.left(F.trim(F.regexp_replace(F.array_join("taken", " "), r"[\s\u00A0\u2000-\u200B\u2028\u2029]+", " ")), F.lit(longest))
    found = walks.select(
        "id", F.when(joined != "", joined).otherwise(NO_TEXT).alias("reference"), F.coalesce("of", F.lit("proximity")).alias("method"), "spans_pages",
        F.round(F.when(F.col("start") > 0, 0.8).otherwise(0.3) + F.when(F.col("spans_pages"), 0.1).otherwise(0.0), 6).alias("confidence"), F.size("taken").alias("lines_used"),
    )
    empty = {"reference": F.lit(NO_TEXT), "method": F.lit("none"), "spans_pages": F.lit(False), "confidence": F.lit(0.0), "lines_used": F.lit(0)}
    return targets.select("id").join(found, "id", "left").select("id", *[F.coalesce(c, other).alias(c) for c, other in empty.items()])


# ---------------------------------------------------------------- queries on derived references

_REFS = r"""SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN concat('[', doc_id % 9 + 1, '] Smith, J., and Lee, K. "A study of ', doc_id, ' things". (', 1990 + doc_id % 30, ') doi:10.1234/x', doc_id, '.')
  WHEN 1 THEN concat('(', doc_id % 7 + 1, ') Jones, A. et al. Learning about number ', doc_id, '. ', 1980 + doc_id % 40, ' arXiv:2101.0', 1000 + doc_id % 9000, 'v2')
  WHEN 2 THEN concat(doc_id % 5 + 1, '. Brown, B. A longer title of paper ', doc_id, ' here. see https://example.org/p/', doc_id, ', and https://doi.org/10.5555/y', doc_id, ';')
  ELSE concat('Miller (', 1800 + doc_id % 400, ') plain text ', 1950 + doc_id % 70, ' https://example.org/q', doc_id, '.') END AS raw FROM {documents}"""
_REFS_DUCK = _REFS.replace("{documents}", "documents")


def _refs(spark, sf_dir) -> DataFrame:
    return spark.sql(_REFS, documents=table(spark, sf_dir, "documents"))


def _field(name: str, column, sql: str) -> None:
    """A query of one parsed field, null where the text has none."""
    query(name, f"WITH r AS ({_REFS_DUCK}) SELECT doc_id, {sql} AS value FROM r")(lambda spark, sf_dir: _refs(spark, sf_dir).select("doc_id", column(F.col("raw")).alias("value")))


_BARE = "CASE WHEN contains({0}, '(') OR contains({0}, '[') THEN rtrim({0}, '.,;:!?''\"') ELSE rtrim({0}, '.,;:!?''\")]}}>') END"
_field("f40_doi", R.doi, f"nullif({_BARE.format(f"regexp_extract(raw, '{R.DOI}')")}, '')")
_field("f41_arxiv_id", R.arxiv_id, f"nullif(regexp_extract(raw, '[aA][rR][xX][iI][vV](?:\\.org/(?:abs|pdf)/|:\\s*)({R.ARXIV})', 1), '')")
_field("f42_url", R.url, f"list_filter(list_transform(regexp_extract_all(raw, '{R.LINK}'), lambda u: {_BARE.format('u')}), lambda u: NOT regexp_matches(u, '^https?://((dx|www)\\.)?(doi|arxiv)\\.org(/|$)'))[1]")
_field("f43_year", R.year, r"list_filter(list_transform(list_concat(regexp_extract_all(raw, '\((\d{4})[a-z]?\)', 1), regexp_extract_all(raw, '\b(\d{4})\b', 1)), lambda y: y::INT), lambda y: y BETWEEN 1900 AND 2030)[1]")
# by the four forms of the derived references
_field("f44_title", R.title, "CASE doc_id % 4 WHEN 0 THEN 'A study of ' || doc_id || ' things' WHEN 1 THEN 'Learning about number ' || doc_id WHEN 2 THEN 'A longer title of paper ' || doc_id || ' here' END")
_field("f45_authors", lambda c: F.array_join(R.authors(c), "|"), "CASE doc_id % 4 WHEN 0 THEN 'Smith, J.|Lee, K.' WHEN 1 THEN 'Jones, A.' WHEN 2 THEN 'Brown, B.' END")
query("f51_arxiv_pdf_address", "SELECT doc_id, 'https://arxiv.org/pdf/2101.0' || (1000 + doc_id % 9000) || CASE WHEN doc_id % 2 = 0 THEN 'v3' ELSE '' END || '.pdf' AS address FROM documents")(
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", R.arxiv_abs_to_pdf(F.expr("concat('https://arxiv.org/abs/2101.0', 1000 + doc_id % 9000, if(doc_id % 2 = 0, 'v3', ''), if(doc_id % 3 = 0, '?context=cs', ''))")).alias("address"))
)
query("f52_doi_of_address", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN '10.5555/y' || doc_id END AS doi FROM documents")(
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", R.doi_of_url(F.expr("concat(case doc_id % 3 when 0 then 'https://doi.org/' when 1 then 'http://dx.doi.org/' else 'https://example.org/' end, '10.5555/y', doc_id, '?a=1#b')")).alias("doi"))
)


# references whose authors and year stand in the title
_MIXED = r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('Anna Smith and Bert K. Lee. ', 1990 + doc_id % 30, '. A study of things.') WHEN 1 THEN concat('J. Brown, and K. Lee. ', 1990 + doc_id % 30, '. More things')
  WHEN 2 THEN concat(1990 + doc_id % 30, 'a. Late things. ', 1980 + doc_id % 9, '.') ELSE ' Plain things. ' END AS title, CASE WHEN doc_id % 3 = 0 THEN concat('in ', 1970 + doc_id % 20) WHEN doc_id % 3 = 1 THEN 'soon' END AS year FROM {documents}"""
query("f53_clean_title", f"WITH r AS ({_MIXED.replace('{documents}', 'documents')}) SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'A study of things' WHEN 1 THEN 'More things' WHEN 2 THEN 'Late things' ELSE 'Plain things' END AS title, CASE doc_id % 4 WHEN 0 THEN 'Anna Smith|Bert K. Lee' WHEN 1 THEN 'J. Brown|K. Lee' ELSE '' END AS authors FROM r")(
    lambda spark, sf_dir: spark.sql(_MIXED, documents=table(spark, sf_dir, "documents")).select("doc_id", R.clean_title(F.col("title")).alias("title"), F.array_join(R.title_authors(F.col("title")), "|").alias("authors"))
)


@query("f54_repaired_references", f"""WITH r AS ({_MIXED.replace('{documents}', 'documents')}) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN (1970 + doc_id % 20)::VARCHAR WHEN 1 THEN NULL ELSE CASE doc_id % 4 WHEN 3 THEN NULL WHEN 2 THEN (1980 + doc_id % 9)::VARCHAR ELSE (1990 + doc_id % 30)::VARCHAR END END AS year,
CASE WHEN doc_id % 5 = 0 THEN 'X' WHEN doc_id % 4 = 0 THEN 'Anna Smith|Bert K. Lee' WHEN doc_id % 4 = 1 THEN 'J. Brown|K. Lee' ELSE '' END AS authors FROM r""")
def f54(spark, sf_dir):
    r = spark.sql(_MIXED, documents=table(spark, sf_dir, "documents")).withColumn("authors", F.expr("if(doc_id % 5 = 0, array(' ', 'X'), cast(array() as array<string>))"))
    _, year, authors, _ = R.repair(F.col("title"), F.col("year"), F.col("authors"), F.lit(None).cast("string"))
    return r.select("doc_id", year.alias("year"), F.array_join(authors, "|").alias("authors"))


_POPUP = "SELECT doc_id, concat('[', doc_id % 9, '] Smith J, Lee K and Roe M. ', CASE WHEN doc_id % 2 = 0 THEN concat(1990 + doc_id % 30, '. ') ELSE '' END, 'On the nature of things x', doc_id, '. Journal. Press') AS raw FROM {documents}"
_POPUP_SQL = "SELECT doc_id, 'On the nature of things x' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '.  Journal' END AS title, 'Smith J|Lee K|Roe M' AS authors, CASE WHEN doc_id % 2 = 0 THEN 1990 + doc_id % 30 END AS year FROM documents"


@query("f55_popup_fields", _POPUP_SQL)
def f55(spark, sf_dir):
    title, authors, year = R.popup_fields(F.col("raw"))
    return spark.sql(_POPUP, documents=table(spark, sf_dir, "documents")).select("doc_id", title.alias("title"), F.array_join(authors, "|").alias("authors"), year.alias("year"))


_LAID = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('[3] Smith J and Lee K (', 1990 + doc_id % 30, '). A study of things. Venue') WHEN 1 THEN concat('2. A study  of things. Smith J, ', 1990 + doc_id % 30, '. Venue.') WHEN 2 THEN concat('Smith J Lee K Roe M ', 1990 + doc_id % 30, ' Venue.') ELSE 'Nothing known.' END AS raw FROM {documents}"
query("f56_components", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'authorYear' WHEN 1 THEN 'titleFirst' WHEN 2 THEN 'simple' ELSE 'unknown' END AS format, CASE doc_id % 4 WHEN 0 THEN 'Smith J and Lee K' WHEN 1 THEN 'Smith J' WHEN 2 THEN 'Smith J Lee K Roe M' ELSE '' END AS authors,
CASE WHEN doc_id % 4 < 2 THEN 'A study of things' ELSE '' END AS title, CASE doc_id % 4 WHEN 2 THEN ' Venue' WHEN 3 THEN 'Nothing known' ELSE 'Venue' END AS venue,
CASE doc_id % 4 WHEN 0 THEN '"A study of things" Smith J and ' || (1990 + doc_id % 30) WHEN 1 THEN '"A study of things" Smith J ' || (1990 + doc_id % 30) WHEN 2 THEN 'Smith J Lee ' || (1990 + doc_id % 30) ELSE 'Nothing known' END AS query FROM documents""")(
    lambda spark, sf_dir: spark.sql(_LAID, documents=table(spark, sf_dir, "documents")).select("doc_id", R.components(F.col("raw")).alias("c"), R.search_query(F.col("raw")).alias("query")).select("doc_id", "c.format", "c.authors", "c.title", "c.venue", "query")
)
query("f64_search_text", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Smith J and Lee K (' || (1990 + doc_id % 30) || '). A study of things. Venue' WHEN 1 THEN 'A study of things. Smith J, ' || (1990 + doc_id % 30) || '. Venue' WHEN 2 THEN 'Smith J Lee K Roe M ' || (1990 + doc_id % 30) || ' Venue' ELSE 'Nothing known' END AS text FROM documents")(
    lambda spark, sf_dir: spark.sql(_LAID, documents=table(spark, sf_dir, "documents")).select("doc_id", R.search_text(F.col("raw")).alias("text"))
)


@query("f47_parse_and_link")
def f47(spark, sf_dir):
    return parse_references(_refs(spark, sf_dir)).withColumn("authors", F.array_join("authors", "|"))


@query("f48_link_kind", f"""WITH r AS ({_REFS_DUCK}) SELECT CASE doc_id % 4 WHEN 0 THEN 'doi' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'doi' ELSE 'url' END AS link_type, count(*) AS n FROM r GROUP BY 1""")
def f48(spark, sf_dir):
    return parse_references(_refs(spark, sf_dir)).groupBy("link_type").agg(F.count("*").alias("n"))


# sections of ten references of one form; those of the last form have no numbers and stay together
@query("f46_split_references", f"""WITH r AS (SELECT *, doc_id // 40 * 4 + doc_id % 4 AS section FROM ({_REFS_DUCK}))
SELECT section, (row_number() OVER (PARTITION BY section ORDER BY doc_id) - 1)::INT AS pos, trim(raw) AS reference FROM r WHERE doc_id % 4 < 3
UNION ALL SELECT section, 0, string_agg(raw, chr(10) ORDER BY doc_id) FROM r WHERE doc_id % 4 = 3 GROUP BY section""")
def f46(spark, sf_dir):
    r = _refs(spark, sf_dir).withColumn("section", F.expr("doc_id div 40 * 4 + doc_id % 4"))
    sections = r.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "raw"))), lambda x: x["raw"]), "\n").alias("text"))
    return sections.select("section", F.posexplode(R.split_references(F.col("text"))).alias("pos", "reference"))


_CITED = r"""SELECT doc_id, concat('As in (Smith, ', 1990 + doc_id % 30, ') and [', doc_id % 9 + 1, ',', doc_id % 5 + 2, '], see 10.1234/x', doc_id, ' or https://example.org/', doc_id, ' ; arXiv:2101.0', 1000 + doc_id % 9000, ' again [', doc_id % 9 + 1, ',', doc_id % 5 + 2, ']') AS body FROM {documents}"""
_CITED_SQL = f"""b AS ({_CITED.replace('{documents}', 'documents')}), c AS (
  SELECT doc_id, 'inline' AS type, 0.9::DOUBLE AS confidence, unnest(list_distinct(regexp_extract_all(body, '\\(([A-Z][a-z]+(?:\\s+et\\s+al\\.)?),?\\s+(\\d{{4}}[a-z]?)\\)'))) AS text FROM b UNION ALL
  SELECT doc_id, 'inline', 0.85, unnest(list_distinct(regexp_extract_all(body, '\\(([A-Z][a-z]+(?:\\s*,\\s*[A-Z][a-z]+)*(?:\\s*&\\s*[A-Z][a-z]+)?),?\\s+(\\d{{4}}[a-z]?)\\)'))) FROM b UNION ALL
  SELECT doc_id, 'reference', 0.8, unnest(list_distinct(regexp_extract_all(body, '\\[(\\d+(?:[-,]\\d+)*)\\]'))) FROM b UNION ALL
  SELECT doc_id, 'doi', 0.95, unnest(list_distinct(regexp_extract_all(body, '(10\\.\\d{{4,}}/[^\\s\\)]+)'))) FROM b UNION ALL
  SELECT doc_id, 'url', 0.9, unnest(list_distinct(regexp_extract_all(body, '(https?://[^\\s\\)]+)'))) FROM b UNION ALL
  SELECT doc_id, 'reference', 0.9, unnest(list_distinct(regexp_extract_all(body, '(arXiv:\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?)'))) FROM b)"""


def _cited(spark, sf_dir) -> DataFrame:
    bodies = spark.sql(_CITED, documents=table(spark, sf_dir, "documents"))
    return bodies.select("doc_id", F.explode(R.citations(F.col("body"))).alias("c")).select("doc_id", "c.type", "c.text", "c.confidence", "c.priority")


query("f39_in_text_citations", f"WITH {_CITED_SQL} SELECT doc_id, type, text, max(confidence) AS confidence FROM c GROUP BY ALL")(
    lambda spark, sf_dir: _cited(spark, sf_dir).groupBy("doc_id", "type", "text").agg(F.max("confidence").alias("confidence"))
)
query("o07_citation_ranking", f"""WITH {_CITED_SQL} SELECT doc_id, type, text, row_number() OVER (PARTITION BY doc_id ORDER BY CASE type WHEN 'doi' THEN 4 WHEN 'inline' THEN 3 WHEN 'url' THEN 2 ELSE 1 END DESC, confidence DESC, text) AS rank FROM c""")(
    lambda spark, sf_dir: _cited(spark, sf_dir).select("doc_id", "type", "text", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("priority"), F.desc("confidence"), "text")).cast("long").alias("rank"))
)
for _name, _low, _incl in (("a05_extraction_summary", 0.5, False), ("a06_extraction_summary_inclusive", 0.7, True)):
    query(_name, f"""WITH {_CITED_SQL}, m AS (SELECT string_agg(concat(type, ':', n), ',' ORDER BY type) AS methods FROM (SELECT type, count(*) AS n FROM c GROUP BY type))
SELECT count(*) AS total, round(avg(confidence), 6) AS average, count(*) FILTER (confidence > 0.7) AS high, count(*) FILTER (confidence {'<=' if _incl else '<'} {_low}) AS low, any_value(methods) AS methods FROM c, m""")(
        lambda spark, sf_dir, low=_low, incl=_incl: citation_summary(_cited(spark, sf_dir), low, incl, "type")
        .withColumn("methods", F.array_join(F.transform(F.map_entries("by_method"), lambda m: F.concat(m["key"], F.lit(":"), m["value"].cast("string"))), ",")).drop("by_method")
    )
query("a07_citations_by_type", f"WITH {_CITED_SQL} SELECT type, count(*) AS n, round(avg(confidence), 6) AS average, count(*) FILTER (confidence > 0.8) AS confident FROM c GROUP BY type")(
    lambda spark, sf_dir: _cited(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("average"), F.count_if(F.col("confidence") > 0.8).alias("confident"))
)

_ANSWERS = r"SELECT doc_id, concat('First [c', doc_id % 5 + 1, '] then [c', doc_id % 3 + 1, '] and [c', doc_id % 5 + 1, '] [CONFIDENCE:0.', 10 + doc_id % 90, ']', CASE WHEN doc_id % 2 = 0 THEN ' [CHAT_HISTORY]' ELSE '' END) AS answer FROM {documents}"
_ANSWERS_DUCK = _ANSWERS.replace("{documents}", "documents")


def _answers(spark, sf_dir) -> DataFrame:
    return spark.sql(_ANSWERS, documents=table(spark, sf_dir, "documents"))


@query("f19_citation_markers", rf"WITH a AS ({_ANSWERS_DUCK}) SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(answer, '\[c(\d+)\]', 1), lambda n: n::INT - 1), lambda n: n < 4), ',') AS markers FROM a")
def f19(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", F.array_join(valid_markers(F.col("answer"), F.lit(4)), ",").alias("markers"))


@query("f20_answer_flags", rf"""WITH a AS ({_ANSWERS_DUCK}) SELECT doc_id, regexp_extract(answer, '\[CONFIDENCE:\s*([0-9.]+)\]', 1)::DOUBLE AS confidence, contains(answer, '[CHAT_HISTORY]') AS used_history,
trim(regexp_replace(replace(answer, '[CHAT_HISTORY]', ''), '\[CONFIDENCE:\s*[0-9.]+\]', '', 'g')) AS clean FROM a""")
def f20(spark, sf_dir):
    confidence, used, clean = answer_flags(F.col("answer"))
    return _answers(spark, sf_dir).select("doc_id", confidence.alias("confidence"), used.alias("used_history"), clean.alias("clean"))


@query("j13_ordinal_citations", rf"""WITH a AS ({_ANSWERS_DUCK}), h AS (SELECT item_id AS rank, left(text, 20) AS head FROM benchmark WHERE item_id < 4),
m AS (SELECT doc_id, rank, min(i) AS i FROM (SELECT doc_id, unnest(x) AS rank, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_transform(regexp_extract_all(answer, '\[c(\d+)\]', 1), lambda n: n::INT - 1) AS x FROM a)) GROUP BY ALL)
SELECT doc_id, rank, head, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT AS number FROM m JOIN h USING (rank)""")
def j13(spark, sf_dir):
    hits = table(spark, sf_dir, "benchmark").where("item_id < 4").select(F.col("item_id").cast("int").alias("rank"), F.left("text", F.lit(20)).alias("head"))
    return ordinal_citations(_answers(spark, sf_dir), hits).select("doc_id", "rank", "head", "number")


@query("t26_assembled_answers", rf"""WITH a AS ({_ANSWERS_DUCK}), m AS (SELECT doc_id, x, list_filter(list_distinct(x), lambda n: n <= 4) AS known FROM (SELECT doc_id, list_transform(regexp_extract_all(answer, '\[c(\d+)\]', 1), lambda n: n::INT) AS x FROM a))
SELECT doc_id, len(known)::INT AS cited, (10 + doc_id % 90) / 100.0::DOUBLE AS confidence, doc_id % 2 = 0 AS used_history FROM m""")
def t26(spark, sf_dir):
    hits = table(spark, sf_dir, "benchmark").where("item_id < 4").select(F.col("item_id").cast("int").alias("rank"), "text", F.lit(0.5).alias("score"))
    return assemble_answers(_answers(spark, sf_dir), hits).select("doc_id", F.coalesce(F.size("citations"), F.lit(0)).alias("cited"), "confidence", "used_history")


for _name, _chained in (("w02_renumber_citations", False), ("w03_renumber_chained", True)):
    query(_name)(lambda spark, sf_dir, chained=_chained: _answers(spark, sf_dir).select("doc_id", renumber(F.col("answer"), chained=chained).alias("answer")))
query("w14_renumber_with_gaps")(lambda spark, sf_dir: _answers(spark, sf_dir).select("doc_id", renumber(F.col("answer")).alias("answer"), F.size(F.array_distinct(marker_numbers(F.col("answer")))).alias("numbers")))


@query("a16_score_confidence", "SELECT coalesce(least(0.95, greatest(0.3, round(CASE WHEN avg(l_discount) > 1 THEN avg(l_discount) / 100 ELSE avg(l_discount) END, 6))), 0.5)::DOUBLE AS confidence FROM lineitem")
def a16(spark, sf_dir):
    return score_confidence(table(spark, sf_dir, "lineitem"), "l_discount").withColumn("confidence", F.round("confidence", 6))


_BOXES = "SELECT doc_id, CAST(floor(doc_id / 50) AS BIGINT) AS page, (doc_id * 37 % 101) / 101.0D AS x, (doc_id * 53 % 103) / 103.0D AS y FROM {documents}"
_BOXES_DUCK = _BOXES.replace("{documents}", "documents").replace("101.0D", "101.0::DOUBLE").replace("103.0D", "103.0::DOUBLE")
# twenty pages, which fill up as the table grows
_FULL, _FULL_DUCK = (b.replace("CAST(floor(doc_id / 50) AS BIGINT)", "doc_id % 20") for b in (_BOXES, _BOXES_DUCK))


@query("j06_nearest_reference", f"""WITH b AS ({_FULL_DUCK}), a AS (SELECT doc_id AS annotation_id, page, x AS ax, y AS ay FROM b WHERE doc_id % 2 = 0), r AS (SELECT doc_id AS ref_id, page, x AS rx, y AS ry FROM b WHERE doc_id % 2 = 1 OR doc_id % 4 = 0),
n AS (SELECT annotation_id, ref_id, sqrt((ax - rx) * (ax - rx) + ((1 - ay) - ry) * ((1 - ay) - ry)) AS d FROM a JOIN r USING (page)),
k AS (SELECT *, row_number() OVER (PARTITION BY annotation_id ORDER BY d, ref_id) AS i FROM n WHERE d < 0.1)
SELECT a.annotation_id, ref_id, round(d, 6) AS distance FROM a LEFT JOIN k ON a.annotation_id = k.annotation_id AND i = 1""")
def j06(spark, sf_dir):
    b = spark.sql(_FULL, documents=table(spark, sf_dir, "documents"))
    a = b.where("doc_id % 2 = 0").select(F.col("doc_id").alias("annotation_id"), "page", F.col("x").alias("ax"), F.col("y").alias("ay"))
    r = b.where("doc_id % 2 = 1 or doc_id % 4 = 0").select(F.col("doc_id").alias("ref_id"), F.col("doc_id").alias("ref_order"), "page", F.col("x").alias("rx"), F.col("y").alias("ry"))
    return match_annotations(a, r).withColumn("distance", F.round("distance", 6))


@query("j07_starting_line", """WITH c AS (SELECT doc_id AS citation_id, doc_id % 20 AS page, doc_id * 7 % 60 AS cx, doc_id * 11 % 700 AS cy FROM documents WHERE doc_id % 3 = 0),
l AS (SELECT doc_id AS line_index, doc_id % 20 AS page, doc_id * 13 % 60 AS lx, doc_id * 17 % 700 AS ly, doc_id % 4 = 0 AS is_start FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY is_start DESC, sqrt((lx - cx) * (lx - cx) + abs(ly - cy) * abs(ly - cy)), line_index) AS r FROM c JOIN l USING (page) WHERE lx - cx BETWEEN -5 AND 8 AND abs(ly - cy) <= 15)
SELECT citation_id, line_index FROM n WHERE r = 1""")
def j07(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    c = d.where("doc_id % 3 = 0").selectExpr("doc_id citation_id", "doc_id % 20 page", "doc_id * 7 % 60 cx", "doc_id * 11 % 700 cy")
    lines = d.selectExpr("doc_id line_index", "doc_id % 20 page", "doc_id * 13 % 60 lx", "doc_id * 17 % 700 ly", "doc_id % 4 = 0 is_start")
    return starting_line(c, lines).select("citation_id", "line_index")


@query("j05_mentions_per_reference", """SELECT c_custkey::VARCHAR AS ref_id, coalesce(m, '') AS mentions FROM customer LEFT JOIN (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def j05(spark, sf_dir):
    refs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ref_id"))
    marks = table(spark, sf_dir, "orders").select(F.concat(F.lit("#"), F.col("o_custkey").cast("string")).alias("target"), F.col("o_orderkey").cast("string").alias("mention"))
    return collect_mentions(refs, marks).select("ref_id", F.array_join("mentions", ",").alias("mentions"))


_LINES = "SELECT doc_id, pos, line, pos % 3 = 0 AS is_start FROM (SELECT doc_id, posexplode(split(text, '\\n')) AS (pos, line) FROM {documents})"


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line)."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("w05_reference_lines", r"""WITH l AS (SELECT rid, doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id AS rid, doc_id, string_split(text, chr(10)) AS x FROM documents))
SELECT doc_id, (pos // 3 + 1)::BIGINT AS ref, count(*) AS n FROM l GROUP BY ALL""")
def w05(spark, sf_dir):
    lines = lines_of(table(spark, sf_dir, "documents")).withColumn("is_start", F.col("pos") % 3 == 0)
    run = lines.withColumn("ref", F.sum(F.col("is_start").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("doc_id", "ref").agg(F.count("*").alias("n"))


@query("w11_join_lines")
def w11(spark, sf_dir):
    return references_from_lines(lines_of(table(spark, sf_dir, "documents")).withColumn("is_start", F.col("pos") % 3 == 0))


@query("w07_consecutive_ids", """WITH a AS (SELECT doc_id + doc_id // 7 AS id, doc_id // 10 % 2 AS suffix, doc_id // 50 AS dest FROM documents), i AS (SELECT *, id - row_number() OVER (PARTITION BY suffix, dest ORDER BY id) AS g FROM a)
SELECT suffix, dest, min(id) AS first_id, count(*) AS n FROM i GROUP BY suffix, dest, g""")
def w07(spark, sf_dir):
    """Ids with a gap after every seven."""
    return consecutive_ids(table(spark, sf_dir, "documents").selectExpr("doc_id + doc_id div 7 id", "doc_id div 10 % 2 suffix", "doc_id div 50 dest"))


@query("w06_merge_boxes", f"""WITH b AS (SELECT page AS dest, x AS x1, x + 0.03 AS x2, floor(y * 20) / 20 AS y1, floor(y * 20) / 20 + 0.01 AS y2 FROM ({_BOXES_DUCK})),
g AS (SELECT *, CASE WHEN x1 - max(x2) OVER (PARTITION BY dest, y1 ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0.05 THEN 0 ELSE 1 END AS opens FROM b),
r AS (SELECT *, sum(opens) OVER (PARTITION BY dest, y1 ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)
SELECT dest, y1, min(x1) AS x1, max(x2) AS x2, max(y2) AS y2 FROM r GROUP BY dest, y1, run""")
def w06(spark, sf_dir):
    """Fifty boxes to a destination; those of one line have the same y."""
    b = spark.sql(_BOXES, documents=table(spark, sf_dir, "documents"))
    return merge_boxes(b.selectExpr("page dest", "x x1", "x + 0.03D x2", "double(floor(y * 20)) / 20 y1", "double(floor(y * 20)) / 20 + 0.01D y2"))


@query("j20_best_candidate", """WITH p AS (SELECT p_name AS title, 1990 + p_partkey % 30 AS year, p_brand AS author, p_partkey AS pos FROM part), q AS (SELECT title AS qt FROM p WHERE pos = (SELECT min(pos) FROM p)),
s AS (SELECT *, CASE WHEN lower(title) = lower(qt) THEN 100 WHEN contains(lower(title), lower(qt)) OR contains(lower(qt), lower(title)) THEN 50 ELSE 0 END + CASE WHEN year = 2001 THEN 50 ELSE 0 END + CASE WHEN contains(lower(author), 'brand') THEN 30 ELSE 0 END AS score FROM p, q)
SELECT pos, title, score FROM s ORDER BY CASE WHEN score > 20 THEN score ELSE -1 END DESC, pos LIMIT 1""")
def j20(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_name title", "1990 + p_partkey % 30 year", "p_brand author", "p_partkey pos")
    title = p.orderBy("pos").first()["title"]
    return best_candidate(p, title, 2001, "brand").select("pos", "title", "score")


query("j25_metadata_fallback", """SELECT c_custkey, coalesce(CASE WHEN length(c_mktsegment) > 8 THEN c_mktsegment END, own.o_orderpriority, 'none') AS abstract
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS o_orderpriority FROM orders GROUP BY o_custkey) own ON own.o_custkey = c_custkey""")(
    lambda spark, sf_dir: L.look_up_first(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), [(table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderpriority").alias("priority")), F.col("c_custkey"), "priority")], "abstract", F.lit("none"), F.when(F.length("c_mktsegment") > 8, F.col("c_mktsegment"))).select("c_custkey", "abstract")
)


@query("w13_reference_walk")
def w13(spark, sf_dir):
    """A page per document, its lines 12 apart with every third numbered; each document points at its fourth line."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", r"\n|(?<=[.!?]) ")).alias("pos", "line"))
    text = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("] "), "line")).otherwise(F.col("line"))
    lines = docs.select("page", "pos", F.lit(50.0).alias("x"), (700.0 - F.col("pos") * 12).alias("y"), text.alias("text"))
    targets = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("page"), F.lit(52.0).alias("x"), F.lit(664.0).alias("y"))
    return reference_walk(targets, lines)
