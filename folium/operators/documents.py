"""Document text: sections and chunks, clean-up, hashes, images and tables in text, web pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.operators import lookups as L
from folium.operators.retrieval import hashing_embedder, vector_cosine
from folium.plans.registry import query
from folium.session import table

# ---------------------------------------------------------------- sections and chunks


def markdown_parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, part, has_heading, level, heading, body): split before headings of up to three marks."""
    parts = docs.select(key, F.posexplode(F.split(text, r"(?m)(?=^#{1,3}\s)")).alias("pos", "part")).where(T.strip(F.col("part")) != "")
    line = F.substring_index("part", "\n", 1)
    heads = line.rlike(r"^#{1,3}\s")
    return parts.select(
        key, "pos", "part", heads.alias("has_heading"), F.when(heads, T.heading_level(line)).alias("level"),
        F.when(heads, T.strip(F.regexp_replace(line, r"^#+\s*", ""))).alias("heading"),
        T.strip(F.when(heads, F.substring(F.col("part"), F.length(line) + 1, F.length("part"))).otherwise(F.col("part"))).alias("body"),
    )


def carry_forward(rows: DataFrame, value: str, group: str, order: str, out: str) -> DataFrame:
    """The last value that isn't null, up to each row."""
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def useful_parts(parts: DataFrame, words: int = 20) -> DataFrame:
    """Parts without a heading need some words to stay."""
    return parts.where(F.col("has_heading") | (F.size(F.split("body", r"\s+")) >= words))


def semantic_split(sections: DataFrame, key: str | list[str], text: str = "body", percentile: float = 0.95, embed=hashing_embedder, buffer: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, chunk, text): sentences are cut where the distance to the next one is above the document's percentile. What is compared of a
    sentence is its text with `buffer` sentences before and after it. Columns to keep, the same in all of a key, follow.

    A distance is worked out in the row of its sentence, so that sentences are dealt by key and vectors are not."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy("i")
    parted = sections.select(*keys, *keep, F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "").alias("sentences"))
    near = lambda i: F.array_join(F.slice("sentences", F.greatest(i - buffer, F.lit(0)) + 1, i + buffer + 1 - F.greatest(i - buffer, F.lit(0))), " ")
    places = F.when(F.size("sentences") > 0, F.sequence(F.lit(0), F.size("sentences") - 1))
    rows = F.transform(places, lambda i: F.struct(i.alias("i"), F.get("sentences", i).alias("sentence"), F.when(i > 0, near(i - 1)).alias("last"), near(i).alias("here")))
    sentences = parted.select(*keys, *keep, F.inline(rows))
    gaps = sentences.select(*keys, *keep, "i", "sentence", (1 - F.coalesce(vector_cosine(embed(F.col("last")), embed(F.col("here"))), F.lit(0.0))).alias("d"))
    limit = F.percentile(F.when(F.col("i") > 0, F.col("d")), percentile).over(Window.partitionBy(*keys))
    breaks = gaps.withColumn("b", ((F.col("i") > 0) & (F.col("d") > limit)).cast("int"))
    chunked = breaks.withColumn("chunk", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]), " ")
    return chunked.groupBy(*keys, "chunk").agg(joined.alias("text"), *[F.first(c).alias(c) for c in keep])


_NO_IMAGES = "cast(array() as array<struct<caption:string,path:string>>)"


def chunk_markdown(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, chunk, title, text, images, chunk_id) of Markdown documents. Links of images leave the text; the images of a part go to
    the chunk that names their path, else to the part's last one."""
    parts = useful_parts(carry_forward(markdown_parts(docs, key, text), "heading", key, "pos", "title"))
    found, plain = images_of_markdown(F.col("body"))
    parts = parts.select(key, "pos", "title", found.alias("found"), plain.alias("body"))
    chunks = semantic_split(parts, [key, "pos"], keep=("title", "found"))
    index = F.row_number().over(Window.partitionBy(key).orderBy("pos", "chunk")) - 1
    placed = with_images(chunks, [key, "pos"], "chunk", "found").withColumn("index", index)
    return placed.select(key, "pos", "chunk", "title", "text", "images", T.chunk_id(F.col(key), F.col("index"), F.col("text")).alias("chunk_id"))


def with_images(chunks: DataFrame, section: str | list[str], order: str, found: str) -> DataFrame:
    """Chunks with the images (caption, path) of their section (`found`, the same in all its chunks): those whose path the text names,
    and in the last chunk those that none names. Named paths leave the text."""
    w = Window.partitionBy(*[section] if isinstance(section, str) else section)
    every = F.coalesce(F.col(found), F.expr(_NO_IMAGES))
    rows = chunks.withColumn("images", F.filter(every, lambda i: F.col("text").contains(i["path"])))
    rows = rows.withColumn("__named", F.flatten(F.collect_set(F.transform("images", lambda i: i["path"])).over(w))).withColumn("__last", F.row_number().over(w.orderBy(F.desc(order))) == 1)
    left = F.filter(every, lambda i: ~F.array_contains("__named", i["path"]))
    text = F.when(F.size("images") > 0, without_paths(F.col("text"), F.transform("images", lambda i: i["path"]))).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("images", F.when(F.col("__last"), F.concat("images", left)).otherwise(F.col("images"))).drop("__named", "__last", found)


def without_paths(text: Column, paths: Column) -> Column:
    """Without these paths and with single blanks."""
    return T.squeeze(F.aggregate(paths, text, lambda t, p: F.replace(t, p, F.lit(" "))))


def chunk_sections(sections: DataFrame, key: str = "doc_id", order: str = "pos", text: str = "text") -> DataFrame:
    """(key, order, chunk, title, page, text, images) of sections (key, order, title, page, text, figures: array of (figure_id, path)).

    Links of images leave the text. A chunk has the figures that its text names, and null where it names none; a section with images
    or figures but no text is one empty chunk with all of them; one with neither is left out."""
    linked, plain = images_of_markdown(F.coalesce(F.col(text), F.lit("")))
    as_figures = F.transform(linked, lambda i: F.struct(i["caption"].alias("figure_id"), i["path"].alias("path")))
    kind = "array<struct<figure_id:string,path:string>>"
    figures = F.concat(F.coalesce(F.col("figures").cast(kind), F.array().cast(kind)), as_figures.cast(kind))
    rows = sections.select(key, order, "title", "page", figures.alias("__figures"), plain.alias("body"))
    blank = T.strip(F.col("body")) == ""
    empty = rows.where(blank & (F.size("__figures") > 0)).select(key, order, F.lit(0).cast("long").alias("chunk"), "title", "page", F.lit("").alias("text"), F.col("__figures").alias("images"))
    chunks = semantic_split(rows.where(~blank), [key, order], keep=("title", "page", "__figures"))
    named = F.filter("__figures", lambda f: F.coalesce((f["figure_id"] != "") & F.col("text").contains(f["figure_id"]), F.lit(False)))
    return chunks.select(key, order, "chunk", "title", "page", "text", F.when(F.size(named) > 0, named).alias("images")).unionByName(empty)


def adjacent_groups(rows: DataFrame, group: str, title: str, order: str, text: str) -> DataFrame:
    """Neighbouring rows of one title become one, texts joined by an empty line."""
    w = Window.partitionBy(group).orderBy(order)
    new = F.coalesce((F.lag(title).over(w) != F.col(title)).cast("int"), F.lit(1))
    islands = rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(group, "island", title).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n").alias(text))


def sentence_context(text: Column, keyword: Column, k: int = 1) -> Column:
    """The sentence of the keyword's first occurrence with k on either side."""
    sentences = F.filter(F.transform(F.split(text, r"[.!?]+"), T.strip), lambda s: s != "")
    at = F.array_position(F.transform(sentences, lambda s: F.lower(s).contains(F.lower(keyword))), F.lit(True)).cast("int")
    return F.when(at > 0, F.array_join(F.slice(sentences, F.greatest(at - k, F.lit(1)), at + k - F.greatest(at - k, F.lit(1)) + 1), ". "))


def occurrences(text: Column, word: Column) -> Column:
    """0-based places of the non-overlapping occurrences, case ignored."""
    pieces = F.split(F.lower(text), F.concat(F.lit("\\Q"), F.lower(word), F.lit("\\E")), -1)
    lengths = F.slice(F.transform(pieces, lambda p: F.length(p)), F.lit(1), F.size(pieces) - 1)
    return F.aggregate(
        lengths, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda a, n: F.struct((a["at"] + n + F.length(word)).alias("at"), F.array_append(a["out"], a["at"] + n).alias("out")),
    )["out"]


def images_of_markdown(text: Column) -> tuple[Column, Column]:
    """Image links (data: left out) and the text without them."""
    pattern = r"(?s)!\[(.*?)\]\((.*?)\)"
    found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2), lambda c, p: F.struct(c.alias("caption"), p.alias("path")))
    return F.filter(found, lambda x: ~x["path"].startswith("data:")), T.collapse_blank_lines(F.regexp_replace(text, pattern, ""))


def with_tables(text: Column, labels: Column, bodies: Column) -> Column:
    return F.concat(text, F.array_join(F.zip_with(labels, bodies, lambda l, b: F.concat(F.lit("\n\nTable "), l, F.lit(":\n"), F.left(b, F.lit(4000)))), ""))


def references_section(text: Column) -> Column:
    """What follows a references heading up to the next heading, if it has over 100 characters."""
    body = T.strip(F.regexp_extract(text, r"(?ims)^#{1,3}\s*(?:references|bibliography|works cited)\s*$(.*?)(?=^#{1,3}\s|\z)", 1))
    return F.when(F.length(body) > 100, body)


def scrape_results(html: Column, most: int = 5) -> Column:
    """Array of (title, href) of the first links of a page."""
    pattern = r'(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    found = F.zip_with(F.regexp_extract_all(html, F.lit(pattern), 1), F.regexp_extract_all(html, F.lit(pattern), 2), lambda h, t: F.struct(T.strip_html(t).alias("title"), h.alias("href")))
    return F.slice(found, 1, most)


# ---------------------------------------------------------------- queries

_MD = r"SELECT doc_id, concat('Intro of ', doc_id, '\n\n\n# Title ', doc_id, '\n', substring(regexp_replace(text, '[#\\n]', ' '), 1, CAST(length(text) / 2 AS INT)), '\n## Part\n', substring(regexp_replace(text, '[#\\n]', ' '), CAST(length(text) / 2 AS INT) + 1), '\n#### Deep\nx ![Fig ', doc_id, '](images/', doc_id, '.png) and ![d](data:abc) end') AS text FROM {documents}"


def _markdown(spark, sf_dir) -> DataFrame:
    return spark.sql(_MD, documents=table(spark, sf_dir, "documents"))


query("s08_markdown_parts")(lambda spark, sf_dir: markdown_parts(_markdown(spark, sf_dir)).drop("part"))
query("f02_heading_levels", """SELECT doc_id, level::INT AS level, 1::BIGINT AS n FROM documents, (VALUES (1), (2)) AS t(level)""")(
    lambda spark, sf_dir: markdown_parts(_markdown(spark, sf_dir)).where("has_heading").groupBy("doc_id", "level").agg(F.count("*").alias("n"))
)
query("w04_carried_title")(lambda spark, sf_dir: carry_forward(markdown_parts(_markdown(spark, sf_dir)), "heading", "doc_id", "pos", "title").select("doc_id", "pos", "title"))
query("p28_useful_parts")(lambda spark, sf_dir: useful_parts(markdown_parts(_markdown(spark, sf_dir))).select("doc_id", "pos", "heading"))
query("t11_semantic_split")(lambda spark, sf_dir: semantic_split(table(spark, sf_dir, "documents"), "doc_id", "text"))
query("t13_chunk_markdown")(lambda spark, sf_dir: chunk_markdown(_markdown(spark, sf_dir)))
query("t12_chunk_sections")(
    lambda spark, sf_dir: chunk_sections(table(spark, sf_dir, "documents").select(
        "doc_id", F.lit(0).alias("pos"), F.col("source").alias("title"), F.lit(1).alias("page"), F.when(F.col("doc_id") % 3 > 0, F.concat("text", F.lit(" Fig 1. ![Fig 1](images/a.png)"))).otherwise(F.when(F.col("doc_id") % 2 == 0, "![Fig 2](images/b.png)")).alias("text"),
        F.expr("cast(null as array<struct<figure_id:string,path:string>>)").alias("figures")))
)
query("w12_leftover_images", "SELECT doc_id, 'images/' || doc_id || '.png' AS path FROM documents")(
    lambda spark, sf_dir: chunk_markdown(_markdown(spark, sf_dir)).select("doc_id", F.explode("images").alias("i")).select("doc_id", "i.path")
)
query("f04_without_paths", rf"SELECT doc_id, regexp_replace(regexp_replace(text || ' a b', '[ \t\n\x0B\f\r]+', ' ', 'g'), '^ +| +$', '', 'g') AS text FROM documents")(
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", without_paths(F.concat("text", F.lit(" a images/1.png  b images/2.png")), F.array(F.lit("images/1.png"), F.lit("images/2.png"))).alias("text"))
)
query("f01_images_of_markdown", "SELECT doc_id, 'Fig ' || doc_id AS caption, 'images/' || doc_id || '.png' AS path FROM documents")(
    lambda spark, sf_dir: _markdown(spark, sf_dir).select("doc_id", F.explode(images_of_markdown(F.col("text"))[0]).alias("i")).select("doc_id", "i.caption", "i.path")
)
query("j03_image_paths", "SELECT doc_id, 'images/' || doc_id || '.png' AS path FROM documents WHERE doc_id % 2 = 0")(
    lambda spark, sf_dir: _markdown(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"images/[^\s)]+\.(?:png|jpg)"), 0)).alias("path")).join(
        table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path")), "path").select("doc_id", "path")
)


@query("a13_adjacent_groups", """WITH c AS (SELECT conv_id, turn, role, text, coalesce((lag(role) OVER w <> role)::INT, 1) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c) SELECT conv_id, island::BIGINT AS island, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, island, role""")
def a13(spark, sf_dir):
    return adjacent_groups(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn", "text")


@query("a38_context_string", "SELECT conv_id, string_agg('[Chat Context ' || turn || ' - ' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def a38(spark, sf_dir):
    part = F.concat(F.lit("[Chat Context "), F.col("turn").cast("string"), F.lit(" - "), "role", F.lit("]\n"), "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", part.alias("p"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "p"))), lambda x: x["p"]), "\n\n").alias("context"))


def _text(name: str, column, sql: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> None:
    """A query of one text function over a table's texts."""
    query(name, f"SELECT {key}, {sql} AS value FROM {source}" if sql else None)(lambda spark, sf_dir: table(spark, sf_dir, source).select(key, column(F.col(text)).alias("value")))


_WS = r"[ \t\n\x0B\f\r]"
_text("f03_blank_lines", T.collapse_blank_lines, rf"regexp_replace(regexp_replace(text, '\n{_WS}*\n+', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g')")
_text("f06_clean_markdown", T.clean_markdown, None)
_FOLDED = reduce(lambda sql, pair: f"""replace({sql}, '{pair[0].replace("'", "''")}', '{pair[1].replace("'", "''")}')""", T.LIGATURES.items(), "text")
_text("f08_ligatures", lambda c: T.fold_ligatures(F.concat(c, F.lit(" ﬁn “x” … ﬄ"))), _FOLDED + " || ' fin \"x\" ... ffl'")
_text("f09_keyword_text", lambda c: T.keyword_text(F.concat(c, F.lit(" see https://a.b/c [1, 2] (Smith et al., 2020) Fig. 3 doi:10.1/x end"))), None)
_text("f14_chunk_id", lambda c: T.chunk_id(F.col("doc_id"), F.lit(3), c, "::"), "sha1(doc_id || '::3::' || left(text, 200))")
_text("w01_sequential_chunk_id", lambda c: T.chunk_id(F.col("source"), F.col("doc_id"), c), "sha1(source || ':' || doc_id || ':' || left(text, 200))")
_text("f15_content_hash", lambda c: F.sha2(F.regexp_replace(F.concat(c, F.lit(" [View CSV](x)")), r"\[View CSV\]\([^)]*\)", ""), 256), "sha256(text || ' ')")
_text("f17_cache_key", lambda c: F.md5(F.concat_ws("_", F.col("source"), F.lit("medium"), F.lit("0.5"))), "md5(source || '_medium_0.5')")
_text("f18_excerpt", T.normalise_excerpt, rf"regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{_WS}*\n+', chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g')")
_text("f21_head_tail", T.head_tail, "CASE WHEN length(text) > 950 THEN left(text, 800) || '...' || right(text, 150) WHEN length(text) > 500 THEN left(text, 400) || '...' || right(text, 100) ELSE text END")
_text("f26_seed", lambda c: F.array_join(F.slice(F.split(T.squeeze(c), " "), 1, 5), ""), rf"array_to_string(list_slice(string_split(regexp_replace(regexp_replace(text, '{_WS}+', ' ', 'g'), '^ +| +$', '', 'g'), ' '), 1, 5), '')")
_text("f34_plain_words", lambda c: F.md5(T.plain_words(F.regexp_replace(c, r"[^\x00-\x7F]", ""))), rf"md5(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), '[^\w\s]', ' ', 'g'), '{_WS}+', ' ', 'g'), '^ +| +$', '', 'g'))")
_text("f63_reference_clean", lambda c: F.substring(T.squeeze(c), 1, 1000), rf"left(regexp_replace(regexp_replace(text, '{_WS}+', ' ', 'g'), '^ +| +$', '', 'g'), 1000)")
_text("f65_strip_html", T.strip_html, None, "pages", "page_id", "html")
_text("f66_escape_html", T.escape_html, "replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')", "pages", "page_id", "html")
_text("f67_content_tokens", lambda c: F.size(T.content_tokens(c)).cast("long"), r"len(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '' AND w NOT IN ('the','a','of','and','or','to','in','for','on','by','with','as','is','are')))")
_text("f69_title_case", lambda c: F.initcap(F.regexp_replace(F.lower(c), "[^a-z ]", "")), None, "benchmark", "item_id")
_text("f70_regex_escape", T.regex_escape, r"regexp_replace(html, '([.*+?^${}()|\[\]\\])', '\\\1', 'g')", "pages", "page_id", "html")
_text("f71_occurrences", lambda c: F.array_join(occurrences(c, F.lit("the")).cast("array<string>"), ","), None)
_text("f73_section_name", lambda c: F.translate(c, ":/*#", "----"), "translate(text, ':/*#', '----')")
_text("f75_keyword_list", lambda c: F.array_join(F.filter(F.transform(F.split(c, "[;,]"), lambda x: F.trim(x)), lambda x: x != ""), "|"), "array_to_string(list_filter(list_transform(string_split_regex(text, '[;,]'), lambda x: trim(x, ' ')), lambda x: x <> ''), '|')")
_text("w09_sentence_context", lambda c: sentence_context(c, F.lit("and")), None)
_text("f49_quote_plus", lambda c: T.quote_plus(F.regexp_replace(c, r"[^\x20-\x7E]", "")), None)
_text("f07_references_section", lambda c: references_section(F.concat(F.lit("# A\nx\n## References\n"), F.regexp_replace(c, "#", ""), F.lit("\n# End\n"))), None)
query("f35_edit_distance", "SELECT p_partkey, levenshtein(p_name, p_type)::BIGINT AS d, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS similarity FROM part")(
    lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("d"), F.round(T.edit_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))
)
query("u02_jaccard", "SELECT conv_id, turn, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS j FROM (SELECT conv_id, turn, list_distinct(string_split(regexp_replace(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '^ +| +$', '', 'g'), ' ')) AS a, list_distinct(['the', 'a', role]) AS b FROM conversations)")(
    lambda spark, sf_dir: table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(T.jaccard(F.col("text"), F.concat(F.lit("the a "), F.col("role"))), 6).alias("j"))
)
query("s24_scraped_links")(lambda spark, sf_dir: table(spark, sf_dir, "pages").select("page_id", F.posexplode(scrape_results(F.col("html"))).alias("i", "r")).select("page_id", "i", "r.title", "r.href"))
query("f72_table_text", "SELECT doc_id, md5(text || chr(10) || chr(10) || 'Table 1:' || chr(10) || left(text, 4000)) AS value FROM documents")(
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", F.md5(with_tables(F.col("text"), F.array(F.lit("1")), F.array(F.col("text")))).alias("value"))
)
query("f76_creation_year", "SELECT o_orderkey, substring(concat('D:', CAST(year(o_orderdate) AS STRING), '0101'), 3, 4) AS year FROM orders")(
    lambda spark, sf_dir: table(spark, sf_dir, "orders").select("o_orderkey", L.creation_year(F.concat(F.lit("D:"), F.year("o_orderdate").cast("string"), F.lit("0101"))).alias("year"))
)
query("f79_distance", "SELECT c_custkey, round(sqrt(power(c_nationkey - 5, 2) + power(c_acctbal - 100, 2)), 6) AS d FROM customer")(
    lambda spark, sf_dir: table(spark, sf_dir, "customer").select("c_custkey", F.round(L.distance(F.col("c_nationkey"), F.col("c_acctbal"), F.lit(5), F.lit(100)), 6).alias("d"))
)
query("f29_rounded_box", "SELECT event_id, round(value / 7, 4) AS l, round(value / 11, 4) AS t FROM events")(
    lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", *L.rounded_box(l=F.col("value") / 7, t=F.col("value") / 11))
)
query("f82_clean_arxiv_id", "SELECT doc_id, trim(regexp_replace(concat('arXiv:2101.', doc_id), '^arXiv:', '')) AS id FROM documents")(
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", L.clean_arxiv_id(F.concat(F.lit("arXiv:2101."), "doc_id")).alias("id"))
)
query("f83_best_pdf_link", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN concat('https://arxiv.org/pdf/2101.', doc_id) END, CASE WHEN doc_id % 3 = 1 THEN concat('https://doi.org/10.1/', doc_id) END, concat('https://example.org/', doc_id)) AS link FROM documents")(
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", L.best_pdf_link(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("2101."), "doc_id")), F.lit(None), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("10.1/"), "doc_id")), F.concat(F.lit("https://example.org/"), "doc_id")).alias("link"))
)
query("f84_confidence_of_distance", "SELECT event_id, CAST(CASE WHEN value < 10 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence FROM events")(
    lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", L.confidence_of_distance(F.col("value")).alias("confidence"))
)
query("f77_metadata", "SELECT c_custkey, coalesce(c_mktsegment, 'Unknown') AS subject, substring('2021-05-06', 1, 4) AS year FROM customer")(
    lambda spark, sf_dir: table(spark, sf_dir, "customer").select("c_custkey", L.known(F.col("c_mktsegment")).alias("subject"), L.year_of_date(F.lit("2021-05-06")).alias("year"))
)
