"""Chat history search, interleaving and the smaller joins and aggregates around answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.operators import lookups as L
from folium.operators.retrieval import cosine, hashing_embedder
from folium.plans.registry import query
from folium.session import table

# ---------------------------------------------------------------- chat and answers


def chat_search(messages: DataFrame, question: str, k: int, session: int | None = None, embed=hashing_embedder) -> DataFrame:
    """Messages nearest a question. With a session, 2 k are ranked over all first and filtered then, so fewer may come."""
    q = messages.sparkSession.createDataFrame([(question,)], "q string").select(embed(F.col("q")).alias("qv"))
    scored = messages.withColumn("v", embed(F.col("text"))).crossJoin(F.broadcast(q)).withColumn("score", F.coalesce(cosine(F.col("v"), F.col("qv")), F.lit(0.0))).drop("v", "qv")  # one row
    order = [F.desc(F.round("score", 6)), F.col("conv_id"), F.col("turn")]
    if session is None:
        return scored.orderBy(*order).limit(k)
    return scored.orderBy(*order).limit(2 * k).where(F.col("conv_id") == session).orderBy(*order).limit(k)


def figures_in_text(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """Chunks that name a figure, by an equi join on the names found in them instead of a nested loop on contains."""
    named = chunks.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"fig(?:ure)?\.? ?\d+"), 0))).alias("name"))
    return named.join(figures.select(F.lower("figure_id").alias("name"), "figure_id"), "name").select("doc_id", "figure_id")


def interleave(blocks: DataFrame, assets: DataFrame, page: str = "page") -> DataFrame:
    """Texts and assets of a page as one string, by y; texts before assets at equal height."""
    both = blocks.select(page, "y", F.lit(0).alias("kind"), "id", "text").unionByName(assets.select(page, "y", F.lit(1).alias("kind"), "id", "text"))
    return both.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "kind", "id", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def image_scores(contexts: DataFrame, question: Column, least: int = 1) -> DataFrame:
    """Twice the question's words in the caption plus those in the text."""
    q = F.array_distinct(T.content_tokens(question))
    score = 2 * F.size(F.array_intersect(q, T.content_tokens(F.col("caption")))) + F.size(F.array_intersect(q, T.content_tokens(F.col("text"))))
    return contexts.withColumn("score", score).where(F.col("score") >= least)


# ---------------------------------------------------------------- queries

query("t23_chat_search")(lambda spark, sf_dir: chat_search(table(spark, sf_dir, "conversations"), "what is the answer of this", 10))
query("t24_chat_context")(lambda spark, sf_dir: chat_search(table(spark, sf_dir, "conversations"), "the", 2000, session=1).select("conv_id", "turn", F.round("score", 6).alias("score")))
query("j04_figures_in_text", """WITH c AS (SELECT doc_id, 'see Figure ' || doc_id % 7 || ' and fig. ' || doc_id % 5 AS t FROM documents), f AS (SELECT 'Figure ' || item_id AS figure_id FROM benchmark WHERE item_id < 4 UNION ALL SELECT 'Fig. ' || item_id FROM benchmark WHERE item_id < 3)
SELECT DISTINCT doc_id, figure_id FROM c, f WHERE contains(lower(t) || ' ', lower(figure_id) || ' ')""")(
    lambda spark, sf_dir: figures_in_text(
        table(spark, sf_dir, "documents").select("doc_id", F.expr("concat('see Figure ', doc_id % 7, ' and fig. ', doc_id % 5)").alias("text")),
        table(spark, sf_dir, "benchmark").selectExpr("explode(array(if(item_id < 4, concat('Figure ', item_id), null), if(item_id < 3, concat('Fig. ', item_id), null))) figure_id").where("figure_id is not null"),
    )
)
query("j21_interleave", """WITH b AS (SELECT floor(doc_id / 50)::BIGINT AS page, doc_id * 7 % 100 AS y, 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT floor(page_id / 50)::BIGINT, page_id * 11 % 100, 1, page_id, url FROM pages)
SELECT page, string_agg(text, chr(10) || chr(10) ORDER BY y, kind, id) AS text FROM b GROUP BY page""")(
    lambda spark, sf_dir: interleave(table(spark, sf_dir, "documents").selectExpr("doc_id div 50 page", "doc_id * 7 % 100 y", "doc_id id", "text"), table(spark, sf_dir, "pages").selectExpr("page_id div 50 page", "page_id * 11 % 100 y", "page_id id", "url text"))
)
query("u03_image_scores", """WITH q AS (SELECT list_distinct(['steel', 'red', 'brand']) AS q), t AS (SELECT p_partkey, string_split(regexp_replace(lower(p_type), '[^a-z0-9 ]', ' ', 'g'), ' ') AS c, string_split(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g'), ' ') AS x FROM part)
SELECT p_partkey, (2 * len(list_intersect(q, c)) + len(list_intersect(q, x)))::INT AS score FROM t, q WHERE 2 * len(list_intersect(q, c)) + len(list_intersect(q, x)) >= 1""")(
    lambda spark, sf_dir: image_scores(table(spark, sf_dir, "part").selectExpr("p_partkey", "p_type caption", "p_name text"), F.lit("the steel red, brand")).select("p_partkey", "score")
)
query("a11_groups_by_label", "SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS BIGINT) AS n, event_id FROM events")(
    lambda spark, sf_dir: L.ranked_in_groups(table(spark, sf_dir, "events"), "event_type", [F.desc("value"), "event_id"]).select("event_type", "n", "event_id")
)
query("a30_largest_per_group", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) q WHERE r = 1")(
    lambda spark, sf_dir: L.best_per_group(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"]).select("l_orderkey", "l_linenumber")
)
query("a33_fingerprint", "SELECT o_custkey, md5(string_agg(o_orderpriority || ':' || o_orderkey, '' ORDER BY o_orderpriority, o_orderkey)) AS hash FROM orders GROUP BY o_custkey")(
    lambda spark, sf_dir: table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderpriority", "o_orderkey"))), lambda x: F.concat(x["o_orderpriority"], F.lit(":"), x["o_orderkey"].cast("string"))), "")).alias("hash"))
)
query("o06_chunk_order", "SELECT doc_id, CAST(row_number() OVER (ORDER BY source, doc_id) AS BIGINT) AS n FROM documents")(
    lambda spark, sf_dir: L.numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"]).select("doc_id", "n")
)
query("o08_rerank", "SELECT vec_id, label FROM (SELECT vec_id, label FROM embeddings ORDER BY label DESC, vec_id LIMIT 10) q")(
    lambda spark, sf_dir: L.first_rows(table(spark, sf_dir, "embeddings").select("vec_id", "label"), [F.desc("label"), "vec_id"], 10)
)
query("f80_rect_to_viewport", "SELECT event_id, round(value * 1.5, 6) AS x, round(792 - value * 1.5, 6) AS y FROM events")(
    lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", *[F.round(v, 6).alias(n) for n, v in zip("xy", L.rect_to_viewport(F.col("value"), F.col("value"), 1.5, 792.0))])
)
query("f86_box_to_pixels", "SELECT l_orderkey, l_linenumber, round(l_discount * 612, 4) AS px, round(l_tax * 792, 4) AS py FROM lineitem")(
    lambda spark, sf_dir: table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[v.alias(n) for n, v in zip(("px", "py"), L.box_to_pixels(F.col("l_discount"), F.col("l_tax"), 612.0, 792.0))])
)
query("j12_session_list", "SELECT o_custkey, count(*) AS n, max(o_orderdate) AS updated FROM orders GROUP BY o_custkey")(
    lambda spark, sf_dir: L.session_list(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")
)
