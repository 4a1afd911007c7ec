"""Retrieval: TF-IDF and dense search, their fusion, extractive answers, and the embedder, retriever and reranker registries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from folium.functions.text import query_keywords
from folium.plans.registry import query
from folium.session import scratch_path, table

TOKEN = r"[\p{L}\p{N}_]{2,}"


# ---------------------------------------------------------------- lexical

def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def terms_of(docs: DataFrame, key: str, text: str, bigrams: bool, parts: int | None = None) -> DataFrame:
    """(key, t): the terms of each text. Bigrams join neighbours of the token stream. Texts are dealt by key."""
    toks = docs.select(key, text).repartition(*([parts] if parts else []), key).select(F.col(key), tokens(F.col(text)).alias("t"))
    if not bigrams:
        return toks
    pairs = F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return toks.select(key, F.concat(F.col("t"), F.when(F.size("t") > 1, pairs).otherwise(F.expr("cast(array() as array<string>)"))).alias("t"))


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", bigrams: bool = True, parts: int | None = None) -> DataFrame:
    """(key, term, tf). A text's terms are sorted and counted within its row, so that none is held or shuffled; only where a key is in
    several rows, their terms are added up."""
    terms = terms_of(docs, key, text, bigrams, parts).select(key, F.sort_array("t").alias("t"))
    places = F.when(F.size("t") > 0, F.sequence(F.lit(0), F.size("t") - 1))
    terms = terms.select(key, "t", F.filter(places, lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1))).alias("first"))
    behind = F.concat(F.slice("first", 2, F.size("first")), F.array(F.size("t")))
    runs = F.zip_with("first", behind, lambda i, j: F.struct(F.get("t", i).alias("term"), (j - i).cast("long").alias("tf")))
    tf = terms.select(key, F.inline(runs))
    repeated = docs.groupBy(key).count().where("count > 1").limit(1).count()
    return tf.groupBy(key, "term").agg(F.sum("tf").alias("tf")) if repeated else tf


#: A vocabulary of so many terms is joined by broadcast (about 10 MB).
BROADCAST_TERMS = 100_000
#: Hashes of terms and norms of texts are, up to so many (at most 100 MB); hashes taken beyond the cap, more than ever collide.
BROADCAST_HASHES, BROADCAST_NORMS, SPARE = 1_000_000, 5_000_000, 1000


def often_enough(tf: DataFrame, hashed: DataFrame, most: int) -> DataFrame:
    """Rows of tf without most of the terms that are not among the `most` terms with most occurrences; hashed: (h, n), counts of hashes of terms.

    Occurrences are counted by the terms' hashes first, which are narrow. A hash counts no less than each of its terms, so if more hashes
    than asked for (by SPARE, for those that terms share) reach a count, the terms asked for reach it too, and so do their hashes.
    """
    spark, path = tf.sparkSession, scratch_path(tf.sparkSession, "hashes")
    hashed.groupBy("h").agg(F.sum("n").alias("cf")).write.option("compression", "zstd").parquet(path)
    counted = spark.read.schema("h long, cf long").parquet(path)
    there, least = 0, 0
    for r in sorted(counted.groupBy("cf").count().collect(), reverse=True):  # a row for each number of occurrences, about the root of all at most
        there, least = there + r["count"], r["cf"]
        if there >= most + SPARE:
            break
    enough = counted.where(F.col("cf") >= least).select("h")
    return tf.withColumn("h", F.xxhash64("term")).join(F.broadcast(enough) if there <= BROADCAST_HASHES else enough, "h", "left_semi").drop("h")


def most_frequent(tf: DataFrame, max_features: int | None, hashed: DataFrame | None = None) -> DataFrame:
    """(term, df, cf) of the terms with most occurrences, ties by term."""
    if max_features:
        tf = often_enough(tf, tf.select(F.xxhash64("term").alias("h"), F.col("tf").alias("n")) if hashed is None else hashed, max_features)
    counted = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return counted.orderBy(F.desc("cf"), "term").limit(max_features) if max_features else counted


def hashed_terms(docs: DataFrame, key: str, text: str, bigrams: bool) -> DataFrame:
    """(h, n): a row for each term of the texts."""
    return terms_of(docs, key, text, bigrams).select(F.explode(F.transform("t", lambda t: F.xxhash64(t))).alias("h")).withColumn("n", F.lit(1))


def vocabulary(tf: DataFrame, docs: DataFrame, max_features: int | None, hashed: DataFrame | None = None) -> DataFrame:
    """(term, df, cf, idf) of the terms with most occurrences, ties by term."""
    vocab = most_frequent(tf, max_features, hashed)
    n = docs.agg(F.count("*").alias("n"))  # one row
    return vocab.crossJoin(F.broadcast(n)).select("term", "df", "cf", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weighed_terms(tf: DataFrame, vocab: DataFrame, max_features: int | None, key: str) -> DataFrame:
    """(key, term, w) before normalisation."""
    idf = vocab.select("term", "idf")
    small = max_features is not None and max_features <= BROADCAST_TERMS
    return tf.join(F.broadcast(idf) if small else idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))


def fit_tfidf(docs: DataFrame, key: str = "doc_id", text: str = "text", bigrams: bool = True, max_features: int | None = 50_000) -> tuple[DataFrame, DataFrame]:
    """Vocabulary (term, df, cf, idf) and L2-normalised postings (key, term, w). The cap keeps the terms with most occurrences, ties by term."""
    tf = term_counts(docs, key, text, bigrams)
    vocab = vocabulary(tf, docs, max_features, hashed_terms(docs, key, text, bigrams))
    weighed = weighed_terms(tf, vocab, max_features, key)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return vocab, weighed.select(key, "term", (F.col("w") / norm).alias("w"))


def search_texts(docs: DataFrame, keywords: DataFrame, k: int, key: str = "doc_id", text: str = "text", bigrams: bool = True, max_features: int | None = 50_000) -> DataFrame:
    """keyword_search over texts that are not fitted yet: norms and the keywords' weights come from one aggregate, no postings are built."""
    tf = term_counts(docs, key, text, bigrams)
    weighed = weighed_terms(tf, vocabulary(tf, docs, max_features, hashed_terms(docs, key, text, bigrams)), max_features, key)
    asked = keywords.select("term").distinct().withColumn("asked", F.lit(True))
    hits = weighed.join(F.broadcast(asked), "term", "left")  # at most a handful of keywords
    scored = hits.groupBy(key).agg(F.sum(F.when(F.col("asked"), F.col("w"))).alias("s"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return scored.where("s is not null").select(key, (F.col("s") / F.col("norm")).alias("score")).orderBy(F.desc(F.round("score", 6)), key).limit(k)


def keyword_search(postings: DataFrame, keywords: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """Top k of (key, score): each keyword is a query of one term, so its cosine is the posting; scores are summed."""
    hits = postings.join(F.broadcast(keywords.select("term")), "term")  # at most a handful of keywords
    return hits.groupBy(key).agg(F.sum("w").alias("score")).orderBy(F.desc(F.round("score", 6)), key).limit(k)


# ---------------------------------------------------------------- dense

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


@F.pandas_udf(DoubleType())
def vector_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """`cosine` of vectors without nulls, for many of them: the same sums in the same order, over all rows at once; null where a vector is null or zero."""
    out, there = np.full(len(a), np.nan), np.flatnonzero((a.notna() & b.notna()).to_numpy())
    if len(there):
        x, y = np.stack(a.iloc[there].to_numpy()).astype(float).T, np.stack(b.iloc[there].to_numpy()).astype(float).T
        xy, xx, yy = (np.zeros(len(there)) for _ in range(3))
        for p, q in zip(x, y, strict=True):
            xy, xx, yy = xy + p * q, xx + p * p, yy + q * q
        size = np.sqrt(xx) * np.sqrt(yy)
        out[there] = np.divide(xy, size, out=np.full(len(there), np.nan), where=size != 0)
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def normalise(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), x))


def dense_search(vectors: DataFrame, query_vector: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Top k of (key, cos, score) for one query vector; score is (1 + cos) / 2."""
    q = F.broadcast(query_vector.select(F.col(vector).alias("q")).limit(1))
    scored = vectors.crossJoin(q).select(key, cosine(F.col(vector), F.col("q")).alias("cos"))
    return scored.orderBy(F.desc(F.round("cos", 6)), key).limit(k).withColumn("score", (1 + F.col("cos")) / 2)


def fuse(dense: DataFrame, lexical: DataFrame, k: int, alpha: float = 0.5, key: str = "id") -> DataFrame:
    """Weighted full-outer fusion of (key, score) lists; a missing side counts 0."""
    both = dense.select(key, (F.col("score") * alpha).alias("s")).unionAll(lexical.select(key, (F.col("score") * (1 - alpha)).alias("s")))
    return both.groupBy(key).agg(F.sum("s").alias("score")).orderBy(F.desc(F.round("score", 6)), key).limit(k)


def hashing_embedder(text: Column, width: int = 64) -> Column:
    """The offline default of the embedder interface: signed hashed tokens, L2-normalised; blank texts are all zeros."""

    def code(word: Column) -> Column:
        h = F.crc32(word.cast("binary"))
        return (h % width * 2 + F.shiftright(h, 16).bitwiseAND(1)).cast("int")

    @F.pandas_udf("array<double>")
    def embed(coded: pd.Series) -> pd.Series:
        out = []
        for codes in coded:
            v = np.zeros(width) if codes is None else np.bincount(codes >> 1, codes % 2 * 2.0 - 1, width)
            norm = np.linalg.norm(v)
            out.append(v / norm if norm else v)
        return pd.Series(out)

    return embed(F.transform(tokens(text), code))


EMBEDDERS: dict[str, Callable[[Column], Column]] = {"hashing": hashing_embedder}
RETRIEVERS: dict[str, Callable] = {"dense": dense_search, "keyword": keyword_search, "hybrid": fuse}
RERANKERS: dict[str, Callable[[DataFrame, int], DataFrame]] = {"none": lambda hits, k: hits.orderBy("rank").limit(k)}


def build_store(chunks: DataFrame, key: str = "doc_id", text: str = "text", embed: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors (key, embedding), vocabulary and postings of chunks; those without text are in none of them."""
    filled = chunks.where(F.coalesce(F.trim(text), F.lit("")) != "")
    vocab, postings = fit_tfidf(filled.select(key, text), key, text)
    return filled.select(key, (embed or EMBEDDERS["hashing"])(F.col(text)).alias("embedding")), vocab, postings


def rerank(hits: DataFrame, question: Column, k: int, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Hits by a scorer of (question, text); without one they pass through in rank order."""
    if scorer is None:
        return RERANKERS["none"](hits, k)
    return hits.withColumn("rerank_score", scorer(question, F.col("text"))).orderBy(F.desc(F.round("rerank_score", 6)), "rank").limit(k)


def with_texts(hits: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Rank-preserving join: hits in order, those without a chunk dropped."""
    return chunks.join(F.broadcast(hits), key).orderBy("rank")  # hits are a top-k list


def ranked(hits: DataFrame, score: str, key: str) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round(score, 6)), key)) - 1)


def extractive_answer(contexts: DataFrame, question: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The sentence of the contexts nearest the question by unigram TF-IDF over sentences and question; the first wins."""
    parts = contexts.select(F.col(key).alias("doc"), F.posexplode(F.split(text, r"\. ")).alias("pos", "sentence")).where(F.trim("sentence") != "")
    numbered = parts.select(F.concat_ws(":", "doc", "pos").alias("sid"), "doc", "pos", "sentence")
    spark = contexts.sparkSession
    asked = spark.createDataFrame([("?", question)], "sid string, sentence string")
    _, postings = fit_tfidf(numbered.select("sid", "sentence").union(asked), "sid", "sentence", bigrams=False, max_features=None)
    q = postings.where("sid = '?'").select("term", F.col("w").alias("qw"))
    scores = postings.where("sid <> '?'").join(F.broadcast(q), "term").groupBy("sid").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
    return numbered.join(scores, "sid").orderBy(F.desc(F.round("score", 6)), "doc", "pos").limit(1).select("doc", "pos", "sentence", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- queries

def _question(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = query_keywords(F.col("text"))
    return table(spark, sf_dir, "benchmark").where("item_id = 0").select(F.explode(words).alias("term"))


_TF = r"""
tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents),
gram AS (
  SELECT doc_id, unnest(t) AS term FROM tok UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM tok
),
tf AS (SELECT doc_id, term, count(*) AS tf FROM gram GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
vocab AS (
  SELECT term, df, cf, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 50000), n
),
wt AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
norm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY doc_id),
post AS (SELECT doc_id, term, w / norm AS w FROM wt JOIN norm USING (doc_id))
"""
_KW = r"""
kw AS (SELECT unnest(list_slice(k, 1, 5)) AS term FROM (
  SELECT list_filter(list_distinct_ordered, lambda x: true) AS k FROM (
    SELECT list(w ORDER BY i) AS list_distinct_ordered FROM (
      SELECT w, min(i) AS i FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
        SELECT list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('the','a','of','and','or','to','in','for','on','by','with','as','is','are','what','which','that')) AS ws
        FROM benchmark WHERE item_id = 0)) GROUP BY w))))
"""


@query("t06_tfidf_vocabulary", f"WITH {_TF} SELECT term, df, cf, round(idf, 6) AS idf FROM vocab")
def t06(spark, sf_dir):
    vocab, _ = fit_tfidf(table(spark, sf_dir, "documents"))
    return vocab.withColumn("idf", F.round("idf", 6))


@query("t04_keyword_search", f"WITH {_TF}, {_KW} SELECT doc_id, round(sum(w), 6) AS score FROM post JOIN kw USING (term) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10")
def t04(spark, sf_dir):
    return search_texts(table(spark, sf_dir, "documents"), _question(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query("t25_build_store", f"WITH {_TF} SELECT doc_id, count(*) AS terms, 64::BIGINT AS width FROM wt GROUP BY doc_id")
def t25(spark, sf_dir):
    vectors, _, postings = build_store(table(spark, sf_dir, "documents"))
    return postings.groupBy("doc_id").agg(F.count("*").alias("terms")).join(vectors.select("doc_id", F.size("embedding").cast("long").alias("width")), "doc_id")


_DENSE = """
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
cosine AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS cos FROM embeddings, q)
"""


@query("t01_knn_search", f"WITH {_DENSE} SELECT vec_id, round(cos, 6) AS cos, round((1 + cos) / 2, 6) AS score FROM cosine ORDER BY round(cos, 6) DESC, vec_id LIMIT 10")
def t01(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return dense_search(v, v.where("vec_id = 0"), 10).select("vec_id", F.round("cos", 6).alias("cos"), F.round("score", 6).alias("score"))


@query("t03_dense_search", f"WITH {_DENSE} SELECT vec_id, row_number() OVER (ORDER BY round(cos, 6) DESC, vec_id) - 1 AS rank FROM cosine ORDER BY rank LIMIT 25")
def t03(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    hits = ranked(dense_search(v, v.where("vec_id = 0"), 25), "cos", "vec_id")
    return hits.select("vec_id", F.col("rank").cast("long").alias("rank"))


@query("t02_cosine_similarity", f"WITH {_DENSE} SELECT vec_id, round(cos, 6) AS cos FROM cosine")
def t02(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return v.crossJoin(F.broadcast(q)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("cos"))


@query("u01_hybrid_fusion", f"""WITH {_TF}, {_KW}, {_DENSE},
l AS (SELECT doc_id AS id, sum(w) AS s FROM post JOIN kw USING (term) GROUP BY doc_id ORDER BY round(sum(w), 6) DESC, doc_id LIMIT 20),
d AS (SELECT vec_id AS id, cos AS s FROM cosine ORDER BY round(cos, 6) DESC, vec_id LIMIT 20)
SELECT id, round(sum(s), 6) AS score FROM (SELECT id, 0.5 * s AS s FROM l UNION ALL SELECT id, 0.5 * s FROM d) GROUP BY id ORDER BY score DESC, id LIMIT 10""")
def u01(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    dense = dense_search(v, v.where("vec_id = 0"), 20).select(F.col("vec_id").alias("id"), F.col("cos").alias("score"))
    lexical = search_texts(table(spark, sf_dir, "documents"), _question(spark, sf_dir), 20).withColumnRenamed("doc_id", "id")
    return fuse(dense, lexical, 10).withColumn("score", F.round("score", 6))


@query("j01_hits_with_texts", f"""WITH {_DENSE}, h AS (SELECT vec_id, cos, row_number() OVER (ORDER BY round(cos, 6) DESC, vec_id) - 1 AS rank FROM cosine ORDER BY round(cos, 6) DESC, vec_id LIMIT 10)
SELECT doc_id, rank, round(cos, 6) AS cos, left(text, 80) AS head FROM h JOIN documents ON doc_id = vec_id""")
def j01(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    hits = ranked(dense_search(v, v.where("vec_id = 0"), 10), "cos", "vec_id").withColumnRenamed("vec_id", "doc_id")
    return with_texts(hits, table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.col("rank").cast("long"), F.round("cos", 6).alias("cos"), F.left("text", F.lit(80)).alias("head"))


@query("t17_extractive_answer")
def t17(spark, sf_dir):
    hits = t01(spark, sf_dir).select(F.col("vec_id").alias("doc_id"))
    docs = table(spark, sf_dir, "documents").join(F.broadcast(hits), "doc_id")
    return extractive_answer(docs, "what is the of and that in on")


@query("t07_hashing_embedding")
def t07(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing_embedder(F.col("text")).alias("embedding"))


@query("f68_query_keywords", r"""SELECT item_id, array_to_string(list_slice(k, 1, 5), ' ') AS keywords FROM (
  SELECT item_id, list(w ORDER BY i) AS k FROM (
    SELECT item_id, w, min(i) AS i FROM (
      SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
        SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('the','a','of','and','or','to','in','for','on','by','with','as','is','are','what','which','that')) AS ws FROM benchmark))
    GROUP BY item_id, w) GROUP BY item_id)""")
def f68(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(query_keywords(F.col("text")), " ").alias("keywords"))
