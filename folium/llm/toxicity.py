"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words without surrounding punctuation and their first four, five and six bytes, hashed
to 32 bits. The score is the logistic of bias + linear weights + pairwise interactions of latent vectors, the latter
over the number of terms. It is fitted by AdaGrad on at most SAMPLE labelled rows (those with the smallest hashes of
their doc_id, whatever the table's size) from the training part. Learned are the terms whose presence tells about the label:
those with a likelihood-ratio statistic of at least TELLING; the many others would only add noise to long texts. Every
text is scored whole.

Cases: a null or empty text has no terms and scores the bias; labels that are null or not 0 or 1, or of no document, are not
learned from, of repeated labels of one doc_id the largest counts, of repeated documents the first text in order; repeated
rows score alike; without both labels in the training
part every score is the smoothed share of toxic rows; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm.common import Scratch, add_columns, table, utf8, words_of

#: The bound on labelled rows the model is fitted on.
SAMPLE = 12_000
TELLING, FACTORS, EPOCHS, BATCH, RATE, DECAY = 11.0, 8, 12, 64, 0.1, 1e-5
#: Steps of few samples at least.
STEPS = 3000
PREFIXES = (4, 5, 6)
EDGES = b".,;:!?\"'()[]{}<>*#$%&|-_=+/\\~`^@"
CACHE_WORDS = 300_000


def terms_of(word: bytes) -> list[int]:
    """Hashed terms of one word."""
    bare = word.strip(EDGES)
    if not bare:
        return []
    return [zlib.crc32(bare)] + [zlib.crc32(bare[:n], n) for n in PREFIXES if len(bare) > n]


def held_out(doc_id: Column, parts: int) -> Column:
    """Whether crc32 of the doc_id as text leaves the remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))


@dataclass
class Machine:
    bias: float
    terms: np.ndarray  # sorted hashes
    linear: np.ndarray
    latent: np.ndarray

    def score(self, rows: np.ndarray) -> float:
        """Log-odds of a text with these rows of the model."""
        if not len(rows):
            return self.bias
        v = self.latent[rows]
        pair = 0.5 * float((v.sum(axis=0) ** 2).sum() - (v * v).sum()) / len(rows)
        return self.bias + float(self.linear[rows].sum()) + pair


def g_statistic(n: Column, hits: Column, docs: int, toxic: int) -> Column:
    """How strongly presence (in n of docs samples, hits of the toxic ones) and the label depend on one another."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    cells = ((hits, n * toxic), (n - hits, n * (docs - toxic)), (toxic - hits, (docs - n) * toxic), (docs - n - toxic + hits, (docs - n) * (docs - toxic)))
    return F.lit(2.0) * sum((part(seen, row / docs) for seen, row in cells), F.lit(0.0))


def log_odds(toxic: float, n: int) -> float:
    """Of the smoothed share of toxic samples."""
    rate = (toxic + 0.5) / (n + 1)
    return float(np.log(rate / (1 - rate)))


def nothing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """No terms, and so no weights."""
    return np.array([], np.uint32), np.array([], np.float32), np.zeros((0, FACTORS), np.float32)


def fit(samples: list[tuple[int, np.ndarray]], terms: np.ndarray) -> Machine:
    """A machine over these terms from (label, rows of the terms in a text) pairs."""
    labels = np.array([y for y, _ in samples], np.float64)
    bias = log_odds(labels.sum(), len(labels))
    rows = [r for _, r in samples]
    rng = np.random.default_rng(7)
    w, v = np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS))
    gw, gv, gb = np.full(len(terms), 1e-8), np.full((len(terms), FACTORS), 1e-8), 1e-8
    for _ in range(max(EPOCHS, STEPS * BATCH // len(samples))):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), BATCH):
            docs = [i for i in order[at : at + BATCH] if len(rows[i])]
            if not docs:
                continue
            idx, n = np.concatenate([rows[i] for i in docs]), np.array([len(rows[i]) for i in docs])
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            of = v[idx]
            total = np.add.reduceat(of, starts)
            pair = 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((of * of).sum(axis=1), starts)) / n
            z = bias + np.add.reduceat(w[idx], starts) + pair
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[docs]
            each = np.repeat(g, n)
            uniq, inverse = np.unique(idx, return_inverse=True)
            dw = np.bincount(inverse, each, len(uniq)) / len(docs) + DECAY * w[uniq]
            dof = (each / np.repeat(n, n))[:, None] * (np.repeat(total, n, axis=0) - of)
            dv = np.stack([np.bincount(inverse, dof[:, f], len(uniq)) for f in range(FACTORS)], axis=1) / len(docs) + DECAY * v[uniq]
            gw[uniq] += dw**2
            gv[uniq] += dv**2
            db = float(g.mean())
            gb += db**2
            w[uniq] -= RATE * dw / np.sqrt(gw[uniq])
            v[uniq] -= RATE * dv / np.sqrt(gv[uniq])
            bias -= RATE * db / np.sqrt(gb)
    return Machine(float(bias), terms, w.astype(np.float32), v.astype(np.float32))


def training_texts(docs: DataFrame, labels: DataFrame, parts: int = 5) -> DataFrame:
    """(toxic, text) of at most SAMPLE labelled documents outside the held-out part."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"), parts)).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    known = known.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(SAMPLE)
    sampled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return sampled.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame, parts: int = 5) -> Machine:
    """Terms are counted in Spark; the driver gets those that tell about the label and, of each sampled text, which of them it has."""
    spark = docs.sparkSession

    def hashed(texts: pa.Array) -> list[pa.Array]:
        found = [np.unique(np.fromiter(chain.from_iterable(map(terms_of, set(words_of(utf8(t.as_py()))))), np.int64)) for t in texts]
        return [pa.array(found, pa.list_(pa.int64()))]

    texts = training_texts(docs, labels, parts)
    sample = Scratch(spark, "toxicity").write(add_columns(texts, "text", hashed, "terms array<bigint>").select("toxic", "terms"), "sample")
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or toxic in (0, n):
        return Machine(log_odds(toxic, n), *nothing())
    counted = sample.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))
    telling = counted.where(g_statistic(F.col("n"), F.col("hits"), n, toxic) >= TELLING).select("term").collect()
    terms = np.array(sorted(r["term"] for r in telling), np.uint32)

    def present(found: pa.ListArray) -> list[pa.Array]:
        rows = [np.searchsorted(terms, t)[np.isin(t, terms, assume_unique=True)] for t in (np.array(x.as_py(), np.int64) for x in found)]
        return [pa.array([r.astype(np.int32).tobytes() for r in rows], pa.binary())]

    rows = add_columns(sample, "terms", present, "rows binary").select("toxic", "rows").collect()
    samples = [(r["toxic"], np.frombuffer(bytes(r["rows"]), np.int32).astype(np.int64)) for r in rows]
    return fit(sorted(samples, key=lambda x: (x[0], len(x[1]), x[1].tobytes())), terms)


class Scorer:
    """A machine and the rows of the words met so far."""

    def __init__(self, machine: Machine):
        self.machine, self.row_of = machine, {int(h): i for i, h in enumerate(machine.terms)}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def rows(self, word: bytes) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            found = tuple(self.row_of[h] for h in terms_of(word) if h in self.row_of)
            if len(self.known) < CACHE_WORDS and len(word) < 40:
                self.known[word] = found
        return found

    def odds(self, text: bytes) -> float:
        return self.machine.score(np.unique(np.fromiter(chain.from_iterable(map(self.rows, set(words_of(text)))), np.int64)))


_SCORERS: list[Scorer] = []


def scorer_of(machine: Machine) -> Scorer:
    """That of the machine a worker process used last, or a new one."""
    if not _SCORERS or _SCORERS[0].machine is not machine:
        _SCORERS[:] = [Scorer(machine)]
    return _SCORERS[0]


def score_texts(docs: DataFrame, model: Machine, out: str = "score") -> DataFrame:
    """docs with the model's probability of label 1 in a last column, which replaces any other of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> list[pa.Array]:
        scorer = scorer_of(shared.value)
        odds = np.array([scorer.odds(utf8(text.as_py())) for text in texts], np.float64)
        return [pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))]

    return add_columns(docs.drop(out), "text", score, T.StructType([T.StructField(out, T.DoubleType())]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
