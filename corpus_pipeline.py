"""The corpus pipeline: stages that each call one operator of folium.llm on what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import mixing, neardup, packing, pii, toxicity
from folium.llm.common import Scratch, columns_of, fresh, table

#: Documents are near duplicates from this Jaccard similarity of their runs of five words on, in percent.
SIMILAR_PERCENT = 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine calls toxic (from 0.5 on) go.

    Cases: null, empty and very long texts are scored whole, an empty one by the bias, and go only if that is toxic; labels
    that are null, of no document or neither 0 nor 1 are not learned from; equal texts score alike, so ties and repeated rows go
    or stay together; an empty table stays empty; columns may have any names and pass through unchanged.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    score = fresh("toxicity", docs)
    return toxicity.score_texts(docs, model, score).where(F.col(score) < 0.5).select(*columns_of(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of its smallest doc_id.

    Cases: rows without words or without a doc_id link with nothing and stay; very long texts are compared whole; of rows that
    agree in doc_id and text one stays, rows of one doc_id with other texts are documents of their own; an empty table stays
    empty; columns may have any names and pass through unchanged.
    """
    return neardup.drop_near_duplicates(docs, SIMILAR_PERCENT)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed personal data is replaced by its kind; all documents stay.

    Cases: a null text stays null, an empty one empty; very long texts are read whole; repeated rows are masked alike;
    n_chars, where it is a column, follows the text; an empty table stays empty; other columns pass through unchanged.
    """
    return pii.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets.

    Cases: a null source is one of its own; texts that are null or without words count nothing and follow their source's rate;
    repeated rows share their doc_id's draw; an empty table stays empty; columns may have any names and pass through. The copies
    of a document are equal rows; `pack` tells them apart.
    """
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document sits in the training sequences.

    Cases: a null or empty text is the closing id alone; texts longer than a sequence are cut into pieces; every copy and every
    repeated row is packed, under a `copy` number of its own; an empty table gives no rows; other columns are not read.
    """
    return packing.pack_documents(packing.numbered_copies(docs.select("doc_id", "text")))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: Scores of a trained model and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
