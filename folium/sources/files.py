"""Scans of files: parsed JSON, whole texts, TEI references, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parsed_json(spark: SparkSession, path: str, schema: str, name_contains: str = "") -> DataFrame:
    """Parsed JSON files; records that don't parse keep their text in _corrupt_record, unreadable files are skipped."""
    df = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).json(path)
    return df.withColumn("file", F.input_file_name()).where(F.col("file").contains(name_contains))


def read_whole_texts(spark: SparkSession, path: str, name_prefix: str = "") -> DataFrame:
    """(file, text) of Markdown or text files."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return df.where(F.element_at(F.split("file", "/"), -1).startswith(name_prefix))


def read_tei_references(spark: SparkSession, path: str) -> DataFrame:
    """biblStruct rows of TEI files: title, first author's surname and the year."""
    schema = "analytic struct<title:array<string>,author:array<struct<persName:struct<surname:string>>>>, monogr struct<title:array<string>,imprint:struct<date:struct<_when:string>>>"
    rows = spark.read.format("xml").option("rowTag", "biblStruct").schema(schema).load(path)
    return rows.select(
        F.coalesce(F.try_element_at("analytic.title", F.lit(1)), F.try_element_at("monogr.title", F.lit(1))).alias("title"),
        F.transform("analytic.author", lambda a: a["persName"]["surname"]).alias("authors"), F.left(F.col("monogr.imprint.date._when"), F.lit(4)).alias("year"),
    )


def read_page_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, w, h) of the surfaces of TEI files; those without a whole page number or with sizes that are no numbers are left out."""
    rows = spark.read.format("xml").option("rowTag", "surface").schema("_n string, _lrx string, _lry string").load(path)
    sizes = rows.select(F.input_file_name().alias("file"), F.col("_n").try_cast("int").alias("page"), F.col("_lrx").try_cast("double").alias("w"), F.col("_lry").try_cast("double").alias("h"))
    return sizes.where("page is not null and w is not null and h is not null")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(name, url, short_definition) of a dictionary, a JSON array; terms without a name are left out."""
    return spark.read.schema("name string, url string, short_definition string").option("multiLine", True).json(path).where("trim(name) <> ''")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified), newest first, without reading contents."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")
