"""File sources. Every column arrives as text; typing is the normaliser's job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from factorwise.functions.text import WHITESPACE, strip

CORRUPT = "_line_error"
BOM = "﻿"

# File endings and the reader each one gets.
FORMATS = {".csv": "csv", ".json": "json", ".txt": "text", ".md": "text"}


def _csv_header(spark: SparkSession, path: str, encoding: str) -> list[str]:
    """Column names of a CSV source; a byte-order mark is not part of the first name."""
    names = spark.read.option("header", True).option("encoding", encoding).option("inferSchema", False).csv(path).columns
    return [n.lstrip(BOM) for n in names]


def ingest_csv(spark: SparkSession, path: str, *, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header as text columns, plus the raw text of malformed lines and the file name.

    Splittable and schema-on-read: nothing is inferred, bad lines are kept in
    ``_line_error`` instead of failing the job. Use ``encoding="windows-1252"``
    for legacy exports.
    """
    names = _csv_header(spark, path, encoding)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("encoding", encoding)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )


def ingest_json(spark: SparkSession, path: str, schema: T.StructType, *, lines: bool = False) -> DataFrame:
    """JSON object or array of objects per file (or JSON lines); non-objects land in ``_line_error``."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(full)
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )


def ingest_dispatch(spark: SparkSession, path: str, json_schema: T.StructType, *, encoding: str = "UTF-8") -> DataFrame:
    """One frame over a folder of mixed uploads, each read by its ending; other endings are ignored."""

    def only(ending: str):
        return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}")

    parts = []
    header = only(".csv").option("header", True).option("encoding", encoding).csv(path).columns
    if header:
        names = [n.lstrip(BOM) for n in header]
        rows = (
            only(".csv").schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
            .option("header", True).option("enforceSchema", True).option("encoding", encoding).csv(path)
        )
        parts.append(rows.withColumn("source_format", F.lit("csv")).withColumn("source_file", F.col("_metadata.file_path")))
    objects = only(".json").schema(json_schema).option("multiLine", True).json(path)
    parts.append(objects.withColumn("source_format", F.lit("json")).withColumn("source_file", F.col("_metadata.file_path")))
    for ending in (e for e, kind in FORMATS.items() if kind == "text"):
        texts = only(ending).text(path, wholetext=True).withColumnRenamed("value", "text")
        parts.append(texts.withColumn("source_format", F.lit("text")).withColumn("source_file", F.col("_metadata.file_path")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def ingest_text_dir(
    spark: SparkSession, path: str, *, category: str = "regulation", endings: Sequence[str] = (".txt", ".md")
) -> DataFrame:
    """Whole text files below a folder: id (file stem), title, content, source, category; empty files skipped."""
    pattern = "*{" + ",".join(endings) + "}"
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    files = reader.text(path, wholetext=True)
    located = files.select(strip(F.col("value")).alias("content"), F.col("_metadata.file_path").alias("source"))
    stem = _stem(F.url_decode("source"))
    return located.where(F.col("content") != "").select(
        stem.alias("id"),
        F.initcap(F.translate(stem, "_-", "  ")).alias("title"),
        "content",
        "source",
        F.lit(category).alias("category"),
    )
