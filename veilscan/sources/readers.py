"""Sources and sinks: files of any kind, labelled JSON lines, findings as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELLED = "text string, category string, source string"


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, content) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def text_items(found: DataFrame) -> DataFrame:
    """(kind, id, text) of the files that read as UTF-8; the id is a hash of the path."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return found.select(F.lit("file").alias("kind"), F.xxhash64("path").alias("id"), "path", F.regexp_replace(text, "^﻿", "").alias("text")).filter("text IS NOT NULL")


def labelled_lines(spark: SparkSession, path: str, label: int, shortest: int = 30, longest: int = 5000) -> DataFrame:
    """Labelled JSON lines with length bounds; a missing source is NULL, broken lines fall away."""
    rows = spark.read.schema(LABELLED).json(path).filter(F.length("text").between(shortest, longest))
    return rows.withColumn("label", F.lit(label))


def write_findings(found: DataFrame, path: str) -> None:
    found.write.mode("overwrite").json(path)
