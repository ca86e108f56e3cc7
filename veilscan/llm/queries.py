"""Queries of the training-data problems, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import leaks, neardup, overlaps, packing, quality, splits
from veilscan.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = overlaps.cross_split_overlaps(table(spark, d, "labelled_text"))
    return found.select(F.least("train_id", "held_id").alias("sample_id_a"), F.greatest("train_id", "held_id").alias("sample_id_b")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_report(overlaps.cross_split_overlaps(table(spark, d, "labelled_text")))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_classes(table(spark, d, "labelled_text"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "labelled_text").select(F.lit(0).alias("coll"), F.col("sample_id").alias("id"), "text")
    return samples.union(table(spark, d, "trap").select(F.lit(1).alias("coll"), F.col("trap_id").alias("id"), F.col("payload").alias("text")))


def _collection() -> Column:
    return F.when(F.col("coll") == 0, "labelled_text").otherwise("trap").alias("collection")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.group_pairs(neardup.near_groups(_records(spark, d))).select(_collection(), "id_a", "id_b").distinct()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = neardup.near_groups(_records(spark, d))
    least = groups.groupBy("group_key").agg(F.min("id").alias("group_id"))
    return groups.join(least, "group_key").select(_collection(), "id", "group_id", "class_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.tied_samples(table(spark, d, "labelled_text"))


def p4_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "labelled_text"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, d, "documents")))


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "external_eval"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_matches(spark, d).filter("match = 'phrase'").select("doc_id", "item_id").distinct()


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_statistics(spark, d).filter("kind IS NOT NULL").select("doc_id", "kind")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_report": p3_report, "p3_classes": p3_classes, "p5_found": p5_found, "p5_groups": p5_groups, "p4_found": p4_found, "p4_split": p4_split, "p6_containers": p6_containers, "p6_report": p6_report, "p7_found": p7_found, "p7_matches": p7_matches, "p8_found": p8_found, "p8_statistics": p8_statistics}
