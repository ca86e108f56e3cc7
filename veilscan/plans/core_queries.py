"""Queries of the general record problems, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilscan.operators import drift, nested
from veilscan.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "suite_result")).distinct()


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified_table(table(spark, d, "suite_result"))


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    return nested.occurrences(table(spark, d, "scan_report"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.bridge(_occurrences(spark, d)).select("report_id", "parent_path", "path")


def p2_bridge(spark: SparkSession, d: str) -> DataFrame:
    return nested.full_bridge(_occurrences(spark, d))


def p2_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.full_objects(_occurrences(spark, d))


def p2_scalars(spark: SparkSession, d: str) -> DataFrame:
    return nested.scalars(_occurrences(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_table": p1_table, "p2_found": p2_found, "p2_bridge": p2_bridge, "p2_objects": p2_objects, "p2_scalars": p2_scalars}
