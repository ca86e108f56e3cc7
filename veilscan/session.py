"""Session helpers: reading tables and writing intermediate tables to shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of the test-data layout; column pruning and filters are left to Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Small inputs (fewer scan tasks than cores) dealt out evenly before costly per-row work; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named in ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, a laptop) a folder of this machine is made, once.
    """
    global _LOCAL_DIR
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="veilscan-")
        atexit.register(shutil.rmtree, _LOCAL_DIR, ignore_errors=True)
    return _LOCAL_DIR


class Stage:
    """An intermediate result written as Parquet to the shared folder.

    Cuts lineage in a way that survives the loss of executors, and compresses better than a row checkpoint. What still stands
    when the session ends is named by ``kept`` and removed by ``drop_stages``.
    """

    kept: set[str] = set()

    def __init__(self, spark: SparkSession, path: str, df: DataFrame):
        self.spark, self.path, self.df = spark, path, df

    def drop(self) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        Stage.kept.discard(self.path)


#: With it, the shuffle files of a write are removed when the write is over, and not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> Stage:
    """Write ``df`` once and read it back with its schema known (no inference pass); its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilscan/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    Stage.kept.add(path)
    return Stage(spark, path, spark.read.schema(df.schema).parquet(path))


def drop_stages(spark: SparkSession) -> None:
    """Remove every intermediate table that this process still keeps; results that are not yet written lose their source."""
    for path in list(Stage.kept):
        Stage(spark, path, None).drop()
