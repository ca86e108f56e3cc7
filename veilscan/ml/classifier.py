"""Trap classifier: hashed word n-grams with inverse document frequencies beside heuristic features, logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.operators import scan

FEATURES = ("keywords", "credentials", "urgency", "role_hijack", "task_markers", "authority", "special_ratio", "length_bucket", "tool_call", "fragment_marker")
#: The model is fitted on at most so many labelled rows, drawn by a hash of their key.
MOST_TRAINING_ROWS = 100_000


def with_features(rows: DataFrame) -> DataFrame:
    """Adds the heuristic features; ``rows`` has kind, id, text, y."""
    low = scan.heuristic_features(rows.select("kind", "id", "text").distinct())
    return rows.join(low.dropDuplicates(["kind", "id"]), ["kind", "id"])


def train(rows: DataFrame, most: int = MOST_TRAINING_ROWS, seed: int = 42) -> PipelineModel:
    """Fits on labelled rows (y is 0 or 1); classes weigh alike."""
    total = rows.count()
    if total > most:
        rows = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * most / total))
    share = rows.agg(F.avg("y")).first()[0] or 0.5
    rows = rows.withColumn("weight", F.when(F.col("y") == 1, 1 - share).otherwise(share) * 2)
    stages = [RegexTokenizer(inputCol="text", outputCol="w1", pattern=r"[^\p{L}\p{N}_]+")]
    vectors = []
    for n in (1, 2, 3):
        if n > 1:
            stages.append(NGram(n=n, inputCol="w1", outputCol=f"w{n}"))
        stages += [HashingTF(numFeatures=1 << 14, inputCol=f"w{n}", outputCol=f"tf{n}", binary=True), IDF(minDocFreq=2, inputCol=f"tf{n}", outputCol=f"idf{n}")]
        vectors.append(f"idf{n}")
    stages += [VectorAssembler(inputCols=vectors, outputCol="raw"), Normalizer(inputCol="raw", outputCol="text_vector"), VectorAssembler(inputCols=["text_vector", *FEATURES], outputCol="features")]
    stages.append(LogisticRegression(labelCol="y", weightCol="weight", regParam=0.002, maxIter=30))
    return Pipeline(stages=stages).fit(rows)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows.withColumn("weight", F.lit(1.0))).withColumn("score", vector_to_array("probability")[1])


def thresholds(scored: DataFrame, steps: int = 100) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) at each of ``steps`` cuts: counts per score bin, then sums over the bins."""
    bins = scored.groupBy(F.floor(F.col("score") * steps).alias("bin")).agg(F.sum("y").cast("bigint").alias("pos"), F.count("*").alias("n"))
    above = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)  # at most steps + 1 rows
    everything = Window.partitionBy()
    rows = bins.withColumns({"tp": F.sum("pos").over(above), "fp": F.sum(F.col("n") - F.col("pos")).over(above), "all_pos": F.sum("pos").over(everything)})
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("all_pos")
    return rows.select((F.col("bin") / steps).alias("threshold"), "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r), 6).alias("f1"))


def metrics(scored: DataFrame, at: float = 0.5, steps: int = 10_000) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1 at the cut (taken to the nearest bin), and auc, the chance that a positive outscores a negative.

    Scores are counted by ``steps`` bins before anything is ordered; ties in a bin count one half. Rows without a label do not
    count; where a class is missing, auc is NULL.
    """
    rows = scored.filter("y IS NOT NULL AND score IS NOT NULL")
    bins = rows.groupBy(F.least(F.floor(F.col("score") * steps), F.lit(steps - 1)).alias("bin")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most ``steps`` rows
    bins = bins.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    yes = F.col("bin") >= round(at * steps)
    n = lambda c, by: F.coalesce(F.sum(F.when(c, F.col(by)).otherwise(0)), F.lit(0)).cast("bigint")
    one = bins.agg(
        n(yes, "pos").alias("tp"), n(yes, "neg").alias("fp"), n(~yes, "pos").alias("fn"), n(~yes, "neg").alias("tn"),
        F.round(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0)), 6).alias("auc"),
    )
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return one.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.try_divide(2 * p * r, p + r), 6)})
