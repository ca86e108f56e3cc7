"""Connected components by iterated minimum labels with star shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.session import Stage, stage


def _minimum_of_neighbours(edges: DataFrame, both: bool) -> tuple[DataFrame, DataFrame]:
    """Each (u, v), and for each u the least of u and its neighbours v (partial sums before the shuffle)."""
    pairs = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    if both:
        pairs = pairs.unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs, least.withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    pairs, least = _minimum_of_neighbours(edges, True)
    hung = pairs.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return hung.filter("hi > lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    pairs, least = _minimum_of_neighbours(edges, False)
    hung = pairs.join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    own = least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))
    return hung.unionByName(own).filter("hi > lo").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Each upper end has one lower end, and no lower end is an upper end of another edge."""
    n, nodes = edges.groupBy("hi").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*")).first()
    if (n or 0) != nodes:
        return False
    return edges.select(F.col("lo").alias("hi")).distinct().join(edges.select("hi"), "hi", "left_semi").isEmpty()


def connected_components(edges: DataFrame, a: str, b: str, name: str = "components", most_rounds: int = 60) -> Stage:
    """Rows (node, label): for each node of an edge its component's least node.

    Every round hangs each node's neighbours on the least label seen (first the larger ones, then the smaller
    ones with the node itself), so that long chains shrink to stars in about log(n) rounds. Nodes are BIGINT.
    Edges stay distributed; a round's result is written to the shared folder, which cuts lineage, and the
    driver sees only counts: the rounds end when each node hangs on one label and no label hangs on another.
    Null ends and loops tie nothing. An empty edge table gives an empty result.
    """
    known = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    pair = known.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi > lo")
    now = stage(pair.distinct(), f"{name}-0")
    for k in range(1, most_rounds + 1):
        after = stage(_small_star(_large_star(now.df)), f"{name}-{k}")
        now.drop()
        now = after
        if _is_stars(now.df):
            break
    else:
        raise RuntimeError("the edges are no stars after the last round")
    stars = now.df.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    roots = now.df.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return Stage(now.spark, now.path, stars.unionByName(roots))
