import random

from pyspark.sql import functions as F

from veilscan.operators.components import connected_components
from veilscan.operators.ordering import ranged, with_previous, with_running_sum


def test_running_sum_and_previous_cross_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaaaab"), i, rng.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(7)
    order = ranged(df, ["g", "i"], "t").df
    got = {(r.g, r.i): (r.run, r.prev) for r in with_previous(with_running_sum(order, F.col("v"), "run", ["g"]), "g", "i", "prev").collect()}
    run, prev = {}, {}
    for g, i, v in sorted(rows):
        run[g] = run.get(g, 0) + v
        assert got[g, i] == (run[g], prev.get(g))
        prev[g] = i


def test_running_sum_over_all_and_empty(spark):
    df = spark.range(100).withColumnRenamed("id", "i")
    order = ranged(df, ["i"], "t").df
    assert max(r.run for r in with_running_sum(order, F.lit(1), "run").collect()) == 100
    assert with_running_sum(ranged(df.limit(0), ["i"], "t").df, F.lit(1), "run").count() == 0


def test_components_chain_star_loops_and_nulls(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, x) for x in range(1001, 1200)] + [(5, 5), (None, 3), (7, None), (1, 0)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").df.collect()}
    assert set(got[i] for i in range(301)) == {0}
    assert set(got[i] for i in range(1000, 1200)) == {1000}
    assert len(got) == 501
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").df.count() == 0
