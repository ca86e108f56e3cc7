"""Splits that keep related records together: minimum labels over the record-entity graph, then stratified assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.operators.components import connected_components
from veilscan.operators.ordering import ranged, with_running_sum
from veilscan.session import Stage, stage

#: Stand-ins for a missing source or author, by letters and digits only. "real" is the default
#: that the reference's loader puts where a source is missing.
STAND_INS = ("", "na", "nan", "nil", "none", "null", "unknown", "anonymous", "missing", "undefined", "unspecified", "notavailable", "notapplicable", "tbd", "real")
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Groups of at least this share of all samples (so at most 1 / share of them) are placed one by one.
LARGE = 0.001


def entity_key(name: Column) -> Column:
    """Letters and digits of the name without case; NULL for a missing name or a stand-in."""
    key = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")
    return F.when(~key.isin(*STAND_INS), key)


def record_entities(samples: DataFrame) -> DataFrame:
    """(sample_id, label, entities): each sample's source and author as hashes, over all its deliveries."""
    rows = samples.filter("sample_id IS NOT NULL").select(
        "sample_id", "label", entity_key(F.col("source")).alias("s"), entity_key(F.col("author")).alias("a"), entity_key(F.col("category")).alias("c")
    )
    sources = rows.filter("s IS NOT NULL").select(F.col("s").alias("c")).distinct()
    named = rows.filter("s IS NULL AND c IS NOT NULL")
    found = named.join(sources.withColumn("known", F.lit(True)), "c", "left").withColumn("s", F.expr("CASE WHEN known THEN c END"))
    rows = rows.filter("s IS NOT NULL OR c IS NULL").select("sample_id", "label", "s", "a").unionByName(found.select("sample_id", "label", "s", "a"))
    s = F.when(F.col("s").isNotNull(), F.xxhash64(F.lit("source"), "s"))
    a = F.when(F.col("a").isNotNull(), F.xxhash64(F.lit("author"), "a"))
    one = rows.select("sample_id", "label", s.alias("s"), a.alias("a")).groupBy("sample_id").agg(
        F.max("label").alias("label"), F.array_distinct(F.concat(F.array_sort(F.collect_set("s")), F.array_sort(F.collect_set("a")))).alias("e")
    )
    return one


def tied_groups(samples: DataFrame) -> tuple[Stage, DataFrame]:
    """(records with their first entity ``node``; per node: group_id = the least sample_id tied, n = samples in the group).

    Record nodes are contracted: a record with several entities is an edge from its first to each other. What is shuffled
    per round is the distinct entity pairs, not the records; a hot source is one node, its counts are summed before any
    shuffle.
    """
    one = record_entities(samples)
    records = stage(one.select("sample_id", "label", F.try_element_at("e", F.lit(1)).alias("node"), F.expr("slice(e, 2, greatest(size(e), 1))").alias("rest")), "split-records")
    edges = records.df.filter("size(rest) > 0").select("node", F.explode("rest").alias("other")).distinct()
    labels = connected_components(edges, "node", "other", "split-components").df.withColumnRenamed("label", "root")
    nodes = records.df.filter("node IS NOT NULL").groupBy("node").agg(F.min("sample_id").alias("least_id"), F.count("*").alias("n"))
    nodes = nodes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = nodes.groupBy("root").agg(F.min("least_id").alias("group_id"), F.sum("n").alias("n"))
    return records, nodes.select("node", "root").join(groups, "root").select("node", "group_id", "n")


def tied_samples(samples: DataFrame) -> DataFrame:
    """(sample_id, group_id) of each sample tied, directly or through others, to at least one other.

    ``samples`` has sample_id, source, author, category and label; other columns are ignored. Missing values and stand-ins tie
    nothing; deliveries of one sample_id are one sample with the ties of all. Null ids are left out. Empty in, empty out.
    """
    records, nodes = tied_groups(samples)
    return records.df.join(nodes.filter("n > 1"), "node").select("sample_id", "group_id")


def _place_large(groups: list, totals: dict[int, int], proportions: dict[str, float]) -> tuple[dict[int, str], dict[str, float]]:
    """Largest first, each group to the split where it leaves the least squared deviation from the wanted label counts."""
    wanted = {(s, y): p * t for s, p in proportions.items() for y, t in totals.items()}
    have = dict.fromkeys(wanted, 0)
    placed: dict[int, str] = {}
    for g in sorted(groups, key=lambda g: (-g.n, g.group_id)):
        mix = {1: g.positive, 0: g.n - g.positive}

        def cost(s: str) -> float:
            over = lambda y: have[s, y] + mix[y] - wanted[s, y]
            before = lambda y: have[s, y] - wanted[s, y]
            return sum((over(y) ** 2 - before(y) ** 2) / max(proportions[s], 1e-9) for y in mix)

        best = min(proportions, key=lambda s: (cost(s), s))
        placed[g.group_id] = best
        for y in mix:
            have[best, y] += mix[y]
    left = {s: max(0.0, sum(wanted[s, y] - have[s, y] for y in totals)) for s in proportions}
    return placed, left


def assign_splits(samples: DataFrame, proportions: dict[str, float] | None = None) -> DataFrame:
    """(sample_id, group_id, split): tied samples never part, splits near their proportions, labels spread alike.

    Groups of at least LARGE of all samples come to the driver (their number is bounded by 1 / LARGE) and are placed one
    by one. The rest are ordered by label mix and hash over range partitions; a group goes to the split in whose
    share of the running total its middle falls, mix by mix, so that what the large groups took is made up for.
    A sample without ties is a group of its own. Labels other than 1 count as 0.
    """
    proportions = proportions or PROPORTIONS
    records, nodes = tied_groups(samples)
    full = records.df.join(nodes.drop("n"), "node", "left").select("sample_id", F.coalesce("group_id", "sample_id").alias("group_id"), F.when(F.col("label") == 1, 1).otherwise(0).alias("y"))
    full = stage(full, "split-samples").df
    groups = stage(full.groupBy("group_id").agg(F.count("*").alias("n"), F.sum("y").alias("positive")), "split-groups").df
    n, positive = groups.agg(F.sum("n"), F.sum("positive")).first()
    n, positive = n or 0, positive or 0
    large = groups.filter(F.col("n") >= max(2, LARGE * n)).collect()
    placed, left = _place_large(large, {1: positive, 0: n - positive}, proportions)
    total = sum(left.values()) or 1.0
    rest = groups.filter(F.col("n") < max(2, LARGE * n)).withColumns({"mix": F.round(10 * F.col("positive") / F.col("n")).cast("int"), "h": F.xxhash64("group_id")})
    order = with_running_sum(ranged(rest, ["mix", "h", "group_id"], "split-order").df, F.col("n"), "run", ["mix"])
    sums = rest.groupBy("mix").agg(F.sum("n").alias("mix_total"))
    order = order.join(F.broadcast(sums), "mix").withColumn("u", (F.col("run") - F.col("n") / 2) / F.col("mix_total"))
    split, upto = F.lit(list(proportions)[-1]), 1.0
    for s in reversed(list(proportions)[:-1]):
        upto -= left[list(proportions)[list(proportions).index(s) + 1]] / total
        split = F.when(F.col("u") < upto, s).otherwise(split)
    small = order.select("group_id", split.alias("split"))
    spark = samples.sparkSession
    big = spark.createDataFrame([(int(g), s) for g, s in placed.items()], "group_id bigint, split string")
    return full.join(small.unionByName(big), "group_id").select("sample_id", "group_id", "split")
