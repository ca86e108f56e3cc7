"""Filling containers of fixed capacity: exact-complement hashing on the histogram of lengths, then best fit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.operators.ordering import ranged, with_running_sum
from veilscan.session import stage

CAPACITY = 2048
#: A public tokenizer's ranks; the file must be at this path on every executor.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that goes with that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer, loaded once per Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens) over whole texts; a null or empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def _take(left: np.ndarray, sizes: tuple[int, ...], patterns: list) -> int:
    """Fills as many containers with exactly these sizes as the counts allow."""
    need: dict[int, int] = {}
    for s in sizes:
        need[s] = need.get(s, 0) + 1
    m = min(int(left[s]) // k for s, k in need.items())
    if m:
        for s, k in need.items():
            left[s] -= m * k
        patterns.append((sizes, m))
    return m


def _pair_for(left: np.ndarray, total: int, low: int = 1) -> tuple[int, int] | None:
    """The most even pair of lengths at hand that adds up to total: one look at the single-length index for all."""
    half = total // 2
    if half < low:
        return None
    a = np.arange(half, low - 1, -1)
    ok = (left[a] > 0) & (left[total - a] > 0)
    if total % 2 == 0 and ok[0] and left[half] < 2:
        ok[0] = False
    at = ok.argmax()
    return (int(a[at]), int(total - a[at])) if ok[at] else None


def plan_patterns(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, how many containers) that use up ``counts[length]`` items; every length is 1 .. capacity.

    From the longest length down, gaps are looked up in the index of single lengths, then of pair sums, then of triple
    sums; a hit is consumed as often as the counts allow, so each step uses a length up: the number of steps, and of
    patterns, depends on the capacity and not on the number of items. What fills no gap exactly is placed by best fit.
    """
    left = counts.astype(np.int64).copy()
    patterns: list[tuple[tuple[int, ...], int]] = []
    for s in range(capacity, 0, -1):
        while left[s]:
            gap = capacity - s
            if gap == 0:
                _take(left, (s,), patterns)
                continue
            if gap <= s and left[gap] and _take(left, (s, gap), patterns):
                continue
            left[s] -= 1
            two = _pair_for(left, gap)
            three = None
            if two is None:  # the longest of three is at least a third of the gap
                for c in (np.flatnonzero(left[-(-gap // 3) : gap - 1]) + -(-gap // 3))[::-1].tolist():
                    left[c] -= 1
                    two = _pair_for(left, gap - c)
                    left[c] += 1
                    if two is not None:
                        three, two = (c, *two), None
                        break
            left[s] += 1
            if two is None and three is None:
                break
            if not _take(left, (s, *(two or three)), patterns):
                break
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # gap -> containers with that gap
    gaps = np.zeros(capacity + 1, bool)
    for s in range(capacity, 0, -1):
        m = int(left[s])
        while m:
            fit = np.flatnonzero(gaps[s:])
            if len(fit):
                gap = int(fit[0]) + s
                sizes, k = open_[gap].pop()
                t = min(m, k)
                if k > t:
                    open_[gap].append((sizes, k - t))
            else:
                gap, sizes = capacity, ()
                per = capacity // s  # a new container takes as many of this length as fit
                if m >= per:
                    t = m // per
                    sizes = (s,) * (per - 1)
                    m -= t * (per - 1)
                    gap = capacity - s * (per - 1)
                else:
                    t, sizes, gap = 1, (s,) * (m - 1), capacity - s * (m - 1)
                    m = 1
            m -= t
            rest = gap - s
            open_.setdefault(rest, []).append(((*sizes, s), t))
            gaps[rest] = True
            if gap in open_ and not open_[gap]:
                gaps[gap] = False
    return patterns + [p for group in open_.values() for p in group]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, last rank, first container, containers) of each pattern's places; the number of containers."""
    base, used, out = 0, {}, []
    for sizes, m in patterns:
        for s in sorted(set(sizes)):
            n = sizes.count(s) * m
            start = used.get(s, 0)
            used[s] = start + n
            out.append((s, start, start + n - 1, base, m))
        base += m
    return out, base


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str = RANKS) -> DataFrame:
    """(container_id, doc_id, piece, first_token, n_tokens): what each container holds.

    A document longer than the capacity is divided into full containers and a remainder; no other is. Documents of one
    remaining length are ranked over range partitions, and a rank leads to its container through the pattern table,
    which is broadcast: its rows are bounded by the capacity (about three a pattern, some patterns a length), not by
    the number of documents. Documents without tokens go to container 0. Empty in, empty out.
    """
    sized = token_counts(docs, path).withColumns({"q": F.expr(f"n_tokens DIV {capacity}"), "r": F.expr(f"n_tokens % {capacity}")})
    sized = stage(sized, "pack-sizes").df  # ranges are sampled, then written: two reads, one pass of the tokenizer
    order = ranged(sized, ["r", "doc_id"], "pack-order").df
    counts = np.zeros(capacity + 1, np.int64)
    for row in order.groupBy("r").agg(F.count("*").alias("n")).collect():  # at most one row per length
        counts[row.r] = row.n
    counts[0] = 0
    places, n_packed = slots(plan_patterns(counts, capacity))
    spark = docs.sparkSession
    table = spark.createDataFrame(places or [(-1, 0, 0, 0, 1)], "r bigint, lo bigint, hi bigint, base bigint, m bigint")
    ranked = with_running_sum(with_running_sum(order, F.lit(1), "rank", ["r"]), F.col("q"), "run_q")
    ranked = stage(ranked.select("doc_id", "n_tokens", "q", "r", (F.col("rank") - 1).alias("rank"), (F.col("run_q") - F.col("q")).alias("before")), "pack-ranked").df
    on = (ranked["r"] == table["r"]) & F.col("rank").between(F.col("lo"), F.col("hi"))
    rest = ranked.filter("r > 0").join(F.broadcast(table), on).select(
        (F.col("base") + (F.col("rank") - F.col("lo")) % F.col("m")).alias("container_id"), "doc_id", F.col("q").cast("int").alias("piece"), (F.col("q") * capacity).alias("first_token"), ranked["r"].alias("n_tokens")
    )
    whole = ranked.filter("q > 0").select("doc_id", "before", F.explode(F.expr("sequence(0L, q - 1)")).alias("j")).select(
        (F.lit(n_packed) + F.col("before") + F.col("j")).alias("container_id"), "doc_id", F.col("j").cast("int").alias("piece"), (F.col("j") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("n_tokens")
    )
    none = ranked.filter("n_tokens = 0").select(F.lit(0).cast("bigint").alias("container_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("first_token"), "n_tokens")
    return rest.unionByName(whole).unionByName(none)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens and the share of capacity in use."""
    one = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    return one.agg(
        F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.sum(F.when(F.col("used") == capacity, 1).otherwise(0)).alias("n_full"),
        F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("fill"),
    )
