"""Guards over call and message logs: trailing-window limits, loops, fragments that only speak together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.functions import catalog as C
from veilscan.operators.scan import any_of, sanitized


def trailing_count(events: DataFrame, key: str, ts: str, seconds: int, out: str) -> DataFrame:
    """How many events of the key, this one included, are less than ``seconds`` old at each event.

    Time is cut into buckets of ``seconds``; each event also stands in the next bucket, so a bucket holds all that its own
    events look back on. A hot key is thereby spread over time: no task sees more than two buckets of one key. Rows with a
    null key or time are left out. Ties in time count each other.
    """
    width = seconds * 1_000_000
    rows = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = rows.withColumn("_own", F.floor(F.col("_us") / width))
    both = rows.withColumn("_bucket", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    back = Window.partitionBy(key, "_bucket").orderBy("_us").rangeBetween(-(width - 1), 0)
    both = both.withColumn(out, F.count("*").over(back))
    return both.filter(F.col("_bucket") == F.col("_own")).drop("_us", "_own", "_bucket")


def rate_limited(events: DataFrame, key: str, ts: str, most: int, seconds: int = 60) -> DataFrame:
    """Events with ``recent`` and whether they exceed the limit."""
    return trailing_count(events, key, ts, seconds, "recent").withColumn("limited", F.col("recent") > most)


def circuit_breaker(messages: DataFrame, session: str, seq: list[str], peer: str, window: int = 10) -> DataFrame:
    """Messages at which the last ``window`` ones of a session, six at least, went between at most two pairs."""
    last = Window.partitionBy(session).orderBy(*seq).rowsBetween(-(window - 1), 0)
    rows = messages.withColumns({"n_last": F.count("*").over(last), "n_pairs": F.size(F.collect_set(peer).over(last))})
    return rows.withColumn("tripped", (F.col("n_last") >= 6) & (F.col("n_pairs") <= 2))


@dataclass(frozen=True)
class ActionPolicy:
    """What tool calls are held against. ``allowed`` None lets every tool through that no other part of the policy stops."""

    allowed: tuple[str, ...] | None = None
    destructive: bool = False
    network: bool = False
    spawn: bool = False
    most_per_minute: int = 0
    arguments: bool = False


def action_verdicts(calls: DataFrame, tool: str) -> DataFrame:
    """Policy verdict of each call: destructive before network before allowed."""
    t = F.col(tool)
    verdict = F.when(t.rlike(C.DESTRUCTIVE), "destructive").when(t.rlike(C.NETWORK), "network").otherwise("allowed")
    risk = F.when(t.rlike(C.DESTRUCTIVE), 0.9).when(t.rlike(C.NETWORK), 0.7).otherwise(0.0)
    return calls.withColumns({"verdict": verdict, "risk": risk})


def action_policy(calls: DataFrame, tool: str, ts: str, arguments: str, policy: ActionPolicy) -> DataFrame:
    """Adds ``reason`` (NULL: allowed), ``allowed`` and ``risk`` to each call; the first part of the policy that objects is the reason.

    The order is: allow list, destructive, network, spawn, rate (calls of the tool in the last minute), injected arguments. A null tool is
    not on any list; a null argument holds nothing. Calls without a time have no rate. Columns are kept as they are.
    """
    t, checks = F.col(tool), []
    rows = calls
    if policy.allowed is not None:
        checks.append((~F.coalesce(t.isin(*policy.allowed), F.lit(False)), "not_listed", 0.8))
    checks += [(t.rlike(p), name, risk) for on, p, name, risk in ((policy.destructive, C.DESTRUCTIVE, "destructive", 0.9), (policy.network, C.NETWORK, "network", 0.7), (policy.spawn, C.SPAWN, "spawn", 0.8)) if on]
    if policy.most_per_minute:
        timed = trailing_count(calls, tool, ts, 60, "_recent")
        rows = timed.unionByName(calls.filter(F.col(tool).isNull() | F.col(ts).isNull()).withColumn("_recent", F.lit(0).cast("bigint")))
        checks.append((F.col("_recent") > policy.most_per_minute, "rate", 0.6))
    if policy.arguments:
        checks.append((any_of(F.coalesce(arguments, F.lit("")), C.ARGUMENT_RULES) > 0, "injected_argument", 0.8))
    reason, risk = F.lit(None).cast("string"), F.lit(0.0)
    for hit, name, r in reversed(checks):
        reason, risk = F.when(hit, name).otherwise(reason), F.when(hit, r).otherwise(risk)
    rows = rows.withColumns({"reason": reason, "risk": risk})
    return rows.withColumn("allowed", F.col("reason").isNull()).drop("_recent")


def guarded(items: DataFrame, found: DataFrame, injected: DataFrame, mode: str = "strip", block_injection: bool = True) -> DataFrame:
    """(kind, id, outcome, text) of each item: passed, blocked (injection), rejected (mode raise), stripped or logged.

    ``found`` and ``injected`` have (kind, id) of items with hidden channels and with injected instructions. A blocked or rejected item has
    no text, a stripped one its clean text. Null texts pass.
    """
    keys = ["kind", "id"]
    rows = items.join(found.select(*keys).distinct().withColumn("_f", F.lit(True)), keys, "left").join(injected.select(*keys).distinct().withColumn("_i", F.lit(True)), keys, "left")
    dirty = {"strip": "stripped", "raise": "rejected", "log": "logged"}[mode]
    hit = F.coalesce("_f", F.lit(False)) | F.coalesce("_i", F.lit(False))
    outcome = F.when(F.col("_i") & F.lit(block_injection), "blocked").when(hit & F.col("text").isNotNull(), dirty).otherwise("passed")
    rows = rows.withColumn("outcome", outcome)
    text = F.when(F.col("outcome").isin("blocked", "rejected"), None).when(F.col("outcome") == "stripped", sanitized(F.col("text"))).otherwise(F.col("text"))
    return rows.select(*keys, "outcome", text.alias("text"))


def fragment_sessions(sessions: DataFrame, key: str, fragments: str) -> DataFrame:
    """(key, n_fragments, together, apart): how many rules match the joined fragments, and how many match a fragment by itself."""

    def alone(rule: str) -> Column:
        return F.exists(F.col(fragments), lambda x: F.coalesce(x.rlike(rule), F.lit(False))).cast("int")

    apart = sum((alone(p) for p in C.FRAGMENT_RULES), F.lit(0))
    rows = sessions.filter(F.col(fragments).isNotNull())
    return rows.select(key, F.size(fragments).cast("bigint").alias("n_fragments"), any_of(F.array_join(fragments, " "), C.FRAGMENT_RULES).alias("together"), apart.alias("apart"))
