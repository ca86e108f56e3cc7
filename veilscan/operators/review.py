"""Review of what an agent puts up for approval: pace of approvals, density, actions that do not fit the task, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions import catalog as C
from veilscan.operators.scan import count_of


def approval_fatigue(sessions: DataFrame, approvals: str, minutes: str) -> DataFrame:
    """Adds ``rate`` (a minute, of one minute at least) and ``fatigue``: high above two a minute from ten approvals on, else medium from twenty
    where no time is known. Nulls count as none."""
    n, m = F.coalesce(F.col(approvals), F.lit(0)), F.coalesce(F.col(minutes).cast("double"), F.lit(0.0))
    rate = F.when(m > 0, n / F.greatest(m, F.lit(1.0))).otherwise(0.0)
    fatigue = F.when((n >= 10) & (m > 0), F.when(rate > 2, "high")).when(n >= 20, "medium")
    return sessions.withColumns({"rate": F.round(rate, 6), "fatigue": F.coalesce(fatigue, F.lit("none"))})


def complexity(text: Column) -> Column:
    """0 to 1 from the share of jargon and the mean lengths of words and sentences; 0 under ten words."""
    n = count_of(text, r"\S+")
    letters = F.length(F.regexp_replace(text, r"\s+", ""))
    sentences = F.greatest(F.size(F.filter(F.split(text, "[.!?]+"), lambda s: s.rlike(r"\S"))), F.lit(1))
    score = count_of(text, C.JARGON) / n * 5 + F.greatest(letters / n - 5, F.lit(0.0)) * 0.2 + F.greatest(n / sentences - 20, F.lit(0.0)) * 0.02
    return F.when(n >= 10, F.least(score, F.lit(1.0))).otherwise(0.0)


def task_complexity(task: Column) -> Column:
    n = count_of(task, r"\S+")
    return F.when(n > 3, F.least(count_of(task, C.JARGON) / n * 5, F.lit(1.0)))


def review(outputs: DataFrame, key: str, output: str, task: str, actions: str) -> DataFrame:
    """(key, complexity, camouflaged, mismatches, conflicts, n_links, bad_links, risk) of each output put up for approval.

    camouflaged: much denser than its task, or dense in itself. mismatches: distinct proposed actions (an array) that change, send or run
    something where the task only reads. conflicts: pairs of actions that do not go together. bad_links: shortened or cheap domains.
    risk is high with a mismatch, medium with any other sign, else low. A null output is empty text, null tasks and actions are none.
    """
    text, what = F.coalesce(output, F.lit("")), F.lower(F.coalesce(task, F.lit("")))
    each = F.array_distinct(F.transform(F.array_compact(F.coalesce(actions, F.array().cast("array<string>"))), lambda a: F.lower(a)))
    holds = lambda a, ws: sum((a.contains(w).cast("int") for w in ws), F.lit(0)) > 0
    unfit = sum((_matching(each, words) for words in C.UNFIT_ACTIONS.values()), F.lit(0))
    pairs = sum((((_matching(each, (a,)) > 0) & (_matching(each, (b,)) > 0)).cast("int") for a, b in C.CONFLICTS), F.lit(0))
    links = F.regexp_extract_all(text, F.lit(C.LINK), F.lit(0))
    rows = outputs.select(
        F.col(key), complexity(text).alias("c"), task_complexity(what).alias("t"), F.when(holds(what, C.READING), unfit).otherwise(0).cast("bigint").alias("mismatches"), pairs.cast("bigint").alias("conflicts"),
        F.size(links).cast("bigint").alias("n_links"), F.size(F.filter(links, lambda x: x.rlike(C.SHORTENED))).cast("bigint").alias("bad_links"),
    )
    rows = rows.withColumn("camouflaged", (F.col("c") > 0.7) | F.coalesce(F.col("c") - F.col("t") > 0.4, F.lit(False)))
    risk = F.when(F.col("mismatches") > 0, "high").when(F.col("camouflaged") | (F.col("conflicts") > 0) | (F.col("bad_links") > 0), "medium").otherwise("low")
    return rows.select(key, F.round("c", 6).alias("complexity"), "camouflaged", "mismatches", "conflicts", "n_links", "bad_links", risk.alias("risk"))


def _matching(actions: Column, words: tuple[str, ...]) -> Column:
    """How many of the actions hold one of the words."""
    return F.size(F.filter(actions, lambda a: sum((a.contains(w).cast("int") for w in words), F.lit(0)) > 0))
