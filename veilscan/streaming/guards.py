"""Streams: the text scan on arriving items, trailing limits by event time, fragment sessions with kept state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilscan.functions import catalog as C
from veilscan.operators import scan

FRAGMENT_OUT = "session string, n_seen bigint, rules int"


def stream_findings(items: DataFrame) -> DataFrame:
    """Findings of a stream of (kind, id, text): stateless, so the batch expressions serve as they are."""
    return scan.findings(items)


def stream_rates(events: DataFrame, key: str, ts: str, most: int, seconds: int = 60, late: str = "60 seconds") -> DataFrame:
    """(key, window start, n, limited) per window of ``seconds`` that slides by a quarter of it; later events than ``late`` fall away."""
    width, slide = f"{seconds} seconds", f"{max(1, seconds // 4)} seconds"
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, width, slide), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("window.start").alias("start"), "n", (F.col("n") > most).alias("limited"))


def fragment_guard(fragments: DataFrame, keep: int = 50, idle: str | None = None) -> DataFrame:
    """Per session the last ``keep`` fragments are joined and tested at each micro-batch.

    ``fragments`` has session, seq and text; within a micro-batch they are taken in the order of seq. With ``idle`` (such as
    "10 minutes" of processing time) sessions without news are forgotten; the stream then runs empty micro-batches to see
    time pass, so it never counts as drained. Without it state is kept, at most ``keep`` texts a session.
    """
    import re

    rules = [re.compile(p) for p in C.FRAGMENT_RULES]
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, kept = state.get if state.exists else (0, [])
        new = pd.concat(list(batches)).sort_values("seq")
        kept = [*kept, *[t for t in new["text"] if isinstance(t, str)]][-keep:]
        n += len(new)
        state.update((n, kept))
        if wait:
            state.setTimeoutDuration(wait)
        joined = " ".join(kept)
        yield pd.DataFrame({"session": [key[0]], "n_seen": [n], "rules": [sum(bool(r.search(joined)) for r in rules)]})

    return fragments.filter("session IS NOT NULL").groupBy("session").applyInPandasWithState(step, FRAGMENT_OUT, "n bigint, kept array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)
