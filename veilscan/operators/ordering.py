"""Global order without a single-task window: range partitions, partition totals, carried boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.session import Stage, stage

PID, SEQ = "_pid", "_seq"


def ranged(df: DataFrame, keys: Sequence[str], name: str) -> Stage:
    """Rows with ``_pid`` (rising with the keys) and ``_seq`` (rising inside the partition).

    The range-partitioned, sorted rows are written before anything else reads them: range bounds come from a
    sample, so partition numbers must not be computed twice. No partition holds more than its range, whatever
    the skew of the first key, as long as the keys together are nearly unique.
    """
    rows = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumns({PID: F.shiftright("_at", 33).cast("int"), SEQ: F.col("_at").bitwiseAND((1 << 33) - 1)})
    return stage(rows.drop("_at"), name)


def with_running_sum(ordered: DataFrame, value: Column, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact running sum (inclusive) of ``value`` over ``ranged`` rows, restarting for each ``by`` group.

    Inside a partition a window frame; across partitions one offset per (partition, group) from a table of
    partition totals, whose size is partitions + groups because groups are contiguous in the order.
    """
    rows = ordered.withColumn("_v", value)
    totals = rows.groupBy(PID, *by).agg(F.sum("_v").alias("_total"))
    before = Window.partitionBy(*by).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = Window.partitionBy(PID, *by).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum("_v").over(inside))
    on = rows[PID] == offsets[PID]
    for b in by:
        on = on & rows[b].eqNullSafe(offsets[b])
    keep = [rows[c] for c in rows.columns if c not in ("_v", "_run")]
    return rows.join(offsets, on).select(*keep, (rows["_run"] + offsets["_off"]).alias(out))


def with_previous(ordered: DataFrame, group: str, column: str, out: str) -> DataFrame:
    """The value of ``column`` in the row before, within ``group``, over ``ranged`` rows.

    A partition's first row of a group takes the last row of the same group in an earlier partition.
    """
    inside = Window.partitionBy(PID, group).orderBy(SEQ)
    rows = ordered.withColumn(out, F.lag(column).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    last = ordered.groupBy(PID, group).agg(F.max_by(column, SEQ).alias("_last"))
    last = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(group).orderBy(PID))).drop("_last")
    on = (rows[PID] == last[PID]) & rows[group].eqNullSafe(last[group]) & rows["_first"]
    keep = [rows[c] for c in rows.columns if c not in (out, "_first")]
    return rows.join(last, on, "left").select(*keep, F.coalesce(rows[out], last["_carry"]).alias(out))
