"""Sliding-window limits over event tables."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemesh.operators.ordered import ordered_scan
from casemesh.operators.sequence import RANGE_BITS, join_null_safe, previous_row
from casemesh.session import cut_lineage

HOUR_MICROS = 3_600_000_000


def window_counts(events: DataFrame, key: str, seconds: int, ts: str = "ts", order: str = "seq") -> DataFrame:
    """Append ``in_window``: events of the key in the ``seconds`` up to and including each event.

    An upper bound for the limiter, which does not count refused events. Keys are cut into stretches of time;
    each stretch also sees the last ``seconds`` of the one before it.
    """
    span = max(HOUR_MICROS, seconds * 1_000_000)
    micros = F.unix_micros(ts)
    cut = events.withColumn("_t", micros).withColumn("_stretch", F.floor(F.col("_t") / span).cast("long"))
    tail = cut.filter(F.col("_t") % span >= span - seconds * 1_000_000).select(
        key, "_t", (F.col("_stretch") + 1).alias("_stretch"))
    both = cut.withColumn("_own", F.lit(True)).unionByName(tail, allowMissingColumns=True)
    frame = Window.partitionBy(key, "_stretch").orderBy("_t").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return both.withColumn("in_window", F.count(F.lit(1)).over(frame)).filter("_own").select(
        *events.columns, "in_window")


def _quiet_segments(events: DataFrame, key: str, seconds: int, ts: str, order: str) -> DataFrame:
    """Append ``_segment``: a new one starts where the key was silent for the whole window.

    Nothing before such a pause can matter, so segments are independent.
    """
    near = previous_row(events.withColumn("_t", F.unix_micros(ts)), order, ["_t"], [key])
    fresh = F.col("previous__t").isNull() | (F.col("_t") - F.col("previous__t") >= seconds * 1_000_000)
    marked = cut_lineage(near.withColumn("_mark", F.when(fresh, F.col(order)))).withColumn(
        "_range", F.shiftright(F.col(order).cast("long"), RANGE_BITS))
    upto = Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("_local", F.last("_mark", ignorenulls=True).over(upto))
    tops = marked.groupBy(key, "_range").agg(F.max("_mark").alias("_top"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(key, "_range", F.max("_top").over(earlier).alias("_before"))
    joined = join_null_safe(local, carried, [key, "_range"])
    return joined.withColumn("_segment", F.coalesce("_local", "_before"))


def rate_verdicts(events: DataFrame, key: str, limit: int, seconds: int, ts: str = "ts", order: str = "seq",
                  clears: str | None = None) -> DataFrame:
    """``(key, order, ts, allowed, retry_after)`` where only allowed events count against the limit.

    With ``clears``, an allowed event for which that column is true is not counted and forgets the key's
    history (a successful sign-in). State per segment is the times of at most ``limit`` events.
    """
    needed = events.select(key, order, ts, (F.col(clears) if clears else F.lit(False)).alias("_wipe"))
    slim = _quiet_segments(needed, key, seconds, ts, order).select(
        F.col(key).alias("k"), F.col("_segment").alias("segment"), F.col(order).cast("long").alias("o"),
        F.col("_t").alias("t"), F.col("_wipe").alias("wipe"))
    window = seconds * 1_000_000

    def step(seen: deque, row):
        while seen and seen[0] <= row.t - window:
            seen.popleft()
        if len(seen) >= limit:
            wait = max(1, int((seen[0] + window - row.t) / 1e6) + 1)
            return seen, [(row.k, row.o, row.t, False, wait)]
        if row.wipe:
            seen.clear()
        else:
            seen.append(row.t)
        return seen, [(row.k, row.o, row.t, True, None)]

    kt = events.schema[key].dataType.simpleString()
    done = ordered_scan(slim, ["k", "segment"], ["o"], lambda row: deque(), step,
                        f"k {kt}, o BIGINT, t BIGINT, allowed BOOLEAN, retry_after INT")
    return done.select(F.col("k").alias(key), F.col("o").alias(order), F.timestamp_micros("t").alias(ts),
                       "allowed", "retry_after")
