"""Previous row and row number by a numeric order, without ever sorting one key in one task.

The order column is cut into ranges of ``2**bits`` values. Each range is handled on its own; one summary row
per range carries the rest, so a key holding a third of the table is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_BITS = 16


def _range_of(order: str | Column, bits: int) -> Column:
    return F.shiftright((F.col(order) if isinstance(order, str) else order).cast("long"), bits)


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join on same-named columns, nulls matching nulls, keeping the left side's copy."""
    renamed = right.select(*(F.col(c).alias(f"_j_{c}") if c in on else F.col(c) for c in right.columns))
    condition = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_j_{c}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*(f"_j_{c}" for c in on))


def _carry(last: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """For each range the payload of the last earlier range of the same key, through one more level."""
    wide = last.withColumn("_wide", _range_of("_range", bits))
    within = Window.partitionBy(*keys, "_wide").orderBy("_range")
    tops = wide.groupBy(*keys, "_wide").agg(F.max_by("_last", "_range").alias("_top"))
    # One row per 2**(2 * bits) values is left here; the sign bit stands in for "no further key".
    across = Window.partitionBy(*keys, _range_of("_wide", 63)).orderBy("_wide")
    tops = tops.withColumn("_top", F.lag("_top").over(across))
    near = wide.withColumn("_near", F.lag("_last").over(within))
    joined = join_null_safe(near, tops, [*keys, "_wide"])
    return joined.select(*keys, "_range", F.coalesce("_near", "_top").alias("_before"))


def previous_row(df: DataFrame, order: str, cols: Sequence[str], keys: Sequence[str] = (),
                 bits: int = RANGE_BITS) -> DataFrame:
    """Append ``previous_<col>`` from the preceding existing row of the same key, by ``order``."""
    keys = list(keys)
    payload = F.struct(*cols)
    ranged = df.withColumn("_range", _range_of(order, bits))
    near = ranged.withColumn("_near", F.lag(payload).over(Window.partitionBy(*keys, "_range").orderBy(order)))
    last = ranged.groupBy(*keys, "_range").agg(F.max_by(payload, F.col(order)).alias("_last"))
    joined = join_null_safe(near, _carry(last, keys, bits), [*keys, "_range"])
    before = F.coalesce("_near", "_before")
    return joined.select(*df.columns, *(before[c].alias(f"previous_{c}") for c in cols))


def number_rows(df: DataFrame, order: str, keys: Sequence[str], out: str = "row_number",
                bits: int = RANGE_BITS) -> DataFrame:
    """Append the 1-based position of each row within its key, by a unique numeric ``order``."""
    keys = list(keys)
    ranged = df.withColumn("_range", _range_of(order, bits))
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)))
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_range", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_o"))
    joined = join_null_safe(local, offsets, [*keys, "_range"])
    return joined.select(*df.columns, (F.col("_n") + F.col("_o")).alias(out))
