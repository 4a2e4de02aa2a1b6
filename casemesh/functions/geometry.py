"""Box geometry as column arithmetic over ``x1, y1, x2, y2`` (integers, exclusive right and bottom)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")
CELL = 64


def side(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def area(p: str = "") -> Column:
    return (side(p, "x2") - side(p, "x1")) * (side(p, "y2") - side(p, "y1"))


def overlap(p: str, q: str) -> Column:
    zero = F.lit(0)
    wide = F.least(side(p, "x2"), side(q, "x2")) - F.greatest(side(p, "x1"), side(q, "x1"))
    high = F.least(side(p, "y2"), side(q, "y2")) - F.greatest(side(p, "y1"), side(q, "y1"))
    return F.greatest(zero, wide) * F.greatest(zero, high)


def iou(p: str, q: str) -> Column:
    shared = overlap(p, q)
    return F.when(shared > 0, shared / (area(p) + area(q) - shared)).otherwise(F.lit(0.0))


def containment(inner: str, outer: str) -> Column:
    """Share of the inner box that lies in the outer one."""
    return F.when(area(inner) > 0, overlap(inner, outer) / area(inner)).otherwise(F.lit(0.0))


def same_line(p: str, q: str) -> Column:
    """The boxes share more than half of the lower one's height."""
    shared = F.least(side(p, "y2"), side(q, "y2")) - F.greatest(side(p, "y1"), side(q, "y1"))
    lower = F.least(side(p, "y2") - side(p, "y1"), side(q, "y2") - side(q, "y1"))
    return shared > 0.5 * lower


def x_coverage(x1: Column, x2: Column, spans: Column) -> Column:
    """Share of ``[x1, x2]`` covered by the union of ``array<struct<s,e>>``."""

    def step(acc: Column, span: Column) -> Column:
        start, end = F.greatest(span["s"], acc["cursor"]), F.least(span["e"], x2)
        more = end > start
        return F.struct(F.when(more, acc["covered"] + (end - start)).otherwise(acc["covered"]).alias("covered"),
                        F.when(more, end).otherwise(acc["cursor"]).alias("cursor"))

    covered = F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0.0).alias("covered"), x1.cast("double").alias("cursor")),
        lambda acc, s: step(acc, F.struct(s["s"].cast("double").alias("s"), s["e"].cast("double").alias("e"))),
        lambda acc: acc["covered"])
    return F.when(x2 > x1, covered / (x2 - x1)).otherwise(F.lit(0.0))


def flatten(boxes: DataFrame) -> DataFrame:
    """Boxes with ``box array<int>`` as the four sides; malformed boxes get null sides."""
    ok = F.size("box") >= 4
    return boxes.select(*(c for c in boxes.columns if c != "box"), *(
        F.when(ok, F.try_element_at("box", F.lit(i + 1))).alias(s) for i, s in enumerate(SIDES)))


def _cells(boxes: DataFrame, prefix: str, cell: int) -> DataFrame:
    def spread(low: str, high: str) -> Column:
        return F.sequence(F.floor(side(prefix, low) / cell).cast("int"),
                          F.floor((side(prefix, high) - 1) / cell).cast("int"))

    solid = boxes.filter((side(prefix, "x2") > side(prefix, "x1")) & (side(prefix, "y2") > side(prefix, "y1")))
    by_x = solid.withColumn(f"{prefix}cx", F.explode(spread("x1", "x2")))
    return by_x.withColumn(f"{prefix}cy", F.explode(spread("y1", "y2")))


def touching(left: DataFrame, right: DataFrame, condition: Column, page: Sequence[str] = ("doc_id", "page"),
             how: str = "inner", cell: int = CELL) -> DataFrame:
    """Join boxes of one page that overlap, through a grid, so that only neighbours are ever compared.

    Columns are prefixed ``a_`` and ``b_``. An inner join meets each pair once, in the grid cell of the upper
    left corner of its overlap. A semi join gives the left rows that satisfy ``condition`` with some right row.
    """
    a = _cells(left.select(*(F.col(c).alias(f"a_{c}") for c in left.columns)), "a_", cell)
    b = _cells(right.select(*(F.col(c).alias(f"b_{c}") for c in right.columns)), "b_", cell)
    keys = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in (*page, "cx", "cy")]
    if how == "semi":
        hits = a.join(b, [*keys, condition], "left_semi")
        return hits.select(*(F.col(f"a_{c}").alias(c) for c in left.columns)).distinct()
    corner = ((F.floor(F.greatest("a_x1", "b_x1") / cell) == F.col("a_cx"))
              & (F.floor(F.greatest("a_y1", "b_y1") / cell) == F.col("a_cy")))
    return a.join(b, [*keys, corner, condition]).drop("a_cx", "a_cy", "b_cx", "b_cy")
