"""Joins by nearness. Spark does not accelerate range joins, so both sides are dealt into buckets as wide as the
tolerance; one side is repeated in the neighbouring buckets and the exact condition follows the equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(value: str | Column, width: float) -> Column:
    return F.floor((F.col(value) if isinstance(value, str) else value) / width)


def banded(left: DataFrame, right: DataFrame, on: Sequence[str], a: str, b: str, tolerance: float) -> DataFrame:
    """band_join with the left row's bucket, `_b`: all pairs of a left row lie in one, so they are grouped by `on` and `_b`, too,
    where they met."""
    one = left.withColumn("_b", bucket(a, tolerance))
    spread = F.explode(F.array(*(bucket(b, tolerance) + i for i in (-1, 0, 1))))
    return one.join(right.withColumn("_b", spread), [*on, "_b"]).filter(F.abs(F.col(a) - F.col(b)) <= tolerance)


def band_join(left: DataFrame, right: DataFrame, on: Sequence[str], a: str, b: str, tolerance: float) -> DataFrame:
    """Pairs with equal `on` whose a and b differ by no more than tolerance."""
    return banded(left, right, on, a, b, tolerance).drop("_b")


def radius_join(left: DataFrame, right: DataFrame, on: Sequence[str], a: tuple[str, str], b: tuple[str, str], radius: float) -> DataFrame:
    """Pairs with equal `on` no further apart than radius (Euclidean), with their distance."""
    one = left.withColumn("_bx", bucket(a[0], radius)).withColumn("_by", bucket(a[1], radius))
    for c, v in (("_bx", b[0]), ("_by", b[1])):
        right = right.withColumn(c, F.explode(F.array(*(bucket(v, radius) + i for i in (-1, 0, 1)))))
    d = F.hypot(F.col(a[0]) - F.col(b[0]), F.col(a[1]) - F.col(b[1]))
    return one.join(right, [*on, "_bx", "_by"]).drop("_bx", "_by").withColumn("distance", d).filter(F.col("distance") <= radius)


def nearest(pairs: DataFrame, key: Sequence[str], distance: Column, tie: Sequence[str | Column]) -> DataFrame:
    """The pair of least distance for each key, ties by a total order."""
    w = Window.partitionBy(*key).orderBy("distance", *tie)
    return pairs.withColumn("distance", distance).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def nearest_within(left: DataFrame, right: DataFrame, on: Sequence[str], a: str, b: str, tolerance: float, key: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """For each left row the nearest right row along one axis, if any lies within tolerance."""
    return nearest(band_join(left, right, on, a, b, tolerance), key, F.abs(F.col(a) - F.col(b)), tie)


def in_box(points: DataFrame, boxes: DataFrame, on: Sequence[str], x: str, y: str, width: float) -> DataFrame:
    """Points inside boxes (x0, x1, y0, y1) of at most `width` along x."""
    p = points.withColumn("_b", bucket(x, width))
    spread = F.explode(F.sequence(bucket("x0", width), bucket("x1", width)))
    inside = F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1"))
    return p.join(boxes.withColumn("_b", spread), [*on, "_b"]).drop("_b").filter(inside)


def box_gap(a: str, b: str) -> Column:
    """Distance between two boxes whose columns carry the prefixes a and b; 0 where they touch or overlap."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.col(f"{a}{lo}") - F.col(f"{b}{hi}"), F.col(f"{b}{lo}") - F.col(f"{a}{hi}"))
    return F.hypot(side("x0", "x1"), side("y0", "y1"))


def box_pairs(boxes: DataFrame, on: Sequence[str], key: str, reach: float, width: float) -> DataFrame:
    """Pairs of boxes (each once, by key) whose gap is at most reach; width is the widest box along x."""
    step = width + reach
    a = boxes.select(*on, *(F.col(c).alias(f"a_{c}") for c in (key, "x0", "x1", "y0", "y1"))).withColumn("_b", bucket("a_x0", step))
    b = boxes.select(*on, *(F.col(c).alias(f"b_{c}") for c in (key, "x0", "x1", "y0", "y1")))
    b = b.withColumn("_b", F.explode(F.array(*(bucket("b_x0", step) + i for i in (-1, 0, 1)))))
    pairs = a.join(b, [*on, "_b"]).drop("_b").filter(F.col(f"a_{key}") < F.col(f"b_{key}"))
    return pairs.withColumn("gap", box_gap("a_", "b_")).filter(F.col("gap") <= reach)


def overlap_share(a: str, b: str) -> Column:
    """Overlap of two spans along y as a share of the shorter."""
    shared = F.least(F.col(f"{a}y1"), F.col(f"{b}y1")) - F.greatest(F.col(f"{a}y0"), F.col(f"{b}y0"))
    return F.greatest(F.lit(0.0), shared) / F.least(F.col(f"{a}y1") - F.col(f"{a}y0"), F.col(f"{b}y1") - F.col(f"{b}y0"))


def in_spans(points: DataFrame, spans: DataFrame, on: Sequence[str], at: str) -> DataFrame:
    """Points with the anchor (span_<at>) of the half-open span (lo, hi) that holds them; spans of a group don't overlap.

    Points and spans are sorted together, and each point looks at the last span that began: no range join, whatever the
    widths.
    """
    a = spans.select(*on, F.col("lo").alias("_x"), F.lit(0).alias("_k"), F.struct(F.col(at).alias("a"), "hi").alias("_s"))
    b = points.select(*on, F.col(at).alias("_x"), F.lit(1).alias("_k"), F.struct(*points.columns).alias("_p"))
    w = Window.partitionBy(*on).orderBy("_x", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_s", F.last("_s", ignorenulls=True).over(w))
    return both.filter((F.col("_k") == 1) & (F.col("_x") < F.col("_s.hi"))).select("_p.*", F.col("_s.a").alias(f"span_{at}"))
