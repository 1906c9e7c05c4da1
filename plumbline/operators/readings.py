"""Readings of a sheet against each other: shifts, hypotheses and orientations, scored by what they explain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import near
from .ordered import first_by

Columns = Sequence[str]


def swept(left: DataFrame, right: DataFrame, on: Columns, a: str, b: str, most: int, reach: float, item: str, row: str, claims: Column, agrees: Column, reserved: Column) -> DataFrame:
    """The score of every whole shift o of the left positions, from -most to most, in each group `on`: how many left items
    have a right row within reach (pairs), how many of those claim something (chk), how many claims their nearest row
    agrees with (sat), and how many land on a reserved row. The smaller row wins ties.

    A group may be a document, a hypothesis about it, or one of its readings. Only shifts that bring a pair together are
    made; a shift without a pair has no row.
    """
    pairs = near.banded(left, right, on, a, b, float(most + reach))
    apart = F.col(b) - F.col(a)
    o = F.sequence(F.greatest(F.lit(-most), F.ceil(apart - reach).cast("int") - 1), F.least(F.lit(most), F.floor(apart + reach).cast("int") + 1))
    shifted = pairs.withColumn("o", F.explode(F.filter(o, lambda x: x.between(-most, most)))).withColumn("_d", F.abs(F.col(a) + F.col("o") - F.col(b))).filter(F.col("_d") <= reach)
    found = F.min(F.struct("_d", row, claims.alias("claims"), agrees.alias("agrees"), reserved.alias("reserved")))
    best = shifted.groupBy(*on, "_b", "o", item).agg(found.alias("m"))  # not shuffled again: `_b` is of the join
    count = lambda c: F.count(F.when(c, 1))
    claim = F.col("m.claims")
    return best.groupBy(*on, "o").agg(F.count(F.lit(1)).alias("pairs"), count(claim).alias("chk"), count(claim & F.col("m.agrees")).alias("sat"), count(F.col("m.reserved")).alias("reserved"))


def best_shift(scores: DataFrame, on: Columns) -> DataFrame:
    """The best shift of each group: most agreeing claims, fewest that disagree, fewest on reserved rows, most pairs, then the smallest."""
    return first_by(scores, on, [F.desc("sat"), F.col("chk") - F.col("sat"), "reserved", F.desc("pairs"), F.abs("o"), "o"])


def both_readings(rows: DataFrame, group: Columns, part: str, at: str, side: str) -> DataFrame:
    """rows with `reading`: 0 as they stand, 1 with the order of positions reversed within every part that has one side only.

    Which way such a part faces is no evidence; parts with both sides stay as they are. A group without a one-sided part
    has no second reading.
    """
    w = Window.partitionBy(*group, part)
    one = F.min(side).over(w) == F.max(side).over(w)
    facing = rows.withColumn("_one", one).withColumn("_turned", F.when(F.col("_one"), F.min(at).over(w) + F.max(at).over(w) - F.col(at)).otherwise(F.col(at)))
    facing = facing.withColumn("_any", F.max("_one").over(Window.partitionBy(*group)))
    each = F.array(F.struct(F.lit(0).alias("reading"), F.col(at).alias(at)), F.struct(F.lit(1).alias("reading"), F.col("_turned").alias(at)))
    kept = facing.withColumn("_r", F.explode(F.when(F.col("_any"), each).otherwise(F.slice(each, 1, 1))))
    return kept.drop(at, "_one", "_turned", "_any").select("*", "_r.*").drop("_r")


def arbitrated(best: DataFrame, group: Columns) -> DataFrame:
    """One reading of each group: the second only if it is strictly better by (sat, sat - chk), so that a tie turns nothing."""
    score = F.struct(F.col("sat"), F.col("sat") - F.col("chk"))
    rows = best.groupBy(*group).agg(F.max_by(F.struct(*best.columns), F.struct(score, -F.col("reading"))).alias("_b"))
    return rows.select("_b.*")


def ranked_fits(fits: DataFrame, document: Columns, hypothesis: str) -> DataFrame:
    """The hypotheses about each document by the share of claims that agree, then the number of claims, then name; without
    those that check nothing, which is no evidence either way."""
    w = Window.partitionBy(*document).orderBy(F.desc(F.col("sat") / F.col("chk")), F.desc("chk"), hypothesis)
    return fits.filter("chk > 0").withColumn("rank", F.row_number().over(w))
