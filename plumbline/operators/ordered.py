"""Operators along one coordinate: gaps, clusters, carried state, spans, holes, runs, ranks and folds.

Every function takes the group's columns and orders its rows by a total order that the caller gives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Columns = Sequence[str]


def within(group: Columns, order: Sequence[str | Column]):
    return Window.partitionBy(*group).orderBy(*order)


def consecutive_gap(df: DataFrame, group: Columns, at: str, tie: str, to: str = "gap") -> DataFrame:
    """Distance to the row before; null for the first."""
    return df.withColumn(to, F.col(at) - F.lag(at).over(within(group, [at, tie])))


def gap_clusters(df: DataFrame, group: Columns, at: str, tie: str, tolerance: float, to: str = "cluster") -> DataFrame:
    """Number the runs in which neighbours lie no further apart than tolerance."""
    w = within(group, [at, tie])
    new = F.when(F.col(at) - F.lag(at).over(w) > tolerance, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(to, F.sum("_new").over(w)).drop("_new")


def cluster_sizes(df: DataFrame, group: Columns, at: str, tie: str, tolerance: float) -> DataFrame:
    """cluster, n, low and high of every gap cluster."""
    return gap_clusters(df, group, at, tie, tolerance).groupBy(*group, "cluster").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("low"), F.max(at).alias("high"))


def dominant_cluster(df: DataFrame, group: Columns, at: str, tie: str, tolerance: float) -> DataFrame:
    """The largest gap cluster of each group, the lowest on ties."""
    return first_by(cluster_sizes(df, group, at, tie, tolerance), group, [F.desc("n"), "low"])


def least_spacing(df: DataFrame, group: Columns, at: str, low: float, high: float, default: float, digits: int = 2) -> DataFrame:
    """The least gap between distinct rounded positions that lies between low and high; default where none does."""
    d = df.select(*group, F.round(at, digits).alias("_p")).distinct()
    d = d.withColumn("_g", F.round(F.col("_p") - F.lag("_p").over(within(group, ["_p"])), digits))
    ok = F.when((F.col("_g") > low) & (F.col("_g") < high), F.col("_g"))
    return d.groupBy(*group).agg(F.coalesce(F.min(ok), F.lit(default)).alias("pitch"))


def carried(df: DataFrame, group: Columns, order: Columns, when: Column, value: Column, to: str, reset: Column | None = None) -> DataFrame:
    """Each row's latest value at which `when` held, up to and including it; a later reset row ends it."""
    w = within(group, order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(when, F.struct(value.alias("v")))
    if reset is not None:
        mark = F.when(reset, F.struct(F.lit(None).cast("string").alias("v"))).when(when, F.struct(value.cast("string").alias("v")))
    return df.withColumn("_m", mark).withColumn(to, F.last("_m", ignorenulls=True).over(w)["v"]).drop("_m")


def back_filled(df: DataFrame, group: Columns, order: Columns, value: Column, to: str) -> DataFrame:
    """The row's own value or the next one after it in its group."""
    w = within(group, order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("_v", value).withColumn(to, F.first("_v", ignorenulls=True).over(w)).drop("_v")


def toggled(df: DataFrame, group: Columns, order: Columns, mark: Column, to: str = "inside") -> DataFrame:
    """Whether an odd number of marks has occurred up to each row (fences that open and close)."""
    w = within(group, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_m", mark.cast("int")).withColumn(to, F.sum("_m").over(w) % 2 == 1).drop("_m")


def first_by(df: DataFrame, group: Columns, order: Sequence[str | Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in a total order."""
    return df.withColumn("_r", F.row_number().over(within(group, order))).filter(F.col("_r") <= n).drop("_r")


def ranked(df: DataFrame, group: Columns, order: Sequence[str | Column], to: str = "rank") -> DataFrame:
    return df.withColumn(to, F.row_number().over(within(group, order)))


def top_and_rest(df: DataFrame, group: Columns, order: Sequence[str | Column], n: int) -> DataFrame:
    """rank and whether a row is among the first n or in the reported remainder."""
    return ranked(df, group, order).withColumn("listed", F.col("rank") <= n)


def runner_up(df: DataFrame, group: Columns, distance: str, tie: str, ratio: float) -> DataFrame:
    """The nearest row of each group, decided only if the next one is at least ratio times as far."""
    w = within(group, [distance, tie])
    out = df.withColumn("_r", F.row_number().over(w)).withColumn("second", F.lead(distance).over(w)).filter("_r = 1").drop("_r")
    return out.withColumn("decided", F.col("second").isNull() | (F.col("second") >= ratio * F.col(distance)))


def voted(df: DataFrame, group: Columns, kind: str, token: str, index: str, order: Columns, least: int) -> DataFrame:
    """The kind of each group with the most distinct tokens (winner, votes), and the index that most of its rows state.

    A tie at the top, or fewer than `least` votes, is no winner (null). Of indexes stated equally often the one seen first
    in order counts; rows without one state nothing.
    """
    votes = df.groupBy(*group, kind).agg(F.count_distinct(token).alias("_n"))
    w = Window.partitionBy(*group).orderBy(F.desc("_n"), kind)
    top = votes.withColumn("_next", F.coalesce(F.lead("_n").over(w), F.lit(0))).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    won = (F.col("_n") >= least) & (F.col("_n") > F.col("_next"))
    stated = df.filter(F.col(index).isNotNull()).groupBy(*group, index).agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct(*order)).alias("_first"))
    most = first_by(stated, group, [F.desc("_c"), "_first"]).select(*group, index)
    return top.select(*group, F.when(won, F.col(kind)).alias("winner"), F.when(won, F.col("_n")).alias("votes")).join(most, list(group), "left")


def midpoint_spans(df: DataFrame, group: Columns, at: str, single: float) -> DataFrame:
    """Half-open spans that meet midway between neighbouring anchors; the outer ends lie half the median distance away, and
    half of `single` around an anchor that is alone."""
    w = within(group, [at])
    a = F.col(at)
    gaps = df.withColumn("_g", a - F.lag(at).over(w)).groupBy(*group).agg(F.median("_g").alias("_p"))
    half = F.coalesce("_p", F.lit(single)) / 2
    out = df.join(gaps, list(group))
    return out.withColumn("lo", F.coalesce((F.lag(at).over(w) + a) / 2, a - half)).withColumn("hi", F.coalesce((F.lead(at).over(w) + a) / 2, a + half)).drop("_p")


def hole_slots(df: DataFrame, group: Columns, at: str, pitch: float) -> DataFrame:
    """The positions missing from a grid: multiples of pitch between neighbours that lie further apart."""
    w = within(group, [at])
    steps = F.round((F.lead(at).over(w) - F.col(at)) / pitch).cast("int")
    d = df.withColumn("_n", steps).filter("_n > 1")
    return d.select(*group, F.explode(F.transform(F.sequence(F.lit(1), F.col("_n") - 1), lambda i: F.col(at) + i * pitch)).alias("slot"))


def run_to_break(df: DataFrame, group: Columns, order: Columns, at: str, best: Column, most: float) -> DataFrame:
    """The rows of each group that a walk outward from its best row, both ways, reaches before a step above most.

    best holds for one row of a group; a group without one keeps nothing.
    """
    w = within(group, order)
    step = F.coalesce((F.col(at) - F.lag(at).over(w) > most).cast("int"), F.lit(0))
    run = df.withColumn("_b", best).withColumn("_s", step).withColumn("_run", F.sum("_s").over(w))
    own = F.max(F.when(F.col("_b"), F.col("_run"))).over(Window.partitionBy(*group))
    return run.withColumn("_own", own).filter("_run = _own").drop("_b", "_s", "_run", "_own")


def thinned(df: DataFrame, group: Columns, at: str, least: float) -> DataFrame:
    """Positions at least `least` from the one kept before them (what is dropped anchors nothing): group, at.

    A gap of `least` or more parts what can influence each other, so each such cluster begins anew. Within one the next
    kept position depends on the last, which is all that a task remembers while it passes over the sorted positions; no
    group is gathered. `least` is above zero, so repeated positions count once; null positions are left out.
    """
    each = df.select(*group, F.col(at).cast("double").alias(at)).filter(F.col(at).isNotNull())
    gap = F.col(at) - F.lag(at).over(within(group, [at]))
    sorted_ = each.withColumn("_new", F.coalesce(gap >= least, F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = -math.inf
        for batch in batches:
            x = batch.column(batch.schema.get_field_index(at)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)).tolist()
            keep = []
            for k, (begin, end) in enumerate(zip([0, *starts], [*starts, len(x)], strict=True)):
                last, i = -math.inf if k else last, begin  # the first stretch goes on with the cluster of the batch before
                while i < end:
                    i += int(np.searchsorted(x[i:end], last + least))
                    while i > begin and x[i - 1] - last >= least:  # the sum may round otherwise than the difference
                        i -= 1
                    while i < end and x[i] - last < least:
                        i += 1
                    if i < end:
                        keep.append(i)
                        last = float(x[i])
            yield batch.select(range(batch.num_columns - 1)).take(pa.array(keep, pa.int64()))

    return sorted_.mapInArrow(run, each.schema)


def numbered(df: DataFrame, group: Columns, order: Columns, eligible: Column, ceiling: Column, to: str = "number") -> DataFrame:
    """Number the eligible rows from 0 up to a ceiling; -1 for all others, with the reason."""
    w = within([*group, "_e"], order)
    d = df.withColumn("_e", eligible).withColumn("_n", F.row_number().over(w) - 1)
    ok = F.col("_e") & (F.col("_n") < ceiling)
    reason = F.when(~F.col("_e"), "not eligible").when(~ok, "beyond the ceiling")
    return d.withColumn(to, F.when(ok, F.col("_n")).otherwise(-1)).withColumn("reason", reason).drop("_e", "_n")


def stitched(df: DataFrame, group: Columns, at: str, end: str, tie: str, token: str, reach: float, stop: Column) -> DataFrame:
    """Join tokens of a line to their right neighbour while it begins within reach, up to and including one at which stop holds.

    Each chain has its tokens joined, the number of pieces, and the box from the first piece's begin to the last one's end.
    """
    w = within(group, [at, tie])
    broken = (F.col(at) - F.lag(end).over(w) > reach) | F.lag("_stop").over(w)
    chained = df.withColumn("_stop", stop).withColumn("_new", F.coalesce(broken.cast("int"), F.lit(0))).withColumn("chain", F.sum("_new").over(w))
    items = F.sort_array(F.collect_list(F.struct(at, tie, token)))
    return chained.groupBy(*group, "chain").agg(F.array_join(F.transform(items, lambda s: s[token]), "").alias("joined"), F.count(F.lit(1)).alias("pieces"), F.min(at).alias("x0"), F.max(end).alias("x1"))


def adopted(edge: DataFrame, spare: DataFrame, group: Columns, at: str, across: str, key: str, least: float, width: float, share: float) -> DataFrame:
    """Rows of spare that fill the holes of an edge: group, slot, key.

    The pitch of an edge of three rows or more is its least distance above `least`; a distance of n pitches between
    neighbours has n - 1 slots. A slot takes the nearest spare row (then the least key) within share of a pitch that lies
    no more than width off the edge's median; a spare row goes to its first slot. Slots of a pitch lie further apart than
    twice that share, so no spare row is wanted by two of them.
    """
    own = within(group, [at, key])
    gaps = edge.withColumn("_n", F.lead(at).over(own) - F.col(at))
    shape = gaps.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"), F.min(F.when(F.col("_n") > least, F.col("_n"))).alias("_p"), F.median(across).alias("_a")).filter("_rows >= 3 AND _p IS NOT NULL")
    holes = gaps.join(shape, list(group)).withColumn("_k", F.bround(F.col("_n") / F.col("_p"), 0).cast("int")).filter("_k > 1")
    slots = holes.select(*group, "_p", "_a", F.explode(F.transform(F.sequence(F.lit(1), F.col("_k") - 1), lambda i: F.col(at) + i * F.col("_p"))).alias("slot"))
    # both sides in buckets of the group's own pitch
    wanted = slots.withColumn("_b", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.floor(F.col("slot") / F.col("_p")) + i)))
    offered = spare.select(*group, key, F.col(at).alias("_at"), F.col(across).alias("_off")).join(shape.select(*group, F.col("_p").alias("_q")), list(group)).withColumn("_b", F.floor(F.col("_at") / F.col("_q"))).drop("_q")
    d = F.abs(F.col("_at") - F.col("slot"))
    near = wanted.join(offered, [*group, "_b"]).filter((d <= F.col("_p") * share) & (F.abs(F.col("_off") - F.col("_a")) <= width)).withColumn("_d", d)
    best = first_by(near, [*group, "slot"], ["_d", key])
    return first_by(best, [*group, key], ["slot"]).select(*group, "slot", key)
